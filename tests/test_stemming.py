"""Stems by the published rules, and postings by stem."""

import pytest
from veristrata.functions.stemming import STOP_WORDS, stem, stem_postings
from veristrata.operators import ranking

PAIRS = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consolation consol|consolations consol|consolatory consolatori|console consol
consolidate consolid|consolingly consol|consonant conson|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|constable constabl|constancy constanc|knack knack|knackeries knackeri|knavish knavish|knees knee|knell knell|knight knight|knightly knight|knots knot
caresses caress|ties tie|cries cri|gas gas|gaps gap|kiwis kiwi|agreed agre|feed feed|hopping hop|hoping hope|happy happi|enjoy enjoy|relational relat|conditional condit|generate generat|general general|communism communism|rate rate|falling fall|skies sky|dying die|news news|inning inning|proceed proceed|sensational sensat|traditional tradit|hopefulness hope|sized size|luxuriated luxuri|by by"""


@pytest.mark.parametrize("pair", PAIRS.replace("\n", "|").split("|"))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_postings_by_stem(spark):
    docs = spark.createDataFrame([(1, "hopping and hopped the hop"), (2, "hope été")], "k long, t string")
    rows = {(r.k, r.lexeme): r.hits for r in stem_postings(ranking.postings(docs, "k", {"D": "t"}), "k").collect()}
    assert rows == {(1, "hop"): 3, (2, "hope"): 1, (2, "été"): 1} and "the" in STOP_WORDS
