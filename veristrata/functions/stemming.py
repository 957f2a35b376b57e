"""English stems (the published Porter2 rules) and stop words for full-text lexemes.

Words are stemmed once each: the distinct words of a table go through the UDF, and rows take their stems by a join."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stop words of the English text-search configuration.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Fixed values of the rules: words with stems of their own, words left as they are, endings by step.
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
_KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_SECOND = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_VOWELS = frozenset("aeiouy")
_DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS and word[-1] not in "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of one lower-case word; words of other letters than a to z stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in _OWN or word in _KEPT:
        return _OWN.get(word, word)
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0)
    r2 = _region(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_LATER:
        return w
    # past forms and gerunds
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if end.startswith("eed"):
        if len(w) - len(end) >= r1:
            w = w[: len(w) - len(end)] + "ee"
    elif end and any(c in _VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in _DOUBLES:
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # derived forms, the longest ending first
    end = next((e for e in sorted(_SECOND, key=len, reverse=True) if w.endswith(e)), "")
    if end:
        if len(w) - len(end) >= r1:
            w = w[: len(w) - len(end)] + _SECOND[end]
    elif w.endswith("ogi"):
        if len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
        w = w[:-2]
    end = next((e for e in sorted(_THIRD, key=len, reverse=True) if w.endswith(e)), "")
    if end:
        if len(w) - len(end) >= r1:
            w = w[: len(w) - len(end)] + _THIRD[end]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    end = next((e for e in _FOURTH if w.endswith(e)), "")
    if end:
        if len(w) - len(end) >= r2:
            w = w[: len(w) - len(end)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexeme(word: str) -> str | None:
    """What the English configuration keeps of a lower-case word: its stem, nothing of a stop word."""
    return None if word in STOP_WORDS else stem(word)


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_postings(posts: DataFrame, key: str) -> DataFrame:
    """Postings (``key, lexeme, weight, hits``) by stem: stop words go, the hits of one stem's words add up."""
    kept = posts.where(~F.col("lexeme").isin(*sorted(STOP_WORDS)))
    known = kept.select("lexeme").distinct().withColumn("stem", stems("lexeme"))
    return kept.join(known, "lexeme").groupBy(key, F.col("stem").alias("lexeme"), "weight").agg(F.sum("hits").alias("hits"))
