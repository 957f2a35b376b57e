"""Repeated ids, many languages, ties, added tokens, hot ids and very long texts of the model and token operators."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from veristrata.llm import bpe, language_id, pu_quality, simhash, tokenfile

SF = "/root/testdata/sf0.001"
LONG = "The plain words of a very long text go on and on, é and ü too. " * 50_000


def test_repeated_ids_train_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    once, often = pu_quality.train(docs, labels), pu_quality.train(docs.unionAll(docs).unionAll(docs), labels.unionAll(labels))
    assert once["prior"] == often["prior"] and np.allclose(once["mean"], often["mean"]) and np.isclose(once["a"], often["a"])
    texts = [(r.text or "").encode() for r in docs.collect()]
    assert np.allclose(pu_quality.score_texts(once, texts), pu_quality.score_texts(often, texts))


def test_threshold_is_inclusive_and_long_text(spark):
    docs = spark.createDataFrame([(1, LONG, "x"), (2, "", "y"), (2, None, "z")], "doc_id long, text string, held_out string")
    got = {(r.doc_id, r.score, r.predicted) for r in pu_quality.score(docs, None, threshold=0.5).collect()}
    assert got == {(1, 0.5, 1), (2, 0.5, 1)}


def test_sixty_unknown_codes(spark):
    r = np.random.default_rng(1)
    alphabets = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)) for _ in range(60)]
    word = lambda a: "".join(r.choice(list(a), int(r.integers(3, 8))))
    rows = [(i * 60 + k, " ".join(word(a) for _ in range(30)), f"x{k:02d}") for k, a in enumerate(alphabets) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, limit=600)
    assert len(model.machines) == 60 * 59 // 2
    assert sum(at.nbytes + value.nbytes for at, value, _ in model.machines) < 60_000_000
    held = [g for g in language_id.identify(docs, model).collect() if g.held_out]
    assert np.mean([g.lang_pred == f"x{g.doc_id % 60:02d}" for g in held]) > 0.8


def test_equal_votes_and_long_text(spark):
    rows = [(i, "abc abd", "aa" if i % 2 else "bb") for i in range(40)]  # one text, two languages: no margin at all
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert {g.lang_pred for g in language_id.identify(docs, model).collect()} <= {"aa", "bb"}
    clash = spark.createDataFrame([(1, LONG, "q", 3), (None, LONG, "q", 3)], "doc_id long, text string, score string, lang_pred int")
    assert language_id.identify(clash, model).count() == 2


def test_added_tokens_as_the_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "none here", *[f"x {t} y{t}" for t in added[:5]], LONG]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, n_tokens int")
    rows = tokenfile.read_token_files(spark, tokenfile.write_token_files(docs, path, f"file://{tmp_path}/a"), with_ids=True).collect()
    want = {i: [*library.encode(t, add_special_tokens=False).ids, tokenfile.END_ID] for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in rows} == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()) for r in rows)


def test_a_hot_id_spreads_over_files(spark, tmp_path):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text for all").alias("text")).repartition(4)
    manifest = tokenfile.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/hot")
    assert sum(m.n_docs for m in manifest) == 4000 and max(m.n_docs for m in manifest) < 2500


def test_long_pieces_and_long_texts(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.tokenizer(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ids, special_tokens={})
    texts = ["z" * 511, "abc" * 400, "é" * 2000, "q" * 20_000, LONG]
    rows = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_long_text_fingerprint():
    assert simhash.fingerprint(LONG) == simhash.fingerprint(LONG.upper().replace("É", "é").replace("Ü", "ü"))
