"""Tokenizers and token files against the public libraries, exact round trips, damaged files."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from veristrata.llm import bpe, tokenfile

ODD = ["", " ", "  a  b", "a  b\n\n c", " x", "x ", "\t tab  \n", "don't we'll", "a b  c", "ab" * 900 + "  z", "日本語 テスト 🎉🎉 ok", "\x1c a \x1d b", "x" * 600, "\n", "a \n b", "<|endoftext|> a <|endoftext|>", "The the the. The"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    own = bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ids, special_tokens={})


def _encoded(own, texts):
    ids, counts = own.encode(texts)
    return [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]


def test_same_ids_as_the_library(library):
    own, other = library
    texts = [*ODD, *ODD]
    assert _encoded(own, texts) == [other.encode_ordinary(t) for t in texts]
    own.cache.limit, kept = 5, own.cache.limit
    for t in texts:  # generations of the cache turn over all the time
        assert _encoded(own, [t]) == [other.encode_ordinary(t)]
    own.cache.limit = kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab E.,'!3é\n\t 日")), max_size=40), min_size=1, max_size=4))
def test_any_text(texts):
    import tiktoken

    own = bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ids, special_tokens={})
    assert _encoded(own, texts) == [other.encode_ordinary(t) for t in texts]
    assert [own.decode(np.array(i, np.uint32)).decode() for i in _encoded(own, texts)] == texts


def test_pair_table_finds_every_pair(library):
    own, _ = library
    pairs = list(own.pairs.items())[::37]
    left, right = np.array([p[0][0] for p in pairs]), np.array([p[0][1] for p in pairs])
    assert own.table.find(left, right).tolist() == [p[1] for p in pairs]
    assert own.table.find(np.array([50255]), np.array([50255]))[0] == own.pairs.get((50255, 50255), 2**31 - 1)


def _docs(spark):
    rows = [(i, t, f"x{i}") for i, t in enumerate(ODD)] + [(None, "no id", "y"), (8, ODD[8], "again"), (8, ODD[8], "again"), (99, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")


def test_documents(spark, library):
    _, other = library
    rows = bpe.encode_documents(_docs(spark), RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(ODD) + 4
    by_id = {r.doc_id: r for r in rows}
    for i, text in [*enumerate(ODD), (99, "")]:
        ids = np.array(other.encode_ordinary(text), "<u4").tobytes()
        assert (by_id[i].n_tokens, by_id[i].ids_sha256, by_id[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert bytes(by_id[i].ids) == ids
    assert bpe.encode_documents(_docs(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    assert other.encode("a <|endoftext|> b", add_special_tokens=False).ids != other.encode("a <|endoftext |> b", add_special_tokens=False).ids
    manifest = tokenfile.write_token_files(_docs(spark), path, f"file://{tmp_path}/t", frame_bytes=64)
    rows = tokenfile.read_token_files(spark, manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x))
    start, texts = 0, dict(enumerate(ODD)) | {None: "no id", 99: ""}
    for r in rows:
        ids = [*other.encode(texts[r.doc_id], add_special_tokens=False).ids, tokenfile.END_ID]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sum(m.n_docs for m in manifest) == len(rows) == len(ODD) + 4
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(_docs(spark).limit(0), path, f"file://{tmp_path}/e")).count() == 0


def test_damage_is_found(tmp_path):
    path = f"file://{tmp_path}/f.bin"
    writer = tokenfile.FrameWriter(path, frame_bytes=40)
    docs = [np.arange(i, i + 7, dtype="<u4") for i in range(20)]
    for i, ids in enumerate(docs):
        writer.add(i, ids.tobytes())
    assert writer.close() == (20, 140)
    reader = tokenfile.FrameReader(path)
    assert len(reader.sizes) > 5 and all((reader.document(i) == docs[i]).all() for i in (19, 0, 7))
    raw = bytearray((tmp_path / "f.bin").read_bytes())
    raw[12] ^= 0xFF
    (tmp_path / "f.bin").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  the library's error or the checksum's
        tokenfile.FrameReader(path).document(0)
