"""Operator 10: token ids in files of independent zstandard frames with a trailing seek table.

File layout (one file a range of document ids, in ascending order):

* data frames: whole documents' ids, little-endian unsigned 32-bit, each frame about ``frame_bytes``
  before compression, with zstandard's own content checksum;
* one index frame: per document ``doc_id`` (int64), a flag for a null id (uint8), tokens (uint32);
* a skippable frame with the seek table of the public zstandard seekable format: per frame its
  compressed size, its decompressed size and the low 32 bits of the XXH64 of its content, then the
  number of frames, the descriptor byte 0x80 and the magic number 0x8F92EAB1.

A reader takes the table from the file's end, the index from the last frame, and decompresses only
the frames of the documents asked for; each frame is held against its checksum. Files are written
by the executors through ``pyarrow.fs`` (local, HDFS or object stores) below the shared folder,
each under a name of its own attempt; the manifest rows of successful tasks name the files that count.

Files number as the input's bytes over ``FILE_BYTES``, or as the shuffle partitions if those are more, so
neither a file nor its index grows with the corpus. Rows are dealt by id, then by a digest of the text, then
by their place in the input, so an id with most of the rows spreads over files.

Defined cases: a null text is an empty document (only the end id); null doc_ids sort first; repeated
ids sort by a digest of their texts; strings of added tokens in a text become these tokens, as the library's
encoder has it; repeated rows are documents of their own, in the order of their places; a very long text is one
document in frames of its own; other columns, whatever their names, are not read; an empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch_path, slices, table
from .wordcache import WordCache, gather, split_pieces

END_ID = 2
FRAME_BYTES = 1 << 18
FILE_BYTES = 64 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def _checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system, name


class FrameWriter:
    """Writes one file. ``add`` takes documents in order; ``close`` adds the index and the table."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.system, name = _open(path)
        self.system.create_dir(name.rpartition("/")[0], recursive=True)
        self.sink = self.system.open_output_stream(name)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes, self.entries, self.held, self.size = frame_bytes, [], [], 0
        self.doc_ids, self.nulls, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.sink.write(packed)
        self.entries.append(struct.pack("<III", len(packed), len(content), _checksum(content)))

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._flush()
        n = len(self.doc_ids)
        self._frame(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.counts, "<u4").tobytes())
        body = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)
        self.sink.close()
        return n, int(sum(self.counts))


class FrameReader:
    """Random access to one file's documents."""

    def __init__(self, path: str):
        import zstandard

        self.system, name = _open(path)
        self.source = self.system.open_input_file(name)
        self.unpacker = zstandard.ZstdDecompressor()
        end = self.source.size()
        frames, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{path}: no seek table")
        rows = np.frombuffer(self._at(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = rows.T
        self.offsets = np.cumsum(self.packed) - self.packed
        index = self.frame(frames - 1)
        n = len(index) // 13
        ids, nulls = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, 9 * n).astype(np.int64)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(ids, nulls)]
        self.frame_ends = np.cumsum(self.sizes[:-1])
        self.starts = np.cumsum(self.counts) - self.counts
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(size))

    def frame(self, k: int) -> bytes:
        content = self.unpacker.decompress(self._at(self.offsets[k], self.packed[k]))
        if len(content) != self.sizes[k] or _checksum(content) != self.sums[k]:
            raise ValueError(f"frame {k}: checksum differs")
        return content

    def document(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document; decompresses the one frame that holds them."""
        start, size = int(self.starts[i]) * 4, int(self.counts[i]) * 4
        k = int(np.searchsorted(self.frame_ends, start, "right"))
        if self._last[0] != k:
            self._last = k, self.frame(k)
        first = start - (int(self.frame_ends[k]) - int(self.sizes[k]))
        return np.frombuffer(self._last[1][first : first + size], "<u4")


_loaded: dict[str, WordCache] = {}
#: The bytes that byte-level vocabularies write as themselves; the others follow from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Below this code point the library's pattern engine and ``regex`` know the same letters and digits.
_LATIN_END = "\u0250"


def _cache(path: str) -> WordCache:
    """Ids by the library: its model encodes each distinct piece of Latin words once, its whole
    encoder the other words. For texts without an added token (:func:`_added`)."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex

        library, _ = _added(path)
        model, pattern = library.model, regex.compile(public_tokenizers.PATTERN)

        def latin(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            pieces, at, counts = split_pieces(pattern, parts)
            found = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(_BYTE_CHARS))] for p in pieces]
            flat = np.fromiter((i for ids in found for i in ids), np.uint32)
            return gather(flat, np.fromiter(map(len, found), np.int64, len(found)), at, counts)

        def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            plain = np.fromiter((max(p, default="") < _LATIN_END for p in parts), bool, len(parts))
            if plain.all():
                return latin(parts)
            ids, lens = latin([p for p, k in zip(parts, plain.tolist()) if k])
            rest = [e.ids for e in library.encode_batch([p for p, k in zip(parts, plain.tolist()) if not k], add_special_tokens=False)]
            pool = np.concatenate([ids, np.array([i for r in rest for i in r], np.uint32)])
            counts = np.zeros(len(parts), np.int64)
            counts[plain], counts[~plain] = lens, [len(r) for r in rest]
            first = np.zeros(len(parts), np.int64)
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            first[order] = np.cumsum(counts[order]) - counts[order]
            ends = np.cumsum(counts)
            return pool[np.repeat(first - (ends - counts), counts) + np.arange(int(counts.sum()))], counts

        _loaded[path] = WordCache(encode, limit=500_000)
    return _loaded[path]


_libraries: dict[str, tuple] = {}


def _added(path: str) -> tuple:
    """The library's encoder for whole texts, and the strings of its added tokens; read once a worker."""
    if path not in _libraries:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        _libraries[path] = library, sorted(t.content for t in library.get_added_tokens_decoder().values())
    return _libraries[path]


def _encoded(cache: WordCache, added: tuple, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and their counts; texts with an added token go whole to the library's encoder."""
    library, tokens = added
    whole = [i for i, t in enumerate(texts) if any(token in t for token in tokens)]
    if not whole:
        return cache.texts(texts)
    parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    rest = sorted(set(range(len(texts))).difference(whole))
    ids, counts = cache.texts([texts[i] for i in rest])
    for i, own in zip(rest, np.split(ids, np.cumsum(counts)[:-1]) if rest else []):
        parts[i] = own
    for i in whole:
        parts[i] = np.array(library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> list:
    """Encodes and writes all documents; returns one manifest row a file, in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, added, writer, part = _cache(tokenizer_path), _added(tokenizer_path), None, TaskContext.get().partitionId()
        path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex[:8]}.bin"
        tail = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            writer = writer or FrameWriter(path, frame_bytes)
            ids, counts = _encoded(cache, added, [t or "" for t in batch.column("text").to_pylist()])
            blob, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
            for doc_id, n, end in zip(batch.column("doc_id").to_pylist(), counts.tolist(), ends):
                writer.add(doc_id, blob[4 * (end - n) : 4 * end] + tail)
        if writer:
            n, total = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n], "n_ids": [total]})

    spark, text = docs.sparkSession, F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("nth"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc_nulls_first(), "nth"]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # one row a file: as many as there are tasks
    return sorted(map_arrow(ordered, run, "part long, path string, n_docs long, n_ids long").collect(), key=lambda r: r.part)


def read_token_files(spark: SparkSession, manifest: list, with_ids: bool = False) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) from the files of ``manifest``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    base, files = 0, []
    for row in manifest:
        files.append((row.path, base))
        base += row.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = FrameReader(path)
                for s in range(0, len(reader.doc_ids), 2000):
                    own = range(s, min(s + 2000, len(reader.doc_ids)))
                    ids = [reader.document(i) for i in own]
                    out = {
                        "doc_id": pa.array([reader.doc_ids[i] for i in own], pa.int64()),
                        "start": pa.array([first + int(reader.starts[i]) for i in own], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    listed = spark.createDataFrame(files, "path string, first long")
    return map_arrow(listed.repartition(max(1, len(files))), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "tokens"))
    return read_token_files(spark, manifest)
