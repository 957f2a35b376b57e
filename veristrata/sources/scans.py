"""File scans: verified bytes, JSON lines, worksheets, articles, taxonomy dumps."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import workers_import
from . import markdown

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def verify_bytes(spark: SparkSession, path: str, sha256: str, size: int) -> DataFrame:
    """One row a file: digest, length, and whether both are the expected ones."""
    files = spark.read.format("binaryFile").load(path)
    found = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    return found.withColumn("verified", (F.col("sha256") == sha256) & (F.col("size") == size))


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a closed schema; a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def scan_verified_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, sha256: str, size: int) -> DataFrame:
    """As :func:`scan_jsonl` for one file of a known digest and length. Rows come from the very bytes that are
    checked, in one read, so no change between check and read can slip in; files below 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    good = (F.sha2("content", 256) == sha256) & (F.col("length") == size)
    text = F.when(good, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("the file is not the expected one")).cast("string"))
    lines = files.select(F.explode(F.split(text, "\r?\n")).alias("line")).where(F.trim("line") != "")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def load_packet(spark: SparkSession, folder: str, manifest: dict) -> dict[str, DataFrame]:
    """The JSON-lines files of a packet by name. ``manifest``: name to ``file, sha256, size, schema``. A packet
    holds exactly its files: others in the folder, or missing ones, are refused before any is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = {s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    expected = {m["file"] for m in manifest.values()}
    if {f for f in found if not f.startswith((".", "_"))} - {"manifest.json"} != expected:
        raise ValueError(f"the folder holds {sorted(found)}, the manifest {sorted(expected)}")
    return {name: scan_verified_jsonl(spark, f"{folder}/{m['file']}", m["schema"], m["sha256"], m["size"]) for name, m in manifest.items()}


def load_sealed(spark: SparkSession, path: str, schema: T.StructType | str, own: str = "record_sha256") -> DataFrame:
    """JSON lines whose records carry their own digest; a record that is not what it says fails the read."""
    rows = scan_jsonl(spark, path, schema)
    rest = F.to_json(F.struct(*[c for c in sorted(rows.columns) if c != own]), {"ignoreNullFields": "false"})
    return rows.withColumn(own, F.when(F.col(own).eqNullSafe(F.sha2(rest, 256)), F.col(own)).otherwise(F.raise_error(F.concat(F.lit("record digest differs: "), F.coalesce(own, F.lit("none")))).cast("string")))


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text, never cut."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _elements(part: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """Every element ``tag`` of a stream, once it is whole. After use it leaves the tree, so none of it is held."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == tag:
            yield e
            if above:
                above[-1].clear()  # it holds nothing else of use


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    with archive.open("xl/sharedStrings.xml") as part:
        return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in _elements(part, f"{_MAIN}si")]


def decode_cell(cell: ElementTree.Element, strings: list[str]) -> str:
    """Inline, shared or raw value; a missing one is an empty text."""
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.find(f"{_MAIN}v")
    text = (value.text or "") if value is not None else ""
    return strings[int(text)] if kind == "s" and text else text


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def worksheet_rows(content: bytes, names: tuple[str, ...], header: tuple[str, ...]) -> Iterator[tuple[int, list[str]]]:
    """Rows below the header of the first sheet with one of ``names``; the header must be exact."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings = _shared_strings(archive)
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        ids = [s.get(_REL) for s in book.iter(f"{_MAIN}sheet") if s.get("name") in names]
        if len(ids) != 1:
            raise ValueError(f"expected one sheet named {names}, found {len(ids)}")
        with archive.open("xl/" + links[ids[0]].removeprefix("/xl/")) as part:
            for row in _elements(part, f"{_MAIN}row"):
                number, cells = int(row.get("r")), [""] * len(header)
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r"))
                    if at < len(cells):
                        cells[at] = decode_cell(cell, strings)
                if number == 1:
                    if tuple(cells) != header:
                        raise ValueError("the worksheet header differs")
                else:
                    yield number, cells


def scan_worksheet(spark: SparkSession, path: str, names: tuple[str, ...], header: tuple[str, ...]) -> DataFrame:
    """Workbooks (one a task) as ``source_row`` and one string column a header name; rows stream."""
    workers_import(spark)
    schema = T.StructType([T.StructField("source_row", T.LongType()), *[T.StructField(h, T.StringType()) for h in header]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                held = []
                for number, cells in worksheet_rows(bytes(content), names, header):
                    held.append([number, *cells])
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=["source_row", *header])
                        held = []
                yield pd.DataFrame(held, columns=["source_row", *header])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


BLOCK = "array<struct<index:int,kind:string,heading:array<string>,text:string,first_line:int,last_line:int>>"


def markdown_blocks(text: str) -> list[tuple]:
    """Typed blocks (title, heading, list_item, table, code, paragraph) with heading path and line span."""
    out: list[tuple] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []
    kind, start, fenced = "paragraph", 0, False

    def close(last: int) -> None:
        nonlocal held, kind
        if held:
            out.append((len(out), kind, [h for _, h in path], "\n".join(held), start, last))
        held, kind = [], "paragraph"

    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        if line.startswith("```"):
            if not fenced:
                close(n - 1)
                kind, start = "code", n
            held.append(line)
            fenced = not fenced
            if not fenced:
                close(n)
            continue
        if fenced:
            held.append(line)
            continue
        head = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        item = re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line)
        if head:
            close(n - 1)
            level = len(head[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, head[2]))
            first = level == 1 and not any(b[1] == "title" for b in out)
            out.append((len(out), "title" if first else "heading", [h for _, h in path], head[2], n, n))
        elif not line.strip():
            close(n - 1)
        elif item:
            close(n - 1)
            held, kind, start = [item[1]], "list_item", n
        else:
            now = "table" if line.lstrip().startswith("|") else "paragraph"
            if held and kind != now and not (kind == "list_item" and now == "paragraph"):
                close(n - 1)
            if not held:
                kind, start = now, n
            held.append(line.strip())
    close(len(lines))
    return out


def jats_blocks(text: str) -> list[tuple]:
    """Title, abstracts, sections, lists and captions of a JATS article; documents with a DOCTYPE or entities are refused."""
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text):
        raise ValueError("document type and entity declarations are refused")
    root = ElementTree.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    flat = lambda e: " ".join("".join(e.itertext()).split())
    out: list[tuple] = []

    def add(kind: str, path: list[str], value: str) -> None:
        if value:
            out.append((len(out), kind, path, value, 0, 0))

    def walk(e: ElementTree.Element, path: list[str], kind: str) -> None:
        for kid in e:
            if kid.tag == "sec":
                title = kid.find("title")
                name = flat(title) if title is not None else ""
                add("heading", [*path, name], name)
                walk(kid, [*path, name], kind)
            elif kid.tag == "p":
                add(kind, path, flat(kid))
            elif kid.tag == "list":
                for item in kid.iter("list-item"):
                    add("list_item", path, flat(item))
            elif kid.tag in ("fig", "table-wrap"):
                caption = kid.find("caption")
                if caption is not None:
                    add("figure_caption" if kid.tag == "fig" else "table_caption", path, flat(caption))
            elif kid.tag not in ("title", "label"):
                walk(kid, path, kind)

    for title in root.iter("article-title"):
        add("title", [], flat(title))
        break
    for abstract in root.iter("abstract"):
        walk(abstract, ["Abstract"], "abstract")
    for body in root.iter("body"):
        walk(body, [], "paragraph")
    return out


def parse_blocks(docs: DataFrame, format_: str, text: str = "text") -> DataFrame:
    """One row a block of every document, by ``format_``: markdown (line by line), commonmark (containers
    nest) or jats; other columns stay."""
    workers_import(docs.sparkSession)
    parse = {"markdown": markdown_blocks, "commonmark": markdown.blocks, "jats": jats_blocks}[format_]

    @F.pandas_udf(BLOCK)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [dict(zip(("index", "kind", "heading", "text", "first_line", "last_line"), b)) for b in parse(t)])

    return docs.withColumn("_b", F.explode(run(text))).select(*[c for c in docs.columns if c != text], F.col("_b.index").alias("block_index"), F.col("_b.kind").alias("block_type"), F.col("_b.heading").alias("section_path"), F.col("_b.text").alias("text"), F.col("_b.first_line"), F.col("_b.last_line"))


def plain_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blank-line paragraphs of plain text, JVM side; the first is the title."""
    parts = docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.filter(F.split(F.col(text), r"\n[ \t]*\n+"), lambda p: F.trim(p) != "")).alias("block_index", "_p"))
    return parts.withColumn("block_type", F.when(F.col("block_index") == 0, "title").otherwise("paragraph")).withColumn("text", F.trim("_p")).drop("_p")


def plain_block_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """As :func:`plain_blocks`, with the first and last line of each block (from 1): a block begins at a line
    with something on it after one without, and ends before the next without. An inner explode would send a filter on
    the list's size down to the scan, where the marks of all lines are worked out again for each line; the outer one
    leaves a row without a block, which goes afterwards."""
    wide = docs.select(*[c for c in docs.columns if c != text], F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_l"))
    on = wide.withColumn("_on", F.transform("_l", lambda s: ~s.rlike(r"^[ \t]*$"))).withColumn("_at", F.sequence(F.lit(1), F.size("_l")))
    is_on = lambda i: F.coalesce(F.get(F.col("_on"), i - 1), F.lit(False))
    first = F.filter("_at", lambda i: is_on(i) & ((i == 1) | ~is_on(i - 1)))
    last = F.filter("_at", lambda i: is_on(i) & ~is_on(i + 1))
    parts = on.withColumn("_b", F.arrays_zip(first.alias("f"), last.alias("t"))).select("*", F.posexplode_outer("_b").alias("block_index", "_s")).where("block_index is not null")
    return parts.select(*[c for c in docs.columns if c != text], "block_index", F.when(F.col("block_index") == 0, "title").otherwise("paragraph").alias("block_type"), F.trim(F.array_join(F.slice("_l", F.col("_s.f"), F.col("_s.t") - F.col("_s.f") + 1), "\n")).alias("text"), F.col("_s.f").alias("first_line"), F.col("_s.t").alias("last_line"))


def chunks(docs: DataFrame, tokens: str, size: int = 384, overlap: int = 64) -> DataFrame:
    """Token windows of an array column: ``chunk_index, start, tokens``."""
    from ..functions.scalar import chunk_starts

    cut = docs.select(*[c for c in docs.columns if c != tokens], F.col(tokens).alias("_t"), F.posexplode(chunk_starts(F.size(tokens), size, overlap)).alias("chunk_index", "start"))
    return cut.withColumn("tokens", F.slice("_t", F.col("start") + 1, F.lit(size))).drop("_t")


#: Fields of a taxonomy dump's files.
DUMP_FIELDS = {"nodes": ("tax_id", "parent_id", "rank"), "names": ("tax_id", "name", "unique_name", "name_class"), "merged": ("old_id", "new_id"), "delnodes": ("tax_id",)}


def scan_taxdump(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One file of a dump: fields between ``\\t|\\t``, the line ends with ``\\t|``."""
    fields = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.trim(fields.getItem(i)).alias(name) for i, name in enumerate(DUMP_FIELDS[kind])])


def scan_taxdump_archive(spark: SparkSession, path: str) -> DataFrame:
    """``member, line_number, line`` of the dump's files in a (compressed) tar archive, lines streamed. A
    missing or repeated file fails the read."""
    workers_import(spark)
    wanted = {f"{m}.dmp" for m in DUMP_FIELDS}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tarfile

        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as archive:
                    members = [m for m in archive.getmembers() if m.name.rpartition("/")[2] in wanted]
                    if sorted(m.name.rpartition("/")[2] for m in members) != sorted(wanted):
                        raise ValueError(f"the archive holds {[m.name for m in members]}")
                    for m in members:
                        held = []
                        for n, raw in enumerate(archive.extractfile(m), 1):
                            held.append((m.name.rpartition("/")[2][:-4], n, raw.decode().rstrip("\n")))
                            if len(held) == 20_000:
                                yield pd.DataFrame(held, columns=["member", "line_number", "line"])
                                held = []
                        yield pd.DataFrame(held, columns=["member", "line_number", "line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, line_number long, line string")


def dump_table(lines: DataFrame, kind: str) -> DataFrame:
    """One file of :func:`scan_taxdump_archive` as columns, with its line numbers."""
    fields = F.split(F.regexp_replace("line", r"\t\|$", ""), r"\t\|\t")
    return lines.where(F.col("member") == kind).select("line_number", *[F.trim(fields.getItem(i)).alias(name) for i, name in enumerate(DUMP_FIELDS[kind])])


def species_coverage(sheet: DataFrame, list_: DataFrame, species: str = "Species") -> DataFrame:
    """Species of one of two sheets only: ``species, side``. Empty means that the sheets cover each other."""
    own, other = (df.where(F.coalesce(species, F.lit("")) != "").select(F.trim(species).alias("species")).distinct() for df in (sheet, list_))
    return own.join(other, "species", "left_anti").withColumn("side", F.lit("sheet")).unionByName(other.join(own, "species", "left_anti").withColumn("side", F.lit("list")))


def rank_edges(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """Hierarchy of a sheet with one column a rank: ``rank, name, parent_name`` of the filled cells."""
    filled = F.filter(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).alias("name")) for r in ranks]), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    at = rows.select(filled.alias("p")).select("p", F.posexplode("p").alias("i", "n"))
    return at.select(F.col("n.rank").alias("rank"), F.col("n.name").alias("name"), F.when(F.col("i") > 0, F.element_at("p", F.col("i"))["name"]).alias("parent_name")).distinct()
