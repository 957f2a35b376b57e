"""Row normalisation with quarantine, authority resolution, ledger, audit counters and digests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ASSEMBLY_ACCESSION, CONTIG_ACCESSION, is_accession, locus_key, stable_key
from ..functions.scalar import UNSIGNED_INTEGER, is_compound_interval, strict_integer
from ..session import workers_import

#: Issue codes, in the order in which a row reports them.
ISSUE_CODES = (
    "invalid_assembly_accession_version",
    "invalid_sequence_accession_version",
    "invalid_vr_token",
    "locus_key_error",
    "multipart_interval",
    "invalid_integer",
    "invalid_contig_length",
    "ncbi_assembly_not_resolved",
    "ncbi_sequence_not_resolved",
    "ncbi_contig_length_mismatch",
    "invalid_interval",
    "length_mismatch",
    "interval_out_of_bounds",
    "viral_contig_policy_quarantine",
    "unsupported_vr_type",
)
#: The source worksheet's header, spelled as in the source.
HEADER = (
    "Assembly", "Contig", "VR", "HCVR", "Contig Length", "Start", "End", "Length", "Annoated Viral Proportion", "Viral Major Taxon", "Eukaryote Classification",
    "Phylum", "Class", "Order", "Family", "Genus", "Organism Name", "VR Type", "Unique Rate", "Conserved OG", "Busco score",
)


def issues_of(*found: tuple[str, Column]) -> Column:
    """Array of the codes whose condition holds, in order. One joined text, cut again: generated code, where a
    filter over an array would be interpreted row by row. The text is named once, so it is worked out once."""
    joined = F.concat_ws(",", *[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in found])
    return F.array_remove(F.split(joined, ","), "")


def in_scope(rows: DataFrame, assemblies: tuple[str, ...], taxon: str, host_class: str) -> DataFrame:
    return rows.where(F.col("Assembly").isin(*assemblies) & (F.col("Viral Major Taxon") == taxon) & (F.col("Class") == host_class))


def authority_index(reports: DataFrame) -> DataFrame:
    """``assembly, accession, length`` from reports with two accessions a sequence; both name it. Rows
    with conflicting lengths carry ``lengths > 1`` and must be refused by the caller."""
    both = reports.select(F.col("assembly_accession").alias("assembly"), F.explode(F.array("genbank_accession", "refseq_accession")).alias("accession"), "length")
    return both.where("accession is not null").groupBy("assembly", "accession").agg(F.min("length").alias("length"), F.count_distinct("length").alias("lengths"))


def resolve(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``assembly_resolution, contig_resolution, authority_contig_length`` by left joins."""
    known = index.select(F.col("assembly").alias("_a")).distinct()
    own = index.select(F.col("assembly").alias("_sa"), F.col("accession").alias("_sc"), F.col("length").alias("authority_contig_length"))
    joined = rows.join(known, F.col("Assembly") == F.col("_a"), "left").join(own, (F.col("Assembly") == F.col("_sa")) & (F.col("Contig") == F.col("_sc")), "left")
    joined, length = joined.withColumn("_cl", strict_integer(F.col("Contig Length"))), F.col("_cl")
    state = (
        F.when(F.col("_a").isNull() | F.col("authority_contig_length").isNull(), "unresolved")
        .when(length.isNull() | (length <= 0), "length_unverified")
        .when(length != F.col("authority_contig_length"), "length_mismatch")
        .otherwise("exact")
    )
    return joined.withColumn("assembly_resolution", F.when(F.col("_a").isNull(), "unresolved").otherwise("exact")).withColumn("contig_resolution", state).drop("_a", "_sa", "_sc", "_cl")


def normalize(rows: DataFrame, snapshot: str | Column, policy: str | Column) -> DataFrame:
    """One terminal outcome a row: ``normalized_candidate`` without issues, else ``quarantine``. Numbers are
    read once, as columns, and the rules use these. A valid identity has no key all the same if the snapshot or the
    policy (a text, or a column of the rows) is no exact token: null, empty or with white space around it."""
    snapshot, policy = (F.lit(x) if isinstance(x, str) else x for x in (snapshot, policy))
    unkeyed = reduce(lambda a, b: a | b, [F.coalesce((x == "") | x.rlike(r"^\s|\s$"), F.lit(True)) for x in (snapshot, policy)])
    whole = {c: F.coalesce(F.col(c).rlike(UNSIGNED_INTEGER), F.lit(False)) for c in ("Start", "End", "Length")}
    rows = rows.withColumns({f"_whole_{c}": is_whole for c, is_whole in whole.items()})
    is_compound = reduce(lambda a, b: a | b, [~F.col(f"_whole_{c}") & is_compound_interval(F.col(c)) for c in whole])  # no integer is one
    read = rows.withColumns(
        {
            "source_assessment": F.when(F.col("HCVR") == "Yes", "source_high").otherwise("source_low"),
            "_compound": is_compound,
            "contig_length": strict_integer(F.col("Contig Length")),
            "_assembly": is_accession(F.col("Assembly"), ASSEMBLY_ACCESSION),
            "_contig": is_accession(F.col("Contig"), CONTIG_ACCESSION),
            "_token": F.coalesce(F.col("VR").rlike(r"^vr[1-9][0-9]*$"), F.lit(False)),
        }
    )
    read = read.withColumns({new: F.when(~F.col("_compound") & F.col(f"_whole_{old}"), F.col(old).cast("long")) for new, old in (("start0", "Start"), ("end0", "End"), ("_length", "Length"))})
    start, end, length, contig_length, compound = (F.col(c) for c in ("start0", "end0", "_length", "contig_length", "_compound"))
    not_integer = contig_length.isNull() | (~compound & (start.isNull() | end.isNull() | length.isNull()))
    resolved = "assembly_resolution" in rows.columns
    nothing = F.lit(False)
    issues = issues_of(
        ("invalid_assembly_accession_version", ~F.col("_assembly")),
        ("invalid_sequence_accession_version", ~F.col("_contig")),
        ("invalid_vr_token", ~F.col("_token")),
        ("locus_key_error", F.col("_assembly") & F.col("_contig") & F.col("_token") & unkeyed),
        ("multipart_interval", compound),
        ("invalid_integer", not_integer),
        ("invalid_contig_length", contig_length <= 0),
        ("ncbi_assembly_not_resolved", F.col("assembly_resolution") == "unresolved" if resolved else nothing),
        ("ncbi_sequence_not_resolved", (F.col("assembly_resolution") == "exact") & (F.col("contig_resolution") == "unresolved") if resolved else nothing),
        ("ncbi_contig_length_mismatch", F.col("contig_resolution") == "length_mismatch" if resolved else nothing),
        ("invalid_interval", ~((start >= 0) & (start < end))),
        ("length_mismatch", length != end - start),
        ("interval_out_of_bounds", end > contig_length),
        ("viral_contig_policy_quarantine", F.col("VR Type") == "Viral contig"),
        ("unsupported_vr_type", ~F.coalesce(F.col("VR Type").isin("Viral contig", "Integration"), nothing)),
    )
    key = F.when(F.col("_assembly") & F.col("_contig") & F.col("_token") & ~unkeyed, locus_key(snapshot, F.col("Assembly"), F.col("Contig"), F.col("VR"), policy))
    named = read.withColumns({"locus_key": key, "issues": issues}).drop("_compound", "_length", "_assembly", "_contig", "_token", *[f"_whole_{c}" for c in whole])
    return named.withColumn("outcome", F.when(F.size("issues") == 0, "normalized_candidate").otherwise("quarantine"))


def source_record_key(artifact: Column, snapshot: Column, sheet: Column, row: Column) -> Column:
    return stable_key("source_record", artifact_sha256=artifact, source_snapshot_key=snapshot, worksheet=sheet, row=row)


def ledger_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def issue_counts(rows: DataFrame) -> DataFrame:
    """Rows of each code. An inner explode would send a filter on the list's size below the rules, which then are worked out
    once for each place that names them; the outer one leaves a row without a code, which goes afterwards."""
    return rows.select(F.explode_outer("issues").alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


def audit(rows: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """All counters in one pass: rows, distinct keys, one conditional count a flag."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), *[F.count_if(c).alias(n) for n, c in sorted(flags.items())])


#: The counters of :func:`worksheet_audit`, in order.
WORKSHEET_COUNTERS = (
    "source_records", "source_high", "source_low", "normalized_candidate", "quarantine", "vr_type_integration", "vr_type_viral_contig", "vr_type_other",
    "assembly_resolution_exact", "assembly_resolution_not_exact", "contig_resolution_exact", "contig_resolution_not_exact",
    "missing_locus_key", "missing_organism_name", "invalid_call_key_format", "invalid_locus_key_format", "locus_key_preimage_error", "locus_key_preimage_mismatch",
    "assemblies", "contigs", "source_organism_names", "call_key_values", "call_key_extra_occurrences", "locus_key_values", "locus_key_extra_occurrences",
)


def worksheet_audit(rows: DataFrame) -> DataFrame:
    """One row of counters over normalised rows: assessments, outcomes, types, resolutions, missing and badly
    formed keys, keys that their fields do not give, and distinct and repeated keys. ``rows``: the columns of
    :func:`normalize` and :func:`resolve`, ``stored_key`` (the key as stored), ``record_key`` and ``name``. What is
    counted of a key comes from the grouping by it, where nothing is filtered: a filter would go down to the scan, and
    the other counters would need the digests again."""
    flags = {
        "source_high": F.col("source_assessment") == "source_high",
        "source_low": F.col("source_assessment") == "source_low",
        "normalized_candidate": F.col("outcome") == "normalized_candidate",
        "quarantine": F.col("outcome") == "quarantine",
        "vr_type_integration": F.col("VR Type") == "Integration",
        "vr_type_viral_contig": F.col("VR Type") == "Viral contig",
        "vr_type_other": ~F.coalesce(F.col("VR Type").isin("Integration", "Viral contig"), F.lit(False)),
        "assembly_resolution_exact": F.col("assembly_resolution") == "exact",
        "assembly_resolution_not_exact": ~F.col("assembly_resolution").eqNullSafe(F.lit("exact")),
        "contig_resolution_exact": F.col("contig_resolution") == "exact",
        "contig_resolution_not_exact": ~F.col("contig_resolution").eqNullSafe(F.lit("exact")),
        "missing_organism_name": F.coalesce(F.col("name"), F.lit("")) == "",
    }
    counts = rows.agg(F.count("*").alias("source_records"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    distinct = rows.agg(F.count_distinct("Assembly").alias("assemblies"), F.count_distinct("Assembly", "Contig").alias("contigs"), F.count_distinct("name").alias("source_organism_names"))
    call, locus, n = F.col("record_key"), F.col("stored_key"), F.col("_n")
    calls = rows.groupBy("record_key").agg(F.count("*").alias("_n")).agg(
        _rows_if(~F.coalesce(call.rlike("^source_record:sha256:[0-9a-f]{64}$"), F.lit(False))).alias("invalid_call_key_format"),
        F.count_if(call.isNotNull() & (n > 1)).alias("call_key_values"),
        _rows_if(call.isNotNull(), n - 1).alias("call_key_extra_occurrences"),
    )
    own = F.col("locus_key")
    loci = rows.groupBy("stored_key").agg(F.count("*").alias("_n"), F.count_if(own.isNull()).alias("_errors"), F.count_if(own.isNotNull() & ~locus.eqNullSafe(own)).alias("_others"))
    loci = loci.agg(
        _rows_if(locus.isNull()).alias("missing_locus_key"),
        _rows_if(~locus.rlike("^locus:sha256:[0-9a-f]{64}$")).alias("invalid_locus_key_format"),
        F.coalesce(F.sum("_errors"), F.lit(0)).alias("locus_key_preimage_error"),
        F.coalesce(F.sum("_others"), F.lit(0)).alias("locus_key_preimage_mismatch"),
        F.count_if(locus.isNotNull() & (n > 1)).alias("locus_key_values"),
        _rows_if(locus.isNotNull(), n - 1).alias("locus_key_extra_occurrences"),
    )
    return counts.crossJoin(distinct).crossJoin(calls).crossJoin(loci).select(*WORKSHEET_COUNTERS)  # single rows


def _rows_if(condition: Column, n: Column | None = None) -> Column:
    """Rows of the groups whose condition holds, or the sum of ``n`` over them."""
    return F.coalesce(F.sum(F.when(condition, F.col("_n") if n is None else n)), F.lit(0))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once, and their extra occurrences."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.agg(F.count_if(F.col("_n") > 1).alias("repeated_values"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_rows"))


#: Rows of a key set that one row may hold as a list; larger sets are hashed as a stream.
KEY_SET = 100_000


#: Keys of one range of a large key set, about; keys of one piece of it.
RANGE, PIECE = 1 << 18, 1 << 15


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range's JSON texts, joined and compressed in numbered pieces."""
    number, held = TaskContext.get().partitionId() << 32, []
    row = lambda: pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([zlib.compress(",".join(held).encode())])], ["piece", "z"])
    for batch in batches:
        held += batch.column("j").to_pylist()
        if len(held) >= PIECE:
            yield row()
            number, held = number + 1, []
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the JSON list of a stream of keys, given in pieces in their order."""
    state, first = hashlib.sha256(b"["), True
    for batch in batches:
        for piece in batch.column("z").to_pylist():
            state.update((b"" if first else b",") + zlib.decompress(piece))
            first = False
    state.update(b"]")
    yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], ["digest"])


def key_set_digest(rows: DataFrame, key: str, limit: int = KEY_SET) -> DataFrame:
    """SHA-256 of the JSON list of sorted keys (nulls are not listed), with the number of rows. Above ``limit`` rows the
    list is never held: keys are dealt to ranges, every task sorts one and packs it in pieces, and one task hashes the
    pieces in their order, since this digest is sequential by definition. :func:`multiset_digest` is the identity that tasks share."""
    keys = rows.select(F.col(key).cast("string").alias("k"))
    n = keys.count()
    if n <= limit:
        listed = keys.agg(F.array_sort(F.collect_list("k")).alias("ks"), F.count("*").alias("n"))
        return listed.select(F.sha2(F.to_json("ks"), 256).alias("digest"), "n")
    one = F.to_json(F.array("k"))
    workers_import(rows.sparkSession)
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // RANGE))
    ordered = keys.where("k is not null").repartitionByRange(ranges, "k").sortWithinPartitions("k").select(F.substring(one, F.lit(2), F.length(one) - 2).alias("j"))
    packed = ordered.mapInArrow(_pieces, "piece long, z binary").repartition(1).sortWithinPartitions("piece")
    return packed.select("z").mapInArrow(_hashed, "digest string").withColumn("n", F.lit(n).cast("long"))


#: Rows of a table whose buckets of entries are held as lists; those of larger tables are hashed as streams.
BUCKETED = 16**6


def _bucket_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``b, d, n`` of each bucket from a stream of entries in order: no entry is held."""
    bucket, state, total = None, None, 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([bucket], pa.string()), pa.array([state and state.hexdigest()], pa.string()), pa.array([total], pa.int64())], ["b", "d", "n"])
    for batch in batches:
        for h, n in zip(batch.column("h").to_pylist(), batch.column("n").to_pylist()):
            own = h and h[:3]
            if total and own != bucket:
                yield row()
                state, total = None, 0
            bucket = own
            if h is not None:
                state = state or hashlib.sha256()
                state.update(f"{',' if total else ''}{h}:{n}".encode())
            total += n
    if total:
        yield row()


def multiset_digest(rows: DataFrame, key: str, limit: int = BUCKETED) -> DataFrame:
    """The same identity at any size. Equal keys are one entry with a count; the entries are hashed in 4,096 buckets by
    the first three hex digits of their keys' digests, then the buckets' digests. Above ``limit`` rows no bucket is held
    as a list: a task sorts its buckets (on disk, if need be) and hashes one entry after the other. Null keys count as
    rows only."""
    entries = rows.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n")).select(F.sha2("k", 256).alias("h"), "n")
    bucket = F.substring("h", 1, 3)
    if rows.count() > limit:
        workers_import(rows.sparkSession)
        dealt = entries.withColumn("b", bucket).repartition("b").sortWithinPartitions("b", "h").select("h", "n")
        now = dealt.mapInArrow(_bucket_digests, "b string, d string, n long")
    else:
        entry = F.concat("h", F.lit(":"), F.col("n").cast("string"))
        own = entries.groupBy(bucket.alias("b")).agg(F.array_sort(F.collect_list(entry)).alias("own"), F.sum("n").alias("n"))
        now = own.select("b", F.sha2(F.array_join("own", ","), 256).alias("d"), "n")
    listed = F.array_sort(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "d"))))
    whole = now.agg(listed.alias("own"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return whole.select(F.sha2(F.array_join(F.transform("own", lambda x: x["d"]), ","), 256).alias("digest"), "n")


def compare(expected: DataFrame, actual: DataFrame, name: str = "metric") -> DataFrame:
    """Metrics whose expected and actual values differ; a missing side differs."""
    e, a = expected.select(name, F.col("value").alias("expected")), actual.select(name, F.col("value").alias("actual"))
    return e.join(a, name, "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def new_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Idempotent replay: rows whose key is not stored yet, the least row of each key."""
    rest = [c for c in batch.columns if c != key]
    once = batch.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest]) if rest else batch.distinct()
    return once.join(stored.select(key), key, "left_anti").select(*batch.columns)


def flank_window(start: Column, end: Column, length: Column, size: int) -> tuple[Column, Column]:
    """Clamped half-open window as 1-based inclusive bounds."""
    return F.greatest(F.lit(0), start - size) + 1, F.least(length, end + size)
