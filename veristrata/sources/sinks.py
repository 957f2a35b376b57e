"""Writers: new files only, deterministic order, commit markers, idempotent staging, vector sidecars."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import new_rows


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables in their dependency order, each only if it is new."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _committed(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, f"{folder}/_committed")
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_staged(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all committed runs; none yet: ``None``."""
    runs = _committed(spark, folder)
    if not runs:
        return None
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/run_key={run}" for run in runs])


def stage(batch: DataFrame, folder: str, key: str, run_key: str) -> int:
    """Adds the rows whose key is not stored yet as one run, and returns their number. The run's files are
    written under its name, over what a failed attempt left there, and count once its marker exists; a run
    that has one adds nothing. One writer at a time."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_key):
        raise ValueError("a run key is letters, digits, dots, dashes and underscores")
    spark = batch.sparkSession
    if run_key in _committed(spark, folder):
        return 0
    stored = read_staged(spark, folder)
    fresh = new_rows(batch, stored if stored is not None else batch.limit(0), key)
    own = f"{folder}/run_key={run_key}"
    fresh.write.mode("overwrite").parquet(own)
    fs, marker = _fs(spark, f"{folder}/_committed/{run_key}")
    fs.create(marker, True).close()
    return spark.read.schema(fresh.schema).parquet(own).count()


def report_csv(df: DataFrame, folder: str, order: list[str]) -> None:
    """A small report as one sorted CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).csv(folder)


def report_jsonl(df: DataFrame, folder: str, order: list[str]) -> None:
    df.select(*sorted(df.columns)).orderBy(*order).coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(folder)


def canonical_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON with sorted names and explicit nulls."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """Every row as one line of a table, with ``line``; bars and backslashes are escaped, nulls are empty."""
    clean = lambda c: F.coalesce(F.regexp_replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\n", " "), F.lit(""))
    return df.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *[clean(c) for c in df.columns]), F.lit(" |")))


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A result page as a table; bars and backslashes are escaped."""
    clean = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(map(clean, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(map(clean, r)) + " |" for r in rows]])


def write_vectors(df: DataFrame, folder: str, key: str, vector: str, meta: dict) -> None:
    """Vectors sorted by key as Parquet, with a manifest beside them."""
    df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).orderBy("key").write.mode("errorifexists").parquet(f"{folder}/vectors.parquet")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "manifest string").coalesce(1).write.mode("errorifexists").text(f"{folder}/manifest")


def index_rows(rows: DataFrame, key: str, text: str, embed, tokenize, window: int) -> DataFrame:
    """``key, vector, truncated, truncated_tokens``: each text's tokens beyond ``window`` are counted and
    left out of what ``embed`` gets (UDFs of :mod:`veristrata.functions.providers`)."""
    cut = rows.select(F.col(key).alias("key"), F.col(text).alias("_text"), tokenize(F.col(text)).alias("_at"))
    seen = F.when(F.size("_at") > window, F.substring(F.col("_text"), F.lit(1), F.get("_at", F.lit(window - 1))["end"])).otherwise(F.col("_text"))
    more = F.greatest(F.size("_at") - window, F.lit(0))
    return cut.select("key", embed(seen).alias("vector"), (more > 0).alias("truncated"), more.cast("long").alias("truncated_tokens"))


def read_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/vectors.parquet"), json.loads(spark.read.text(f"{folder}/manifest").first()[0])
