"""Staging of several dependent tables as one commit: get-or-create by key, replay by run, one winner among writers.

An attempt writes the rows of each table that are not stored yet to a folder of its own, parents first. They count once a
manifest with the next number names them. A manifest appears whole and never replaces another: by a hard link on a local
disk, elsewhere by a rename that refuses an existing target (as on HDFS). The loser of a race reads what the winner
stored, leaves those keys out and tries the next number; a crash leaves a folder that no manifest names."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import new_rows
from ..operators.release import dependency_levels


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def commits(spark: SparkSession, folder: str) -> list[dict]:
    """All manifests in their order: ``number, run_key, attempt, rows`` (by table)."""
    fs, path = _path(spark, f"{folder}/_commits")
    names = sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return []
    found = [json.loads(r.value) for r in spark.read.text(names, wholetext=True).collect()]
    return sorted(found, key=lambda c: c["number"])


def _publish(spark: SparkSession, folder: str, manifest: dict) -> bool:
    """Whether the manifest became the one of its number."""
    jvm = spark.sparkContext._jvm
    fs, draft = _path(spark, f"{folder}/_commits/.{uuid.uuid4().hex}")
    _, final = _path(spark, f"{folder}/_commits/{manifest['number']:012d}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    try:
        if final.toUri().getScheme() == "file":
            files, at = jvm.java.nio.file.Files, lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            files.createLink(at(final), at(draft))
        else:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)


def _stored(spark: SparkSession, folder: str, done: Sequence[dict], table: str, like: DataFrame) -> DataFrame:
    paths = [f"{folder}/{table}/attempt={c['attempt']}" for c in done if c["rows"].get(table)]
    return spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)


def read_table(spark: SparkSession, folder: str, table: str, upto: int | None = None) -> DataFrame | None:
    """The rows of a table that manifests name (up to a number); none yet: ``None``."""
    done = [c for c in commits(spark, folder) if c["rows"].get(table) and (upto is None or c["number"] <= upto)]
    paths = [f"{folder}/{table}/attempt={c['attempt']}" for c in done]
    if not paths:
        return None
    runs = spark.createDataFrame([(c["attempt"], c["run_key"]) for c in done], "attempt string, run_key string")
    rows = spark.read.option("basePath", f"{folder}/{table}").option("recursiveFileLookup", False).parquet(*paths)
    return rows.withColumn("attempt", F.col("attempt").cast("string")).join(runs, "attempt").drop("attempt")


def stage_tables(batches: dict[str, tuple[DataFrame, str]], parents: dict[str, dict[str, str]], folder: str, run_key: str, tries: int = 20) -> dict[str, int]:
    """Adds to each table (``rows, key``) those rows whose key is not stored, as one commit; returns their numbers. A run
    that is committed adds nothing. ``parents``: for each table its parent tables with the column that names their key;
    a row that names a key which neither is stored nor comes along is refused, and nothing is committed."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_key):
        raise ValueError("a run key is letters, digits, dots, dashes and underscores")
    spark = next(iter(batches.values()))[0].sparkSession
    order = [t for level in dependency_levels({t: tuple(parents.get(t, {})) for t in batches}) for t in level]
    for _ in range(tries):
        done = commits(spark, folder)
        if any(c["run_key"] == run_key for c in done):
            return dict.fromkeys(batches, 0)
        attempt, counts, known = uuid.uuid4().hex, {}, {}
        for table in order:
            rows, key = batches[table]
            stored = _stored(spark, folder, done, table, rows)
            path = f"{folder}/{table}/attempt={attempt}"
            new_rows(rows, stored, key).write.parquet(path)
            fresh = spark.read.schema(rows.schema).parquet(path)
            for parent, column in parents.get(table, {}).items():
                held = known[parent].select(F.col(batches[parent][1]).alias(column))
                if not fresh.where(F.col(column).isNotNull()).join(held, column, "left_anti").isEmpty():
                    raise ValueError(f"rows of {table} name a {column} that {parent} does not hold")
            counts[table] = fresh.count()
            known[table] = stored.unionByName(fresh)
        number = 1 + (done[-1]["number"] if done else 0)
        if _publish(spark, folder, {"number": number, "run_key": run_key, "attempt": attempt, "rows": counts}):
            return counts
    raise RuntimeError("other writers committed first each time")
