"""What the corpus operators share: table access, durable intermediate tables, Arrow helpers.

Every intermediate table goes to the folder that the cluster names in ``spark.checkpoint.dir``
(shared by the driver and all executors), so a lost executor costs a task retry, never data.
Only when that setting is absent *and* Spark runs in one local JVM is a temporary folder used.
"""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import workers_import

#: Scratch folders written so far, newest last.
_scratch: list[tuple[SparkSession, str]] = []
#: Those of the last pipeline stage.
_stored: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets one only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veristrata-")
        spark.sparkContext.setCheckpointDir(found)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)  # a path without a scheme is the default file system's
    full = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/veristrata/{label}-{uuid.uuid4().hex[:12]}"
    _scratch.append((spark, path))
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def passing(spark: SparkSession, *lasting: str):
    """Deletes the intermediate tables written inside, once all inside has run, but for those whose
    labels are ``lasting``: the result still reads them. If a run fails, its lasting tables go as well."""
    first = len(_scratch)
    done = False
    try:
        yield
        done = True
    finally:
        own = _scratch[first:]
        del _scratch[first:]
        for entry in own:
            if entry[0] is spark and not (done and any(entry[1].rpartition("/")[2].startswith(f"{label}-") for label in lasting)):
                delete_path(*entry)
            else:
                _scratch.append(entry)


def staged(fn: Callable) -> Callable:
    """A pipeline stage that deletes the intermediate tables of the stage before it: those are stored
    by then, since stages are written and read again."""

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _stored:
            delete_path(*_stored.pop())
        first = len(_scratch)
        out = fn(spark, docs, sf_dir)
        _stored.extend(x for x in _scratch[first:] if x[0] is spark)
        return out

    return run


def slices(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each slice holds about ``max_bytes`` of text (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        total = pc.sum(pc.binary_length(batch.column(text_col))).as_py() or 0
        if total <= max_bytes:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    workers_import(df.sparkSession)
    return df.mapInArrow(fn, schema)
