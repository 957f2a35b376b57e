"""Registry of the core queries: name -> (function, oracle SQL)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import workers_import
from . import catalog, corpus, evaluation, questions, records, release_graph, staging

Query = Callable[[SparkSession, str], DataFrame]
_ALL = (catalog, staging, corpus, evaluation, questions, release_graph, records)


def _ready(query: Query) -> Query:
    """The query for a session whose workers find this package, whichever query comes first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_import(spark)
        return query(spark, sf_dir)

    return run


def core_queries() -> dict[str, Query]:
    return {name: _ready(q[0]) for m in _ALL for name, q in m.QUERIES.items()}


def core_oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in _ALL for name, q in m.QUERIES.items() if q[1]}
