"""Queries that cover whole tables, held against their SQL twins."""

import duckdb
from veristrata.queries import catalog, corpus

SF = "/root/testdata/sf0.01"


def _oracle(sql, *tables):
    db = duckdb.connect()
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return sorted(db.execute(sql).fetchall(), key=str)


def test_every_quote_meets_every_document(spark):
    run, sql = corpus.QUERIES["X38_quote_containment"]
    got = sorted(map(tuple, run(spark, SF).select("item_id", "doc_id").collect()), key=str)
    assert got == _oracle(sql, "benchmark", "documents")
    assert any(doc % 40 != item % 40 for item, doc in got)


def test_every_question_is_searched(spark):
    run, sql = corpus.QUERIES["H24_dense_batch"]
    got = sorted(map(tuple, run(spark, SF).select("query_id", "vec_id", "score", "rank").collect()), key=str)
    assert got == _oracle(f"SELECT query_id, vec_id, score, rank FROM ({sql})", "embeddings")
    assert {g[0] for g in got} == set(range(0, 500, 50))


def test_every_name_is_mapped(spark):
    run, sql = catalog.QUERIES["H33_name_mapping"]
    got = list(map(tuple, run(spark, SF).select("name", "rank", "term_id", "matches").collect()))
    assert sorted(got, key=str) == sorted(_oracle(f"SELECT name, rank, term_id, matches FROM ({sql})", "part"), key=str)
    assert sum(g[3] for g in got) == spark.read.parquet(f"{SF}/part.parquet").count()
