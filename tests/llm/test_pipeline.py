"""The pipeline: stages, edge cases and its SQL; and the operators' SQL on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from cliploom.llm import oracles, queries

from .conftest import EDGES


def plain(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    order, columns = [c[0] for c in found.description], sorted(df.columns)
    assert sorted(order) == columns
    theirs = sorted(repr(tuple(plain(r[order.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_operator_sql(name, spark, sf_dir):
    same(queries.QUERIES[name](spark, sf_dir), oracles.ORACLES[name], sf_dir)


def test_pipeline_sql(spark, sf_dir):
    same(corpus_pipeline.run(spark, sf_dir), corpus_pipeline.ORACLE_SQL, sf_dir)


def test_stages(spark, edges, empty, sf_dir):
    for docs in (edges, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.count() <= len(EDGES)
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, edges, sf_dir).count() > 0 and last(spark, empty, sf_dir).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_line_stage_keeps_documents(spark, edges, sf_dir):
    assert corpus_pipeline.dedup_lines(spark, edges, sf_dir).count() == len(EDGES)
