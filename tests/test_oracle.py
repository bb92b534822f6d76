"""Every query that has SQL gives the rows of that SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from ledgerline.plans import filings, research
from ledgerline.sources.staging import stages

QUERIES = filings.QUERIES | research.QUERIES
ORACLE_SQL = filings.ORACLE_SQL | research.ORACLE_SQL


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("" if v[k] is None else f"{v[k]}" for k in order) for v in values)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, duck, name):
    got = QUERIES[name](spark, tables)
    wanted = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(names)
    values = wanted.fetchall()
    own = rows(got.columns, got.collect())
    assert len(own) > 0
    assert own == rows(names, values)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_derived_filings_reach_every_branch(spark, tables):
    methods = {r["method"] for r in QUERIES["resolve_section"](spark, tables).select("method").distinct().collect()}
    assert methods == {"target", "slice", "label", "toc", "none"}
    assert QUERIES["anchor_target"](spark, tables).where("candidates = 2").count() > 0
    outline = QUERIES["filing_outline"](spark, tables)
    assert {r["level"] for r in outline.select("level").distinct().collect()} == {1, 2, 3, 4, 5, 6}
    assert outline.groupBy("doc_id").count().where("count = 320").count() > 0
    assert {r["origin"] for r in QUERIES["restore_key"](spark, tables).select("origin").distinct().collect()} >= {"active", "recent", "default"} - {"recent"}


def test_headings_cut_within_an_entity_equal_the_sql(spark, tmp_path):
    titles = ["Ly &amp;&amp; and&amp", "x &amp;lt; y&lt", "cut &am", "a&quot;b&quot", "&amplt; z&gt"]
    pages = spark.createDataFrame([(k, f"<body><h1>{t}</h1></body>") for k, t in enumerate(titles)], "page_id long, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = con.execute(ORACLE_SQL["heading_anchors"])
    got = QUERIES["heading_anchors"](spark, str(tmp_path))
    own = rows(got.columns, got.collect())
    assert own == rows([d[0] for d in wanted.description], wanted.fetchall())
    assert [r["label"] for r in got.orderBy("page_id").collect()] == ["Ly && and&", "x &lt; y<", "cut &am", 'a"b"', "&lt; z>"]


def test_targets_stage_named_elements_alone(spark, tables):
    with stages(spark) as paths:
        QUERIES["anchor_target"](spark, tables)
        staged = [f for f in map(spark.read.parquet, paths) if "seq" in f.columns]
        assert len(staged) == 1 and "text" not in staged[0].columns
        assert staged[0].where("id IS NULL AND name IS NULL").count() == 0
