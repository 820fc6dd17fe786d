"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracemill.plans.queries import QUERIES, SQL, evidence

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    own = sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=str)
    cur = db.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert own == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"source_model"}))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_cascade_counts_all_refusals(spark):
    """Metrics, one cell of the grid and the best rule against counts of the rows' own evidence."""
    rows = evidence(spark, SF).select("y", "stripped", "refusal", "overlap", "length", F.contains(F.lower("trace"), F.lit("cannot help")).alias("plain")).collect()
    assert any(r["refusal"] and not r["plain"] for r in rows)
    said = [(r["y"], not (r["stripped"] < 5 or r["refusal"]) and (r["overlap"] > 0.08 or r["length"] > 3500)) for r in rows]
    want = [said.count(x) for x in ((True, True), (False, True), (True, False), (False, False))]
    got = QUERIES["rule_metrics"](spark, SF).first()
    grid = QUERIES["rule_grid"](spark, SF).collect()
    cell = next(r for r in grid if (r["overlap_1000"], r["length"]) == (80, 3500))
    assert [got[k] for k in ("tp", "fp", "fn", "tn")] == want == [cell[k] for k in ("tp", "fp", "fn", "tn")]
    assert QUERIES["rule_best"](spark, SF).first()["f1_macro"] == max(r["f1_macro"] for r in grid)
