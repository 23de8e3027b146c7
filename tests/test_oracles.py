"""Every query with an oracle against DuckDB on the same tables; the others run and keep their invariants."""

import math

import pytest

from gazettemill.plans import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 5) + 0.0)
    return "~" if value is None else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_key(row[names.index(c)]) for c in columns) for row in result.fetchall())
    got = sorted(tuple(_key(v) for v in row) for row in df.select(columns).collect())
    assert got == want


def test_intervals_hold_the_point(spark, sf):
    rows = catalog.queries()["b4_agenda_interval"](spark, sf).collect()
    assert rows and all(r["low"] <= r["high"] for r in rows)
    inside = sum(r["low"] - 1e-9 <= r["deviation"] <= r["high"] + 1e-9 for r in rows)
    assert inside >= 0.9 * len(rows)


def test_each_article_has_one_story(spark, sf):
    rows = catalog.queries()["c4_story_assignment"](spark, sf)
    assert rows.count() == rows.select("article_id").distinct().count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_greedy_keeps_no_near_pair(spark, sf):
    from gazettemill.operators import dedup
    from gazettemill.plans import views

    prints = dedup.simhash(views.doc(spark, sf))
    kept = dedup.greedy_keep(prints).where("kept").join(prints.select("article_id", "fp"), "article_id")
    assert dedup.near_pairs(kept, 3, ["outlet"]).count() == 0
