"""Streams by themselves, story assignment against the plain fold, late articles and replays."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazettemill.operators import coverage, stories, vectors
from gazettemill.plans import catalog, views
from gazettemill.streaming import arrivals
from gazettemill.streaming import stories as streamed


def folded(rows, threshold=0.18):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, _, v in rows]
    return dict(zip([r[0] for r in rows], vectors.fold_stories([(t, v) for (_, t, _), v in zip(rows, unit)], threshold)))


@pytest.fixture(scope="module")
def timed(spark, sf):
    return views.arr(spark, sf).select("article_id", "desk", (F.unix_micros("published_at") / 3.6e9).alias("t"), "embedding")


@pytest.mark.parametrize("slice_rows,listed", [(2000, 8), (150, 2)])
def test_assignment_equals_the_fold(timed, slice_rows, listed):
    """Slices of 150 with two listed stories: many slices end early, where the next decision isn't sure."""
    want = folded([(r["article_id"], r["t"], r["embedding"]) for r in timed.collect()])
    got = {r["article_id"]: r["story"] for r in stories.assign_stories(timed, 0.18, slice_rows=slice_rows, listed=listed).collect()}
    assert got == want


def test_assignment_of_ties_copies_and_nothing(spark):
    schema = "article_id long, t double, embedding array<double>"
    assert stories.assign_stories(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, 5.0, [1.0, 0.0]) for i in range(6)] + [(i, 5.0, [0.0, 1.0]) for i in range(6, 9)]
    got = {r["article_id"]: r["story"] for r in stories.assign_stories(spark.createDataFrame(rows, schema), slice_rows=2).collect()}
    assert got == folded(rows)


def test_stream_of_stories_equals_the_fold_and_forgets(spark, sf, timed):
    """Three deliveries with restarts between them: the fold of each block, and every story closed by its timer."""
    rows = catalog.queries()["st5_stateful_stories"](spark, sf).collect()
    placed = {r["article_id"]: (r["block"], r["story"]) for r in rows if r["article_id"] is not None}
    sizes = {(r["block"], r["story"]): r["articles"] for r in rows if r["article_id"] is None}
    by_desk = {}
    for r in timed.collect():
        by_desk.setdefault(r["desk"], []).append((r["article_id"], r["t"], r["embedding"]))
    assert placed == {a: (desk, s) for desk, found in by_desk.items() for a, s in folded(found).items()}
    assert sizes == {key: sum(v == key for v in placed.values()) for key in set(placed.values())}


def test_state_shrinks_after_the_timer(spark, tmp_path):
    schema = "block string, article_id long, published_at timestamp, embedding array<double>"
    start = dt.datetime(2024, 1, 1)
    land = lambda *rows: spark.createDataFrame([("b", i, start + dt.timedelta(hours=h), v) for i, h, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    land((1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 2, [0.0, 1.0]))
    stream = streamed.assigned(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    held = []
    with arrivals.state_store(spark, streamed.ROCKS):
        for more in ([], [(4, 200, [1.0, 0.0])], [(5, 400, [1.0, 0.0])]):
            if more:
                land(*more)
            arrivals.run_landed(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out"), str(tmp_path))
            read = lambda name: spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", name).load()
            held.append((read("stories").count(), read("members").count()))
    assert held[0][0] == 2 and held[1][0] == 1 and held[2][0] == 1
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {r["article_id"]: r["story"] for r in out.where("article_id is not null").collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    assert sorted((r["story"], r["articles"]) for r in out.where("article_id is null").collect()) == [(0, 2), (1, 1), (2, 1)]


def test_late_articles_and_replays(spark, tmp_path):
    start = dt.datetime(2024, 1, 10)
    batch = lambda *rows: spark.createDataFrame([(s, o, start + dt.timedelta(hours=h)) for s, o, h in rows], "story string, outlet_id long, published_at timestamp")
    on_time, late = batch(*[("a", o, 1.0 + o / 4) for o in range(5)], ("b", 9, 100.0)), batch(("a", 7, -3.0), ("b", 9, 101.0))
    store = streamed.StoryStore(spark, f"{tmp_path}/store")
    store.merge(on_time, 0)
    assert {r["story"]: r["is_flash"] for r in store.stories().collect()} == {"a": True, "b": False}
    store.merge(late, 1)
    told = sorted(map(tuple, store.stories().collect()))
    a = next(r for r in told if r[0] == "a")
    assert a[1:4] == (6, 6, 1) and a[4] == start - dt.timedelta(hours=3) and a[6] is False
    for again in (lambda: store.merge(late, 1), store.compact, lambda: store.merge(on_time, 0)):
        again()
        assert sorted(map(tuple, store.stories().collect())) == told
    both = on_time.union(late)
    assert {r["story"] for r in coverage.flash_stories(both, "story").collect()} == {r[0] for r in told if r[6]}
    store.merge(batch(("c", 1, 5.0)), 2)
    assert store.stories().count() == 3


def test_tables_in_folders_land(spark, sf, tmp_path):
    from gazettemill.plans import catalog

    for name in ("pages", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name in ("st1_canonical_arrivals", "st1_first_arrivals"):
        want = catalog.queries()[name](spark, sf)
        got = catalog.queries()[name](spark, f"file://{tmp_path}")
        assert want.count() and sorted(got.collect()) == sorted(want.collect())


def test_slices_of_stories_broadcast_nothing(spark):
    rows = spark.createDataFrame([(1, 0.0, [1.0, 0.0])], "article_id long, t double, embedding array<double>")
    opened = spark.createDataFrame([(7, [1.0, 0.0], 1, 0.0)], "story long, centroid array<double>, n long, last double")
    members = spark.createDataFrame([(7, 9, [1.0, 0.0])], "story long, article_id long, vector array<double>")
    near = stories._nearest(rows, opened, 1, 8, 72)
    best = stories._best_member(near.select("article_id", "story"), rows, members)
    assert [tuple(r) for r in best.collect()] == [(1, 7, 1.0)]
    for found in (near, best):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held,listed,slices", [(2000, 2, 3), (0, 2, None), (0, 8, None)])
def test_slices_end_early_only_beyond_the_held_stories(spark, monkeypatch, held, listed, slices):
    """Articles around 30 centres change every open story in a slice; a task that holds all stories decides to its end."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 64))
    rows = [(i, i / 25, (centres[rng.integers(30)] + 1.5 * rng.normal(size=64)).tolist()) for i in range(1500)]
    rounds, decider = [], stories._decider
    monkeypatch.setattr(stories, "HELD", held)
    monkeypatch.setattr(stories, "_decider", lambda *settings: rounds.append(1) or decider(*settings))
    timed = spark.createDataFrame(rows, "article_id long, t double, embedding array<double>")
    got = {r["article_id"]: r["story"] for r in stories.assign_stories(timed, 0.18, slice_rows=500, listed=listed).collect()}
    assert got == folded(rows)
    assert slices is None or len(rounds) == slices
