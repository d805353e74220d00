import json

import pytest
from pyspark.sql import functions as F

from strataform.operators import canonical, graph, quality, sessions
from strataform.operators.facts import reconcile, scd2
from strataform.operators.grid import bin_of, edges, grid_estimate
from strataform.operators.reviews import normalise

COLS = "seq long, run_id string, seen_at string, place_id string, cid string, data_id string, title string, address string, phone string, website string"


def rec(seq, run, at, place=None, cid=None, data=None, title="T"):
    return (seq, run, at, place, cid, data, title, None, None, None)


def test_ids_converge_and_the_latest_title_wins(spark):
    rows = [rec(1, "r1", "2024-01-01", place="p", title="Old"), rec(2, "r1", "2024-01-01", cid="c"), rec(3, "r2", "2024-01-02", place="p", cid="c", title="New"), rec(4, "r0", "2023-01-01", place="p", title="Ancient")]
    got = canonical.canonicalise(spark.createDataFrame(rows, COLS)).collect()
    assert [(r.canonical_key, r.place_id, r.cid, r.title, r.first_run_id, r.last_run_id, r.runs) for r in got] == [("place:p", "p", "c", "New", "r0", "r2", ["r0", "r1", "r2"])]


def test_reingest_changes_nothing_and_unidentified_rows_stay_out(spark):
    rows = [rec(1, "r1", "2024-01-01", place="p"), rec(2, "r1", "2024-01-01", place="p"), rec(3, "r1", "2024-01-01", title=None), rec(4, "r1", "2024-01-01", title="Only title")]
    got = {r.canonical_key.split(":")[0] for r in canonical.canonicalise(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {"place", "fallback"}


def test_classes_in_order(spark):
    d = spark.createDataFrame([(None, 1.0, "k"), (9.0, 1.0, "k"), (1.0, 1.0, None), (2.0, 2.0, "k"), (0.0, 0.0, "k")], "lat double, lon double, k string")
    d = d.withColumn("box", F.struct(*[F.lit(v).alias(n) for n, v in (("min_lat", 0.0), ("min_lon", 0.0), ("max_lat", 2.0), ("max_lon", 2.0))]))
    got = [r.c for r in d.select(canonical.record_class(F.col("lat"), F.col("lon"), F.col("box"), F.col("k")).alias("c")).collect()]
    assert got == ["unlocated", "out_of_bounds", "unidentified", "accepted", "accepted"]


def _grid(spark, box, km, q=1):
    d = spark.createDataFrame([("r", box, km, q)], "run_id string, box struct<min_lat:double,min_lon:double,max_lat:double,max_lon:double>, cell_km double, queries long")
    return tuple(grid_estimate(d).first())[1:]


def test_grid_literals(spark):
    assert _grid(spark, (0.0, 0.0, 1.0, 1.0), 1.0) == (111, 111, 12321, 12321)
    assert _grid(spark, (0.0, 0.0, 0.001, 0.001), 1.0)[2] == 0
    assert _grid(spark, (45.0, 45.0, 46.0, 46.0), 1e-13) == (None, None, None, None)
    assert _grid(spark, (0.0, 0.0, 0.04, 0.04), 2.0)[:2] == (2, 2)


@pytest.mark.parametrize("box", [(0.17, 135.17, 0.47, 135.42), (-45.3, -0.1, -45.0, 0.2), (59.9, 10.0, 60.1, 10.5)])
def test_grid_counts_by_walking(spark, box):
    import math

    km = 0.7
    north = km / 111.32
    east = km / (111.32 * math.cos(math.radians((box[0] + box[2]) / 2)))

    def walk(lo, hi, step):
        at, n = lo + step / 2, 0
        while at < hi:
            at, n = at + step, n + 1
        return n

    assert _grid(spark, box, km)[:2] == (walk(box[0], box[2], north), walk(box[1], box[3], east))


def test_bins_own_their_lower_edge(spark):
    d = spark.createDataFrame([(0.0,), (0.02,), (0.04,), (0.019999,), (0.05,), (None,)], "x double")
    e = edges(F.lit(0.0), F.lit(0.04), F.lit(2).cast("long"))
    assert [r.b for r in d.select(bin_of(F.col("x"), F.lit(0.0), F.lit(0.04), F.lit(2).cast("long")).alias("b")).collect()] == [0, 1, 1, 0, None, None]


def test_redirects(spark):
    e = [(k, k - 1 if k else None) for k in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 9999), (2001, 2000), (1, 0)]
    got = {r.id: (r.root, r.steps, r.state) for r in graph.resolve(spark.createDataFrame(e, "id long, target long")).collect()}
    assert all(got[k] == (0, k, "resolved") for k in range(300))
    assert all(got[k][2] == "cycle" for k in (1000, 1001, 1002, 1003))
    assert got[2001] == (9999, 2, "missing")
    assert graph.resolve(spark.createDataFrame([], "id long, target long")).count() == 0


def test_streaks(spark):
    d = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "complete"), ("a", 3, "failed"), ("a", 9, "failed"), ("b", 1, "failed"), ("c", 1, "complete")], "k string, at long, status string")
    got = {r.k: (r.sessions, r.streak, r.streak_recent) for r in sessions.failure_streaks(d, "k", "at", F.col("status") == "failed", 10, 3).collect()}
    assert got == {"a": (4, 2, 1), "b": (1, 1, 0), "c": (1, 0, 0)}


def test_completion_uses_every_id_once(spark):
    e = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k long")
    c = spark.createDataFrame([(1,), (3,), (3,), (7,)], "k long")
    assert tuple(sessions.completion(e, c, "k").first()) == (2, 2, 1)


def test_latest_and_ties(spark):
    d = spark.createDataFrame([("a", 5, "x"), ("a", 5, "w"), ("a", 1, "v"), ("b", 2, "u")], "k string, at long, i string")
    assert {tuple(r) for r in sessions.latest_or_tie(d, "k", "at", "i").collect()} == {("a", "w", 5, 2), ("b", "u", 2, 1)}


def test_outcomes(spark):
    o = spark.createDataFrame([("new", "1", 5), ("same", "1", 5), ("fixed", "2", 5), ("late", "2", 1), ("moved", "2", 5)], "k string, value_hash string, observed_at long")
    h = spark.createDataFrame([("same", "1", 3, 0), ("fixed", "1", 3, 0), ("late", "1", 3, 1), ("moved", "1", 3, 1)], "k string, value_hash string, valid_from long, soft int")
    got = {r.k: r.outcome for r in reconcile(o, h, ["k"], F.col("h.soft") == 1).collect()}
    assert got == {"new": "created", "same": "supported", "fixed": "deferred", "late": "deferred", "moved": "replaced"}


def test_versions_close(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("b", 2, "z")], "k string, at long, i string")
    assert {(r.i, r.closed_at) for r in scd2(d, ["k"], "at", "i").collect()} == {("x", 4), ("y", None), ("z", None)}
    assert {(r.i, r.closed_at) for r in scd2(d, ["k"], "at", "i", hot_rows=1, chunk_rows=1).collect()} == {("x", 4), ("y", None), ("z", None)}


def test_fingerprint_ignores_order(spark):
    a = spark.range(100).selectExpr("id", "cast(id % 7 as string) s")
    assert quality.fingerprint(a, "id", "s").first() == quality.fingerprint(a.orderBy(F.desc("id")).repartition(5), "id", "s").first()
    assert quality.fingerprint(a, "id", "s").first() != quality.fingerprint(a.filter("id <> 3"), "id", "s").first()
    assert quality.difference(a, a).count() == 0
    assert quality.absent(a.union(a), a.filter("id < 90"), "id").count() == 10
    assert [tuple(r) for r in quality.difference(a.union(a.limit(1)), a).collect()] == [("missing", 1)]


def test_review_fields(spark):
    o = {"Rating": 4, "rating_float": 0, "text_original": " ", "Description": "d", "posted_at_unix_micros": 0, "Name": "secret", "ProfilePicture": "p", "reply_text": "r"}
    r = spark.createDataFrame([(json.dumps(o),), ("{bad",), (None,)], "raw string").select(normalise(F.col("raw")).alias("r")).select("r.*").collect()
    assert (r[0].rating, r[0].text_original, r[0].posted_us, r[0].reply_text) == (4.0, "d", None, "r") and "Name" not in r[0].asDict()
    assert r[2].rating is None


def test_status_moves_with_hot_keys(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    rows = lambda d: {tuple(r) for r in d.collect()}
    assert rows(sessions.status_moves(e, "user_id", "at", "event_id", "event_type")) == rows(sessions.status_moves(e, "user_id", "at", "event_id", "event_type", hot_rows=3, chunk_rows=2))


def test_all_ten_fields_become_facts(spark, data):
    from strataform.plans.reference import QUERIES

    b = spark.read.parquet(f"{data}/businesses.parquet")
    got = QUERIES["facts_unpivot"](spark, data)
    assert got.select("predicate").distinct().count() == 10
    for c in ("latitude", "longitude"):
        facts = got.filter(f"predicate = 'location.{c}'").collect()
        held = sorted((r.id, r[c]) for r in b.filter(f"{c} is not null").collect())
        assert sorted((r.business_id, float(r.value)) for r in facts) == held


def test_entry_keeps_every_mutable_field(spark):
    import __spark_entry__
    from strataform.operators.canonical import MUTABLE

    got = __spark_entry__.entry(spark)
    assert set(MUTABLE) <= set(got.columns)
    assert all(got.filter(f"{c} is not null").count() > 0 for c in MUTABLE)
