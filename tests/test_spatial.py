import math

import numpy as np

from pyspark.sql import functions as F

from strataform.operators.spatial import EARTH_M, Tree, accepted_pairs, containing_regions, near_and_within, near_pairs, points
from strataform.plans.problems import p2_found

B = "id long, latitude double, longitude double, key string"
A = "area_id long, min_lat double, min_lon double, max_lat double, max_lon double"


def brute(points, areas, metres=120.0):
    ok = [(i, a, o) for i, a, o in points if None not in (a, o) and not math.isnan(a) and -90 <= a <= 90 and -180 <= o <= 180 and (a, o) != (0, 0)]
    out = set()
    lat, lon = np.radians([p[1] for p in ok]), np.radians([p[2] for p in ok])
    for k, (i, a, o) in enumerate(ok):
        h = np.sin((lat - lat[k]) / 2) ** 2 + np.cos(lat) * np.cos(lat[k]) * np.sin((lon - lon[k]) / 2) ** 2
        for j in np.nonzero(2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1))) <= metres)[0]:
            if ok[j][0] > i:
                out.add(("near", i, ok[j][0]))
        for n, la, lo, ha, ho in areas:
            if la <= a <= ha and (lo <= o <= ho if lo <= ho else o >= lo or o <= ho):
                out.add(("in", i, n))
    return out


def test_whole_table(spark, data):
    pts = [tuple(r) for r in spark.read.parquet(f"{data}/businesses.parquet").select("id", "latitude", "longitude").collect()]
    areas = [tuple(r) for r in spark.read.parquet(f"{data}/areas.parquet").select("area_id", "min_lat", "min_lon", "max_lat", "max_lon").collect()]
    got = [tuple(r) for r in p2_found(spark, data).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pts, areas)


def test_poles_meridian_copies_blocks(spark):
    rng = np.random.default_rng(3)
    pts = [(1, 89.9999, 10.0), (2, 89.9999, -170.0), (3, -90.0, 0.0), (4, -90.0, 77.0), (5, 10.0, 180.0), (6, 10.0, -180.0), (7, 10.0, -179.9995), (8, None, 1.0), (9, 1.0, float("nan")), (10, 0.0, 0.0), (11, 95.0, 0.0), (12, 0.0, 190.0)]
    pts += [(100 + k, 45.0, 45.0) for k in range(40)]
    pts += [(1000 + k, 45 + float(a), 45 + float(o)) for k, (a, o) in enumerate(rng.normal(0, 0.002, (300, 2)))]
    areas = [(1, 9.0, 179.0, 11.0, -179.0), (2, 45.0, 45.0, 45.0, 45.0), (3, -90.0, -180.0, 90.0, 180.0), (4, 50.0, 0.0, 40.0, 90.0), (5, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(*p, "x") for p in pts] + [(100, 45.0, 45.0, "again")], B)
    got = [tuple(r) for r in near_and_within(df, spark.createDataFrame(areas, A), leaf_rows=8, block_rows=16).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pts, [a for a in areas if a[1] is not None])


def test_empty(spark):
    assert near_and_within(spark.createDataFrame([], B), spark.createDataFrame([], A)).count() == 0


def test_accepted_nodes_are_not_descended(spark):
    """A crowd within a few metres ends at an inner node, as one pair; its points are paired from there."""
    rng = np.random.default_rng(4)
    pts = [(k, 45 + float(a), 45 + float(o)) for k, (a, o) in enumerate(rng.uniform(0, 0.0003, (200, 2)))] + [(500 + k, -10.0 + k, 3.0) for k in range(40)]
    tree = Tree(points(spark.createDataFrame([(*p, "x") for p in pts], B)), 4, 64)
    pairs = accepted_pairs(tree, 120.0).collect()
    assert [r for r in pairs if r.sure and not (r.a_leaf and r.b_leaf)]
    inner = {r.key: r.n for r in tree.nodes.filter("not leaf").collect()}
    assert sum(inner.get(r.a_key, 0) for r in pairs if r.sure and r.a_key == r.b_key) >= 200
    assert {("near", *r) for r in near_pairs(tree, 120.0).collect()} == brute(pts, [])


def test_hot_leaf_is_joined_in_blocks(spark):
    """Twenty regions around twenty thousand points at one place: no key of a join has more than about a block."""
    rows = spark.range(20_000).select("id", F.lit(45.0).alias("latitude"), F.lit(45.0).alias("longitude"))
    tree = Tree(points(rows), 32, 512)
    areas = spark.createDataFrame([(k, 44.0 - k, 44.0, 46.0, 46.0 + k) for k in range(20)], A)
    assert tree.points.groupBy("key", "block").count().agg(F.max("count")).first()[0] <= 2 * 512
    assert tree.members(tree.nodes.filter("not leaf").select("key")).groupBy("key", "block").count().agg(F.max("count")).first()[0] <= 2 * 512
    assert containing_regions(tree, areas).count() == 20 * 20_000
