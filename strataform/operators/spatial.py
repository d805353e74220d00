"""Points near other points, and the regions that hold them, by a dual-tree join.

Method. A tree over latitude and longitude splits a node into 8 x 8 children until it holds at most ``leaf_rows``
points or the last level is reached. Every node carries the tight box of its points, on the unit sphere (x, y, z)
and in degrees. The join starts from the root pair and compares boxes: pairs whose boxes lie too far apart are
dropped, pairs whose farthest corners are near enough are accepted as they stand and descended no further, all others
are replaced by their children. What is left are pairs of leaves, whose points are compared in distributed tasks; the
points of accepted nodes are paired unseen. Regions descend the same tree: a node inside a region is accepted whole.
Distances between boxes are chords through the sphere, so poles and the 180th meridian need no special case.

Skew. Only tree nodes are joined on the way down. A node with more than ``block_rows`` points, such as copies of one
place, is cut into blocks, and nodes are joined with nodes, and with regions, block by block.

Defined results: rows whose coordinate is null, NaN, (0, 0) or out of range take no part; points at one place are near
each other; a repeated row counts once; regions with a null or an inverted latitude hold nothing; empty tables give
empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.session import materialize

EARTH_M = 6_371_008.8
LEVELS = (4, 7, 10, 13, 16, 19)
_BOX = ("lat", "lon", "x", "y", "z")


def _key(level: int, ix: Column, iy: Column) -> Column:
    return (F.lit(level << 40) + F.shiftleft(ix, 20) + iy).cast("long")


def _coarser(level: int, step: int) -> Column:
    """The key of the parent of a node ``key`` at ``level``, ``step`` levels up."""
    code = F.col("key") - F.lit(level << 40)
    return _key(level - step, F.shiftright(F.shiftright(code, 20), step), F.shiftright(code.bitwiseAND(F.lit((1 << 20) - 1)), step))


def usable(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def points(df: DataFrame, id_col: str = "id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Usable points with their place on the unit sphere and the key of their cell on the last level."""
    p = df.select(F.col(id_col).cast("long").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p = p.filter(usable(F.col("lat"), F.col("lon")) & F.col("id").isNotNull())
    n, last = 1 << LEVELS[-1], LEVELS[-1]
    ix = F.least(F.floor((F.col("lon") + 180) / 360 * n), F.lit(n - 1)).cast("long")
    iy = F.least(F.floor((F.col("lat") + 90) / 180 * n), F.lit(n - 1)).cast("long")
    la, lo = F.radians("lat"), F.radians("lon")
    return p.select("id", "lat", "lon", (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"), _key(last, ix, iy).alias("cell"))


class Tree:
    """All nodes of all levels, from one aggregation. ``kids(depth)``: nodes of a level with their parent's key, and the
    leaves of the levels above, each as its own child."""

    def __init__(self, pts: DataFrame, leaf_rows: int, block_rows: int):
        boxes = [f(c).alias(f"{c}{s}") for c in _BOX for f, s in ((F.min, 0), (F.max, 1))]
        up = [f(f"{c}{s}").alias(f"{c}{s}") for c in _BOX for f, s in ((F.min, 0), (F.max, 1))]
        last = LEVELS[-1]
        fine = pts.groupBy(F.col("cell").alias("key")).agg(F.count("*").alias("n"), *boxes)
        at = [F.struct(F.lit(lv).alias("level"), (F.col("key") if lv == last else _coarser(last, last - lv)).alias("key")) for lv in LEVELS]
        nodes = fine.withColumn("at", F.explode(F.array(*at))).drop("key").select("at.level", "at.key", "n", *[f"{c}{s}" for c in _BOX for s in (0, 1)])
        nodes = nodes.groupBy("level", "key").agg(F.sum("n").alias("n"), *up)
        parent = F.lit(0).cast("long")
        for above, lv in zip(LEVELS, LEVELS[1:]):
            parent = F.when(F.col("level") == lv, _coarser(lv, lv - above)).otherwise(parent)
        nodes = materialize(nodes.withColumn("parent", parent), "nodes", rebalance=True)
        split = nodes.filter(F.col("n") > leaf_rows).select(F.col("key").alias("parent"))
        # a node is part of the tree if its parent was split
        self.nodes = nodes.filter("parent = 0").unionByName(nodes.filter("parent <> 0").join(split, "parent", "left_semi").select(*nodes.columns))
        self.nodes = materialize(self.nodes.withColumn("leaf", (F.col("n") <= leaf_rows) | (F.col("level") == last)), "tree", ["level"], rebalance=True)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int")
        self.sizes = self.nodes.select("key", blocks.alias("blocks"))
        self.depth = LEVELS.index(self.nodes.agg(F.coalesce(F.max("level"), F.lit(LEVELS[0]))).first()[0]) + 1
        self.points = self._with_leaf(pts)

    def kids(self, depth: int) -> DataFrame:
        own = self.nodes.filter(F.col("level") == LEVELS[depth])
        return own.unionByName(self.nodes.filter(F.col("leaf") & (F.col("level") < LEVELS[depth])).withColumn("parent", F.col("key")))

    def _with_leaf(self, pts: DataFrame) -> DataFrame:
        """Points with leaf key and block. A point's leaf is the one leaf among its cell's ancestors."""
        leaves = self.nodes.filter("leaf").select("key").join(self.sizes, "key")
        cells = pts.select("cell").distinct().select("cell", F.explode(_ancestors()).alias("key"))
        cells = cells.join(leaves, "key").select("cell", "key", "blocks")
        return materialize(pts.join(cells, "cell").select("id", "lat", "lon", "x", "y", "z", "cell", "key", _block()), "leafed")

    def members(self, inner: DataFrame) -> DataFrame:
        """Points with the key and block of their leaf, and again with those of each of the nodes ``inner`` (key) above."""
        if inner.isEmpty():
            return self.points
        up = self.points.drop("key", "block").withColumn("key", F.explode(_ancestors()))
        up = up.join(inner.join(self.sizes, "key"), "key").select("id", "lat", "lon", "x", "y", "z", "cell", "key", _block())
        return self.points.unionByName(up)


def _ancestors() -> Column:
    last = LEVELS[-1]
    return F.array(*[_ancestor(F.col("cell"), last - lv, lv) for lv in LEVELS])


def _ancestor(cell: Column, step: int, level: int) -> Column:
    code = cell - F.lit(LEVELS[-1] << 40)
    return _key(level, F.shiftright(F.shiftright(code, 20), step), F.shiftright(code.bitwiseAND(F.lit((1 << 20) - 1)), step))


def _block() -> Column:
    return F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")


def _gap2(axes=("x", "y", "z")) -> Column:
    parts = [F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1")) for c in axes]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _span2(axes=("x", "y", "z")) -> Column:
    parts = [F.greatest(F.col(f"a_{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"a_{c}0")) for c in axes]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _side(df: DataFrame, s: str, names) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{s}_{c}") for c in names])


def accepted_pairs(tree: Tree, metres: float) -> DataFrame:
    """(a_key, a_leaf, b_key, b_leaf, sure): pairs of nodes that hold all near pairs of points, each once.

    ``sure`` pairs are near in all their points and may be of any level; the others are pairs of leaves.
    """
    reach2 = (2 * math.sin(min(metres / (2 * EARTH_M), math.pi / 2))) ** 2
    names = ["key", "parent", "leaf", *[f"{c}{s}" for c in ("x", "y", "z") for s in (0, 1)]]
    keep = [f"{s}_{c}" for s in "ab" for c in names if c != "parent"] + ["sure"]
    pairs, done = None, []
    for depth in range(tree.depth):
        kids = tree.kids(depth)
        a, b = _side(kids, "a", names), _side(kids, "b", names)
        if pairs is None:
            step = a.join(b, (F.col("a_parent") == F.col("b_parent")) & (F.col("a_key") <= F.col("b_key")))
        else:
            half = pairs.select(F.col("a_key").alias("p_a"), F.col("b_key").alias("p_b"), *[f"b_{c}{s}" for c in ("x", "y", "z") for s in (0, 1)])
            half = half.join(a, F.col("p_a") == F.col("a_parent")).filter(_gap2() <= reach2 * (1 + 1e-6))
            half = half.drop(*[f"b_{c}{s}" for c in ("x", "y", "z") for s in (0, 1)])
            step = half.join(b, F.col("p_b") == F.col("b_parent")).filter((F.col("p_a") != F.col("p_b")) | (F.col("a_key") <= F.col("b_key")))
        step = step.filter(_gap2() <= reach2 * (1 + 1e-6)).withColumn("sure", _span2() <= reach2 * (1 - 1e-6)).select(*keep)
        last = depth == tree.depth - 1
        ended = F.col("sure") | (F.col("a_leaf") & F.col("b_leaf"))
        step = step if last else materialize(step, f"pairs{depth}", rebalance=True)
        done.append((step if last else step.filter(ended)).select("a_key", "a_leaf", "b_key", "b_leaf", "sure"))
        pairs = step.filter(~ended)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def near_pairs(tree: Tree, metres: float) -> DataFrame:
    """(left_id, right_id), the smaller first, of points at most ``metres`` apart on the sphere."""
    reach2 = (2 * math.sin(min(metres / (2 * EARTH_M), math.pi / 2))) ** 2
    pairs = materialize(accepted_pairs(tree, metres), "accepted")
    inner = pairs.filter("not a_leaf").select(F.col("a_key").alias("key")).union(pairs.filter("not b_leaf").select("b_key")).distinct()
    points = tree.members(inner)
    cut = pairs.join(_side(tree.sizes, "a", ["key", "blocks"]), "a_key").join(_side(tree.sizes, "b", ["key", "blocks"]), "b_key")
    cut = cut.withColumn("a_block", F.explode(F.expr("sequence(0, a_blocks - 1)"))).withColumn("b_block", F.explode(F.expr("sequence(0, b_blocks - 1)")))
    cut = cut.select("a_key", "a_block", "b_key", "b_block", "sure")
    at = ["key", "block", "id", "x", "y", "z"]
    met = cut.join(_side(points, "a", at), ["a_key", "a_block"]).join(_side(points, "b", at), ["b_key", "b_block"])
    chord2 = sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "yz"), (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")))
    met = met.filter(((F.col("a_key") != F.col("b_key")) | (F.col("a_id") < F.col("b_id"))) & (F.col("sure") | (chord2 <= reach2)))
    return met.select(F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id"))


def containing_regions(tree: Tree, regions: DataFrame, id_col: str = "area_id") -> DataFrame:
    """(left_id, right_id) of point and box region, edges included; a box from east to west crosses the 180th meridian."""
    r = regions.select(F.col(id_col).cast("long").alias("area"), *[F.col(c).cast("double").alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    r = r.filter((F.col("min_lat") <= F.col("max_lat")) & F.col("min_lon").isNotNull() & F.col("max_lon").isNotNull() & F.col("area").isNotNull())
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.col("min_lon"), F.col("max_lon")
    r = r.select("area", "min_lat", "max_lat", F.explode(F.when(lo <= hi, F.array(part(lo, hi))).otherwise(F.array(part(lo, F.lit(180.0)), part(F.lit(-180.0), hi)))).alias("s"))
    r = r.select("area", "min_lat", "max_lat", F.col("s.lo").alias("min_lon"), F.col("s.hi").alias("max_lon"))
    n = 1 << LEVELS[0]
    cell = lambda c, off, width: F.greatest(F.lit(0), F.least(F.floor((c + off) / width * n), F.lit(n - 1))).cast("long")
    r = r.withColumn("ix", F.explode(F.sequence(cell(F.col("min_lon"), 180, 360), cell(F.col("max_lon"), 180, 360))))
    r = r.withColumn("iy", F.explode(F.sequence(cell(F.col("min_lat"), 90, 180), cell(F.col("max_lat"), 90, 180))))
    box = ["area", "min_lat", "max_lat", "min_lon", "max_lon"]
    # one chain of left joins: a node wholly inside leaves the descent with a key that meets nothing, and stays a row
    hit = r.select(*box, _key(LEVELS[0], F.col("ix"), F.col("iy")).alias("key"), F.lit(False).alias("leaf"), F.lit(False).alias("sure"))
    for depth in range(tree.depth):
        k = tree.kids(depth).select(F.col("key").alias("kid"), F.col("leaf").alias("kid_leaf"), (F.col("key") if depth == 0 else F.col("parent")).alias("up"), "lat0", "lat1", "lon0", "lon1")
        step = hit.join(k, F.when(F.col("sure"), -F.col("key")).otherwise(F.col("key")) == F.col("up"), "left").filter(F.col("sure") | F.col("kid").isNotNull())
        apart = (F.col("lat1") < F.col("min_lat")) | (F.col("lat0") > F.col("max_lat")) | (F.col("lon1") < F.col("min_lon")) | (F.col("lon0") > F.col("max_lon"))
        inside = (F.col("lat0") >= F.col("min_lat")) & (F.col("lat1") <= F.col("max_lat")) & (F.col("lon0") >= F.col("min_lon")) & (F.col("lon1") <= F.col("max_lon"))
        hit = step.filter(F.col("sure") | ~apart).select(*box, F.when(F.col("sure"), F.col("key")).otherwise(F.col("kid")).alias("key"), F.when(F.col("sure"), F.col("leaf")).otherwise(F.col("kid_leaf")).alias("leaf"), (F.col("sure") | inside).alias("sure"))
    hit = materialize(hit, "regions")
    points = tree.members(hit.filter("not leaf").select("key").distinct()).select("key", "block", "id", "lat", "lon")
    cut = hit.drop("leaf").join(tree.sizes, "key").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    met = points.join(cut, ["key", "block"])
    met = met.filter(F.col("sure") | (F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))))
    return met.select(F.col("id").alias("left_id"), F.col("area").alias("right_id"))


def near_and_within(businesses: DataFrame, areas: DataFrame, metres: float = 120.0, leaf_rows: int = 32, block_rows: int = 2048) -> DataFrame:
    """(relation, left_id, right_id): ``near`` for points, ``in`` for the regions that hold a point."""
    pts = points(businesses).dropDuplicates(["id"])
    tree = Tree(pts, leaf_rows, block_rows)
    near = near_pairs(tree, metres).select(F.lit("near").alias("relation"), "left_id", "right_id")
    held = containing_regions(tree, areas).select(F.lit("in").alias("relation"), "left_id", "right_id")
    return near.unionByName(held)
