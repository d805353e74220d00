"""Search grids over boxes, density bins and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres per degree of latitude, least cosine.
KM_PER_DEGREE = 111.32
LEAST_COS = 1e-6


def steps(box: Column, cell_km: Column) -> tuple[Column, Column]:
    """Degrees per cell north and east, the latter at the box's middle latitude."""
    c = F.cos(F.radians((box["min_lat"] + box["max_lat"]) / 2))
    c = F.when(F.abs(c) < LEAST_COS, F.when(c < 0, -LEAST_COS).otherwise(LEAST_COS)).otherwise(c)
    return cell_km / F.lit(KM_PER_DEGREE), cell_km / (F.lit(KM_PER_DEGREE) * c)


def axis_count(lo: Column, hi: Column, step: Column) -> Column:
    """How many centres lie below ``hi``: from half a step on, whole steps added one after the other.

    Repeated addition can end on the other side of ``hi`` than a product would, so it is carried out.
    """
    most = (F.ceil((hi - lo) / step) + 2).cast("int")
    zero = F.struct((lo + step / 2).alias("at"), F.lit(0).cast("long").alias("n"))
    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), zero, lambda a, _: F.struct((a["at"] + step).alias("at"), (a["n"] + (a["at"] < hi).cast("long")).alias("n")))
    return walk["n"]


def grid_estimate(runs: DataFrame, box: str = "box", cell_km: str = "cell_km", queries: str = "queries") -> DataFrame:
    """(run_id, rows, columns, cells, searches); cells that can't advance the grid give nulls."""
    b = F.col(box)
    north, east = steps(b, F.col(cell_km))
    moves = F.col(cell_km) > 0
    for edge, step in (("min_lat", north), ("max_lat", north), ("min_lon", east), ("max_lon", east)):
        moves &= b[edge] + step / 2 > b[edge]
    d = runs.withColumn("rows", F.when(moves, axis_count(b["min_lat"], b["max_lat"], north))).withColumn("columns", F.when(moves, axis_count(b["min_lon"], b["max_lon"], east)))
    return d.select("run_id", "rows", "columns", (F.col("rows") * F.col("columns")).alias("cells"), (F.col("rows") * F.col("columns") * F.col(queries)).alias("searches"))


def edges(lo: Column, hi: Column, n: Column) -> Column:
    """Edges of ``n`` equal bins: lo + i * height, the last one exactly ``hi``."""
    h = (hi - lo) / n
    return F.concat(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: lo + i * h), F.array(hi))


def _edge(lo: Column, hi: Column, n: Column, k: Column) -> Column:
    """Edge number ``k`` of ``n`` equal bins, 0 to n; the last one exactly ``hi``."""
    return F.when(k >= n, hi).otherwise(lo + k * ((hi - lo) / n))


def bin_of(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    """The bin of a value: an inner edge belongs to the upper bin, the maximum to the last; null outside.

    The bin follows from the offset; as its edge may round to the other side of the value, both neighbours are looked at.
    """
    k = F.greatest(F.lit(0), F.least(F.floor((x - lo) / ((hi - lo) / n)).cast("long"), n - 1))
    k = F.when((k > 0) & (x < _edge(lo, hi, n, k)), k - 1).when((k + 1 < n) & (x >= _edge(lo, hi, n, k + 1)), k + 1).otherwise(k)
    return F.when((x >= lo) & (x <= hi), k)


def bin_boxes(grids: DataFrame) -> DataFrame:
    """(run_id, row, column, min_lat, max_lat, min_lon, max_lon) of every bin of grids (run_id, box, rows, columns)."""
    e = grids.select("run_id", "box", "rows", "columns", F.explode(F.expr("sequence(0L, rows - 1)")).alias("row"))
    e = e.withColumn("column", F.explode(F.expr("sequence(0L, columns - 1)")))
    lat = lambda k: _edge(F.col("box.min_lat"), F.col("box.max_lat"), F.col("rows"), k)
    lon = lambda k: _edge(F.col("box.min_lon"), F.col("box.max_lon"), F.col("columns"), k)
    r, c = F.col("row"), F.col("column")
    return e.select("run_id", "row", "column", lat(r).alias("min_lat"), lat(r + 1).alias("max_lat"), lon(c).alias("min_lon"), lon(c + 1).alias("max_lon"))


def origins(lo: Column, hi: Column, step: Column) -> Column:
    """The centres below ``hi``, from half a step on, whole steps added one after the other."""
    most = (F.ceil((hi - lo) / step) + 2).cast("int")
    zero = F.struct((lo + step / 2).alias("at"), F.array().cast("array<double>").alias("all"))
    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), zero, lambda a, _: F.struct((a["at"] + step).alias("at"), F.when(a["at"] < hi, F.concat(a["all"], F.array(a["at"]))).otherwise(a["all"]).alias("all")))
    return walk["all"]


def distinct_at(places: Column, digits: int = 6) -> Column:
    """Whether no two of the places coincide once rounded."""
    return F.size(F.array_distinct(F.transform(places, lambda p: F.round(p, digits)))) == F.size(places)


def density_bins(points: DataFrame, grids: DataFrame, tier_a: int, tier_b: int) -> DataFrame:
    """(run_id, row, column, business_count, tier) of every bin, empty ones included.

    points: (run_id, latitude, longitude); grids: (run_id, box, rows, columns).
    """
    g = grids.filter("rows > 0 and columns > 0")
    row = bin_of(F.col("latitude"), F.col("box.min_lat"), F.col("box.max_lat"), F.col("rows"))
    column = bin_of(F.col("longitude"), F.col("box.min_lon"), F.col("box.max_lon"), F.col("columns"))
    hit = points.join(g, "run_id").select("run_id", row.alias("row"), column.alias("column"))
    n = hit.filter("row is not null and column is not null").groupBy("run_id", "row", "column").agg(F.count("*").alias("business_count"))
    every = g.select("run_id", F.explode(F.expr("sequence(0L, rows - 1)")).alias("row"), "columns")
    every = every.select("run_id", "row", F.explode(F.expr("sequence(0L, columns - 1)")).alias("column"))
    out = every.join(n, ["run_id", "row", "column"], "left").withColumn("business_count", F.coalesce("business_count", F.lit(0)))
    return out.withColumn("tier", F.when(F.col("business_count") >= tier_a, "A").when(F.col("business_count") >= tier_b, "B").otherwise("unselected"))


def tier_summary(bins: DataFrame) -> DataFrame:
    tier = lambda t: F.count_if(F.col("tier") == t)
    return bins.groupBy("run_id").agg(
        tier("A").alias("tier_a_bins"), tier("B").alias("tier_b_bins"), tier("unselected").alias("unselected_bins"), F.count_if(F.col("tier") != "unselected").alias("selected_bins"),
        F.count("*").alias("total_bins"), F.sum("business_count").alias("businesses"), F.round(F.count_if(F.col("tier") != "unselected") / F.count("*"), 6).alias("selected_share"),
    )
