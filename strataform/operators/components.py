"""Connected components by alternating large and small stars.

Every round is two joins of the edge list with the smallest neighbour per node, so no node's neighbours are gathered
in one task and nothing but a checksum reaches the driver. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import materialize


def links_by_shared_key(rows: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(u, v): every id whose key occurs again, linked to the smallest id with that key; one link per id and key.

    A key shared by a third of all rows gives as many links, not pairs; its rows are joined with a single row.
    """
    r = rows.select(F.col(id_col).alias("u"), F.col(key_col).alias("k")).filter(F.col("k").isNotNull() & F.col("u").isNotNull())
    least = r.groupBy("k").agg(F.min("u").alias("v"), F.max("u").alias("hi")).filter(F.col("v") < F.col("hi")).drop("hi")
    return r.join(least, "k").filter(F.col("u") != F.col("v")).select("u", "v").distinct()


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v."""
    if large:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(m, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(m.select("u", F.col("m").alias("v")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, group_id) for every node of the links (u, v); group_id is the smallest id. Nodes without links have no row."""
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    before, e = None, materialize(e, "links")
    for _ in range(max_rounds):
        step = _stars(_stars(e, True).filter("u != v").distinct(), False).filter("u != v").distinct()
        e = materialize(step, "stars")
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("group_id")).union(e.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())
