"""Redirects between subjects: where each one ends, what ends in each one, and what never ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import materialize


def resolve(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, root, steps, state) for redirects (id, target), target null for a root.

    Pointer jumping: a round doubles the distance every row has gone, so chains of n need log2(n) rounds. State is
    resolved, missing (a target without a row) or cycle (no end after 2^max_rounds steps).
    """
    e = edges.select("id", "target").distinct()
    at = materialize(e.select("id", F.coalesce("target", "id").alias("root"), F.col("target").isNotNull().cast("long").alias("steps"), F.col("target").isNull().alias("ended")), "redirects")
    for _ in range(max_rounds):
        r = at.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("next_ended"))
        todo = at.filter(~F.col("ended")).join(r, "root", "left")
        lost = F.col("next").isNull()
        step = todo.select("id", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (lost | F.col("next_ended")).alias("ended"), lost.alias("lost"))
        at2 = at.filter("ended").select("id", "root", "steps", "ended", *(["lost"] if "lost" in at.columns else [F.lit(False).alias("lost")])).unionByName(step)
        at2 = materialize(at2, "redirects")
        at = at2
        left, least, rows = at.agg(F.count_if(~F.col("ended")), F.min(F.when(~F.col("ended"), F.col("steps"))), F.count("*")).first()
        # once every distance left exceeds the number of rows there is only going round
        if left == 0 or least > rows:
            break
    state = F.when(~F.col("ended"), "cycle").when(F.col("lost"), "missing").otherwise("resolved")
    return at.select("id", F.when(F.col("ended"), F.col("root")).alias("root"), F.when(F.col("ended"), F.col("steps")).alias("steps"), state.alias("state"))


def closure(resolved: DataFrame) -> DataFrame:
    """(root, members): how many subjects end in each root, the root included."""
    return resolved.filter("state = 'resolved'").groupBy("root").agg(F.count("*").alias("members"), F.max("steps").alias("longest"))
