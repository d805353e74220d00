"""Subjects: which rows are one place, merges of places, loads against what is held, and checks between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import clean_text, strong_id
from strataform.operators.components import components, links_by_shared_key

IDS = ("place_id", "cid", "data_id")


def groups(rows: DataFrame) -> DataFrame:
    """(id, root) of all rows (id, strong ids): root is the smallest id of the rows linked directly or through others."""
    keys = F.array_compact(F.array(*[F.concat(F.lit(f"{c}:"), strong_id(F.col(c))) for c in IDS]))
    g = components(links_by_shared_key(rows.select("id", F.explode(keys).alias("k")), "id", "k"))
    return rows.select("id").distinct().join(g, "id", "left").select("id", F.coalesce("group_id", "id").alias("root"))


def canonical_targets(rows: DataFrame, group: DataFrame, created: Column) -> DataFrame:
    """(root, target, members): of each group the row created first, ties by id."""
    d = rows.join(group, "id")
    return d.groupBy("root").agg(F.min_by("id", F.struct(created, F.col("id"))).alias("target"), F.count("*").alias("members"))


def merges(group: DataFrame, targets: DataFrame, live: DataFrame) -> DataFrame:
    """(root, source, target, action) of the rows that go up into their group's target.

    refused where the group has several live rows (id): then none of its rows moves; else redirected.
    """
    n = group.join(live.select("id").withColumn("_live", F.lit(1)), "id", "left").groupBy("root").agg(F.count("_live").alias("live"))
    t = targets.filter("members > 1").join(n, "root")
    m = group.join(t, "root").filter("id <> target")
    return m.select("root", F.col("id").alias("source"), "target", F.when(F.col("live") > 1, "refused").otherwise("redirected").alias("action"))


def repointed(links: DataFrame, merged: DataFrame) -> DataFrame:
    """(location_id, business_id, held_by): the links after the merges; ``held_by`` is the business that had each before."""
    m = merged.filter("action = 'redirected'").select(F.col("source").alias("business_id"), "target")
    return links.join(m, "business_id", "left").select("location_id", F.coalesce("target", "business_id").alias("business_id"), F.col("business_id").alias("held_by"))


def lineage(resolved: DataFrame) -> DataFrame:
    """(root, member): every subject that ends in each root, the root too: the reverse closure, row by row."""
    return resolved.select("root", F.col("id").alias("member"))


def selected(selectors: DataFrame, by_key: DataFrame, resolved: DataFrame) -> DataFrame:
    """(kind, value, root, state) of selectors (kind, value) against keys (kind, value, id): found, ambiguous or missing."""
    k = by_key.join(resolved, "id").groupBy("kind", "value").agg(F.countDistinct("root").alias("n"), F.min("root").alias("root"))
    j = selectors.join(k, ["kind", "value"], "left")
    return j.select("kind", "value", F.when(F.col("n") == 1, F.col("root")).alias("root"), F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("state"))


def load_outcomes(new: DataFrame, held: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(outcome, n) of new rows, each key once, against held ones: inserted, repeated (equal) or collision (differing)."""
    digest = lambda d: d.groupBy(key).agg(F.max(F.sha2(F.to_json(F.struct(*columns)), 256)).alias("_h"))
    a, b = digest(new), digest(held).withColumnRenamed("_h", "_held")
    j = a.join(b, key, "left")
    return j.groupBy(F.when(F.col("_held").isNull(), "inserted").when(F.col("_held") == F.col("_h"), "repeated").otherwise("collision").alias("outcome")).agg(F.count("*").alias("n"))


def compared(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(change, n) between two states of a table: added, removed, changed, unchanged."""
    digest = lambda d, name: d.groupBy(key).agg(F.max(F.sha2(F.to_json(F.struct(*columns)), 256)).alias(name))
    j = digest(before, "_a").join(digest(after, "_b"), key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return j.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def upserts(records: DataFrame, fields: tuple[str, ...] = IDS) -> DataFrame:
    """(root, members, outcome) of records (root, strong ids): what an upsert does to each place.

    conflict where members hold different values of one strong id; merged where several agree; inserted where it is one.
    """
    n = records.groupBy("root").agg(F.count("*").alias("members"), *[F.countDistinct(strong_id(F.col(c))).alias(c) for c in fields])
    clash = F.lit(False)
    for c in fields:
        clash = clash | (F.col(c) > 1)
    return n.select("root", "members", F.when(clash, "conflict").when(F.col("members") > 1, "merged").otherwise("inserted").alias("outcome"))


def legacy_matches(rows: DataFrame) -> DataFrame:
    """(id, older, same_site) of rows that an older key without website would have taken for one: the same title, address
    and phone as the smallest such id; ``same_site`` tells whether the match is accepted, the websites being equal."""
    parts = [F.lower(F.coalesce(clean_text(F.col(c)), F.lit(""))) for c in ("title", "address", "phone")]
    d = rows.withColumn("_k", F.when(F.concat(*parts) != "", F.sha2(F.concat_ws("|", *parts), 256))).filter("_k is not null")
    first = d.groupBy("_k").agg(F.min(F.struct("id", F.coalesce(clean_text(F.col("website")), F.lit("")).alias("site"))).alias("_f"))
    j = d.join(first, "_k").filter(F.col("id") > F.col("_f.id"))
    return j.select("id", F.col("_f.id").alias("older"), (F.coalesce(clean_text(F.col("website")), F.lit("")) == F.col("_f.site")).cast("int").alias("same_site"))
