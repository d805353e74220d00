"""Records of collection runs: classification, identity, survivorship and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.identity import fallback_key, identity_key
from strataform.functions.text import clean_text
from strataform.operators.components import components, links_by_shared_key

BOX = "min_lat double, min_lon double, max_lat double, max_lon double"
MUTABLE = ("title", "category", "address", "latitude", "longitude", "phone", "website", "review_rating", "review_count", "status")
IDS = ("place_id", "cid", "data_id")


def record_payload(raw: Column) -> Column:
    """Typed fields of a raw record, legacy keys included; ``website_conflict`` where both website keys differ."""
    s = "title string, category string, address string, phone string, website string, web_site string, status string, latitude string, longitude string, longtitude string, review_rating string, review_count string"
    j = F.from_json(raw, s)
    a, b = clean_text(j["website"]), clean_text(j["web_site"])
    return F.struct(
        *[clean_text(j[c]).alias(c) for c in ("title", "category", "address", "phone", "status")],
        j["latitude"].try_cast("double").alias("latitude"),
        F.coalesce(j["longitude"], j["longtitude"]).try_cast("double").alias("longitude"),
        F.coalesce(a, b).alias("website"),
        F.coalesce(a != b, F.lit(False)).cast("int").alias("website_conflict"),
        j["review_rating"].try_cast("double").alias("review_rating"),
        j["review_count"].try_cast("long").alias("review_count"),
    )


def record_class(lat: Column, lon: Column, box: Column, key: Column) -> Column:
    """unlocated, out_of_bounds, unidentified or accepted; tested in this order, box edges included."""
    inside = lat.between(box["min_lat"], box["max_lat"]) & lon.between(box["min_lon"], box["max_lon"])
    return F.when(lat.isNull() | lon.isNull(), "unlocated").when(~F.coalesce(inside, F.lit(True)), "out_of_bounds").when(key.isNull(), "unidentified").otherwise("accepted")


def with_identity(df: DataFrame) -> DataFrame:
    """Adds ``identity``, the strongest key of each row; null where it has none."""
    fb = fallback_key(*[F.col(c) for c in ("title", "address", "phone", "website")])
    return df.withColumn("identity", identity_key(F.col("place_id"), F.col("cid"), F.col("data_id"), fb))


def ingest_counts(records: DataFrame, runs: DataFrame, run_col: str = "last_run_id") -> DataFrame:
    """Counters per run: raw, accepted, out_of_bounds, unlocated, unidentified. One shuffle, on the run."""
    r = runs.select(F.col("id").alias(run_col), F.from_json("bbox_json", BOX).alias("box"))
    d = with_identity(records).join(r, run_col)
    d = d.select(F.col(run_col).alias("run_id"), record_class(F.col("latitude"), F.col("longitude"), F.col("box"), F.col("identity")).alias("c"))
    kinds = ("accepted", "out_of_bounds", "unlocated", "unidentified")
    return d.groupBy("run_id").agg(F.count("*").alias("raw_records"), *[F.count_if(F.col("c") == k).alias(f"{k}_records") for k in kinds])


def run_metrics(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: members seen last in it and businesses first seen in it; 0 for runs without any."""
    seen = members.groupBy(F.col("last_run_id").alias("id")).agg(F.countDistinct("id").alias("unique_seen"))
    new = members.groupBy(F.col("first_run_id").alias("id")).agg(F.countDistinct("id").alias("new_businesses"))
    out = runs.select("id").join(seen, "id", "left").join(new, "id", "left")
    return out.select(F.col("id").alias("run_id"), F.coalesce("unique_seen", F.lit(0)).alias("unique_seen"), F.coalesce("new_businesses", F.lit(0)).alias("new_businesses"))


def survivorship(df: DataFrame, key: str, at: Column, run: str = "last_run_id", mutable: tuple[str, ...] = MUTABLE) -> DataFrame:
    """One row per key: smallest id, first and last sighting, the latest value that isn't null of each field.

    Latest is by (instant text, run, id), as text; all in one partial aggregation, no window.
    """
    order = F.struct(at, F.col(run), F.col("id"))
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in mutable]
    return df.groupBy(key).agg(
        F.min("id").alias("primary_id"), F.count("*").alias("members"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max_by(run, order).alias("last_run_id"), *latest
    )


def recovery_overlap(members: DataFrame, source_run: Column, child_run: Column, run: str = "last_run_id") -> DataFrame:
    """unique_union, overlap and increment of the children's members against the source run's."""
    src = members.filter(source_run).select("identity").distinct()
    kids = members.filter(child_run).select("identity").distinct()
    hit = kids.join(src.withColumn("hit", F.lit(1)), "identity", "left")
    return hit.agg(F.count("*").alias("unique_union"), F.count("hit").alias("overlap"), (F.count("*") - F.count("hit")).alias("increment"))


def identity_conflicts(df: DataFrame, groups: DataFrame, fields: tuple[str, ...] = IDS) -> DataFrame:
    """(group_id, field, n) of groups that hold several values of a field."""
    d = df.join(groups, "id").select("group_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), clean_text(F.col(c)).alias("v")) for c in fields])).alias("x"))
    return d.groupBy("group_id", "x.field").agg(F.countDistinct("x.v").alias("n")).filter("n > 1")


def canonicalise(records: DataFrame) -> DataFrame:
    """Records (seq, run_id, seen_at, ids, fields) → businesses.

    Rows that share a strong id or an identity key become one business: its id and canonical key come from the
    earliest row, strong ids from the first row that has one, fields from the latest (seen_at, run_id, seq).
    """
    r = with_identity(records).filter(F.col("identity").isNotNull()).withColumnRenamed("seq", "id")
    keys = F.array_compact(F.array(F.concat(F.lit("k:"), F.col("identity")), *[F.concat(F.lit(f"{c}:"), clean_text(F.col(c))) for c in IDS]))
    g = components(links_by_shared_key(r.select("id", F.explode(keys).alias("k")), "id", "k"))
    r = r.join(g, "id", "left").withColumn("business", F.coalesce("group_id", "id"))
    first, last = F.struct("seen_at", "run_id", "id"), F.struct("seen_at", "run_id", "id")
    return r.groupBy("business").agg(
        F.min_by("identity", F.col("id")).alias("canonical_key"),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in IDS],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), last)).alias(c) for c in ("title", "address", "phone", "website")],
        F.min_by("run_id", first).alias("first_run_id"), F.max_by("run_id", last).alias("last_run_id"),
        F.array_sort(F.collect_set("run_id")).alias("runs"),
    )
