"""One surviving record per group of duplicates, chosen field by field.

Method. Rows that share a strong id, directly or through others, form a group. Their fields are unpivoted to long rows,
each with a vote: the trust in its source times a decay by age. Votes are summed per normalised value, the value with
the largest sum wins by ``max_by``, the best row that holds it supplies it, and the winners are pivoted back to one
record. A half-life of days (``decayed_votes``) lets older rows outvote a newer one. In the strict order (``strict_votes``)
trust counts more than any age, a microsecond of age more than any number of rows, and of rows of one instant each later
id a quarter of the id before. Such votes span more powers of two than a double has, so they are summed as numbers of
base 2^32: per value and leading digit first, then the highest digit per value.

Skew. Groups come from star links (see ``components``), votes are added in two partial aggregations; neither holds a
group in one task. Raw records are read only for rows that belong to a group.

Defined results: placeholders link nothing and are no values; unparseable records hold no values and may still be
group members; rows without an instant come last; ties go to the smallest id; a repeated row counts once; rows
without duplicates have no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import no_placeholder, strong_id
from strataform.operators.components import components, links_by_shared_key

FIELDS = ("title", "category", "address", "phone", "website", "review_rating", "review_count", "status")
#: Fields that occur under further keys.
LEGACY = {"website": ("web_site",)}


def duplicate_groups(df: DataFrame, ids: tuple[str, ...] = ("place_id", "cid", "data_id")) -> DataFrame:
    """(id, group_id) of all rows that share an id with another row."""
    keys = F.array_compact(F.array(*[F.concat(F.lit(f"{c}:"), strong_id(F.col(c))) for c in ids]))
    return components(links_by_shared_key(df.select("id", F.explode(keys).alias("k")), "id", "k"))


def field_values(df: DataFrame, raw: str = "raw_json", fields: tuple[str, ...] = FIELDS) -> Column:
    """Array of (field, value) that a record holds; takes the column ``_v`` with the parsed record."""
    out = []
    for f in fields:
        tries = [no_placeholder(F.try_variant_get(F.col("_v"), f"$.{k}", "string")) for k in (f, *LEGACY.get(f, ()))]
        v = F.coalesce(*tries)
        out.append(F.when(v.isNotNull(), F.struct(F.lit(f).alias("field_name"), v.alias("value"))))
    return F.array_compact(F.array(*out))


def votes(df: DataFrame, groups: DataFrame, trust: Column, at: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Long rows (group_id, field_name, value, norm, id, trust, at); trust is 1 for the most trusted source, never 0."""
    d = df.select("id", trust.cast("double").alias("trust"), at.alias("at"), "raw_json").join(groups, "id")
    d = d.withColumn("_v", F.try_parse_json("raw_json")).drop("raw_json")
    d = d.select("group_id", "id", "trust", "at", F.explode(field_values(d, fields=fields)).alias("f"))
    norm = F.lower(F.regexp_replace("f.value", r"\s+", " "))
    return d.select("group_id", "f.field_name", "f.value", norm.alias("norm"), "id", "trust", "at").dropDuplicates(["group_id", "field_name", "id"])


def _rank() -> Column:
    return F.struct("trust", F.coalesce("at", F.lit(-(1 << 62))).alias("at"), (-F.col("id")).alias("least"))


def decayed_votes(voted: DataFrame, half_life_days: float) -> DataFrame:
    """(group_id, field_name, norm, score, rank, best): the votes of each value, decaying by half in so many days."""
    # decay from a fixed instant: a group's votes keep their proportions whatever the instant
    age = (F.lit(1_900_000_000_000_000) - F.coalesce("at", F.lit(0))) / (86_400_000_000.0 * half_life_days)
    score = F.sum(F.col("trust") * F.pow(F.lit(2.0), -age))
    return voted.groupBy("group_id", "field_name", "norm").agg(score.alias("score"), F.max(_rank()).alias("rank"), F.max_by(F.struct("id", "value"), _rank()).alias("best"))


def strict_votes(voted: DataFrame) -> DataFrame:
    """As ``decayed_votes``, with score = (digit, sum): the votes of a value in the strict order.

    A vote is 2 to the power of 2^66 bits per microsecond less two per id, and 2^122 more for the trusted (trust 1). All
    other votes of a value together stay below a half of its best one, so no carry from a lower digit decides anything.
    """
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    part = lambda c, n: (c.cast("decimal(17,0)") * F.lit(str(n)).cast("decimal(20,0)")).cast("decimal(38,0)")
    at = F.greatest(F.coalesce("at", F.lit(-(1 << 53))), F.lit(-(1 << 53)))
    bits = part(at, 1 << 66) - (F.col("id").cast("decimal(19,0)") * big(2)).cast("decimal(38,0)") + F.when(F.col("trust") >= 1, big(1 << 122)).otherwise(big(0))
    low = F.pmod(bits, big(32)).cast("int")
    digit = (bits - F.pmod(bits, big(32))).cast("decimal(38,0)")
    keys = ["group_id", "field_name", "norm"]
    d = voted.select(*keys, "id", "value", _rank().alias("rank"), digit.alias("digit"), F.pow(F.lit(2.0), low).alias("vote"))
    d = d.groupBy(*keys, "digit").agg(F.sum("vote").alias("sum"), F.max("rank").alias("rank"), F.max_by(F.struct("id", "value"), F.col("rank")).alias("best"))
    return d.groupBy(*keys).agg(F.max(F.struct("digit", "sum")).alias("score"), F.max("rank").alias("rank"), F.max_by("best", F.col("rank")).alias("best"))


def winners(by_value: DataFrame) -> DataFrame:
    """(group_id, field_name, value, id, score): the value with the largest sum of votes and the best row that holds it."""
    won = by_value.groupBy("group_id", "field_name").agg(F.max_by(F.struct("best", "score"), F.struct("score", "rank")).alias("w"))
    return won.select("group_id", "field_name", F.col("w.best.value").alias("value"), F.col("w.best.id").alias("id"), F.col("w.score").alias("score"))


def surviving_records(won: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per group with the winning value of each field, null where no row holds one."""
    return won.groupBy("group_id").pivot("field_name", list(fields)).agg(F.first("value"))
