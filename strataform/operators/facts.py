"""Facts as long rows: unpivot, versions, reconciliation outcomes, corroboration, freshness and open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.identity import opaque_id
from strataform.functions.jsons import instant_us
from strataform.operators.history import next_start

#: Field, subject kind, predicate, domain, cardinality, freshness in days.
PREDICATES = (
    ("title", "business_entity", "business.name.trading", "identity", "single", 90),
    ("category", "business_entity", "business.category.primary", "classification", "single", 90),
    ("website", "business_entity", "business.website.official", "digital_presence", "single", 90),
    ("address", "location", "location.address", "locations", "single", 90),
    ("latitude", "location", "location.latitude", "locations", "single", 90),
    ("longitude", "location", "location.longitude", "locations", "single", 90),
    ("phone", "location", "location.phone", "communication", "multi", 60),
    ("review_rating", "location", "reputation.rating", "reputation", "single", 30),
    ("review_count", "location", "reputation.review_count", "reputation", "single", 30),
    ("status", "location", "location.operating_status", "operations", "single", 30),
    (None, "location", "location.opening_hours", "operations", "single", 30),
    (None, "location", "reputation.customer_review", "reputation", "multi", None),
)
VALUE_STATUS = ("confirmed", "single_source")
SINGLE = "__single__"


def vocabulary(spark) -> DataFrame:
    """(predicate, domain, cardinality, freshness_days): a dozen rows, fixed."""
    return spark.createDataFrame([(p, d, c, f) for _, _, p, d, c, f in PREDICATES], "predicate string, domain string, cardinality string, freshness_days int")


def unpivot_fields(businesses: DataFrame) -> DataFrame:
    """(subject_id, predicate, fact_slot, value, value_hash): one row per field that holds a value; no shuffle."""
    rows = []
    for field, kind, predicate, _, cardinality, _ in PREDICATES:
        if field:
            v = F.col(field).cast("string")
            h = F.sha2(v, 256)
            subject = opaque_id("be" if kind == "business_entity" else "loc", F.col("id"))
            rows.append(F.when(v.isNotNull(), F.struct(subject.alias("subject_id"), F.lit(predicate).alias("predicate"), (F.lit(SINGLE) if cardinality == "single" else h).alias("fact_slot"), v.alias("value"), h.alias("value_hash"))))
    return businesses.select(F.col("id").alias("business_id"), F.explode(F.array_compact(F.array(*rows))).alias("o")).select("business_id", "o.*")


def scd2(statements: DataFrame, keys: list[str], at: str, tie: str, hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """Adds ``closed_at``: the start of the key's next statement by (at, tie), null for the open one.

    Every statement is a version here; for versions by value see ``history``. Hot keys are cut into time chunks.
    """
    return next_start(statements.withColumn("_at", F.col(at)), keys, ["_at", tie], "closed_at", hot_rows, chunk_rows).drop("_at")


def current(facts: DataFrame) -> DataFrame:
    """The open version per slot: the latest by instant, then reconciliation, then id, in one aggregation."""
    keys = ["subject_id", "predicate", "fact_slot"]
    order = F.struct(instant_us(F.col("valid_from")), instant_us(F.col("reconciled_at")), F.col("id"))
    keep = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("f")).select(*keys, "f.*")


def freshness(facts: DataFrame, vocab: DataFrame, now_us: int) -> DataFrame:
    """Adds (domain, freshness_days, evaluated, is_stale) at a given instant.

    The reference is the last verification, else the start; strictly more than the window is stale. Facts that state
    no value, and predicates without a window, aren't evaluated. A predicate the vocabulary lacks has the domain
    ``unknown_predicate``.
    """
    d = facts.join(vocab, "predicate", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown_predicate")))
    ref = instant_us(F.coalesce("last_verified_at", "valid_from"))
    on = ~F.col("status").isin("unknown", "not_applicable") & F.col("freshness_days").isNotNull()
    late = F.lit(now_us) > ref + F.col("freshness_days").cast("long") * 86_400_000_000
    return d.withColumn("evaluated", on.cast("int")).withColumn("is_stale", ((F.col("status") == "stale") | (on & F.coalesce(late, F.lit(False)))).cast("int"))


def reconcile(observed: DataFrame, held: DataFrame, keys: list[str], replaceable: Column) -> DataFrame:
    """Adds ``outcome`` to observations (keys, value_hash, observed_at) against held facts (keys, value_hash, valid_from).

    created: nothing held. supported: same value, held fact stands by itself. deferred: the held fact stands by itself
    or started later. replaced: all else. ``replaceable`` is a condition on the held row, named ``h``.
    """
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(f"o.{k}").eqNullSafe(F.col(f"h.{k}"))
    j = observed.alias("o").join(held.withColumn("_held", F.lit(1)).alias("h"), cond, "left")
    same = F.col("o.value_hash").eqNullSafe(F.col("h.value_hash"))
    out = F.when(F.col("h._held").isNull(), "created").when(same & ~replaceable, "supported").when(~replaceable | (F.col("o.observed_at") < F.col("h.valid_from")), "deferred").otherwise("replaced")
    return j.select(*[F.col(f"o.{c}").alias(c) for c in observed.columns], out.alias("outcome"))


def corroboration(support: DataFrame, keys: list[str], source: str, least: int = 2) -> DataFrame:
    """(keys, supports, sources, state): confirmed from ``least`` distinct sources on."""
    n = support.groupBy(*keys).agg(F.count("*").alias("supports"), F.countDistinct(source).alias("sources"))
    return n.withColumn("state", F.when(F.col("sources") >= least, "confirmed").otherwise("single_source"))


def open_questions(subjects: DataFrame, facts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(subject_id, predicate, why): predicates nothing is known of, and those whose open fact says so.

    Every subject's row grows by the fixed vocabulary, as an array: no cross join.
    """
    names = [p for _, kind, p, *_ in PREDICATES if kind == "location"]
    every = subjects.select("subject_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("predicate"))
    stated = facts.groupBy("subject_id", "predicate").agg(F.bool_or(~F.col("status").isin("unknown", "not_observed")).alias("known"))
    out = every.join(stated, ["subject_id", "predicate"], "left").filter("known is null or not known")
    return out.select("subject_id", "predicate", F.when(F.col("known").isNull(), "unresolved").otherwise("explicit").alias("why"))


def domain_states(facts: DataFrame) -> DataFrame:
    """(subject_id, domain, facts, fresh, state) of facts with freshness; the first rule that holds gives the state."""
    fresh = F.col("status").isin(*VALUE_STATUS) & (F.col("is_stale") == 0)
    g = facts.groupBy("subject_id", "domain").agg(
        F.count("*").alias("facts"), F.count_if(fresh).alias("fresh"), F.count_if(F.col("status") == "conflicted").alias("bad"), F.count_if(F.col("is_stale") == 1).alias("old"),
        F.count_if(F.col("status") == "not_applicable").alias("na"), F.count_if(F.col("status").isin("unknown", "not_observed")).alias("open"), F.count_if(fresh & (F.col("status") == "confirmed")).alias("sure"),
    )
    state = (
        F.when(F.col("bad") > 0, "conflicted").when((F.col("fresh") == 0) & (F.col("old") > 0), "stale").when(F.col("na") == F.col("facts"), "not_applicable")
        .when((F.col("fresh") > 0) & (F.col("open") == 0), F.when(F.col("sure") == F.col("fresh"), "strong").otherwise("sufficient")).when(F.col("fresh") > 0, "partial").otherwise("insufficient")
    )
    return g.select("subject_id", "domain", "facts", "fresh", state.alias("state"))


def readiness(states: DataFrame, mandatory: tuple[str, ...]) -> DataFrame:
    """(subject_id, ready, blocking): mandatory domains that aren't sufficient, strong or not applicable, and absent ones."""
    ok = F.col("state").isin("sufficient", "strong", "not_applicable") & F.col("domain").isin(*mandatory)
    g = states.groupBy("subject_id").agg(F.collect_set(F.when(ok, F.col("domain"))).alias("ok"))
    blocking = F.array_except(F.array(*[F.lit(m) for m in sorted(mandatory)]), F.col("ok"))
    return g.select("subject_id", (F.size(blocking) == 0).cast("int").alias("ready"), F.array_join(blocking, ",").alias("blocking"))


def reconcile_groups(observed: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Outcome per group of observations (key, values, value, sources, at) against held facts (key, value, status, valid_from, last_verified).

    The first rule that holds: values differ among themselves → mixed; nothing held → created; older than the held
    fact, or equal to it and not newer than its last verification → attached if it equals a confirmed fact, else
    ignored; else a new version, confirmed if it renews a confirmed value or two sources agree, single_source if not.
    """
    h = held.select(F.col(key).alias("_k"), F.col("value").alias("_v"), F.col("status").alias("_s"), F.col("valid_from").alias("_f"), F.col("last_verified").alias("_l"))
    j = observed.join(h, observed[key] == h["_k"], "left")
    same = F.col("value").eqNullSafe(F.col("_v"))
    sure = same & (F.col("_s") == "confirmed")
    old = (F.col("at") < F.col("_f")) | (same & F.coalesce(F.col("at") <= F.col("_l"), F.lit(False)))
    out = (
        F.when(F.col("values") > 1, "mixed").when(F.col("_k").isNull(), "created").when(old, F.when(sure, "attached").otherwise("ignored"))
        .otherwise(F.when(sure | (F.col("sources") >= 2), "confirmed").otherwise("single_source"))
    )
    return j.select(*observed.columns, out.alias("outcome"))
