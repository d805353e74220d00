"""What facts rest on: observations, the edges between both, chains to sources, and what is wrong with them.

An observation is what one evidence item says of one predicate. It supports the fact that held for its subject and
predicate when it was made, so an observation has at most one edge and edges never outnumber observations. Evidence that
could not be used was searched: it can show absence, not a value.

Skew. Edges come from one pass over facts and observations in order of time per (subject, predicate); hot keys are cut
into chunks (see ``history.carried``). All checks are aggregations per fact with a partial step.

Defined results: facts without an instant support nothing; observations before the first fact have no edge; rows
delivered twice count once; a fact without edges has a row with zeros wherever facts are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.operators.history import carried

#: What each role of a source speaks of.
ROLE_PREDICATES = {
    "official": ("location.phone", "location.opening_hours", "location.address"),
    "platform": ("location.address", "location.phone", "location.operating_status", "location.opening_hours", "reputation.rating", "reputation.review_count"),
    "customer_generated": ("reputation.customer_review",),
    "third_party": ("location.address", "location.phone"),
    "public_authority": ("location.operating_status", "location.address"),
}


def observations(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(subject_id, predicate, observation_id, evidence_id, source_id, session_id, status, at_us) of evidence (id, business_id,
    source_id, source_role, status, acquisition_session_id, created) and links (business_id, subject_id)."""
    spoken = F.create_map(*[x for role, ps in ROLE_PREDICATES.items() for x in (F.lit(role), F.array(*[F.lit(p) for p in ps]))])
    e = evidence.join(links, "business_id").withColumn("predicate", F.explode(F.try_element_at(spoken, F.col("source_role"))))
    ident = F.concat(F.lit("obs_"), F.substring(F.sha2(F.concat_ws("|", "id", "predicate"), 256), 1, 32))
    return e.select("subject_id", "predicate", ident.alias("observation_id"), F.col("id").alias("evidence_id"), "source_id", F.col("acquisition_session_id").alias("session_id"), "status", F.col("created").alias("at_us"))


def edges(obs: DataFrame, facts: DataFrame, hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """The observations with ``fact_id`` and ``role`` (supports, searched): the fact (id, subject_id, predicate, at_us, rank) of
    their subject and predicate that held at their instant; of several facts of one instant the highest rank holds."""
    keys = ["subject_id", "predicate"]
    one = facts.filter("at_us is not null").groupBy(*keys, "at_us").agg(F.max_by("id", "rank").alias("id"))
    rest = [c for c in obs.columns if c not in (*keys, "at_us")]
    held = one.select(*keys, F.col("at_us").alias("_at"), F.lit(0).alias("_kind"), F.col("id").alias("_fact"), *[F.lit(None).cast(obs.schema[c].dataType).alias(c) for c in rest])
    seen = obs.select(*keys, F.col("at_us").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_fact"), *rest)
    j = carried(held.unionByName(seen), keys, ["_at", "_kind"], "_fact", "fact_id", hot_rows, chunk_rows)
    j = j.filter("_kind = 1 and fact_id is not null").select(*keys, F.col("_at").alias("at_us"), *rest, "fact_id")
    return j.withColumn("role", F.when(F.col("status") == "usable", "supports").otherwise("searched"))


def chains(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """Supporting edges with their source's type: fact → observation → evidence → session → source."""
    s = sources.select(F.col("id").alias("source_id"), "source_type")
    return edge.filter("role = 'supports'").join(s, "source_id").select("fact_id", "observation_id", "evidence_id", "session_id", "source_id", "source_type")


def absences(edge: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(fact_id, session_id, source_id, source_type): sessions that searched in vain for facts that weren't observed."""
    s = sources.select(F.col("id").alias("source_id"), "source_type")
    none = facts.filter("status = 'not_observed'").select(F.col("id").alias("fact_id"))
    return edge.filter("role = 'searched'").join(none, "fact_id").join(s, "source_id").select("fact_id", "session_id", "source_id", "source_type").distinct()


def per_fact(facts: DataFrame, edge: DataFrame) -> DataFrame:
    """The facts with observations, usable, searched, sources, sessions, first_us and last_us of their edges; 0 and null without."""
    usable = F.col("role") == "supports"
    n = edge.groupBy("fact_id").agg(
        F.count("*").alias("observations"),
        F.count_if(usable).alias("usable"),
        F.count_if(~usable).alias("searched"),
        F.countDistinct(F.when(usable, F.col("source_id"))).alias("sources"),
        F.countDistinct("session_id").alias("sessions"),
        F.min("at_us").alias("first_us"),
        F.max("at_us").alias("last_us"),
    )
    return facts.join(n.withColumnRenamed("fact_id", "id"), "id", "left").fillna(0, ["observations", "usable", "searched", "sources", "sessions"])


#: Integrity codes of a fact, with conditions over ``per_fact`` in plain SQL; all that apply are reported, in this order.
FACT_CODES = (
    ("no_observation", "observations = 0"),
    ("value_without_usable_support", "status in ('confirmed', 'single_source', 'stale', 'conflicted') and usable = 0"),
    ("confirmed_by_one_source", "status = 'confirmed' and sources = 1"),
    ("single_source_by_several", "status = 'single_source' and sources > 1"),
    ("conflict_without_two_sources", "status = 'conflicted' and sources < 2"),
    ("absence_without_search", "status = 'not_observed' and searched = 0"),
    ("absence_despite_support", "status = 'not_observed' and usable > 0"),
    ("unusable_evidence", "searched > 0 and status <> 'not_observed'"),
    ("value_missing", "status in ('confirmed', 'single_source', 'stale', 'conflicted') and value_json is null"),
    ("value_despite_absence", "status in ('unknown', 'not_observed', 'not_applicable') and value_json is not null"),
    ("verified_before_start", "verified_us < at_us"),
    ("supported_after_verification", "usable > 0 and verified_us < last_us"),
    ("reconciled_before_start", "reconciled_us < at_us"),
)


def codes(rules=FACT_CODES) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.expr(cond), F.lit(False)), F.lit(code)) for code, cond in rules])), ",")
