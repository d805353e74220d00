"""Queries of facts and what they rest on, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.jsons import instant_us
from strataform.functions.identity import opaque_id
from strataform.operators import facts, quality, subjects, support
from strataform.plans.reference import _CUR, _EV, DAY_US, NOW_US, SQL as _REF, _evidence, _facts, _wide_sql, domain_states
from strataform.session import materialize
from strataform.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "maps_business_location_links", "business_id", F.col("location_id").alias("subject_id"))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return support.observations(_evidence(spark, d), _links(spark, d))


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """Facts with their instants in microseconds."""
    f = _facts(spark, d)
    us = lambda c: instant_us(F.col(c))
    return f.select("id", "subject_id", "predicate", "status", "value_json", us("valid_from").alias("at_us"), us("last_verified_at").alias("verified_us"), us("reconciled_at").alias("reconciled_us"), F.struct(us("reconciled_at"), F.col("id")).alias("rank"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return materialize(support.edges(_observations(spark, d), _stated(spark, d)), "support_edges")


_ROLES = ", ".join(f"('{r}', '{p}')" for r, ps in support.ROLE_PREDICATES.items() for p in ps)
_OBS = f"""{_EV}, f as (select distinct id, subject_id, predicate, status, value_json, epoch_us(valid_from::timestamptz) as at_us, epoch_us(last_verified_at::timestamptz) verified_us, epoch_us(reconciled_at::timestamptz) reconciled_us from facts),
rp(source_role, predicate) as (values {_ROLES}),
ob as (select l.location_id subject_id, rp.predicate, 'obs_' || substr(sha256(e.id || '|' || rp.predicate), 1, 32) observation_id, e.id evidence_id, e.source_id, e.acquisition_session_id session_id, e.status, e.created as at_us
 from e join maps_business_location_links l on l.business_id = e.business_id join rp on rp.source_role = e.source_role),
one as (select subject_id, predicate, at_us, arg_max(id, lpad(coalesce(reconciled_us, 0)::varchar, 20, '0') || id) id from f where at_us is not null group by 1, 2, 3),
ed as (select ob.*, one.id fact_id, case when ob.status = 'usable' then 'supports' else 'searched' end as role from ob asof join one on ob.subject_id = one.subject_id and ob.predicate = one.predicate and ob.at_us >= one.at_us),
pf as (select f.*, coalesce(observations, 0) observations, coalesce(usable, 0) usable, coalesce(searched, 0) searched, coalesce(sources, 0) sources, coalesce(sessions, 0) sessions, first_us, last_us
  from f left join (select fact_id, count(*) observations, count(*) filter (role = 'supports') usable, count(*) filter (role = 'searched') searched, count(distinct case when role = 'supports' then source_id end) sources, count(distinct session_id) sessions, min(at_us) first_us, max(at_us) last_us from ed group by 1) n on n.fact_id = f.id)"""


@query(f"with {_OBS} select fact_id, observation_id, evidence_id, session_id, ed.source_id, source_type from ed join sources s on s.id = ed.source_id where role = 'supports'")
def provenance_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every chain from a fact over observation, evidence and session to its source."""
    return support.chains(_edges(spark, d), table(spark, d, "sources", "id", "source_type"))


@query(f"with {_OBS} select distinct fact_id, session_id, ed.source_id, source_type from ed join f on f.id = ed.fact_id join sources s on s.id = ed.source_id where role = 'searched' and f.status = 'not_observed'")
def absence_edges(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that looked for what a not_observed fact says is not there."""
    return support.absences(_edges(spark, d), _stated(spark, d), table(spark, d, "sources", "id", "source_type"))


@query(f"""with {_OBS} select 'value_without_support' gap, count(*) n from f where status in ('confirmed', 'single_source', 'stale', 'conflicted') and not exists (select 1 from ed where ed.fact_id = f.id)
union all select 'value_without_usable_support', count(*) from f where status in ('confirmed', 'single_source', 'stale', 'conflicted') and not exists (select 1 from ed join sources s on s.id = ed.source_id where ed.fact_id = f.id and role = 'supports' and s.active = 1)
union all select 'absence_without_search', count(*) from f where status = 'not_observed' and not exists (select 1 from ed where ed.fact_id = f.id and role = 'searched')""")
def support_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Value facts without any or without a usable chain to an active source, and absences nobody searched for: anti joins."""
    e, f = _edges(spark, d), _stated(spark, d)
    values = f.filter(F.col("status").isin("confirmed", "single_source", "stale", "conflicted"))
    active = table(spark, d, "sources", F.col("id").alias("source_id"), "active").filter("active = 1")
    usable = e.filter("role = 'supports'").join(active, "source_id", "left_semi")
    parts = [("value_without_support", values, e), ("value_without_usable_support", values, usable), ("absence_without_search", f.filter("status = 'not_observed'"), e.filter("role = 'searched'"))]
    out = [a.join(b.select(F.col("fact_id").alias("id")), "id", "left_anti").agg(F.lit(name).alias("gap"), F.count("*").alias("n")) for name, a, b in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""with {_OBS} select f.predicate, source_type, count(*) chains, count(distinct f.id) facts, count(distinct ed.evidence_id) evidence from ed join f on f.id = ed.fact_id join e on e.id = ed.evidence_id join sources s on s.id = ed.source_id
join maps_business_location_links l on l.location_id = f.subject_id join businesses b on b.id = l.business_id where role = 'supports' group by 1, 2""")
def provenance_counts(spark: SparkSession, d: str) -> DataFrame:
    """Full chains per predicate and type of source: edge, fact, evidence, source, link, business."""
    c = support.chains(_edges(spark, d), table(spark, d, "sources", "id", "source_type"))
    f = _stated(spark, d).select(F.col("id").alias("fact_id"), "subject_id", "predicate")
    e = _evidence(spark, d).select(F.col("id").alias("evidence_id"))
    b = table(spark, d, "businesses", F.col("id").alias("business_id"))
    j = c.join(e, "evidence_id", "left_semi").join(f, "fact_id").join(_links(spark, d).join(b, "business_id", "left_semi"), "subject_id")
    return j.groupBy("predicate", "source_type").agg(F.count("*").alias("chains"), F.countDistinct("fact_id").alias("facts"), F.countDistinct("evidence_id").alias("evidence"))


@query(f"with {_OBS} select evidence_id, count(distinct fact_id) facts, count(distinct predicate) predicates from ed where role = 'supports' group by 1")
def facts_of_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct facts each evidence item reaches."""
    e = _edges(spark, d).filter("role = 'supports'")
    return e.groupBy("evidence_id").agg(F.countDistinct("fact_id").alias("facts"), F.countDistinct("predicate").alias("predicates"))


@query(f"with {_OBS} select ed.fact_id, f.predicate, count(*) supports, count(distinct source_id) sources, max(ed.at_us) last_us, bool_or(source_id <> 'src_google_maps')::int independent from ed join f on f.id = ed.fact_id where role = 'supports' and f.status in ('confirmed', 'single_source') group by 1, 2")
def usable_supports(spark: SparkSession, d: str) -> DataFrame:
    """The usable support of every fact that claims a value, and whether any of it is independent of the listing."""
    f = _stated(spark, d).filter("status in ('confirmed', 'single_source')").select(F.col("id").alias("fact_id"))
    e = _edges(spark, d).filter("role = 'supports'").join(f, "fact_id")
    return e.groupBy("fact_id", "predicate").agg(F.count("*").alias("supports"), F.countDistinct("source_id").alias("sources"), F.max("at_us").alias("last_us"), F.bool_or(F.col("source_id") != "src_google_maps").cast("int").alias("independent"))


def _codes_sql(rules) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {cond} then '{code}' end" for code, cond in rules) + "], lambda x: x is not null), ',')"


@query(f"with {_OBS} select id, observations, usable, searched, sources, sessions, {_codes_sql(support.FACT_CODES)} issues from pf")
def fact_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Every fact with the counts of its edges and all integrity codes that apply to it."""
    p = support.per_fact(_stated(spark, d), _edges(spark, d))
    return p.select("id", "observations", "usable", "searched", "sources", "sessions", support.codes().alias("issues"))


@query(f"""with {_OBS}, x as (select e.acquisition_session_id session_id, count(*) evidence, count(*) filter (e.status = 'usable') usable from e group by 1), y as (select session_id, count(*) observations, count(distinct subject_id) subjects from ob group by 1)
select x.session_id, evidence, usable, coalesce(observations, 0) observations, coalesce(subjects, 0) subjects from x left join y on y.session_id = x.session_id""")
def session_children(spark: SparkSession, d: str) -> DataFrame:
    """Evidence and observations of every session."""
    e = _evidence(spark, d).groupBy(F.col("acquisition_session_id").alias("session_id")).agg(F.count("*").alias("evidence"), F.count_if(F.col("status") == "usable").alias("usable"))
    o = _observations(spark, d).groupBy("session_id").agg(F.count("*").alias("observations"), F.countDistinct("subject_id").alias("subjects"))
    return e.join(o, "session_id", "left").fillna(0, ["observations", "subjects"])


@query(f"""with {_OBS} select x.session_id, sha256(concat_ws(chr(31), coalesce(es, ''), coalesce(os, ''))) seal from (select acquisition_session_id session_id, string_agg(id, chr(31) order by id) es from e group by 1) x left join (select session_id, string_agg(observation_id, chr(31) order by observation_id) os from ob group by 1) y on y.session_id = x.session_id""")
def session_seals(spark: SparkSession, d: str) -> DataFrame:
    """A seal over the children of each session; a session has as many as its run has pages, so they may be gathered."""
    e = _evidence(spark, d).groupBy(F.col("acquisition_session_id").alias("session_id")).agg(F.array_join(F.array_sort(F.collect_list("id")), chr(31)).alias("es"))
    o = _observations(spark, d).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("observation_id")), chr(31)).alias("os"))
    return e.join(o, "session_id", "left").select("session_id", F.sha2(F.concat_ws(chr(31), F.coalesce("es", F.lit("")), F.coalesce("os", F.lit(""))), 256).alias("seal"))


@query(f"""with {_OBS}, bad as (select acquisition_session_id session_id from e where acquisition_session_id is not null group by 1 having count(*) filter (status = 'usable') * 10 < count(*) * 7)
select f.status, count(distinct f.id) facts from ed join f on f.id = ed.fact_id where ed.session_id in (select session_id from bad) and not exists (select 1 from ed o where o.fact_id = f.id and o.role = 'supports' and o.session_id not in (select session_id from bad)) group by 1""")
def dependent_on_bad_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Facts touched by sessions with less than seven in ten items usable and supported by no other, per status."""
    e, ev = _edges(spark, d), _evidence(spark, d)
    bad = ev.groupBy(F.col("acquisition_session_id").alias("session_id")).agg(F.count_if(F.col("status") == "usable").alias("n"), F.count("*").alias("m")).filter("n * 10 < m * 7 and session_id is not null").select("session_id")
    touched = e.join(bad, "session_id", "left_semi").select("fact_id").distinct()
    free = e.filter("role = 'supports'").join(bad, "session_id", "left_anti").select("fact_id")
    left = touched.join(free, "fact_id", "left_anti")
    return _stated(spark, d).join(left, F.col("id") == F.col("fact_id")).groupBy("status").agg(F.count("*").alias("facts"))


@query(f"""with {_OBS}, last as (select subject_id, predicate, arg_max(status, lpad(at_us::varchar, 20, '0') || observation_id) seen, max(at_us) as at_us from ob group by 1, 2), {_CUR.replace('f as (', 'f0 as (').replace('from f)', 'from f0)')}, h as (select subject_id, predicate, bool_or(status in ('confirmed', 'single_source', 'stale')) has_value, bool_or(status in ('conflicted', 'not_applicable')) barred from c group by 1, 2)
select last.subject_id, last.predicate, case when h.subject_id is null then 'open_absence' when barred then 'kept' when has_value then 'kept' else 'renew_absence' end outcome from last left join h on h.subject_id = last.subject_id and h.predicate = last.predicate where seen <> 'usable'""")
def not_observed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a search in vain does: opens an absence where nothing is held, renews one, and never overrides a value, a
    conflict or a not_applicable."""
    o = _observations(spark, d).groupBy("subject_id", "predicate").agg(F.max_by("status", F.struct("at_us", "observation_id")).alias("seen")).filter("seen <> 'usable'")
    h = facts.current(_facts(spark, d)).groupBy("subject_id", "predicate").agg(F.bool_or(F.col("status").isin("confirmed", "single_source", "stale")).alias("has_value"), F.bool_or(F.col("status").isin("conflicted", "not_applicable")).alias("barred"))
    j = o.join(h, ["subject_id", "predicate"], "left")
    return j.select("subject_id", "predicate", F.when(F.col("barred").isNull(), "open_absence").when(F.col("barred") | F.col("has_value"), "kept").otherwise("renew_absence").alias("outcome"))


@query(f"""with {_OBS}, w as (select subject_id, predicate, count(*) observations, count(distinct source_id) filter (status = 'usable') sources, max(at_us) filter (status = 'usable') last_us from ob group by 1, 2), k as (select subject_id, predicate, arg_max(id, lpad(at_us::varchar, 20, '0') || lpad(coalesce(reconciled_us, 0)::varchar, 20, '0') || id) id from f where at_us is not null group by 1, 2),
g as (select w.*, f.status, f.at_us held_us from w left join k on k.subject_id = w.subject_id and k.predicate = w.predicate left join f on f.id = k.id)
select subject_id, predicate, observations, sources, case when last_us is null then 'searched_only' when held_us is null then 'created' when last_us < held_us then 'ignored' when status in ('unknown', 'not_observed', 'not_applicable') then 'replaced' when sources >= 2 then 'confirmed' else 'single_source' end outcome from g""")
def reconcile_all(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of every (subject, predicate) that was observed, against the fact held last."""
    o = _observations(spark, d).groupBy("subject_id", "predicate").agg(F.count("*").alias("observations"), F.countDistinct(F.when(F.col("status") == "usable", F.col("source_id"))).alias("sources"), F.max(F.when(F.col("status") == "usable", F.col("at_us"))).alias("last_us"))
    f = _stated(spark, d).filter("at_us is not null").groupBy("subject_id", "predicate").agg(F.max_by(F.struct("status", "at_us"), F.struct("at_us", "rank")).alias("h"))
    j = o.join(f, ["subject_id", "predicate"], "left")
    out = (
        F.when(F.col("last_us").isNull(), "searched_only").when(F.col("h").isNull(), "created").when(F.col("last_us") < F.col("h.at_us"), "ignored")
        .when(F.col("h.status").isin("unknown", "not_observed", "not_applicable"), "replaced").when(F.col("sources") >= 2, "confirmed").otherwise("single_source")
    )
    return j.select("subject_id", "predicate", "observations", "sources", out.alias("outcome"))


@query(f"""with {_OBS}, s as (select subject_id, session_id, predicate, max((status = 'usable')::int) seen, max((at_us >= {NOW_US - 365 * DAY_US})::int) fresh from ob where session_id is not null group by 1, 2, 3), v as (select subject_id, predicate, max(seen) seen, min(seen) every, max(fresh) fresh from s group by 1, 2)
select subject_id, predicate, case when seen = 1 and every = 1 then 'observed' when seen = 1 then 'observed_in_part' when fresh = 1 then 'inspected_without_result' else 'not_covered' end coverage from v""")
def surface_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the sessions about a subject saw of each predicate: all of them, some, none though recent, or none."""
    o = _observations(spark, d).filter("session_id is not null")
    per = o.groupBy("subject_id", "session_id", "predicate").agg(F.max((F.col("status") == "usable").cast("int")).alias("seen"), F.max((F.col("at_us") >= NOW_US - 365 * DAY_US).cast("int")).alias("fresh"))
    v = per.groupBy("subject_id", "predicate").agg(F.max("seen").alias("seen"), F.min("seen").alias("every"), F.max("fresh").alias("fresh"))
    return v.select("subject_id", "predicate", F.when((F.col("seen") == 1) & (F.col("every") == 1), "observed").when(F.col("seen") == 1, "observed_in_part").when(F.col("fresh") == 1, "inspected_without_result").otherwise("not_covered").alias("coverage"))


_SIGNED = ("domain", "state", "facts", "fresh")


@query(f"""with t as ({_REF["domain_states"]}), a as (select subject_id, count(*) domains, {_wide_sql(*_SIGNED)} signature from t group by 1)
select subject_id, 'asm_' || substr(sha256(subject_id || chr(31) || signature), 1, 32) assessment_id, domains from a""")
def assessments(spark: SparkSession, d: str) -> DataFrame:
    """An assessment per subject whose id follows from what it rests on: the same states give the same id again."""
    a = domain_states(spark, d).groupBy("subject_id").agg(F.count("*").alias("domains"), quality.wide_digest(*_SIGNED).alias("signature"))
    return a.select("subject_id", opaque_id("asm", F.col("subject_id"), F.col("signature")).alias("assessment_id"), "domains")


@query(f"""with t as ({_REF["domain_states"]}), a as (select subject_id, count(*) domains, {_wide_sql(*_SIGNED)} signature, count(*) filter (state = 'conflicted') bad from t group by 1), s as (select subject_id, signature from a where bad = 0)
select a.subject_id, 'asm_' || substr(sha256(a.subject_id || chr(31) || a.signature), 1, 32) assessment_id, domains from a join s on s.subject_id = a.subject_id and s.signature = a.signature""")
def sealed_assessments(spark: SparkSession, d: str) -> DataFrame:
    """The assessments that may be seen: those whose seal, set where no domain is in conflict, still fits their states."""
    states = materialize(domain_states(spark, d), "states")
    a = states.groupBy("subject_id").agg(F.count("*").alias("domains"), quality.wide_digest(*_SIGNED).alias("signature"))
    bad = states.filter("state = 'conflicted'").select("subject_id").distinct()
    seals = states.join(bad, "subject_id", "left_anti").groupBy("subject_id").agg(quality.wide_digest(*_SIGNED).alias("signature"))
    return a.join(seals, ["subject_id", "signature"]).select("subject_id", opaque_id("asm", F.col("subject_id"), F.col("signature")).alias("assessment_id"), "domains")


@query(f"""with t as ({_REF["domain_states"]}) select subject_id, domain, case when state in ('strong', 'sufficient') then 'partial' else state end preview from t""")
def domain_preview(spark: SparkSession, d: str) -> DataFrame:
    """The states of domains before an assessment: never better than partial."""
    return domain_states(spark, d).select("subject_id", "domain", F.when(F.col("state").isin("strong", "sufficient"), "partial").otherwise(F.col("state")).alias("preview"))


@query(f"with {_OBS}, last as (select (business_id) b, arg_max(acquisition_session_id, lpad(created::varchar, 20, '0') || id) session_id, count(distinct acquisition_session_id) sessions from e where business_id is not null group by 1) select l.business_id, l.location_id, last.session_id, coalesce(sessions, 0) sessions from maps_business_location_links l join businesses on businesses.id = l.business_id left join last on last.b = l.business_id")
def planner_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Of every linked listing the session that last brought evidence, and how many did."""
    links = table(spark, d, "maps_business_location_links", "business_id", "location_id").join(table(spark, d, "businesses", F.col("id").alias("business_id")), "business_id", "left_semi")
    last = _evidence(spark, d).filter("business_id is not null").groupBy("business_id").agg(F.max_by("acquisition_session_id", F.struct("created", "id")).alias("session_id"), F.countDistinct("acquisition_session_id").alias("sessions"))
    return links.join(last, "business_id", "left").select("business_id", "location_id", "session_id", F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query("""with r as (select distinct raw_sha256, identity_key, business_id from parsed_reviews), x as (select distinct sha256(raw_json) raw_sha256 from parsed_reviews) select r.business_id, count(*) reviews, count(distinct r.identity_key) identities from r join x on x.raw_sha256 = r.raw_sha256 join businesses b on b.id = r.business_id group by 1""")
def reviews_by_digest(spark: SparkSession, d: str) -> DataFrame:
    """Reviews joined on the id that follows from their content."""
    r = table(spark, d, "parsed_reviews", "raw_sha256", "identity_key", "business_id").distinct()
    x = table(spark, d, "parsed_reviews", F.sha2("raw_json", 256).alias("raw_sha256")).distinct()
    b = table(spark, d, "businesses", F.col("id").alias("business_id"))
    return r.join(x, "raw_sha256", "left_semi").join(b, "business_id", "left_semi").groupBy("business_id").agg(F.count("*").alias("reviews"), F.countDistinct("identity_key").alias("identities"))


@query("select 'repeated' outcome, count(distinct id) n from facts")
def replay_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The same facts loaded again: all are held and equal, none is inserted or differs."""
    f = table(spark, d, "facts", "id", "subject_id", "predicate", "fact_slot", "value_json", "status", "valid_from")
    return subjects.load_outcomes(f, f.dropDuplicates(["id"]), "id", f.columns)
