"""Queries of the record, fact, review and session operators over the project's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import identity, urls
from strataform.functions.jsons import instant_us
from strataform.functions.text import clean_text, no_placeholder, strong_id
from strataform.operators import canonical, facts, graph, grid, quality, reviews, sessions
from strataform.operators.components import components, links_by_shared_key
from strataform.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The instant at which ages are judged: 2025-06-01T00:00:00Z.
NOW_S = 1_748_736_000
NOW_US = NOW_S * 1_000_000
DAY_US = 86_400_000_000
_BLANK = "('', '-', '--', '---', '.', '?', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', 'unknown', 'undefined', 'not available', 'tbd')"
_SID = "case when lower(trim({0})) not in " + _BLANK + " and lower(trim({0})) not in ('0', '0x0', '0x0:0x0', '-1') then trim({0}) end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add



def _or(c: str, none: int = -1):
    """A number, or ``none`` where it is null."""
    return F.coalesce(c, F.lit(none)).alias(c.split(".")[-1])


_BIZ = ("id", "place_id", "cid", "data_id", "title", "category", "address", "phone", "website", "status", "latitude", "longitude", "first_seen_at", "last_seen_at", "first_run_id", "last_run_id")
_KEY_SQL = """coalesce('place:' || nullif(trim(place_id), ''), 'cid:' || nullif(trim(cid), ''), 'data:' || nullif(trim(data_id), ''),
  case when concat(coalesce(trim(title), ''), coalesce(trim(address), ''), coalesce(trim(phone), ''), coalesce(trim(website), '')) <> ''
  then 'fallback:' || sha256(lower(concat(coalesce(trim(title), ''), '|', coalesce(trim(address), ''), '|', coalesce(trim(phone), ''), '|', coalesce(trim(website), '')))) end)"""


@query(f"""
with r as (select id, (bbox_json::json->>'min_lat')::double a, (bbox_json::json->>'max_lat')::double b, (bbox_json::json->>'min_lon')::double c, (bbox_json::json->>'max_lon')::double d from runs),
k as (select last_run_id run_id, case when latitude is null or longitude is null then 'u' when not (latitude between a and b and longitude between c and d) then 'o' when {_KEY_SQL} is null then 'x' else 'a' end as c
  from businesses join r on r.id = last_run_id)
select run_id, count(*) raw_records, count(*) filter (c = 'a') accepted_records, count(*) filter (c = 'o') out_of_bounds_records, count(*) filter (c = 'u') unlocated_records, count(*) filter (c = 'x') unidentified_records from k group by 1""")
def ingest_classify_counts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.ingest_counts(table(spark, d, "businesses", *_BIZ), table(spark, d, "runs", "id", "bbox_json"))


_ORDER = "last_seen_at || '|' || last_run_id || '|' || lpad(id::varchar, 18, '0')"


@query(f"""
select {_KEY_SQL} as identity, min(id) primary_id, count(*) members, min(first_seen_at) first_seen_at, max(last_seen_at) last_seen_at, arg_max(last_run_id, {_ORDER}) last_run_id,
{", ".join(f"arg_max({c}, {_ORDER}) filter ({c} is not null) {c}" for c in canonical.MUTABLE)} from businesses group by 1""")
def canonical_survivorship(spark: SparkSession, d: str) -> DataFrame:
    b = canonical.with_identity(table(spark, d, "businesses", *_BIZ, "review_rating", "review_count"))
    return canonical.survivorship(b, "identity", F.col("last_seen_at"))


@query("""
select r.id run_id, (select count(distinct b.id) from businesses b where b.last_run_id = r.id) unique_seen, (select count(distinct b.id) from businesses b where b.first_run_id = r.id) new_businesses from runs r""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return canonical.run_metrics(table(spark, d, "businesses", "id", "first_run_id", "last_run_id"), table(spark, d, "runs", "id"))


@query(f"""
with m as (select {_KEY_SQL} as k, status s from businesses join (select id rid, status from runs) on rid = last_run_id), m2 as (select distinct k from m where s <> 'complete' and k is not null), m1 as (select distinct k from m where s = 'complete')
select count(*) unique_union, count(*) filter (k in (select k from m1 where k is not null)) overlap, count(*) filter (k not in (select k from m1 where k is not null)) increment from m2""".replace("status s from businesses", "rs s from businesses").replace("select id rid, status from runs", "select id rid, status rs from runs"))
def recovery_overlap(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "runs", "id", "status").select(F.col("id").alias("last_run_id"), F.col("status").alias("run_status"))
    m = canonical.with_identity(table(spark, d, "businesses", *_BIZ)).filter("identity is not null").join(runs, "last_run_id")
    return canonical.recovery_overlap(m, F.col("run_status") == "complete", F.col("run_status") != "complete")


@query(f"select id, {_KEY_SQL} as identity from businesses")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    return canonical.with_identity(table(spark, d, "businesses", *_BIZ)).select("id", "identity")


@query("""
with j as (select id, raw_json::json o from businesses where json_valid(raw_json)), v as (select id, nullif(trim(o->>'title'), '') title, nullif(trim(o->>'website'), '') w1, nullif(trim(o->>'web_site'), '') w2,
  try_cast(o->>'review_count' as bigint) review_count, nullif(trim(o->>'status'), '') status, (o->>'latitude') is not null and coalesce(o->>'longitude', o->>'longtitude') is not null located from j)
select id, title, coalesce(w1, w2) website, case when w1 <> w2 then 1 else 0 end website_conflict, coalesce(review_count, -1) review_count, status, located::int located from v""")
def record_payload(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "businesses", "id", "raw_json").filter(F.try_parse_json("raw_json").isNotNull())
    p = b.select("id", canonical.record_payload(F.col("raw_json")).alias("p"))
    located = (F.col("p.latitude").isNotNull() & F.col("p.longitude").isNotNull()).cast("int")
    return p.select("id", "p.title", "p.website", "p.website_conflict", F.coalesce("p.review_count", F.lit(-1)).alias("review_count"), "p.status", located.alias("located"))


@query("select sha256(text) text_sha256, count(*) copies, min(doc_id) first_id, max(doc_id) last_id from documents where text is not null group by 1 having count(*) > 1")
def dedupe_exact_documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return t.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("copies > 1")


@query("""
with p as (select distinct identity_key, raw_sha256, unnest(source_paths) p from parsed_reviews), e as (select distinct identity_key, raw_sha256 from parsed_reviews)
select e.identity_key, e.raw_sha256, coalesce(string_agg(p.p, ',' order by p.p), '') paths from e left join p on p.identity_key = e.identity_key and p.raw_sha256 = e.raw_sha256 group by 1, 2""")
def review_collapse(spark: SparkSession, d: str) -> DataFrame:
    c = reviews.collapse(table(spark, d, "parsed_reviews", "identity_key", "raw_sha256", "source_paths"))
    return c.select("identity_key", "raw_sha256", F.array_join("paths", ",").alias("paths"))


@query("select identity_key, count(distinct raw_sha256) variants from parsed_reviews group by 1 having count(distinct raw_sha256) > 1")
def review_variants(spark: SparkSession, d: str) -> DataFrame:
    return reviews.variants(reviews.collapse(table(spark, d, "parsed_reviews", "identity_key", "raw_sha256", "source_paths")))


@query("""
with j as (select distinct raw_sha256, raw_json::json o from parsed_reviews)
select raw_sha256, nullif(trim(o->>'review_id'), '') review_id, coalesce(nullif(try_cast(o->>'rating_float' as double), 0), try_cast(o->>'Rating' as double)) rating, coalesce(try_cast(o->>'rating_scale' as bigint), -1) rating_scale,
sha256(coalesce(nullif(trim(o->>'text_original', e' \\n\\t'), ''), nullif(trim(o->>'Description', e' \\n\\t'), ''))) text_sha256, case when try_cast(o->>'posted_at_unix_micros' as bigint) > 0 then try_cast(o->>'posted_at_unix_micros' as bigint) else -1 end posted_us,
case when try_cast(o->>'updated_at_unix_micros' as bigint) > 0 then try_cast(o->>'updated_at_unix_micros' as bigint) else -1 end updated_us, nullif(trim(o->>'reply_language'), '') reply_language, nullif(trim(o->>'When'), '') source_when from j""")
def review_normalise(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "parsed_reviews", "raw_sha256", "raw_json").distinct().select("raw_sha256", reviews.normalise(F.col("raw_json")).alias("r"))
    return r.select("raw_sha256", "r.review_id", "r.rating", _or("r.rating_scale"), F.sha2("r.text_original", 256).alias("text_sha256"), _or("r.posted_us"), _or("r.updated_us"), "r.reply_language", "r.source_when")


def _grids(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runs", "id", "bbox_json", "cell_km", "queries_json")
    return r.select(F.col("id").alias("run_id"), F.from_json("bbox_json", canonical.BOX).alias("box"), "cell_km", F.json_array_length("queries_json").cast("long").alias("queries"))


_GRID_SQL = """with recursive r as (select id run_id, cell_km, json_array_length(queries_json::json) queries, (bbox_json::json->>'min_lat')::double a, (bbox_json::json->>'max_lat')::double b, (bbox_json::json->>'min_lon')::double c, (bbox_json::json->>'max_lon')::double d from runs),
s as (select *, cell_km / 111.32::double n, cell_km / (111.32::double * cos(radians((a + b) / 2))) e from r),
y as (select run_id, a + n / 2 p, n st, b hi, 0 k from s union all select run_id, p + st, st, hi, k + 1 from y where p < hi),
x as (select run_id, c + e / 2 p, e st, d hi, 0 k from s union all select run_id, p + st, st, hi, k + 1 from x where p < hi),
g as (select s.*, (select max(k) from y where y.run_id = s.run_id) as nrow, (select max(k) from x where x.run_id = s.run_id) as ncol from s)"""


@query(_GRID_SQL + " select run_id, nrow::bigint as \"rows\", ncol::bigint as \"columns\", (nrow * ncol)::bigint cells, (nrow * ncol * queries)::bigint searches from g")
def grid_estimate(spark: SparkSession, d: str) -> DataFrame:
    return grid.grid_estimate(_grids(spark, d))


def _bins(spark: SparkSession, d: str) -> DataFrame:
    g = _grids(spark, d)
    sized = grid.grid_estimate(g).select("run_id", "rows", "columns").join(g.select("run_id", "box"), "run_id")
    pts = table(spark, d, "businesses", "last_run_id", "latitude", "longitude").withColumnRenamed("last_run_id", "run_id").filter("latitude is not null and longitude is not null")
    return grid.density_bins(pts, sized, tier_a=5, tier_b=2)


_BINS_SQL = (
    _GRID_SQL
    + """, q as (select run_id, nrow, ncol, a, b, c, d, (b - a) / nrow h, (d - c) / ncol w from g), p as (select q.*, latitude, longitude from q join businesses on last_run_id = run_id where latitude between a and b and longitude between c and d),
hit as (select run_id, least((select count(*) - 1 from range(0, nrow + 1) t(i) where (case when i = nrow then b else a + i * h end) <= latitude), nrow - 1) r, least((select count(*) - 1 from range(0, ncol + 1) t(i) where (case when i = ncol then d else c + i * w end) <= longitude), ncol - 1) k from p),
cnt as (select run_id, r, k, count(*) n from hit group by 1, 2, 3), ev as (select run_id, r.i r, k.i k from q, lateral (select unnest(range(0, nrow)) i) r, lateral (select unnest(range(0, ncol)) i) k),
bins as (select ev.run_id, ev.r::bigint as "row", ev.k::bigint as "column", coalesce(n, 0) business_count, case when coalesce(n, 0) >= 5 then 'A' when coalesce(n, 0) >= 2 then 'B' else 'unselected' end tier from ev left join cnt on cnt.run_id = ev.run_id and cnt.r = ev.r and cnt.k = ev.k)"""
)


@query(_BINS_SQL + ' select run_id, "row", "column", business_count, tier from bins')
def density_bins(spark: SparkSession, d: str) -> DataFrame:
    return _bins(spark, d)


@query(_BINS_SQL + " select run_id, count(*) filter (tier = 'A') tier_a_bins, count(*) filter (tier = 'B') tier_b_bins, count(*) filter (tier = 'unselected') unselected_bins, count(*) filter (tier <> 'unselected') selected_bins, count(*) total_bins, sum(business_count)::bigint businesses, round(count(*) filter (tier <> 'unselected') / count(*), 6) selected_share from bins group by 1")
def tier_summary(spark: SparkSession, d: str) -> DataFrame:
    return grid.tier_summary(_bins(spark, d))


_SOME_FIELDS = {"title": ("be", "business.name.trading", 1), "category": ("be", "business.category.primary", 1), "website": ("be", "business.website.official", 1), "address": ("loc", "location.address", 1), "phone": ("loc", "location.phone", 0), "review_rating": ("loc", "reputation.rating", 1), "review_count": ("loc", "reputation.review_count", 1), "status": ("loc", "location.operating_status", 1)}
_FIELDS = _SOME_FIELDS | {"latitude": ("loc", "location.latitude", 1), "longitude": ("loc", "location.longitude", 1)}


# below 0.001 and above 10 000 000 the two engines write a double differently; the operator's text is Spark's
@query(" union all ".join(f"select id business_id, '{k}_' || substr(sha256(id::varchar), 1, 32) subject_id, '{p}' predicate, {"'__single__'" if one else f"sha256({c}::varchar)"} fact_slot, {c}::varchar as value, sha256({c}::varchar) value_hash from businesses where {c} is not null" for c, (k, p, one) in _FIELDS.items()))
def facts_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """The facts of all ten fields, coordinates included."""
    return facts.unpivot_fields(table(spark, d, "businesses", "id", *_FIELDS))


_F = ("id", "subject_id", "predicate", "fact_slot", "value_json", "status", "valid_from", "last_verified_at", "reconciled_at")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts, each once."""
    return table(spark, d, "facts", *_F).dropDuplicates(["id"])


_FACTS = "f as (select distinct id, subject_id, predicate, fact_slot, value_json, status, valid_from, last_verified_at, reconciled_at, epoch_us(valid_from::timestamptz) vf, epoch_us(reconciled_at::timestamptz) rc from facts)"


@query(f"with {_FACTS} select id, vf valid_from_us, coalesce(lead(vf) over (partition by subject_id, predicate, fact_slot order by vf, id), -1) closed_us from f")
def facts_scd2(spark: SparkSession, d: str) -> DataFrame:
    s = _facts(spark, d).withColumn("valid_from_us", instant_us(F.col("valid_from")))
    return facts.scd2(s, ["subject_id", "predicate", "fact_slot"], "valid_from_us", "id").select("id", "valid_from_us", F.coalesce("closed_at", F.lit(-1)).alias("closed_us"))


_CUR = _FACTS + ", c as (select * from (select *, row_number() over (partition by subject_id, predicate, fact_slot order by vf desc, rc desc nulls last, id desc) n from f) where n = 1)"


@query(f"with {_CUR} select subject_id, predicate, fact_slot, id, status, value_json from c")
def facts_current(spark: SparkSession, d: str) -> DataFrame:
    return facts.current(_facts(spark, d)).select("subject_id", "predicate", "fact_slot", "id", "status", "value_json")


@query(f"""with {_CUR}, o as (select location_id subject_id, review_count::varchar v, epoch_us(last_seen_at::timestamptz) seen from businesses join maps_business_location_links on business_id = id where review_count is not null)
select o.subject_id, o.v as value_hash, o.seen observed_at, case when c.id is null then 'created' when o.v is not distinct from try_cast(try_cast(c.value_json as double) as bigint)::varchar and not (c.status in ('single_source', 'stale')) then 'supported'
when not (c.status in ('single_source', 'stale')) or o.seen < c.vf then 'deferred' else 'replaced' end outcome from o left join c on c.subject_id = o.subject_id and c.predicate = 'reputation.review_count'""")
def reconcile_outcomes(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "maps_business_location_links", "business_id", "location_id")
    b = table(spark, d, "businesses", "id", "review_count", "last_seen_at").filter("review_count is not null")
    o = b.join(links, b["id"] == links["business_id"]).select(F.col("location_id").alias("subject_id"), F.col("review_count").cast("string").alias("value_hash"), instant_us(F.col("last_seen_at")).alias("observed_at"))
    h = facts.current(_facts(spark, d).filter("predicate = 'reputation.review_count'"))
    h = h.select("subject_id", F.expr("cast(try_cast(value_json as double) as bigint)").cast("string").alias("value_hash"), instant_us(F.col("valid_from")).alias("valid_from"), "status")
    return facts.reconcile(o, h, ["subject_id"], F.col("h.status").isin("single_source", "stale"))


_EV = "e as (select distinct id, source_id, source_role, status, acquisition_session_id, (metadata_json::json->>'business_id')::bigint business_id, epoch_us(created_at::timestamptz) created from evidence_items)"


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_items", "id", "source_id", "source_role", "status", "acquisition_session_id", "metadata_json", "created_at").dropDuplicates(["id"])
    return e.withColumn("business_id", F.get_json_object("metadata_json", "$.business_id").cast("long")).withColumn("created", instant_us(F.col("created_at"))).drop("metadata_json", "created_at")


@query(f"with {_EV} select business_id, count(*) supports, count(distinct source_id) sources, case when count(distinct source_id) >= 2 then 'confirmed' else 'single_source' end state from e where status = 'usable' group by 1")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    return facts.corroboration(_evidence(spark, d).filter("status = 'usable'"), ["business_id"], "source_id")


_VOC = "voc(predicate, domain, freshness_days) as (values " + ", ".join(f"('{p}', '{dm}', {f if f is not None else 'null'})" for _, _, p, dm, _, f in facts.PREDICATES) + ")"
_FRESH = f"{_CUR}, {_VOC}, w as (select c.*, coalesce(domain, 'unknown_predicate') as domain, case when status not in ('unknown', 'not_applicable') and freshness_days is not null then 1 else 0 end evaluated, case when status = 'stale' or (status not in ('unknown', 'not_applicable') and freshness_days is not null and {NOW_US} > epoch_us(coalesce(last_verified_at, valid_from)::timestamptz) + freshness_days * {DAY_US}) then 1 else 0 end is_stale from c left join voc using (predicate))"


@query(f"with {_FRESH} select id, domain, evaluated, is_stale from w")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return facts.freshness(facts.current(_facts(spark, d)), facts.vocabulary(spark), NOW_US).select("id", "domain", "evaluated", "is_stale")


@query(f"""with {_FRESH} select subject_id, domain, count(*) facts, count(*) filter (ok) fresh, case when count(*) filter (status = 'conflicted') > 0 then 'conflicted' when count(*) filter (ok) = 0 and count(*) filter (is_stale = 1) > 0 then 'stale' when count(*) filter (status = 'not_applicable') = count(*) then 'not_applicable'
when count(*) filter (ok) > 0 and count(*) filter (status in ('unknown', 'not_observed')) = 0 then case when count(*) filter (ok and status = 'confirmed') = count(*) filter (ok) then 'strong' else 'sufficient' end when count(*) filter (ok) > 0 then 'partial' else 'insufficient' end state
from (select *, status in ('confirmed', 'single_source') and is_stale = 0 ok from w) group by 1, 2""")
def domain_states(spark: SparkSession, d: str) -> DataFrame:
    return facts.domain_states(facts.freshness(facts.current(_facts(spark, d)), facts.vocabulary(spark), NOW_US))


_MANDATORY = ("communication", "locations", "operations", "reputation")


@query(f"""with t as ({SQL["domain_states"]}), ok as (select subject_id, list(domain) filter (state in ('sufficient', 'strong', 'not_applicable')) k from t group by 1)
select subject_id, case when n = 0 then 1 else 0 end ready, coalesce(blocking, '') blocking from (select subject_id, count(m) n, string_agg(m, ',' order by m) blocking from (select subject_id, m from ok, (values {", ".join(f"('{m}')" for m in _MANDATORY)}) v(m) where not list_contains(coalesce(k, []), m)) group by 1) union all
select subject_id, 1, '' from ok where list_has_all(coalesce(k, []), [{", ".join(f"'{m}'" for m in _MANDATORY)}])""")
def domain_ready(spark: SparkSession, d: str) -> DataFrame:
    return facts.readiness(domain_states(spark, d), _MANDATORY)


@query(f"""with {_CUR}, {_EV} select predicate, source_type, count(*) chains, count(distinct c.id) facts from c join maps_business_location_links l on l.location_id = c.subject_id join businesses b on b.id = l.business_id join e on e.business_id = b.id join sources s on s.id = e.source_id where e.status = 'usable' group by 1, 2""")
def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "maps_business_location_links", "business_id", "location_id").withColumnRenamed("location_id", "subject_id")
    src = table(spark, d, "sources", "id", "source_type").withColumnRenamed("id", "source_id")
    # facts are counted per subject before they meet evidence, so a hot subject is one row per predicate
    per = facts.current(_facts(spark, d)).groupBy("subject_id", "predicate").agg(F.count("*").alias("facts"))
    ev = _evidence(spark, d).filter("status = 'usable'").join(src, "source_id").groupBy("business_id", "source_type").agg(F.count("*").alias("items"))
    b = table(spark, d, "businesses", "id").withColumnRenamed("id", "business_id")
    j = per.join(links, "subject_id").join(b, "business_id", "left_semi").join(ev, "business_id")
    return j.groupBy("predicate", "source_type").agg(F.sum(F.col("facts") * F.col("items")).alias("chains"), F.sum("facts").alias("facts"))


@query(f"""with {_FACTS}, {_EV} select 'business_without_evidence' gap, count(*) n from businesses b where not exists (select 1 from e where e.business_id = b.id and e.status = 'usable') union all select 'fact_without_link', count(*) from f where not exists (select 1 from maps_business_location_links l where l.location_id = f.subject_id)
union all select 'business_without_link', count(*) from businesses b where not exists (select 1 from maps_business_location_links l where l.business_id = b.id) union all select 'document_without_business', count(*) from documents x where not exists (select 1 from businesses b where b.id = x.business_id) union all select 'order_without_lines', count(*) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def provenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    b, links = table(spark, d, "businesses", "id"), table(spark, d, "maps_business_location_links", "business_id", "location_id")
    e, f = _evidence(spark, d).filter("status = 'usable'"), _facts(spark, d).select("id", "subject_id")
    docs, o, li = table(spark, d, "documents", "doc_id", "business_id"), table(spark, d, "orders", "o_orderkey"), table(spark, d, "lineitem", "l_orderkey")
    parts = [
        ("business_without_evidence", quality.gaps(b, e, b["id"] == e["business_id"])),
        ("fact_without_link", quality.gaps(f, links, f["subject_id"] == links["location_id"])),
        ("business_without_link", quality.gaps(b, links, b["id"] == links["business_id"])),
        ("document_without_business", quality.gaps(docs, b, docs["business_id"] == b["id"])),
        ("order_without_lines", quality.gaps(o, li, o["o_orderkey"] == li["l_orderkey"])),
    ]
    out = [x.agg(F.lit(name).alias("gap"), F.count("*").alias("n")) for name, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query(f"with {_EV} select b.id business_id, count(distinct case when e.status = 'usable' then source_id end) sources from businesses b left join e on e.business_id = b.id group by 1 having count(distinct case when e.status = 'usable' then source_id end) <> 1")
def having_distinct(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "businesses", "id").withColumnRenamed("id", "business_id")
    j = b.join(_evidence(spark, d), "business_id", "left")
    return j.groupBy("business_id").agg(F.countDistinct(F.when(F.col("status") == "usable", F.col("source_id"))).alias("sources")).filter("sources <> 1")


@query("select c_nationkey customer_nation, s_nationkey supplier_nation, count(distinct o_orderkey) orders from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey where s_nationkey <> c_nationkey group by 1, 2")
def non_equi_mismatch(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem", "l_orderkey", "l_suppkey"), table(spark, d, "orders", "o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    j = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, (o["o_custkey"] == c["c_custkey"]) & (c["c_nationkey"] != s["s_nationkey"]))
    return j.groupBy(F.col("c_nationkey").alias("customer_nation"), F.col("s_nationkey").alias("supplier_nation")).agg(F.countDistinct("o_orderkey").alias("orders"))


@query(f"""with {_CUR}, ev as (select location_id subject_id, p predicate from maps_business_location_links, (values {", ".join(f"('{p}')" for _, k, p, *_ in facts.PREDICATES if k == "location")}) v(p)), st as (select subject_id, predicate, bool_or(status not in ('unknown', 'not_observed')) known from c group by 1, 2)
select ev.subject_id, ev.predicate, case when known is null then 'unresolved' else 'explicit' end why from ev left join st on st.subject_id = ev.subject_id and st.predicate = ev.predicate where known is null or not known""")
def unknowns_cross_anti(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "maps_business_location_links", "location_id").withColumnRenamed("location_id", "subject_id")
    return facts.open_questions(subjects, facts.current(_facts(spark, d)), facts.vocabulary(spark))


@query("""select raw_sha256, case when b.id is null then 'no_business' when l.location_id is null then 'no_location' when title is null then 'no_title' when address is null then 'no_address' when r.language is null then 'no_language' end issue
from (select distinct raw_sha256, language, business_id from parsed_reviews) r left join businesses b on b.id = r.business_id left join maps_business_location_links l on l.business_id = r.business_id""")
def left_chain_issues(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "parsed_reviews", "raw_sha256", "language", "business_id").distinct()
    b = table(spark, d, "businesses", "id", "title", "address").withColumnRenamed("id", "business_id").withColumn("there", F.lit(1))
    j = r.join(b, "business_id", "left").join(table(spark, d, "maps_business_location_links", "business_id", "location_id"), "business_id", "left")
    rules = [("no_business", F.col("there").isNull()), ("no_location", F.col("location_id").isNull()), ("no_title", F.col("title").isNull()), ("no_address", F.col("address").isNull()), ("no_language", F.col("language").isNull())]
    return j.select("raw_sha256", quality.first_issue(rules).alias("issue"))


_MIN = ", ".join(f"min(id) over (partition by {_SID.format(c)}) m_{c}, {_SID.format(c)} k_{c}" for c in ("place_id", "cid", "data_id"))
_GROUPS = f"""gk as (select id, unnest(['p' || place_id, 'c' || cid, 'd' || data_id]) k, unnest([place_id, cid, data_id]) v from businesses), gu as (select id, k from gk where lower(trim(v)) not in {_BLANK} and lower(trim(v)) not in ('0', '0x0', '0x0:0x0', '-1')),
gp as (select id a, id b from businesses union select gp.a, y.id from gp join gu x on x.id = gp.b join gu y on y.k = x.k), gr as (select a id, min(b) root from gp group by 1)"""
_EDGES = f"{_GROUPS}, ed as (select id, case when t < id then t when root < id then root end target from (select id, least(case when k_place_id is not null then m_place_id end, case when k_cid is not null then m_cid end, case when k_data_id is not null then m_data_id end) t from (select id, {_MIN} from businesses)) join gr using (id))"
_WALK = f"{_EDGES}, wk as (select id, id pos, 0 steps from ed union all select wk.id, ed.target, steps + 1 from wk join ed on ed.id = wk.pos where ed.target is not null), rs as (select wk.id, wk.pos root, steps from wk join ed on ed.id = wk.pos where ed.target is null)"


def _redirects(spark: SparkSession, d: str) -> DataFrame:
    """Each listing redirects to the smallest id it shares a strong id with; where that has none smaller but is linked to one through others, on to the smallest."""
    b = table(spark, d, "businesses", "id", "place_id", "cid", "data_id")
    keys = F.array_compact(F.array(*[F.concat(F.lit(f"{c}:"), strong_id(F.col(c))) for c in ("place_id", "cid", "data_id")]))
    k = b.select("id", F.explode(keys).alias("k"))
    low = k.join(k.groupBy("k").agg(F.min("id").alias("low")), "k").groupBy("id").agg(F.min("low").alias("low"))
    group = components(links_by_shared_key(k, "id", "k"))
    target = F.when(F.col("low") < F.col("id"), F.col("low")).when(F.col("group_id") < F.col("id"), F.col("group_id"))
    return b.select("id").join(low, "id", "left").join(group, "id", "left").select("id", target.alias("target"))


@query(f"with recursive {_WALK} select id, root, steps::bigint steps, 'resolved' state from rs")
def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve(_redirects(spark, d))


@query(f"with recursive {_WALK} select root, count(*) members, max(steps)::bigint longest from rs group by 1")
def redirect_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(graph.resolve(_redirects(spark, d)))


_RING = "case when {0} < 5 then ({0} + 1) % 5 when {0} < 10 then {0} - 5 when {0} = 24 then 99 when {0} > 10 then {0} - 1 end"


@query(f"""with recursive ed as (select n_nationkey::bigint id, ({_RING.format("n_nationkey")})::bigint target from nation), wk as (select id, id pos, 0 steps from ed union all select wk.id, ed.target, steps + 1 from wk join ed on ed.id = wk.pos where ed.target is not null and steps < 60),
l as (select id, max(steps) steps from wk group by 1), f as (select wk.id, wk.pos, wk.steps from wk join l on l.id = wk.id and l.steps = wk.steps)
select id, case when steps < 60 then pos else -1 end root, case when steps < 60 then steps::bigint else -1 end steps, case when steps >= 60 then 'cycle' when pos = 99 then 'missing' else 'resolved' end state from f""")
def redirect_cycle_check(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey").select(F.col("n_nationkey").cast("long").alias("id"))
    r = graph.resolve(n.select("id", F.expr(_RING.format("id")).cast("long").alias("target")))
    return r.select("id", _or("root"), _or("steps"), "state")


_EVENT_NOW = 1_706_572_800_000_000


@query(f"""with ok as (select user_id, max(ts) t from events where event_type <> 'error' group by 1) select e.user_id, count(*) sessions, count(*) filter (event_type = 'error' and (t is null or ts > t)) streak, count(*) filter (event_type = 'error' and (t is null or ts > t) and epoch_us(ts) >= {_EVENT_NOW - DAY_US}) streak_recent from events e left join ok on ok.user_id = e.user_id group by 1""")
def failure_streak(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "ts", "event_type").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return sessions.failure_streaks(e, "user_id", "at", F.col("event_type") == "error", _EVENT_NOW, DAY_US)


_RUNAT = f"{NOW_US - 200 * DAY_US}"


@query(f"""with r as (select area_name, status, {_RUNAT} - epoch_us(started_at::timestamptz) age from runs) select area_name, count(*) filter (status in ('failed', 'interrupted', 'partial') and age between 0 and {365 * DAY_US}) retries, count(*) filter (status in ('planned', 'running') and age between -300000000 and {DAY_US // 4}) in_flight_fresh,
count(*) filter (status in ('planned', 'running') and age > {DAY_US // 4}) in_flight_orphaned, count(*) filter (status in ('planned', 'running') and age < -300000000) in_flight_future from r group by 1""")
def retry_window(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runs", "area_name", "status", "started_at").withColumn("at", instant_us(F.col("started_at")))
    return sessions.retry_window(r, "area_name", "at", "status", int(_RUNAT), 365 * DAY_US, DAY_US // 4, 300_000_000)


@query("with e as (select o_orderkey k from orders), c as (select distinct l_orderkey k from lineitem union select unnest([-1, -2, -3])) select (select count(*) from e where k in (select k from c)) matched, (select count(*) from e where k not in (select k from c)) missing, (select count(*) from c where k not in (select k from e)) unexpected")
def completion_compare(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "k")
    c = table(spark, d, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "k").union(spark.createDataFrame([(-1,), (-2,), (-3,)], "k long"))
    return sessions.completion(e, c, "k")


@query("select 'missing' side, (count(*) - count(distinct id))::bigint as \"rows\" from facts")
def relation_diff(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts", *_F)
    return quality.difference(f, f.dropDuplicates(["id"]))


def _wide_sql(*cols: str) -> str:
    row = "md5(concat_ws(chr(31), " + ", ".join(f"coalesce({c}::varchar, chr(0))" for c in cols) + "))"
    part = lambda at: f"sum(('0x' || substr({row}, {at}, 15))::bigint::hugeint)::varchar"
    return f"{part(1)} || '-' || {part(17)}"


_WHOLE = ("id", "canonical_key", "place_id", "cid", "data_id", "title", "category", "address", "phone", "website", "review_count", "status", "first_seen_at", "last_seen_at", "first_run_id", "last_run_id", "raw_json")


@query(f"select count(*) row_count, {_wide_sql(*_WHOLE)} digest from businesses")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Of all columns but the three doubles, whose texts differ between engines; ``raw_json`` holds their values too."""
    return quality.fingerprint(table(spark, d, "businesses", *_WHOLE), *_WHOLE)


@query("select l_orderkey, sha256(concat_ws(chr(31), string_agg(s, chr(31) order by s), string_agg(p, chr(31) order by p))) seal from (select l_orderkey, l_suppkey::varchar || '-' || l_linenumber s, l_partkey::varchar || '-' || l_linenumber p from lineitem) group by 1")
def seal_digest(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    name = lambda c: F.concat(F.col(c).cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    # an order has at most a few dozen lines
    g = li.groupBy("l_orderkey").agg(F.collect_list(name("l_suppkey")).alias("s"), F.collect_list(name("l_partkey")).alias("p"))
    return g.select("l_orderkey", identity.seal(F.col("s"), F.col("p")).alias("seal"))


@query("select id, status, started_at from runs order by started_at desc, id limit 20")
def recent_runs_topk(spark: SparkSession, d: str) -> DataFrame:
    return sessions.newest(table(spark, d, "runs", "id", "status", "started_at"), [F.col("started_at").desc(), F.col("id")], 20)


@query(f"""with c as (select 'fact_id_unique' check_name, (select count(*) from (select id from facts group by 1 having count(*) > 1)) bad union all select 'business_id_unique', (select count(*) from (select id from businesses group by 1 having count(*) > 1)) union all select 'place_id_unique', (select count(*) from (select {_SID.format("place_id")} k from businesses group by 1 having count(*) > 1) where k is not null)
union all select 'location_unique', (select count(*) from (select location_id from maps_business_location_links group by 1 having count(*) > 1)) union all select 'last_run_known', (select count(*) from businesses where last_run_id not in (select id from runs)) union all select 'evidence_source_known', (select count(*) from evidence_items where source_id not in (select id from sources))
union all select 'fact_status', (select count(*) from facts where status is null or status not in ('confirmed', 'single_source', 'stale', 'conflicted', 'unknown', 'not_observed', 'not_applicable')) union all select 'coordinates', (select count(*) from businesses where not coalesce(latitude between -90 and 90 and longitude between -180 and 180, false))
union all select 'value_stated', (select count(*) from facts where (value_json is null) <> (status in ('unknown', 'not_observed', 'not_applicable'))) union all select 'closed_after_start', (select count(*) from facts where not coalesce(valid_to::timestamptz >= valid_from::timestamptz, true)) union all select 'terminal_run_finished', (select count(*) from runs where status = 'complete' and finished_at is null)
union all select 'link_business_known', (select count(*) from maps_business_location_links where business_id not in (select id from businesses)) union all select 'one_link_per_business', (select count(*) from (select business_id from maps_business_location_links group by 1 having count(*) > 1))
union all select 'review_seal', (select count(*) from parsed_reviews where raw_sha256 <> sha256(raw_json)) union all select 'single_slot', (select count(*) from facts where predicate not in ('location.phone', 'reputation.customer_review') and fact_slot <> '__single__')
union all select 'one_open_version', (select count(*) from (select subject_id, predicate, fact_slot from (select distinct id, subject_id, predicate, fact_slot, valid_to from facts) where valid_to is null group by 1, 2, 3 having count(*) > 1))) select check_name, bad, (bad = 0)::int passed from c""")
def dq_gate(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts", "id", "subject_id", "predicate", "fact_slot", "value_json", "status", "valid_from", "valid_to")
    b = table(spark, d, "businesses", "id", "place_id", "latitude", "longitude", "last_run_id")
    r, e = table(spark, d, "runs", "id", "status", "finished_at"), table(spark, d, "evidence_items", "id", "source_id")
    links, reviewed = table(spark, d, "maps_business_location_links", "business_id"), table(spark, d, "parsed_reviews", "raw_sha256", "raw_json")
    none = F.col("status").isin(*facts_none())
    return quality.gate(
        [
            quality.foreign_check(links, "link_business_known", "business_id", b, "id"),
            quality.unique_check(links, "one_link_per_business", "business_id"),
            quality.rule_check(reviewed, "review_seal", F.col("raw_sha256") == F.sha2("raw_json", 256)),
            quality.rule_check(f, "single_slot", F.col("predicate").isin("location.phone", "reputation.customer_review") | (F.col("fact_slot") == "__single__")),
            quality.unique_check(f, "fact_id_unique", "id"),
            quality.unique_check(b, "business_id_unique", "id"),
            quality.unique_check(b.select(strong_id(F.col("place_id")).alias("k")).filter("k is not null"), "place_id_unique", "k"),
            quality.unique_check(table(spark, d, "maps_business_location_links", "location_id"), "location_unique", "location_id"),
            quality.foreign_check(b, "last_run_known", "last_run_id", r, "id"),
            quality.foreign_check(e, "evidence_source_known", "source_id", table(spark, d, "sources", "id"), "id"),
            quality.rule_check(f, "fact_status", F.col("status").isin("confirmed", "single_source", "stale", "conflicted", *facts_none())),
            quality.rule_check(b, "coordinates", F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)),
            quality.rule_check(f, "value_stated", F.col("value_json").isNull() == none),
            quality.rule_check(f, "closed_after_start", F.coalesce(instant_us(F.col("valid_to")) >= instant_us(F.col("valid_from")), F.lit(True))),
            quality.rule_check(r, "terminal_run_finished", (F.col("status") != "complete") | F.col("finished_at").isNotNull()),
            quality.unique_check(f.dropDuplicates(["id"]).filter("valid_to is null"), "one_open_version", "subject_id", "predicate", "fact_slot"),
        ]
    )


def facts_none() -> tuple[str, ...]:
    """Statuses of facts that state no value."""
    return ("unknown", "not_observed", "not_applicable")


@query("""select distinct u url, case when u like 'http%' then regexp_replace(regexp_replace(lower(regexp_extract(u, '^https?://[^/]+')) || coalesce(nullif(regexp_extract(u, '^https?://[^/]+(.*)$', 1), ''), '/'), '([?&])utm_[a-z]+=[^&]*', '\\1'), '[?&]+$', '') end normal
from (select page_url u from documents union select website from businesses) where u is not null""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents", F.col("page_url").alias("url")).union(table(spark, d, "businesses", F.col("website").alias("url"))).filter("url is not null").distinct()
    return u.select("url", urls.normalize_url("url").alias("normal"))


_HOST = "nullif(regexp_replace(lower(regexp_extract({0}, '^https?://([^/?#:]+)', 1)), '^www\\.', ''), '')"


@query(f"select doc_id, {_HOST.format('page_url')} host, coalesce({_HOST.format('page_url')} = {_HOST.format('website')}, false)::int same_site from documents left join businesses on id = business_id where page_url is not null")
def host_same_site(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "page_url", "business_id").filter("page_url is not null")
    j = docs.join(table(spark, d, "businesses", F.col("id").alias("business_id"), "website"), "business_id", "left")
    return j.select("doc_id", urls.host(F.col("page_url")).alias("host"), urls.same_site(F.col("page_url"), F.col("website")).cast("int").alias("same_site"))


@query("""with p as (select doc_id, lower(regexp_extract(page_url, '^https?://[^/?#]*(/[^?#]*)?', 1)) p from documents where page_url is not null)
select doc_id, case when regexp_matches(p, 'book|reserv|appointment') then 'booking' when regexp_matches(p, 'order|delivery|pickup|takeaway|takeout') then 'ordering' when p like '%contact%' then 'contact' when regexp_matches(p, 'service|product|menu|pricing') then 'offerings' when regexp_matches(p, 'location|branches') then 'locations' when p like '%about%' then 'about' when p in ('', '/') then 'home' else 'other' end as role,
(case p when '/menu' then 100 when '/about' then 80 when '/contact' then 100 else 0 end)::bigint priority from p""")
def page_role(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "page_url").filter("page_url is not null")
    return docs.select("doc_id", urls.page_role(F.col("page_url")).alias("role"), urls.link_priority(F.col("page_url"), F.lit("")).alias("priority"))


@query("""with l as (select business_id, page_url, (case regexp_extract(page_url, '^https?://[^/?#]*(/[^?#]*)?', 1) when '/menu' then 100 when '/about' then 80 when '/contact' then 100 else 0 end)::bigint priority from (select distinct business_id, page_url from documents where page_url is not null and business_id is not null))
select business_id, page_url, priority from (select *, row_number() over (partition by business_id order by priority desc, page_url) n from l) where n <= 2""")
def link_priority_topk(spark: SparkSession, d: str) -> DataFrame:
    """The two best pages of every site; Spark limits each group before the shuffle, so a hot site sends few rows."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents", "business_id", "page_url").filter("page_url is not null and business_id is not null").distinct()
    p = docs.withColumn("priority", urls.link_priority(F.col("page_url"), F.lit("")))
    n = F.row_number().over(Window.partitionBy("business_id").orderBy(F.col("priority").desc(), "page_url"))
    return p.withColumn("n", n).filter("n <= 2").drop("n")


@query("select id, nullif(nullif(regexp_replace(regexp_replace(phone, '[^0-9+]', '', 'g'), '^00', '+'), ''), '+') phone from businesses where phone is not null")
def phone_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "businesses", "id", "phone").filter("phone is not null").select("id", urls.normalize_phone(F.col("phone")).alias("phone"))


# websites of the data are plain links to sites of their own, which are no channel
@query("""select id, null channel_type, null identifier from businesses where website is not null and not regexp_matches(lower(website), 'whatsapp|wa\\.me|instagram|facebook|fb\\.com|linkedin|x\\.com|twitter|tiktok|youtu|booksy|calendly|opentable|resy|fresha|mindbody|doordash|ubereats|talabat|hungerstation|jahez|deliveroo') union all
select id, case when p is not null then 'phone' end, p from (select id, nullif(nullif(regexp_replace(regexp_replace(phone, '[^0-9+]', '', 'g'), '^00', '+'), ''), '+') p from businesses where phone is not null)""")
def channel_classify(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "businesses", "id", "website", "phone")
    href = b.select("id", F.explode(F.array_compact(F.array("website", F.concat(F.lit("tel:"), F.col("phone"))))).alias("href"))
    return href.select("id", urls.channel(F.col("href")).alias("c")).select("id", F.col("c.type").alias("channel_type"), F.col("c.identifier").alias("identifier"))


@query(f"with {_EV}, t as (select business_id, max(created) created from e group by 1) select e.business_id, min(e.id) latest, e.created, count(*) ties from e join t on t.business_id = e.business_id and t.created = e.created group by 1, 3")
def latest_or_tie(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_or_tie(_evidence(spark, d), "business_id", "created", "id")


@query("""select greatest((select max(epoch_us(valid_from::timestamptz)) from facts), (select max(epoch_us(reconciled_at::timestamptz)) from facts), (select max(epoch_us(created_at::timestamptz)) from evidence_items), (select max(epoch_us(last_seen_at::timestamptz)) from businesses), (select max(epoch_us(linked_at::timestamptz)) from maps_business_location_links), (select max(epoch_us(finished_at::timestamptz)) from runs)) watermark_us""")
def input_watermark(spark: SparkSession, d: str) -> DataFrame:
    parts = [("facts", "valid_from"), ("facts", "reconciled_at"), ("evidence_items", "created_at"), ("businesses", "last_seen_at"), ("maps_business_location_links", "linked_at"), ("runs", "finished_at")]
    tops = [table(spark, d, t, c).agg(F.max(instant_us(F.col(c))).alias("m")) for t, c in parts]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out.agg(F.max("m").alias("watermark_us"))


@query(f"with {_EV} select source_id, arg_max(id, lpad(created::varchar, 20, '0') || id) freshest, max(created) created from e where status = 'usable' group by 1")
def freshest_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d).filter("status = 'usable'")
    return e.groupBy("source_id").agg(F.max_by("id", F.struct("created", "id")).alias("freshest"), F.max("created").alias("created"))


@query(f"with recursive {_WALK} select root, count(*) locations from rs join maps_business_location_links l on l.business_id = rs.id group by 1 having count(*) > 1")
def duplicate_locations(spark: SparkSession, d: str) -> DataFrame:
    r = graph.resolve(_redirects(spark, d)).filter("state = 'resolved'").select(F.col("id").alias("business_id"), "root")
    return r.join(table(spark, d, "maps_business_location_links", "business_id", "location_id"), "business_id").groupBy("root").agg(F.count("*").alias("locations")).filter("locations > 1")


@query("select user_id, arg_min(event_id, ts) event_id, arg_min(event_type, ts) event_type from events group by 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return sessions.keep_first(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("select before, after, count(*) n from (select lag(event_type) over (partition by user_id order by ts, event_id) before, event_type after from events) where before is not null and before <> after group by 1, 2")
def status_moves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "ts", "event_id", "event_type").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return sessions.status_moves(e, "user_id", "at", "event_id", "event_type")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') as hour, event_type, count(*) n, count(distinct user_id) users from events group by 1, 2")
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "event_type", "user_id")
    hour = F.date_format(F.window(F.col("ts").cast("timestamp"), "1 hour")["start"], "yyyy-MM-dd HH:00").alias("hour")
    return e.groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"""with v(p) as (values {", ".join(f"('{p}')" for _, _, p, *_ in facts.PREDICATES)}), f as (select distinct predicate p from facts) select p predicate, 'unused' side from v where p not in (select p from f) union all select p, 'unknown' from f where p not in (select p from v)""")
def vocabulary_difference(spark: SparkSession, d: str) -> DataFrame:
    v, f = facts.vocabulary(spark).select("predicate"), table(spark, d, "facts", "predicate").distinct()
    return v.join(f, "predicate", "left_anti").withColumn("side", F.lit("unused")).union(f.join(v, "predicate", "left_anti").withColumn("side", F.lit("unknown")))


_STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


@query(f"select id, regexp_matches(retrieved_at, '{_STRICT}')::int strict_form from (select distinct id, retrieved_at from evidence_items) where retrieved_at is not null")
def iso_strict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_items", "id", "retrieved_at").distinct().filter("retrieved_at is not null")
    return e.select("id", F.col("retrieved_at").rlike(_STRICT).cast("int").alias("strict_form"))


@query(f"with {_EV} select id, (created between {NOW_US - 180 * DAY_US} and {NOW_US})::int in_window, date_diff('day', make_timestamp(created), make_timestamp({NOW_US}))::bigint age_days from (select distinct id, created from e)".replace(f"date_diff('day', make_timestamp(created), make_timestamp({NOW_US}))::bigint", f"(floor(({NOW_US} - created) / {DAY_US}.0))::bigint"))
def age_window(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d)
    return e.select("id", F.col("created").between(NOW_US - 180 * DAY_US, NOW_US).cast("int").alias("in_window"), F.floor((F.lit(NOW_US) - F.col("created")) / DAY_US).cast("long").alias("age_days"))


@query("select l.business_id, l.location_id, sha256(l.business_id::varchar || chr(0) || l.location_id || chr(0)) pair_digest, 'acq_' || substr(sha256(l.business_id::varchar || chr(31) || l.location_id), 1, 32) opaque from maps_business_location_links l")
def opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    link = table(spark, d, "maps_business_location_links", "business_id", "location_id")
    return link.select("business_id", "location_id", identity.terminated_digest(F.col("business_id"), F.col("location_id")).alias("pair_digest"), identity.opaque_id("acq", F.col("business_id"), F.col("location_id")).alias("opaque"))


@query(f"select id, case when lower(trim(title)) not in {_BLANK} then trim(title) end title, case when lower(trim(category)) not in {_BLANK} then trim(category) end category, coalesce(try_cast(phone as bigint), -1) phone_number from businesses")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "businesses", "id", "title", "category", "phone")
    return b.select("id", no_placeholder(F.col("title")).alias("title"), no_placeholder(F.col("category")).alias("category"), F.coalesce(clean_text(F.col("phone")).try_cast("long"), F.lit(-1)).alias("phone_number"))


@query("""select event_id, greatest(least(60, 0.5 * 2 ** (event_id % 9)), case when event_type = 'error' then coalesce(least(120, (props::json->>'k')::bigint), 0) else 0 end)::double wait_s from events""")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Doubling waits up to a cap by attempt; a delay that was asked for counts where it is longer."""
    e = table(spark, d, "events", "event_id", "event_type", "props")
    asked = F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k").try_cast("double")).otherwise(0.0)
    return e.select("event_id", sessions.backoff(F.col("event_id") % 9 + 1, asked, 0.5, 60.0, 120.0).alias("wait_s"))


_ONE = ("place_id", "cid", "data_id", "phone", "website")


@query(f"with recursive {_WALK} " + " union all ".join(f"select root group_id, '{c}' as field, count(distinct nullif(trim({c}), '')) n from rs join businesses b on b.id = rs.id group by 1 having count(distinct nullif(trim({c}), '')) > 1" for c in _ONE))
def identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Fields a place should have one value of, in groups that hold several: strong ids, phone, website."""
    g = graph.resolve(_redirects(spark, d)).filter("state = 'resolved'").select("id", F.col("root").alias("group_id"))
    return canonical.identity_conflicts(table(spark, d, "businesses", "id", *_ONE), g, _ONE)
