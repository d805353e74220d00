"""Further queries: integrity, reconciliation of groups, signatures and the read model, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import urls
from strataform.functions.jsons import instant_us
from strataform.functions.text import clean_text
from strataform.operators import facts, graph, grid, quality, reviews
from strataform.plans.reference import _CUR, _EV, _FACTS, _GRID_SQL, _WALK, DAY_US, NOW_US, _evidence, _facts, _grids, _redirects, _wide_sql
from strataform.sources.tables import columns, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_PRIVATE = ("Name", "ProfilePicture")
_ALLOWED = ("review_id", "source", "language", "text_original", "text_translated", "translated_lang", "Description", "When", "Rating", "rating_float", "rating_scale", "posted_at_unix_micros", "updated_at_unix_micros", "reply_text_original", "reply_text", "reply_language", "published_at", "time_zone", "locale")


@query(f"""with j as (select distinct raw_sha256, raw_json::json o from parsed_reviews) select raw_sha256, len(list_intersect(json_keys(o), {_listed(_PRIVATE)}))::bigint private_keys, (len(json_keys(o)) - len(list_intersect(json_keys(o), {_listed(_PRIVATE + _ALLOWED)})))::bigint unknown_keys,
coalesce(try_cast(o->>'Rating' as double) >= 0 and try_cast(o->>'Rating' as double) <= coalesce(try_cast(o->>'rating_scale' as double), 5), false)::int rating_ok from j""")
def privacy_projection(spark: SparkSession, d: str) -> DataFrame:
    """What the review projection drops or can't take: author keys, unknown keys, ratings beyond their scale."""
    r = table(spark, d, "parsed_reviews", "raw_sha256", "raw_json").distinct().withColumn("k", F.json_object_keys("raw_json"))
    names = lambda ns: F.array(*[F.lit(n) for n in ns])
    r = r.withColumn("r", reviews.normalise(F.col("raw_json")))
    ok = (F.col("r.rating") >= 0) & (F.col("r.rating") <= F.coalesce("r.rating_scale", F.lit(5)))
    private, unknown = F.size(F.array_intersect("k", names(_PRIVATE))), F.size(F.array_except("k", names(_PRIVATE + _ALLOWED)))
    return r.select("raw_sha256", private.cast("long").alias("private_keys"), unknown.cast("long").alias("unknown_keys"), F.coalesce(ok, F.lit(False)).cast("int").alias("rating_ok"))


_RUN_RULES = {
    "not_complete": ("status <> 'complete'", lambda: F.col("status") != "complete"),
    "no_finish": ("coalesce(trim(finished_at), '') = ''", lambda: clean_text(F.col("finished_at")).isNull()),
    "bad_exit": ("coalesce(exit_code, 0) <> 0", lambda: F.coalesce("exit_code", F.lit(0)) != 0),
    "no_config": ("config_json is null", lambda: F.col("config_json").isNull()),
    "cell_differs": ("coalesce((config_json::json->>'cell_km')::double, cell_km) <> cell_km", lambda: F.coalesce(F.get_json_object("config_json", "$.cell_km").cast("double"), "cell_km") != F.col("cell_km")),
    "not_strict": ("coalesce(config_json::json->>'strict_bounds', 'x') <> 'true'", lambda: F.coalesce(F.get_json_object("config_json", "$.strict_bounds"), F.lit("x")) != "true"),
    "ends_before_start": ("coalesce(finished_at::timestamptz < started_at::timestamptz, false)", lambda: F.coalesce(instant_us(F.col("finished_at")) < instant_us(F.col("started_at")), F.lit(False))),
}


def _codes(rules) -> str:
    """SQL for the codes of all rules that apply, joined by commas."""
    return "array_to_string(list_filter([" + ", ".join(f"case when {cond} then '{code}' end" for code, cond in rules) + "], lambda x: x is not null), ',')"


@query(f"select id, {_codes([(code, sql) for code, (sql, _) in _RUN_RULES.items()])} issues from runs")
def run_issues(spark: SparkSession, d: str) -> DataFrame:
    """All rules a run breaks before it may serve as a source."""
    r = table(spark, d, "runs", "id", "status", "finished_at", "started_at", "exit_code", "config_json", "cell_km")
    return r.select("id", F.array_join(quality.all_issues([(code, rule()) for code, (_, rule) in _RUN_RULES.items()]), ",").alias("issues"))


_TABLES = ("runs", "sources", "areas", "businesses", "maps_business_location_links", "facts", "evidence_items", "parsed_reviews", "documents", "eval_items", "packing_targets")


@query(f"""select table_name, column_name, ordinal_position as position, case data_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double' when 'VARCHAR[]' then 'array<string>' when 'TIMESTAMP' then 'timestamp_ntz' else data_type end data_type from information_schema.columns where table_name in ({', '.join(repr(t) for t in _TABLES)})""")
def schema_check(spark: SparkSession, d: str) -> DataFrame:
    """Tables, columns, their positions and types as data."""
    return columns(spark, d, _TABLES)


@query("select id, json_valid(raw_json)::int ok from businesses")
def json_strict(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "businesses", "id", "raw_json").select("id", F.try_parse_json("raw_json").isNotNull().cast("int").alias("ok"))


@query(_GRID_SQL + """, q as (select run_id, nrow, ncol, a, b, c, d, (b - a) / nrow h, (d - c) / ncol w from g where nrow > 0 and ncol > 0)
select run_id, i::bigint as "row", k::bigint as "column", round(a + i * h, 6) min_lat, round(case when i + 1 = nrow then b else a + (i + 1) * h end, 6) max_lat, round(c + k * w, 6) min_lon, round(case when k + 1 = ncol then d else c + (k + 1) * w end, 6) max_lon
from q, lateral (select unnest(range(0, nrow)) i) x, lateral (select unnest(range(0, ncol)) k) y""")
def bin_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box of every bin, south to north and west to east; the last edges are exactly the box's."""
    g = _grids(spark, d)
    sized = grid.grid_estimate(g).select("run_id", "rows", "columns").filter("rows > 0 and columns > 0").join(g.select("run_id", "box"), "run_id")
    b = grid.bin_boxes(sized)
    return b.select("run_id", "row", "column", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query(f"""with recursive {_WALK}, {_CUR}, o as (select root, count(distinct review_count) amounts, max(review_count)::varchar amount, count(distinct last_run_id) sources, max(epoch_us(last_seen_at::timestamptz)) seen from rs join businesses b on b.id = rs.id where review_count is not null group by 1),
h as (select business_id, try_cast(try_cast(value_json as double) as bigint)::varchar v, status s, vf f, epoch_us(last_verified_at::timestamptz) l from c join maps_business_location_links on location_id = subject_id where predicate = 'reputation.review_count')
select root, case when amounts > 1 then 'mixed' when business_id is null then 'created' when seen < f or (v is not distinct from amount and coalesce(seen <= l, false)) then case when v is not distinct from amount and s = 'confirmed' then 'attached' else 'ignored' end
when (v is not distinct from amount and s = 'confirmed') or sources >= 2 then 'confirmed' else 'single_source' end outcome from o left join h on h.business_id = o.root""")
def reconcile_groups(spark: SparkSession, d: str) -> DataFrame:
    """Review counts of all listings of a place against the fact held of it."""
    root = graph.resolve(_redirects(spark, d)).filter("state = 'resolved'").select("id", "root")
    b = table(spark, d, "businesses", "id", "review_count", "last_run_id", "last_seen_at").filter("review_count is not null").join(root, "id")
    o = b.groupBy("root").agg(F.countDistinct("review_count").alias("values"), F.max("review_count").cast("string").alias("value"), F.countDistinct("last_run_id").alias("sources"), F.max(instant_us(F.col("last_seen_at"))).alias("at"))
    links = table(spark, d, "maps_business_location_links", F.col("business_id").alias("root"), F.col("location_id").alias("subject_id"))
    h = facts.current(_facts(spark, d).filter("predicate = 'reputation.review_count'")).join(links, "subject_id")
    h = h.select("root", F.expr("cast(try_cast(value_json as double) as bigint)").cast("string").alias("value"), "status", instant_us(F.col("valid_from")).alias("valid_from"), instant_us(F.col("last_verified_at")).alias("last_verified"))
    return facts.reconcile_groups(o, h, "root").select("root", "outcome")


@query(f"with {_FACTS}, n as (select predicate, vf, lead(vf) over (partition by subject_id, predicate, fact_slot order by vf, id) nx from f) select predicate, count(*) statements, count(*) filter (nx = vf) same_instant, count(*) filter (nx is null) slots from n group by 1")
def advancing_time(spark: SparkSession, d: str) -> DataFrame:
    """Per predicate: statements, those followed by one of the same instant, and slots."""
    s = _facts(spark, d).withColumn("vf", instant_us(F.col("valid_from")))
    n = facts.scd2(s, ["subject_id", "predicate", "fact_slot"], "vf", "id")
    return n.groupBy("predicate").agg(F.count("*").alias("statements"), F.count_if(F.col("closed_at") == F.col("vf")).alias("same_instant"), F.count_if(F.col("closed_at").isNull()).alias("slots"))


@query(f"with {_EV} select business_id, bool_and(status = 'usable')::int all_usable, (count(distinct case when status = 'usable' then source_id end) >= 2)::int corroborated, bool_and(source_id = 'src_google_maps')::int maps_only from e group by 1")
def support_quality(spark: SparkSession, d: str) -> DataFrame:
    n = F.countDistinct(F.when(F.col("status") == "usable", F.col("source_id")))
    return _evidence(spark, d).groupBy("business_id").agg(F.bool_and(F.col("status") == "usable").cast("int").alias("all_usable"), (n >= 2).cast("int").alias("corroborated"), F.bool_and(F.col("source_id") == "src_google_maps").cast("int").alias("maps_only"))


_FACT_RULES = (
    ("no_link", "business_id is null"),
    ("value_without_evidence", "status in ('confirmed', 'single_source', 'stale') and usable = 0"),
    ("confirmed_by_one_source", "status = 'confirmed' and sources < 2"),
    ("conflict_without_two_sources", "status = 'conflicted' and sources < 2"),
    ("absence_without_search", "status = 'not_observed' and items = 0"),
    ("nonusable_evidence", "items > usable"),
)


@query(f"""with {_CUR}, {_EV}, n as (select business_id, count(*) items, count(*) filter (status = 'usable') usable, count(distinct source_id) sources from e group by 1), j as (select c.id, c.status, l.business_id, coalesce(items, 0) items, coalesce(usable, 0) usable, coalesce(sources, 0) sources from c left join maps_business_location_links l on l.location_id = c.subject_id left join n on n.business_id = l.business_id)
select id, {_codes(_FACT_RULES)} issues from j""")
def fact_issues(spark: SparkSession, d: str) -> DataFrame:
    """Integrity codes of every open fact, over evidence counted per business before it is joined."""
    n = _evidence(spark, d).groupBy("business_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "usable").alias("usable"), F.countDistinct("source_id").alias("sources"))
    links = table(spark, d, "maps_business_location_links", "business_id", F.col("location_id").alias("subject_id"))
    j = facts.current(_facts(spark, d)).join(links.join(n, "business_id", "left"), "subject_id", "left").fillna(0, ["items", "usable", "sources"])
    return j.select("id", F.array_join(quality.all_issues([(code, F.expr(cond)) for code, cond in _FACT_RULES]), ",").alias("issues"))


@query(f"with {_EV} select distinct business_id from e a where status = 'usable' and source_id = 'src_google_maps' and not exists (select 1 from e b where b.business_id = a.business_id and b.status = 'usable' and b.source_id <> 'src_google_maps')")
def dependent_on_source(spark: SparkSession, d: str) -> DataFrame:
    """Businesses that would lose all usable evidence with one source."""
    e = _evidence(spark, d).filter("status = 'usable'")
    mine, rest = e.filter("source_id = 'src_google_maps'").select("business_id").distinct(), e.filter("source_id <> 'src_google_maps'").select("business_id")
    return mine.join(rest, "business_id", "left_anti")


_UNEXPLAINED = "raw_records - accepted_records - out_of_bounds_records - unlocated_records - unidentified_records"


@query(f"select id, {_UNEXPLAINED} as unexplained, (unique_seen <= accepted_records and new_businesses <= unique_seen)::int consistent from runs")
def counter_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").selectExpr("id", f"{_UNEXPLAINED} as unexplained", "cast(unique_seen <= accepted_records and new_businesses <= unique_seen as int) as consistent")


_STATED = ("id", "subject_id", "predicate", "fact_slot", "value_json", "status", "valid_from", "last_verified_at", "reconciled_at")


@query(f"select reconciliation_version snapshot, count(*) row_count, {_wide_sql(*_STATED)} digest from facts group by 1")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Row counts and order-free digests of snapshots of one table, to be compared with each other."""
    f = table(spark, d, "facts", "reconciliation_version", *_STATED)
    return f.groupBy(F.col("reconciliation_version").alias("snapshot")).agg(F.count("*").alias("row_count"), quality.wide_digest(*_STATED).alias("digest"))


@query(f"with {_CUR} select subject_id, count(*) facts, {_wide_sql(*_STATED)} signature from c group by 1")
def state_signature(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each subject's open facts; equal digests mean nothing changed since."""
    return facts.current(_facts(spark, d)).groupBy("subject_id").agg(F.count("*").alias("facts"), quality.wide_digest(*_STATED).alias("signature"))


@query(f"with recursive {_WALK}, g as (select root, count(*) n from rs group by 1) select rs.id, case when n = 1 then 'sole' when rs.id = rs.root then 'current' else 'merged_alias' end relation from rs join g on g.root = rs.root")
def alias_status(spark: SparkSession, d: str) -> DataFrame:
    r = graph.resolve(_redirects(spark, d)).filter("state = 'resolved'").select("id", "root")
    n = r.groupBy("root").agg(F.count("*").alias("n"))
    return r.join(n, "root").select("id", F.when(F.col("n") == 1, "sole").when(F.col("id") == F.col("root"), "current").otherwise("merged_alias").alias("relation"))


@query("""with p as (select business_id, regexp_extract(page_url, '^https?://[^/?#]*(/[^?#]*)?', 1) p, collected_at from documents where page_url is not null and business_id is not null), o as (select business_id, case p when '/contact' then 'communication.contact_page' when '/menu' then 'offerings.page' when '/' then 'website.home' when '/about' then 'about.page' end predicate, collected_at from p)
select business_id, predicate, count(*) pages, max(epoch_us(collected_at)) last_us from o where predicate is not null group by 1, 2""")
def page_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations from the roles of a business's pages, one per predicate."""
    docs = table(spark, d, "documents", "business_id", "page_url", "collected_at").filter("page_url is not null and business_id is not null")
    role = urls.page_role(F.col("page_url"))
    p = F.when(role == "contact", "communication.contact_page").when(role == "offerings", "offerings.page").when(role == "home", "website.home").when(role == "about", "about.page")
    o = docs.select("business_id", p.alias("predicate"), F.unix_micros(F.col("collected_at").cast("timestamp")).alias("at")).filter("predicate is not null")
    return o.groupBy("business_id", "predicate").agg(F.count("*").alias("pages"), F.max("at").alias("last_us"))


@query(f"""with s as (select business_id, case when page_url is null then source else 'website' end stage, (epoch_us(collected_at) >= {NOW_US - 365 * DAY_US})::int fresh from documents where business_id is not null) select business_id, stage, count(*) contributions, case when max(fresh) = 1 then 'observed' else 'stale' end state from s group by 1, 2""")
def stage_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each kind of material about a business: observed where any of it is fresh, else stale."""
    docs = table(spark, d, "documents", "business_id", "page_url", "source", "collected_at").filter("business_id is not null")
    fresh = (F.unix_micros(F.col("collected_at").cast("timestamp")) >= NOW_US - 365 * DAY_US).cast("int")
    s = docs.select("business_id", F.when(F.col("page_url").isNull(), F.col("source")).otherwise("website").alias("stage"), fresh.alias("fresh"))
    return s.groupBy("business_id", "stage").agg(F.count("*").alias("contributions"), F.when(F.max("fresh") == 1, "observed").otherwise("stale").alias("state"))


@query("select id, json_array_length(queries_json::json)::bigint queries, len(list_distinct(list_transform(from_json(queries_json, '[\"varchar\"]'), lambda q: lower(trim(q)))))::bigint distinct_queries from runs")
def duplicate_inputs(spark: SparkSession, d: str) -> DataFrame:
    q = F.from_json("queries_json", "array<string>")
    one = F.array_distinct(F.transform(q, lambda x: F.lower(F.trim(x))))
    return table(spark, d, "runs", "id", "queries_json").select("id", F.size(q).cast("long").alias("queries"), F.size(one).cast("long").alias("distinct_queries"))


@query(f"""with {_CUR}, {_EV}, s as (select business_id, 'facts' section, vf seen from c join maps_business_location_links on location_id = subject_id union all select business_id, 'evidence', created from e where business_id is not null union all select business_id, 'reviews', null from (select distinct raw_sha256, business_id from parsed_reviews where business_id is not null)
union all select business_id, 'documents', epoch_us(collected_at) from documents where business_id is not null) select business_id, section, count(*) items, coalesce(max(seen), -1) last_us from s group by 1, 2""")
def dossier_sections(spark: SparkSession, d: str) -> DataFrame:
    """What is known of every business, section by section: items and the newest instant."""
    links = table(spark, d, "maps_business_location_links", "business_id", F.col("location_id").alias("subject_id"))
    docs = table(spark, d, "documents", "business_id", "collected_at").filter("business_id is not null")
    parts = [
        facts.current(_facts(spark, d)).join(links, "subject_id").select("business_id", F.lit("facts").alias("section"), instant_us(F.col("valid_from")).alias("at")),
        _evidence(spark, d).filter("business_id is not null").select("business_id", F.lit("evidence").alias("section"), F.col("created").alias("at")),
        table(spark, d, "parsed_reviews", "raw_sha256", "business_id").distinct().filter("business_id is not null").select("business_id", F.lit("reviews").alias("section"), F.lit(None).cast("long").alias("at")),
        docs.select("business_id", F.lit("documents").alias("section"), F.unix_micros(F.col("collected_at").cast("timestamp")).alias("at")),
    ]
    # sections are counted apart, so that no join multiplies one by another
    per = [p.groupBy("business_id", "section").agg(F.count("*").alias("items"), F.coalesce(F.max("at"), F.lit(-1)).alias("last_us")) for p in parts]
    return per[0].unionByName(per[1]).unionByName(per[2]).unionByName(per[3])


@query(f"""with {_CUR}, {_EV} select business_id, 'fact' section, c.id item_key, concat_ws('|', predicate, fact_slot, status) item from c join maps_business_location_links on location_id = subject_id union all select business_id, 'evidence', id, concat_ws('|', source_id, source_role, status) from e where business_id is not null
union all select distinct business_id, 'review', raw_sha256, identity_key from parsed_reviews where business_id is not null union all select business_id, 'document', doc_id::varchar, concat_ws('|', source, coalesce(lang, '')) from documents where business_id is not null""")
def dossier_rows(spark: SparkSession, d: str) -> DataFrame:
    """Everything known of every business as rows (business, section, key, item): a document that no task must hold whole."""
    links = table(spark, d, "maps_business_location_links", "business_id", F.col("location_id").alias("subject_id"))
    row = lambda section, key, *item: ("business_id", F.lit(section).alias("section"), F.col(key).cast("string").alias("item_key"), F.concat_ws("|", *item).alias("item"))
    parts = [
        facts.current(_facts(spark, d)).join(links, "subject_id").select(*row("fact", "id", "predicate", "fact_slot", "status")),
        _evidence(spark, d).select(*row("evidence", "id", "source_id", "source_role", "status")),
        table(spark, d, "parsed_reviews", "raw_sha256", "identity_key", "business_id").distinct().select(*row("review", "raw_sha256", "identity_key")),
        table(spark, d, "documents", "doc_id", "business_id", "source", "lang").select(*row("document", "doc_id", "source", F.coalesce("lang", F.lit("")))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).filter("business_id is not null")
