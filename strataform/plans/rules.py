"""Queries of URL, page, run, grid and review rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.functions import url_cases, urls
from strataform.functions.jsons import instant_us
from strataform.functions.text import clean_text
from strataform.operators import canonical, facts, grid, quality, reviews
from strataform.plans.reference import _BINS_SQL, _CUR, _EV, _GRID_SQL, DAY_US, NOW_US, SQL as _REF, _bins, _evidence, _facts, _grids, domain_states
from strataform.session import scratch
from strataform.sources import files
from strataform.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _lit(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(rows, *names: str) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(_lit(v) for v in r) + ')' for r in rows)}) t({', '.join(names)})"


# written cases: the SQL states the results that the rules demand
@query(_values(url_cases.URLS, "given", "page", "normal"))
def url_rules(spark: SparkSession, d: str) -> DataFrame:
    u = spark.createDataFrame([r[:2] for r in url_cases.URLS], "given string, page string")
    alone = u.filter("page is null").select("given", "page", urls.normalize_url("given").alias("normal"))
    return alone.unionByName(u.filter("page is not null").select("given", "page", urls.normalize_url("given", F.col("page")).alias("normal")))


@query(_values(url_cases.SITES, "a", "b", "same"))
def site_rules(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([r[:2] for r in url_cases.SITES], "a string, b string").select("a", "b", urls.same_site(F.col("a"), F.col("b")).cast("int").alias("same"))


@query(_values(url_cases.CHANNELS, "href", "said", "channel_type", "identifier"))
def channel_rules(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame([r[:2] for r in url_cases.CHANNELS], "href string, said string").select("href", "said", urls.channel(F.col("href"), F.col("said")).alias("c"))
    return c.select("href", "said", F.col("c.type").alias("channel_type"), F.col("c.identifier").alias("identifier"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per document that has a URL, as a site of the data would write it."""
    docs = table(spark, d, "documents", "doc_id", "page_url", "source", "business_id").filter("page_url is not null")
    path = urls.path_of(F.col("page_url"))
    html = F.concat(
        F.lit("<html><head><title> "), F.col("source"), F.lit(" &amp; more</title><link rel=canonical href='/home?utm_source=x'></head><body><a href='/menu'>Our menu</a><a href=\"/a/b/contact\">Write us</a><a rel=nofollow href='/hidden'>x</a>"),
        F.when(path == "/contact", "<a href='mailto:Info@Shop.example?subject=a'>Mail</a><a href='https://wa.me/49301234567'>Chat</a><a href='/t'>Book a table</a>").otherwise(""),
        F.when(path == "/menu", "<a href='/o'>Order food online</a><a href='tel:0049 30 123456'>Call</a>").otherwise(""),
        F.lit("</body></html>"),
    )
    return docs.select("doc_id", "business_id", F.concat("page_url", F.lit("#"), F.col("doc_id").cast("string")).alias("url"), path.alias("path"), html.alias("html"))


_PAGES = "pg as (select doc_id, business_id, source, page_url || '#' || doc_id url, lower(regexp_extract(page_url, '^https?://[^/?#]*(/[^?#]*)?', 1)) as path, regexp_extract(page_url, '^(https?://[^/?#]*)', 1) site from documents where page_url is not null)"


@query(f"""with {_PAGES} select url, source || ' & more' title, site || '/home' canonical_url, (case path when '/contact' then 4 when '/menu' then 3 else 2 end)::bigint links,
case path when '/contact' then 3 when '/menu' then 2 else 0 end::bigint channels, (path = '/contact')::int booking, (path = '/menu')::int ordering, (path = '/contact')::int whatsapp from pg""")
def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Title, canonical URL, links, channels and flags of pages."""
    return urls.page_summary(_pages(spark, d))


@query(f"""with {_PAGES} select doc_id, 'email' channel_type, 'info@shop.example' identifier from pg where path = '/contact' union all select doc_id, 'whatsapp', 'https://wa.me/49301234567' from pg where path = '/contact' union all select doc_id, 'booking', site || '/t' from pg where path = '/contact'
union all select doc_id, 'ordering', site || '/o' from pg where path = '/menu' union all select doc_id, 'phone', '+4930123456' from pg where path = '/menu'""")
def page_channels(spark: SparkSession, d: str) -> DataFrame:
    """The channels that pages offer."""
    p = _pages(spark, d)
    return urls.page_channels(p).join(p.select("doc_id", "url"), "url").select("doc_id", "channel_type", "identifier")


@query(f"""with {_PAGES}, l as (select distinct business_id, site || '/menu' link, 100 priority, 1 depth from pg where business_id is not null union select distinct business_id, site || '/a/b/contact', 94, 3 from pg where business_id is not null union select distinct business_id, site || '/t', 105, 1 from pg where path = '/contact' and business_id is not null
union select distinct business_id, site || '/o', 110, 1 from pg where path = '/menu' and business_id is not null), k as (select *, row_number() over (partition by business_id order by priority desc, depth, link) n from l where depth <= 2) select business_id, link, priority::bigint priority, n::bigint as "position" from k where n <= 2""")
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl of each site would read next: best first, at most two steps deep, two pages a site."""
    p = _pages(spark, d).filter("business_id is not null")
    links = urls.page_links(p).join(p.select("url", "business_id"), "url").groupBy("business_id", "link").agg(F.max("priority").alias("priority"))
    return urls.frontier(links, "business_id", most_pages=2, most_depth=2)


_ALLOWED_KEYS = ("cell_km", "depth", "queries", "bbox", "strict_bounds", "scraper_image", "language", "zoom", "radius", "concurrency", "extract_emails", "max_depth", "exit_on_inactivity", "fast_mode")


@query("select id, case when config_json is not null then json_object('cell_km', config_json->'cell_km', 'depth', config_json->'depth', 'strict_bounds', config_json->'strict_bounds')::varchar end config, sha256(config_json) config_sha256 from runs")
def config_projection(spark: SparkSession, d: str) -> DataFrame:
    """The keys of a run's configuration that a plan may take over, and the configuration's checksum."""
    r = table(spark, d, "runs", "id", "config_json")
    value = lambda k: F.get_json_object("config_json", f"$.{k}")
    text = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json("config_json"), f"$.{k}", "variant")) == "STRING"
    held = F.array_compact(F.array(*[F.when(value(k).isNotNull(), F.concat(F.lit(f'"{k}":'), F.when(text(k), F.concat(F.lit('"'), value(k), F.lit('"'))).otherwise(value(k)))) for k in sorted(_ALLOWED_KEYS)]))
    return r.select("id", F.when(F.col("config_json").isNotNull(), F.concat(F.lit("{"), F.array_join(held, ","), F.lit("}"))).alias("config"), F.sha2("config_json", 256).alias("config_sha256"))


_BIND = (
    ("cell_km", "cell_km is distinct from (config_json::json->>'cell_km')::double", lambda c: ~F.col("cell_km").eqNullSafe(c("cell_km").cast("double"))),
    ("depth", "depth is distinct from (config_json::json->>'depth')::bigint", lambda c: ~F.col("depth").eqNullSafe(c("depth").cast("long"))),
    ("raw_path", "raw_path is distinct from 'runs/' || id || '/raw.jsonl'", lambda c: ~F.col("raw_path").eqNullSafe(F.concat(F.lit("runs/"), F.col("id"), F.lit("/raw.jsonl")))),
    ("image", "not regexp_matches(scraper_image, '@sha256:[0-9a-f]{64}$')", lambda c: ~F.col("scraper_image").rlike("@sha256:[0-9a-f]{64}$")),
    ("run_id", "not regexp_matches(id, '^run-[0-9]{8}-[0-9a-f]{8}$')", lambda c: ~F.col("id").rlike("^run-[0-9]{8}-[0-9a-f]{8}$")),
    ("day", "not starts_with(id, 'run-' || replace(substr(started_at, 1, 10), '-', ''))", lambda c: ~F.col("id").startswith(F.concat(F.lit("run-"), F.replace(F.substring("started_at", 1, 10), F.lit("-"), F.lit(""))))),
    ("status", "status <> 'complete'", lambda c: F.col("status") != "complete"),
    ("exit_code", "coalesce(exit_code, -1) <> 0", lambda c: F.coalesce("exit_code", F.lit(-1)) != 0),
    ("error", "error is not null", lambda c: F.col("error").isNotNull()),
    ("finished", "finished_at is null", lambda c: F.col("finished_at").isNull()),
    ("bounds", "coalesce(config_json::json->>'strict_bounds', 'false') <> 'true'", lambda c: F.coalesce(c("strict_bounds"), F.lit("false")) != "true"),
    ("accepted", "accepted_records > raw_records", lambda c: F.col("accepted_records") > F.col("raw_records")),
    ("unique", "unique_seen > accepted_records", lambda c: F.col("unique_seen") > F.col("accepted_records")),
    ("new", "new_businesses > unique_seen", lambda c: F.col("new_businesses") > F.col("unique_seen")),
    ("sums", "raw_records <> accepted_records + out_of_bounds_records + unlocated_records + unidentified_records", lambda c: F.col("raw_records") != F.col("accepted_records") + F.col("out_of_bounds_records") + F.col("unlocated_records") + F.col("unidentified_records")),
    ("box", "(bbox_json::json->>'min_lat')::double >= (bbox_json::json->>'max_lat')::double", lambda c: F.get_json_object("bbox_json", "$.min_lat").cast("double") >= F.get_json_object("bbox_json", "$.max_lat").cast("double")),
    ("queries", "json_array_length(queries_json::json) = 0", lambda c: F.json_array_length("queries_json") == 0),
)


@query("select id, array_to_string(list_filter([" + ", ".join(f"case when {sql} then '{name}' end" for name, sql, _ in _BIND) + "], lambda x: x is not null), ',') differs from runs")
def plan_binding(spark: SparkSession, d: str) -> DataFrame:
    """In what a run differs from what a plan bound to it may rest on."""
    c = lambda k: F.get_json_object("config_json", f"$.{k}")
    r = table(spark, d, "runs")
    return r.select("id", F.array_join(quality.all_issues([(name, F.coalesce(rule(c), F.lit(False))) for name, _, rule in _BIND]), ",").alias("differs"))


@query("select id, i::bigint position, trim(q) query_text, coalesce(nullif(trim(split_part(q, '#!#', 2)), ''), trim(q)) identity from (select id, unnest(range(0, len(l))) i, unnest(l) q from (select id, from_json(queries_json, '[\"varchar\"]') l from runs))")
def query_identities(spark: SparkSession, d: str) -> DataFrame:
    """The identity of every query of a run: what follows the mark ``#!#``, else its text."""
    q = table(spark, d, "runs", "id", "queries_json").select("id", F.posexplode(F.from_json("queries_json", "array<string>")).alias("position", "q"))
    named = clean_text(F.split_part("q", F.lit("#!#"), F.lit(2)))
    return q.select("id", F.col("position").cast("long").alias("position"), clean_text(F.col("q")).alias("query_text"), F.coalesce(named, clean_text(F.col("q"))).alias("identity"))


@query("""select id, coalesce(nullif(trim(raw_json::json->>'link'), ''), 'place_id:' || nullif(trim(place_id), ''), 'cid:' || nullif(trim(cid), ''), 'data_id:' || nullif(trim(data_id), '')) locator from businesses where json_valid(raw_json)""")
def source_locators(spark: SparkSession, d: str) -> DataFrame:
    """Where a listing can be found again: its link, else its first strong id."""
    b = table(spark, d, "businesses", "id", "place_id", "cid", "data_id", "raw_json").filter(F.try_parse_json("raw_json").isNotNull())
    return b.select("id", F.coalesce(clean_text(F.get_json_object("raw_json", "$.link")), *[F.concat(F.lit(f"{c}:"), clean_text(F.col(c))) for c in ("place_id", "cid", "data_id")]).alias("locator"))


@query("select id, valid_from, strftime(make_timestamp(epoch_us(valid_from::timestamptz) + 1000000), '%Y-%m-%dT%H:%M:%S+00:00') successor from (select distinct id, valid_from from facts)")
def successor_instants(spark: SparkSession, d: str) -> DataFrame:
    """One second after each start, in UTC."""
    f = table(spark, d, "facts", "id", "valid_from").distinct()
    return f.select("id", "valid_from", F.concat(F.date_format(F.timestamp_micros(instant_us(F.col("valid_from")) + 1_000_000), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("successor"))


_RANGES = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


@query(f"select id, (regexp_matches(valid_from, '{_RANGES}'))::int well_formed, coalesce(epoch_us(try_cast(valid_from as timestamptz)), -1) instant_us from (select distinct id, valid_from from facts) union all select id, (regexp_matches(last_seen_at, '{_RANGES}'))::int, coalesce(epoch_us(try_cast(last_seen_at as timestamptz)), -1) from (select 'b' || id id, last_seen_at from businesses)")
def iso_instants(spark: SparkSession, d: str) -> DataFrame:
    """Strict ISO texts with offset, every part in its range, and the instant they name."""
    f = table(spark, d, "facts", "id", F.col("valid_from").alias("t")).distinct().unionByName(table(spark, d, "businesses", F.concat(F.lit("b"), F.col("id").cast("string")).alias("id"), F.col("last_seen_at").alias("t")))
    return f.select("id", F.col("t").rlike(_RANGES).cast("int").alias("well_formed"), F.coalesce(instant_us(F.col("t")), F.lit(-1)).alias("instant_us"))


@query(_GRID_SQL + """ select run_id, k::bigint as "row", round(p, 9) latitude from y where p < hi""")
def grid_origins(spark: SparkSession, d: str) -> DataFrame:
    """The latitudes of a run's rows of cells, made by repeated addition."""
    g = _grids(spark, d)
    step, _ = grid.steps(F.col("box"), F.col("cell_km"))
    return g.select("run_id", F.posexplode(grid.origins(F.col("box.min_lat"), F.col("box.max_lat"), step)).alias("row", "at")).select("run_id", F.col("row").cast("long").alias("row"), F.round("at", 9).alias("latitude"))


@query(_GRID_SQL + """ select g.run_id, (coalesce(na, 0) = nrow)::int distinct_rows, (coalesce(mb, 0) = ncol)::int distinct_columns from g left join (select run_id, count(distinct round(p, 6)) na from y where p < hi group by 1) a on a.run_id = g.run_id left join (select run_id, count(distinct round(p, 6)) mb from x where p < hi group by 1) b on b.run_id = g.run_id""")
def precision_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether the cells of a run stay apart when coordinates are written with six decimals."""
    north, east = grid.steps(F.col("box"), F.col("cell_km"))
    ok = lambda lo, hi, step: grid.distinct_at(grid.origins(F.col(f"box.{lo}"), F.col(f"box.{hi}"), step)).cast("int")
    return _grids(spark, d).select("run_id", ok("min_lat", "max_lat", north).alias("distinct_rows"), ok("min_lon", "max_lon", east).alias("distinct_columns"))


@query(_BINS_SQL + """ select status, count(*) bins, count(*) filter (tier <> 'unselected') selected, sum(business_count)::bigint businesses from bins join runs on runs.id = bins.run_id group by 1""")
def bins_of_runs(spark: SparkSession, d: str) -> DataFrame:
    """Bins by the status of the run that made them."""
    r = table(spark, d, "runs", F.col("id").alias("run_id"), "status")
    return _bins(spark, d).join(r, "run_id").groupBy("status").agg(F.count("*").alias("bins"), F.count_if(F.col("tier") != "unselected").alias("selected"), F.sum("business_count").alias("businesses"))


@query(_BINS_SQL + """ select bins.run_id, count(*) incomplete, count(*) filter (tier <> 'unselected') selected from bins left join (select id from runs where status = 'complete') r on r.id = bins.run_id where r.id is null group by 1""")
def incomplete_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins that no complete run has covered, and how many of them are selected."""
    done = table(spark, d, "runs", F.col("id").alias("run_id"), "status").filter("status = 'complete'")
    left = _bins(spark, d).join(done, "run_id", "left").filter("status is null")
    return left.groupBy("run_id").agg(F.count("*").alias("incomplete"), F.count_if(F.col("tier") != "unselected").alias("selected"))


@query(_BINS_SQL + """ select run_id, count(*) full_bins, count(*) filter (tier <> 'unselected') targeted_bins, (count(*) filter (tier <> 'unselected') * 4 - count(*))::bigint extra_searches, case when count(*) filter (tier = 'A') = 0 then -1 else round(count(*) filter (tier = 'B') / count(*) filter (tier = 'A'), 6) end b_per_a from bins group by 1""")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    """A plan that splits selected bins in four: searches more or less than the full grid, and the ratio of its tiers."""
    n = lambda t: F.count_if(F.col("tier") == t)
    chosen = F.count_if(F.col("tier") != "unselected")
    return _bins(spark, d).groupBy("run_id").agg(F.count("*").alias("full_bins"), chosen.alias("targeted_bins"), (chosen * 4 - F.count("*")).alias("extra_searches"), F.when(n("A") == 0, F.lit(-1.0)).otherwise(F.round(n("B") / n("A"), 6)).alias("b_per_a"))


_SUMS = ("raw_records", "accepted_records", "out_of_bounds_records", "unlocated_records", "unidentified_records")


@query(f"""with c as (select * from runs where status <> 'complete'), m as (select distinct b.canonical_key k, b.first_run_id, r.status from businesses b join runs r on r.id = b.last_run_id), kid as (select distinct k, first_run_id from m where status <> 'complete')
select (select sum(raw_records) from c)::bigint raw_records, (select sum(accepted_records) from c)::bigint accepted_records, (select sum(out_of_bounds_records) from c)::bigint out_of_bounds_records, (select sum(unlocated_records) from c)::bigint unlocated_records, (select sum(unidentified_records) from c)::bigint unidentified_records,
(select count(distinct k) from kid) unique_union, (select count(distinct k) from kid where k in (select k from m where status = 'complete')) overlap, (select count(distinct k) from kid where k not in (select k from m where status = 'complete')) increment, (select count(distinct k) from kid where first_run_id in (select id from c)) globally_new""")
def recovery_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What incomplete runs brought beside complete ones: record sums, distinct listings, overlap, increment, new ones."""
    runs = table(spark, d, "runs", "id", "status", *_SUMS)
    kids = runs.filter("status <> 'complete'")
    sums = kids.agg(*[F.sum(c).alias(c) for c in _SUMS])
    m = table(spark, d, "businesses", F.col("canonical_key").alias("k"), "first_run_id", "last_run_id").join(runs.select(F.col("id").alias("last_run_id"), "status"), "last_run_id")
    mine = m.filter("status <> 'complete'").join(kids.select(F.col("id").alias("first_run_id"), F.lit(1).alias("new")), "first_run_id", "left").groupBy("k").agg(F.max("new").alias("new"))
    held = m.filter("status = 'complete'").select("k").distinct().withColumn("hit", F.lit(1))
    n = mine.join(held, "k", "left").agg(F.count("*").alias("unique_union"), F.count("hit").alias("overlap"), (F.count("*") - F.count("hit")).alias("increment"), F.count("new").alias("globally_new"))
    # one row beside one row
    return sums.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one").drop("_one")


_BOX_KEYS = ("max_lat", "max_lon", "min_lat", "min_lon")


@query("""select id, (list_sort(json_keys(bbox_json)) = ['max_lat', 'max_lon', 'min_lat', 'min_lon'])::int exact_keys, (json_type(bbox_json->'min_lat') in ('DOUBLE', 'BIGINT', 'UBIGINT') and json_type(bbox_json->'max_lat') in ('DOUBLE', 'BIGINT', 'UBIGINT'))::int numbers,
(len(regexp_extract_all(bbox_json, '"[a-z_]+" *:')) = len(list_distinct(regexp_extract_all(bbox_json, '"[a-z_]+" *:'))))::int no_duplicates, (not regexp_matches(bbox_json, 'NaN|Infinity'))::int finite from runs""")
def strict_objects(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as strict JSON: exactly the keys named, numbers only, no key twice, nothing infinite."""
    r = table(spark, d, "runs", "id", "bbox_json")
    names = F.regexp_extract_all("bbox_json", F.lit(r'("[a-z_]+") *:'), F.lit(1))
    number = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json("bbox_json"), f"$.{k}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return r.select(
        "id",
        (F.array_sort(F.json_object_keys("bbox_json")) == F.array(*[F.lit(k) for k in _BOX_KEYS])).cast("int").alias("exact_keys"),
        (number("min_lat") & number("max_lat")).cast("int").alias("numbers"),
        (F.size(names) == F.size(F.array_distinct(names))).cast("int").alias("no_duplicates"),
        (~F.col("bbox_json").rlike("NaN|Infinity")).cast("int").alias("finite"),
    )


@query("""with j as (select distinct raw_sha256, raw_json::json o from parsed_reviews) select raw_sha256, nullif(trim(o->>'source'), '') source, nullif(trim(o->>'language'), '') "language", nullif(trim(o->>'translated_lang'), '') translated_language, nullif(trim(o->>'published_at', e' \\n\\t'), '') published_at,
sha256(nullif(trim(o->>'text_translated', e' \\n\\t'), '')) translated_sha256, sha256(coalesce(nullif(trim(o->>'reply_text_original', e' \\n\\t'), ''), nullif(trim(o->>'reply_text', e' \\n\\t'), ''))) owner_response_text_sha256, nullif(trim(o->>'reply_language'), '') owner_response_language,
case when try_cast(o->>'reply_posted_at_unix_micros' as bigint) > 0 then try_cast(o->>'reply_posted_at_unix_micros' as bigint) else -1 end owner_response_posted_us,
case when coalesce(try_cast(o->>'rating_scale' as double), 5) < coalesce(nullif(try_cast(o->>'rating_float' as double), 0), try_cast(o->>'Rating' as double)) then 0 else 1 end rating_in_scale from j""")
def review_nested(spark: SparkSession, d: str) -> DataFrame:
    """The rest of a normalised review: language, publication, the owner's response, and whether the rating fits its scale."""
    r = table(spark, d, "parsed_reviews", "raw_sha256", "raw_json").distinct().select("raw_sha256", reviews.nested(F.col("raw_json")).alias("r"))
    o = F.col("r.owner_response")
    return r.select("raw_sha256", "r.source", "r.language", "r.translated_language", "r.published_at", F.sha2("r.text_translated", 256).alias("translated_sha256"), F.sha2(o["text"], 256).alias("owner_response_text_sha256"), o["language"].alias("owner_response_language"), F.coalesce(o["posted_us"], F.lit(-1)).alias("owner_response_posted_us"), F.col("r.rating_in_scale").cast("int").alias("rating_in_scale"))


@query(f"""with t as ({_REF["domain_states"]}) select subject_id, min(domain) first_gap, count(*) gaps from t where state not in ('sufficient', 'strong', 'not_applicable') group by 1""")
def first_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Of every subject the first domain that leaves something to be done."""
    s = domain_states(spark, d).filter(~F.col("state").isin("sufficient", "strong", "not_applicable"))
    return s.groupBy("subject_id").agg(F.min("domain").alias("first_gap"), F.count("*").alias("gaps"))


@query(f"""with {_EV}, w as (select business_id, count(*) filter (status = 'usable') usable, count(*) filter (status <> 'usable') failed from e where source_id = 'src_official_web' group by 1), n as (select regexp_replace(lower(website), '^https?://(www\\.)?', '') site, count(distinct id) owners from businesses where website is not null group by 1)
select b.id business_id, website, case when website is null then 'no_site' when owners > 1 then 'contradicted' when coalesce(usable, 0) = 0 then 'unproven' else 'verified' end state from businesses b left join w on w.business_id = b.id left join n on n.site = regexp_replace(lower(website), '^https?://(www\\.)?', '')""")
def site_targets(spark: SparkSession, d: str) -> DataFrame:
    """Which websites may be crawled as a listing's own: with usable official evidence and claimed by no other listing."""
    b = table(spark, d, "businesses", F.col("id").alias("business_id"), "website").withColumn("site", F.regexp_replace(F.lower("website"), r"^https?://(www\.)?", ""))
    w = _evidence(spark, d).filter("source_id = 'src_official_web'").groupBy("business_id").agg(F.count_if(F.col("status") == "usable").alias("usable"))
    n = b.filter("site is not null").groupBy("site").agg(F.countDistinct("business_id").alias("owners"))
    j = b.join(w, "business_id", "left").join(n, "site", "left")
    return j.select("business_id", "website", F.when(F.col("website").isNull(), "no_site").when(F.col("owners") > 1, "contradicted").when(F.coalesce("usable", F.lit(0)) == 0, "unproven").otherwise("verified").alias("state"))


_STAGES = {"location.phone": "contact", "location.address": "find", "location.opening_hours": "plan_visit", "location.operating_status": "plan_visit", "reputation.rating": "evaluate", "reputation.review_count": "evaluate", "reputation.customer_review": "evaluate"}


@query(f"""with {_CUR}, st(predicate, stage) as (values {", ".join(f"('{p}', '{s}')" for p, s in _STAGES.items())}), x as (select subject_id, stage, c.status, coalesce(epoch_us(last_verified_at::timestamptz), vf) >= {NOW_US - 365 * DAY_US} fresh from c join st on st.predicate = c.predicate)
select subject_id, stage, count(*) contributions, case when bool_or(status = 'conflicted') then 'conflicted' when bool_or(status in ('confirmed', 'single_source') and fresh) then 'observed' when bool_or(status in ('confirmed', 'single_source', 'stale')) then 'stale' when bool_or(status = 'not_observed') then 'not_observed_in_bounded_inspection' else 'unknown' end state from x group by 1, 2""")
def journey_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each stage of a customer's way to a place, by the facts that contribute to it; the first rule holds."""
    stage = F.create_map(*[F.lit(x) for kv in _STAGES.items() for x in kv])
    f = facts.current(_facts(spark, d)).withColumn("stage", F.try_element_at(stage, F.col("predicate"))).filter("stage is not null")
    fresh = F.coalesce(instant_us(F.col("last_verified_at")), instant_us(F.col("valid_from"))) >= NOW_US - 365 * DAY_US
    any_ = lambda *s: F.bool_or(F.col("status").isin(*s))
    state = (
        F.when(any_("conflicted"), "conflicted").when(F.bool_or(F.col("status").isin("confirmed", "single_source") & fresh), "observed")
        .when(any_("confirmed", "single_source", "stale"), "stale").when(any_("not_observed"), "not_observed_in_bounded_inspection").otherwise("unknown")
    )
    return f.groupBy("subject_id", "stage").agg(F.count("*").alias("contributions"), state.alias("state"))


@query(f"select *, sha256(concat_ws('|', predicate, domain, cardinality, coalesce(freshness_days::varchar, ''))) checksum from (values {', '.join(f'({_lit(p)}, {_lit(dm)}, {_lit(c)}, {_lit(f)}::int)' for _, _, p, dm, c, f in facts.PREDICATES)}) t(predicate, domain, cardinality, freshness_days)")
def vocabulary_seed(spark: SparkSession, d: str) -> DataFrame:
    """The predicates a store is seeded with, each with its checksum."""
    v = facts.vocabulary(spark)
    return v.withColumn("checksum", F.sha2(F.concat_ws("|", "predicate", "domain", "cardinality", F.coalesce(F.col("freshness_days").cast("string"), F.lit(""))), 256))


@query("""select id, row_number() over (partition by area_name order by started_at desc, id) recent, coalesce(sum(case when status <> 'complete' then 1 else 0 end) over (partition by area_name order by started_at, id rows between unbounded preceding and 1 preceding), 0)::bigint failed_before from runs""")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Each run's place in its area's history and the failures before it; areas have as many runs as they were swept."""
    r = table(spark, d, "runs", "id", "area_name", "started_at", "status")
    w = Window.partitionBy("area_name")
    failed = F.sum((F.col("status") != "complete").cast("long")).over(w.orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, -1))
    return r.select("id", F.row_number().over(w.orderBy(F.col("started_at").desc(), "id")).alias("recent"), F.coalesce(failed, F.lit(0)).alias("failed_before"))


@query("select (json_valid(raw_json) and coalesce(json_type(case when json_valid(raw_json) then raw_json end), '') = 'OBJECT')::int ok, count(*) n, count(case when json_valid(raw_json) then raw_json::json->>'title' end) titled from businesses where trim(raw_json) <> '' group by 1")
def json_lines_scan(spark: SparkSession, d: str) -> DataFrame:
    """Raw records written as JSON lines and read back: lines that hold one object, and those that don't."""
    path = scratch(spark, "lines")
    table(spark, d, "businesses", "raw_json").write.text(path)
    lines = files.json_lines(spark, path, "title string")
    return lines.groupBy("ok").agg(F.count("*").alias("n"), F.count("record.title").alias("titled"))


@query("select q query, (row_number() over (order by q) - 1)::int as position from (select distinct trim(unnest(from_json(queries_json, '[\"varchar\"]'))) q from runs)")
def query_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """All queries of all runs as a query list file: sorted, with comments and blanks between, and read back."""
    path = scratch(spark, "queries")
    q = table(spark, d, "runs", "queries_json").select(F.explode(F.from_json("queries_json", "array<string>")).alias("q"))
    text = q.agg(F.concat(F.lit("# all\n\n"), F.array_join(F.array_sort(F.collect_set(F.trim("q"))), "\n\n# next\n  "), F.lit("\n")).alias("value"))
    text.write.option("lineSep", "\n").text(path)
    return files.query_list(spark, path).select("query", F.col("position").cast("int").alias("position"))


@query("select count(*) n, count(distinct id) ids, min(id) first_id, max(id) last_id from businesses")
def backup_copy(spark: SparkSession, d: str) -> DataFrame:
    """A copy of a table, read back."""
    path = scratch(spark, "backup")
    files.backup(table(spark, d, "businesses", "id", "title"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("select '{\"cell_km\":' || cell_km || ',\"depth\":' || depth || ',\"id\":\"' || id || '\"' || case when error is null then '' else '' end || '}' json from runs")
def rows_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows as the JSON a command line prints: keys sorted."""
    return files.as_json(table(spark, d, "runs", "id", "depth", "cell_km"))


@query("select count(*) completed, count(distinct id) ids from runs where status = 'complete'")
def resume_scan(spark: SparkSession, d: str) -> DataFrame:
    """The complete runs as a resume file, and read back."""
    path = scratch(spark, "resume") + ".json"
    done = [r.id for r in table(spark, d, "runs", "id", "status").filter("status = 'complete'").orderBy("id").collect()]
    files.write_plan({"version": 1, "completed_inputs": done}, path)
    return files.completed_inputs(spark, path).agg(F.count("*").alias("completed"), F.countDistinct("input_id").alias("ids"))
