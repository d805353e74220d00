"""Queries of places, merges, loads and versions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.jsons import instant_us
from strataform.functions.text import clean_text
from strataform.operators import sessions, subjects
from strataform.plans.reference import _GROUPS, _SID
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


def _rows(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "businesses", "id", *subjects.IDS, *more)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return materialize(subjects.groups(_rows(spark, d)), "groups")


_TARGETS = "tg as (select root, arg_min(b.id, lpad(epoch_us(first_seen_at::timestamptz)::varchar, 20, '0') || lpad(b.id::varchar, 20, '0')) target, count(*) members from gr join businesses b on b.id = gr.id group by 1)"


@query(f"with recursive {_GROUPS}, {_TARGETS} select root, target, members from tg")
def canonical_targets(spark: SparkSession, d: str) -> DataFrame:
    """Of every place the listing seen first."""
    return subjects.canonical_targets(_rows(spark, d, "first_seen_at"), _groups(spark, d), instant_us(F.col("first_seen_at")))


_LIVE = "lv as (select id from businesses where status in ('Open', 'Open 24 hours', 'Opens soon', 'Closes soon'))"
_MERGES = f"{_GROUPS}, {_TARGETS}, {_LIVE}, nl as (select root, count(lv.id) live from gr left join lv on lv.id = gr.id group by 1), mg as (select gr.root, gr.id source, target, case when live > 1 then 'refused' else 'redirected' end as action from gr join tg on tg.root = gr.root join nl on nl.root = gr.root where members > 1 and gr.id <> target)"


def _merges(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d)
    targets = subjects.canonical_targets(_rows(spark, d, "first_seen_at"), g, instant_us(F.col("first_seen_at")))
    live = table(spark, d, "businesses", "id", "status").filter(F.col("status").isin("Open", "Open 24 hours", "Opens soon", "Closes soon"))
    return subjects.merges(g, targets, live)


@query(f"with recursive {_MERGES} select root, source, target, action from mg")
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which listings are redirected into which; a place with several live listings is refused."""
    return _merges(spark, d)


@query(f"with recursive {_MERGES} select location_id, coalesce(target, business_id) business_id, business_id held_by from maps_business_location_links l left join (select * from mg where action = 'redirected') m on m.source = l.business_id")
def merged_links(spark: SparkSession, d: str) -> DataFrame:
    """The links after all merges."""
    return subjects.repointed(table(spark, d, "maps_business_location_links", "business_id", "location_id"), _merges(spark, d))


@query(f"""with recursive {_MERGES}, fc as (select distinct id, subject_id, predicate, fact_slot from facts), mv as (select fc.id, fc.predicate, fc.fact_slot, coalesce(target, business_id) business_id, target is not null moved from fc join maps_business_location_links l on l.location_id = fc.subject_id left join (select * from mg where action = 'redirected') m on m.source = l.business_id)
select business_id, predicate, count(*) facts, count(*) filter (moved) moved, count(distinct fact_slot) slots from mv group by 1, 2""")
def converged_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts of each place after the merges: those of redirected listings have moved with their links."""
    f = table(spark, d, "facts", "id", "subject_id", "predicate", "fact_slot").dropDuplicates(["id"])
    links = subjects.repointed(table(spark, d, "maps_business_location_links", "business_id", "location_id"), _merges(spark, d))
    j = f.join(links.withColumnRenamed("location_id", "subject_id"), "subject_id")
    return j.groupBy("business_id", "predicate").agg(F.count("*").alias("facts"), F.count_if(F.col("business_id") != F.col("held_by")).alias("moved"), F.countDistinct("fact_slot").alias("slots"))


@query(f"with recursive {_GROUPS} select root, id member from gr")
def lineage_members(spark: SparkSession, d: str) -> DataFrame:
    """Every listing that ends in each place."""
    return subjects.lineage(_groups(spark, d))


@query(f"with recursive {_GROUPS} select root, 'business' kind, id::varchar member from gr union all select root, 'location', location_id from gr join maps_business_location_links on business_id = id union all select root, 'fact', f.id from gr join maps_business_location_links on business_id = gr.id join (select distinct id, subject_id from facts) f on f.subject_id = location_id")
def subject_scope(spark: SparkSession, d: str) -> DataFrame:
    """All that belongs to a place: listings, locations, facts."""
    g, links = _groups(spark, d), table(spark, d, "maps_business_location_links", "business_id", "location_id")
    at = g.join(links, g["id"] == links["business_id"]).select("root", "location_id")
    f = table(spark, d, "facts", F.col("id").alias("fact_id"), F.col("subject_id").alias("location_id")).distinct()
    parts = [g.select("root", F.lit("business").alias("kind"), F.col("id").cast("string").alias("member")), at.select("root", F.lit("location").alias("kind"), F.col("location_id").alias("member")), at.join(f, "location_id").select("root", F.lit("fact").alias("kind"), F.col("fact_id").alias("member"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""with recursive {_GROUPS}, sel as (select distinct 'canonical_key' kind, canonical_key as value from businesses union select 'business_id', (id + (id % 7 = 0)::int * 1000000000)::varchar from businesses), ky as (select 'canonical_key' kind, canonical_key as value, id from businesses union all select 'business_id', id::varchar, id from businesses),
n as (select kind, value, count(distinct root) n, min(root) root from ky join gr using (id) group by 1, 2) select sel.kind, sel.value, case when n = 1 then root end root, case when n = 1 then 'found' when n > 1 then 'ambiguous' else 'missing' end state from sel left join n on n.kind = sel.kind and n.value = sel.value""")
def select_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Selectors by key or number; every seventh number is made one that doesn't exist."""
    b = table(spark, d, "businesses", "id", "canonical_key")
    by_key = b.select(F.lit("canonical_key").alias("kind"), F.col("canonical_key").alias("value"), "id").unionByName(b.select(F.lit("business_id").alias("kind"), F.col("id").cast("string").alias("value"), "id"))
    asked = b.select(F.lit("canonical_key").alias("kind"), F.col("canonical_key").alias("value")).unionByName(b.select(F.lit("business_id").alias("kind"), (F.col("id") + F.when(F.col("id") % 7 == 0, 1_000_000_000).otherwise(0)).cast("string").alias("value")))
    return subjects.selected(asked.distinct(), by_key, _groups(spark, d))


@query(f"with recursive {_GROUPS} select root, count(*) members, case when count(distinct {_SID.format('place_id')}) > 1 or count(distinct {_SID.format('cid')}) > 1 or count(distinct {_SID.format('data_id')}) > 1 then 'conflict' when count(*) > 1 then 'merged' else 'inserted' end outcome from gr join businesses b on b.id = gr.id group by 1")
def upsert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What loading the listings does to each place."""
    return subjects.upserts(_rows(spark, d).join(_groups(spark, d), "id"))


@query("""with k as (select id, coalesce(trim(website), '') site, lower(concat(coalesce(trim(title), ''), '|', coalesce(trim(address), ''), '|', coalesce(trim(phone), ''))) k from businesses), f as (select k, min(id) lo from k where k <> '||' group by 1)
select k.id, f.lo older, (k.site = o.site)::int same_site from k join f on f.k = k.k join k o on o.id = f.lo where k.id > f.lo""")
def legacy_alias(spark: SparkSession, d: str) -> DataFrame:
    """Listings that an older key, which left out the website, takes for another one."""
    return subjects.legacy_matches(table(spark, d, "businesses", "id", "title", "address", "phone", "website"))


_LOADED = ["id", "subject_id", "predicate", "fact_slot", "value_json", "status", "valid_from"]
_CUT_US = 1_735_689_600_000_000


@query(f"""with f as (select distinct *, epoch_us(reconciled_at::timestamptz) rc from facts), h as (select distinct id from f where rc < {_CUT_US}), n as (select distinct id from f where rc >= {_CUT_US} union select id from (select id from f where rc < {_CUT_US} and hash(id) is not null and substr(id, -1) = '0'))
select case when h.id is null then 'inserted' when substr(n.id, -2) = '00' then 'collision' else 'repeated' end outcome, count(*) n from n left join h on h.id = n.id group by 1""")
def load_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A load of new facts that delivers some held ones again, and a few of those with another status."""
    f = table(spark, d, "facts", *_LOADED, "reconciled_at")
    late = F.coalesce(instant_us(F.col("reconciled_at")) >= _CUT_US, F.lit(False))
    held, again = f.filter(~late), f.filter(~late & F.col("id").endswith("0"))
    again = again.withColumn("status", F.when(F.col("id").endswith("00"), "withdrawn").otherwise(F.col("status")))
    return subjects.load_outcomes(f.filter(late).unionByName(again), held, "id", _LOADED)


@query("""select case when first_n = 0 then 'added' when second_n = 0 then 'removed' when first_h = second_h then 'unchanged' else 'changed' end as change, count(*) n from (
select subject_id, count(*) filter (v = 1) first_n, count(*) filter (v = 2) second_n, max(s) filter (v = 1) first_h, max(s) filter (v = 2) second_h from (select subject_id, case reconciliation_version when 'maps-sync-v1' then 1 when 'maps-sync-v2' then 2 end v, concat_ws('|', predicate, fact_slot, value_json, status) s from facts where reconciliation_version in ('maps-sync-v1', 'maps-sync-v2')) group by 1) group by 1""")
def snapshot_compare(spark: SparkSession, d: str) -> DataFrame:
    """Subjects between two states of the facts, by their greatest row."""
    f = table(spark, d, "facts", "subject_id", "reconciliation_version", F.concat_ws("|", "predicate", "fact_slot", "value_json", "status").alias("s"))
    top = lambda v: f.filter(F.col("reconciliation_version") == v).groupBy("subject_id").agg(F.max("s").alias("s"))
    return subjects.compared(top("maps-sync-v1"), top("maps-sync-v2"), "subject_id", ["s"])


_MOVES = (("single_source", "confirmed"), ("confirmed", "stale"), ("single_source", "stale"), ("stale", "confirmed"), ("stale", "single_source"), ("unknown", "single_source"), ("unknown", "confirmed"), ("not_observed", "single_source"), ("not_observed", "confirmed"), ("confirmed", "conflicted"), ("single_source", "conflicted"), ("conflicted", "confirmed"))


@query(f"""with f as (select distinct id, subject_id, predicate, fact_slot, status, epoch_us(valid_from::timestamptz) vf from facts), p as (select status, lag(status) over (partition by subject_id, predicate, fact_slot order by vf, id) before from f where vf is not null)
select before, status after, (before || '>' || status in ({", ".join(f"'{a}>{b}'" for a, b in _MOVES)}))::int allowed, count(*) n from p where before is not null and before <> status group by 1, 2""")
def lifecycle_moves(spark: SparkSession, d: str) -> DataFrame:
    """Status changes along every slot, judged by the moves allowed."""
    f = table(spark, d, "facts", "id", "subject_id", "predicate", "fact_slot", "status", instant_us(F.col("valid_from")).alias("_at")).distinct().filter("_at is not null")
    return sessions.latest_status_moves(f, ["subject_id", "predicate", "fact_slot"], "status", _MOVES)


@query("""select predicate, count(*) facts, count(*) filter (not starts_with(subject_id, 'loc_')) wrong_kind, count(*) filter (kind_slot) wrong_slot from (select distinct id, subject_id, predicate, (predicate not in ('location.phone', 'reputation.customer_review') and fact_slot <> '__single__') kind_slot from facts) group by 1""")
def subject_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose subject is not of their predicate's kind, or whose slot doesn't suit its cardinality."""
    f = table(spark, d, "facts", "id", "subject_id", "predicate", "fact_slot").distinct()
    wrong = ~F.col("predicate").isin("location.phone", "reputation.customer_review") & (F.col("fact_slot") != "__single__")
    return f.groupBy("predicate").agg(F.count("*").alias("facts"), F.count_if(~F.col("subject_id").startswith("loc_")).alias("wrong_kind"), F.count_if(wrong).alias("wrong_slot"))


_FIXED = ("subject_id", "predicate", "fact_slot", "valid_from")


@query("select c as column_name, count(*) ids, count(*) filter (n > 1) changed from (" + " union all ".join(f"select '{c}' c, id, count(distinct {c}) n from facts group by 2" for c in _FIXED) + ") group by 1")
def immutable_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that no later delivery of a fact may change, and how many facts changed them."""
    n = table(spark, d, "facts", "id", *_FIXED).groupBy("id").agg(*[F.countDistinct(c).alias(c) for c in _FIXED])
    long = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in _FIXED])).alias("x")).select("x.*")
    return long.groupBy("column_name").agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("changed"))


@query("select (raw_sha256 = sha256(raw_json))::int holds, count(*) n from (select distinct raw_sha256, raw_json from parsed_reviews) group by 1")
def seal_check(spark: SparkSession, d: str) -> DataFrame:
    """Stored seals of review records against seals computed anew."""
    r = table(spark, d, "parsed_reviews", "raw_sha256", "raw_json").distinct()
    return r.groupBy((F.col("raw_sha256") == F.sha2("raw_json", 256)).cast("int").alias("holds")).agg(F.count("*").alias("n"))


@query("""with b as (select l.location_id subject_id, 'location.phone' predicate, phone v from businesses join maps_business_location_links l on l.business_id = id where phone is not null union all select l.location_id, 'reputation.review_count', review_count::varchar from businesses join maps_business_location_links l on l.business_id = id where review_count is not null),
s as (select distinct subject_id, predicate, trim(value_json, '"') v from facts where predicate in ('location.phone', 'reputation.review_count') and value_json is not null)
select predicate, 'missing' side, count(*) n from (select * from b except select * from s) group by 1 union all select predicate, 'unexpected', count(*) from (select * from s except select * from b) group by 1 union all select predicate, 'equal', count(*) from (select * from s intersect select * from b) group by 1""")
def expected_stored(spark: SparkSession, d: str) -> DataFrame:
    """What the listings say against what the facts hold, as sets."""
    b = table(spark, d, "businesses", "id", "phone", F.col("review_count").cast("string").alias("review_count"))
    links = table(spark, d, "maps_business_location_links", F.col("business_id").alias("id"), F.col("location_id").alias("subject_id"))
    pair = lambda p, c: F.struct(F.lit(p).alias("predicate"), F.col(c).alias("v"))
    want = b.join(links, "id").select("subject_id", F.explode(F.array(pair("location.phone", "phone"), pair("reputation.review_count", "review_count"))).alias("x")).select("subject_id", "x.*").filter("v is not null").distinct()
    held = table(spark, d, "facts", "subject_id", "predicate", "value_json").filter("value_json is not null").filter(F.col("predicate").isin("location.phone", "reputation.review_count"))
    held = held.select("subject_id", "predicate", F.expr("trim(both '\"' from value_json)").alias("v")).distinct()
    j = want.withColumn("w", F.lit(1)).join(held.withColumn("h", F.lit(1)), ["subject_id", "predicate", "v"], "full_outer")
    return j.groupBy("predicate", F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "unexpected").otherwise("equal").alias("side")).agg(F.count("*").alias("n"))


@query(f"""with v as (select distinct raw_sha256, business_id from parsed_reviews where business_id is not null), e as (select distinct id, status, (metadata_json::json->>'business_id')::bigint business_id from evidence_items where source_id = 'src_reviews'), n as (select business_id, count(*) reviews from v group by 1), m as (select business_id, count(*) filter (status = 'usable') usable, count(*) items from e where business_id is not null group by 1)
select b.id business_id, coalesce(reviews, 0) reviews, coalesce(usable, 0) usable, case when reviews > 0 and usable > 0 then 'mined' when reviews > 0 then 'unproven' when usable > 0 then 'nothing_found' when items > 0 then 'unavailable' else 'not_tried' end state from businesses b left join n on n.business_id = b.id left join m on m.business_id = b.id""")
def review_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the reviews of each listing were mined, looked for in vain, out of reach, or never looked for."""
    b = table(spark, d, "businesses", F.col("id").alias("business_id"))
    n = table(spark, d, "parsed_reviews", "raw_sha256", "business_id").distinct().groupBy("business_id").agg(F.count("*").alias("reviews"))
    e = table(spark, d, "evidence_items", "id", "status", "source_id", F.get_json_object("metadata_json", "$.business_id").cast("long").alias("business_id")).filter("source_id = 'src_reviews'").distinct()
    m = e.groupBy("business_id").agg(F.count_if(F.col("status") == "usable").alias("usable"), F.count("*").alias("items"))
    j = b.join(n, "business_id", "left").join(m, "business_id", "left").fillna(0, ["reviews", "usable", "items"])
    some = F.col("reviews") > 0
    return j.select("business_id", "reviews", "usable", F.when(some & (F.col("usable") > 0), "mined").when(some, "unproven").when(F.col("usable") > 0, "nothing_found").when(F.col("items") > 0, "unavailable").otherwise("not_tried").alias("state"))


@query("""with c as (select id, last_seen_at, nullif(nullif(regexp_replace(regexp_replace(phone, '[^0-9+]', '', 'g'), '^00', '+'), ''), '+') identifier from businesses)
select identifier, arg_max(id, lpad(epoch_us(last_seen_at::timestamptz)::varchar, 20, '0') || lpad(id::varchar, 20, '0')) newest, count(*) listings, (count(*) > 1)::int shared from c where identifier is not null group by 1""")
def newest_channels(spark: SparkSession, d: str) -> DataFrame:
    """Of every phone channel the listing that named it last, and whether several do."""
    from strataform.functions.urls import normalize_phone

    c = table(spark, d, "businesses", "id", "last_seen_at", "phone").select("id", instant_us(F.col("last_seen_at")).alias("at"), normalize_phone(clean_text(F.col("phone"))).alias("identifier")).filter("identifier is not null")
    return c.groupBy("identifier").agg(F.max_by("id", F.struct("at", "id")).alias("newest"), F.count("*").alias("listings"), (F.count("*") > 1).cast("int").alias("shared"))
