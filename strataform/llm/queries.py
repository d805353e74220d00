"""Queries of the text and curation problems, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.jsons import instant_us
from strataform.llm.addresses import buildings, same_building
from strataform.llm.contamination import leaked
from strataform.llm.encoding_repair import repaired
from strataform.llm.languages import Field, fit_on, label_code, labelled
from strataform.llm.packing import TOKENIZER, packed, token_counts
from strataform.llm.survivors import FIELDS, decayed_votes, duplicate_groups, strict_votes, surviving_records, votes, winners
from strataform.session import fitted
from strataform.sources.tables import table


#: Trust in rows of runs that are not complete, against 1.
UNFINISHED_TRUST = 0.25


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Distinct reviews: raw_sha256, identity_key, language, text (the original text)."""
    r = table(spark, d, "parsed_reviews", "raw_sha256", "identity_key", "language", "raw_json")
    r = r.withColumn("j", F.from_json("raw_json", "text_original string, Description string"))
    return r.select("raw_sha256", "identity_key", "language", F.coalesce("j.text_original", "j.Description").alias("text"))


def _field(reviews: DataFrame) -> Field:
    """The field fitted to the reviews as labelled; p3_found and p3_segments share it."""
    return fitted(reviews, "languages", lambda: fit_on(reviews, F.col("text"), F.col("language"), F.col("raw_sha256")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = _reviews(spark, d)
    field = _field(r)
    t = labelled(r.select("raw_sha256", "identity_key", label_code(F.col("language")).alias("code"), "text"), "text", field)
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    t = t.select("raw_sha256", "identity_key", "code", langs.alias("langs")).filter(F.size("langs") > 0)
    t = t.filter((F.size("langs") > 1) | F.col("code").isNull() | (F.col("code") != F.col("langs")[0]))
    return t.select("raw_sha256", "identity_key", F.explode("langs").alias("lang")).distinct()


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every review with its language and confidence, the short and unsure ones too: each word is in one."""
    r = _reviews(spark, d)
    t = labelled(r.select("raw_sha256", "text"), "text", _field(r), min_words=1, min_confidence=0.0)
    t = t.select("raw_sha256", F.posexplode("segments").alias("segment_no", "s"))
    t = t.select("raw_sha256", "segment_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "s.lang", F.round("s.confidence", 6).alias("confidence"), F.col("s.words").alias("words"))
    # copies get equal segments, so they are dropped here, without moving their texts
    return t.dropDuplicates(["raw_sha256", "segment_no"])


def _sized(spark: SparkSession, d: str, tokenizer: str) -> DataFrame:
    """Documents with source, cluster of equal texts (case and spacing aside) and length in tokens."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    cluster = F.xxhash64(F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    return token_counts(docs.select("doc_id", "source", cluster.alias("cluster"), "text"), "text", tokenizer)


def p8_packed(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Containers for every capacity; exact copies of a text (case and spacing aside) never share one."""
    return packed(_sized(spark, d, tokenizer), table(spark, d, "packing_targets", "target_id", "capacity_tokens"))


#: Sources that must not share a container: what a business says of itself and what is said of it.
APART = {"owner_reply": ("maps_review",), "listing_description": ("maps_review",)}


def p8_separated(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """As ``p8_packed``, with the sources in ``APART`` kept out of each other's containers."""
    return packed(_sized(spark, d, tokenizer), table(spark, d, "packing_targets", "target_id", "capacity_tokens"), conflicts=APART)


def _votes(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "businesses", "id", "place_id", "cid", "data_id")
    done = table(spark, d, "runs", "id", "status").filter("status = 'complete'").select(F.col("id").alias("last_run_id"), F.lit(1.0).alias("done"))
    b = table(spark, d, "businesses", "id", "last_seen_at", "last_run_id", "raw_json").join(done, "last_run_id", "left")
    return votes(b, duplicate_groups(ids), F.coalesce("done", F.lit(UNFINISHED_TRUST)), instant_us(F.col("last_seen_at")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return winners(strict_votes(_votes(spark, d))).select("group_id", "field_name", F.col("id").alias("business_id"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records themselves, votes decaying by half in 180 days; rows of unfinished runs have a quarter of a vote."""
    return surviving_records(winners(decayed_votes(_votes(spark, d), 180.0)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return same_building(table(spark, d, "businesses", "id", "address"))


def p6_buildings(spark: SparkSession, d: str) -> DataFrame:
    """Every business with a readable address, and the building it stands in."""
    return buildings(table(spark, d, "businesses", "id", "address"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repaired(table(spark, d, "documents", "doc_id", "text")).select(F.col("key").alias("doc_id"), "restored_sha256")


QUERIES = {"p3_found": p3_found, "p3_segments": p3_segments, "p8_packed": p8_packed, "p8_separated": p8_separated, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_buildings": p6_buildings, "p9_found": p9_found, "p10_found": p10_found}

_BLANK = "('', '-', '--', '---', '.', '?', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'nan', 'unknown', 'undefined', 'not available', 'tbd')"


def _held(key: str) -> str:
    """SQL for a field's value, null where it stands for none."""
    return f"case when lower(trim(j->>'{key}')) not in {_BLANK} then trim(j->>'{key}') end"


_FIELDS = ", ".join(f"('{f}', {_held(f) if f != 'website' else f'coalesce({_held(f)}, {_held("web_site")})'})" for f in FIELDS)
_VOTERS = f"""with recursive k as (select id, unnest(['p' || place_id, 'c' || cid, 'd' || data_id]) k, unnest([place_id, cid, data_id]) v from businesses),
u as (select id, k from k where lower(trim(v)) not in {_BLANK} and lower(trim(v)) not in ('0', '0x0', '0x0:0x0', '-1')),
r as (select id a, id b from u union select r.a, y.id from r join u x on x.id = r.b join u y on y.k = x.k),
g as (select a id, min(b) group_id from r group by 1 having count(*) > 1),
m as (select g.group_id, b.id, coalesce(status = 'complete', false) done, epoch_us(last_seen_at::timestamptz) seen, raw_json::json j from g join (select id, last_seen_at, last_run_id, raw_json from businesses where json_valid(raw_json)) b on b.id = g.id left join (select id rid, status from runs) on rid = last_run_id),
f as (select group_id, id, done, seen, t.f field_name, t.v from m, lateral (select * from (values {_FIELDS}) as x(f, v)) t where t.v is not null)"""
SQL: dict[str, str] = {
    "p5_found": f"""{_VOTERS}
select group_id, field_name, id business_id from (select *, row_number() over (partition by group_id, field_name order by done desc, seen desc nulls last, id) n from f) where n = 1""",
    "p5_records": f"""{_VOTERS}, y as (select * replace (regexp_replace(v, case when field_name = 'review_rating' then '\\.0+$' else '$^' end, '') as v) from f),
w as (select *, case when done then 1.0 else {UNFINISHED_TRUST} end::double t, lower(regexp_replace(v, '\\s+', ' ', 'g')) norm from y),
b as (select group_id, field_name, norm, sum(t * pow(2.0, -(1900000000000000 - coalesce(seen, 0)) / (86400000000.0 * 180))) score from w group by 1, 2, 3),
x as (select w.*, score, row_number() over (partition by w.group_id, w.field_name order by score desc, t desc, seen desc nulls last, id) n from w join b on b.group_id = w.group_id and b.field_name = w.field_name and b.norm = w.norm)
select group_id, {", ".join(f"max(v) filter (field_name = '{c}') {c}" for c in FIELDS)} from x where n = 1 group by 1""",
}
