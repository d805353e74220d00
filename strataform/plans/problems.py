"""The queries of the general data-pipeline problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.flatten import ROOT, flat_rows, flat_table, keyed_rows, nested_objects
from strataform.functions.jsons import instant_us
from strataform.operators.history import fact_history, fact_history_in_loads
from strataform.operators.spatial import near_and_within
from strataform.operators.timestamps import normalise
from strataform.sources.tables import table


def _statements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts", "id", "subject_id", "predicate", "fact_slot", "value_json", "status", "valid_from", "reconciled_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fact_history(_statements(spark, d)).drop("satellite")


#: Loads of ``p1_loads`` end at these instants: 2024-01-01, 2025-01-01 and never.
LOADS_US = (1_704_067_200_000_000, 1_735_689_600_000_000)


def p1_loads(spark: SparkSession, d: str) -> DataFrame:
    """The history of p1_found, its facts arriving in three loads by ``reconciled_at``, with late statements and corrections."""
    at = F.coalesce(instant_us(F.col("reconciled_at")), F.lit(0))
    first, second = LOADS_US
    return fact_history_in_loads(_statements(spark, d), [at < first, (at >= first) & (at < second), at >= second])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    areas = table(spark, d, "areas", "area_id", "min_lat", "min_lon", "max_lat", "max_lon")
    return near_and_within(table(spark, d, "businesses", "id", "latitude", "longitude"), areas)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "businesses", "id", "raw_json")
    return nested_objects(b, "id", "raw_json", with_fields=False).select(F.col("id").alias("business_id"), "parent_path", "path")


def _days(path: str) -> tuple[str, ...]:
    return tuple(f"{path}.{day}" for day in ("mon", "tue", "wed", "thu", "fri", "sat", "sun"))


#: The flat tables of the records, root first; ``p4_rows`` has the rows of these and of any array not named here.
P4_TABLES = {
    "p4_root": ROOT, "p4_reviews": "user_reviews", "p4_images": "user_reviews.images", "p4_place_images": "images",
    **{f"p4_{t.replace('.', '_')}": t for t in (
        "about", "about.options", "menu.sections", "menu.sections.items", "menu.sections.items.options", *_days("open_hours"), "popular_times", "popular_times.hours", "user_reviews.images.tags",
        "user_reviews.owner_response.edits", "user_reviews_extended", "user_reviews_extended.images", "user_reviews_extended.images.tags", "user_reviews_extended.owner_response.edits")},
}


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all flat tables in one, their columns as JSON."""
    return keyed_rows(flat_rows(table(spark, d, "businesses", "id", "raw_json"), "id", "raw_json"))


def _p4_table(name: str, path: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return flat_table(table(spark, d, "businesses", "id", "raw_json"), "id", "raw_json", path)

    run.__name__, run.__doc__ = name, f"The flat table of {path or 'the records themselves'}; ``parent_key`` is the ``row_key`` of the row around it."
    return run


_P4 = {name: _p4_table(name, path) for name, path in P4_TABLES.items()}
p4_reviews, p4_images = _P4["p4_reviews"], _P4["p4_images"]


def _times(spark: SparkSession, d: str) -> DataFrame:
    hints = "time_zone string, locale string"
    e = table(spark, d, "evidence_items", "id", "source_id", "retrieved_at", "metadata_json")
    e = e.select(F.lit("evidence_items").alias("table_name"), F.col("id").alias("row_key"), F.col("source_id").alias("source"), F.col("retrieved_at").alias("value"), F.from_json("metadata_json", hints).alias("h"))
    r = table(spark, d, "parsed_reviews", "raw_sha256", "source", "published_at", "raw_json")
    r = r.select(F.lit("parsed_reviews").alias("table_name"), F.col("raw_sha256").alias("row_key"), F.concat(F.lit("review:"), F.coalesce("source", F.lit(""))).alias("source"), F.col("published_at").alias("value"), F.from_json("raw_json", hints).alias("h"))
    return normalise(e.unionByName(r).select("table_name", "row_key", "source", "value", "h.time_zone", "h.locale"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = _times(spark, d).filter((F.col("state") == "read") & F.col("instant_us").isNotNull())
    return found.select("table_name", "row_key", "instant_us").distinct()


def p7_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """The values that name no one instant, and why: ambiguous, contradicted, no_zone, unknown_zone, invalid, unread."""
    left = _times(spark, d).filter(F.col("instant_us").isNull() & (F.col("state") != "null"))
    return left.select("table_name", "row_key", "state").distinct()


QUERIES = {"p1_found": p1_found, "p1_loads": p1_loads, "p2_found": p2_found, "p4_found": p4_found, "p4_rows": p4_rows, **_P4, "p7_found": p7_found, "p7_unresolved": p7_unresolved}

_OK = "latitude between -90 and 90 and longitude between -180 and 180 and not (latitude = 0 and longitude = 0)"
SQL = {
    "p1_found": """with f as (select distinct id, subject_id, predicate, fact_slot, value_json, status, epoch_us(valid_from::timestamptz) vf, epoch_us(reconciled_at::timestamptz) rc from facts),
v as (select *, case when status in ('unknown', 'not_observed', 'not_applicable') then null when json_type(value_json) = 'OBJECT' then array_to_string(list_transform(list_sort(json_keys(value_json)), lambda k: k || '=' || json_extract_string(value_json, '$."' || k || '"')), chr(31))
  when json_type(value_json) in ('UBIGINT', 'BIGINT', 'DOUBLE') then value_json::double::varchar else json_extract_string(value_json, '$') end as c from f where vf is not null),
s as (select * from (select *, row_number() over (partition by subject_id, predicate, fact_slot, vf order by rc desc nulls last, id desc) n from v) where n = 1),
g as (select *, lag(c) over w p, row_number() over w k from s window w as (partition by subject_id, predicate, fact_slot order by vf)),
b as (select *, lead(vf) over (partition by subject_id, predicate, fact_slot order by vf) nx from g where k = 1 or c is distinct from p)
select subject_id, predicate, fact_slot, vf // 1000000 valid_from_s, coalesce(nx // 1000000, -1) valid_to_s from b where c is not null""",
    "p2_found": f"""with p as (select distinct id, latitude, longitude from businesses where {_OK}),
d as (select a.id x, b.id y, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))) m
  from p a join p b on a.id < b.id and abs(a.latitude - b.latitude) < 0.01)
select 'near' relation, x left_id, y right_id from d where m <= 120 union all
select 'in', id, area_id from p join areas on latitude between min_lat and max_lat and (case when min_lon <= max_lon then longitude between min_lon and max_lon else longitude >= min_lon or longitude <= max_lon end)""",
}
SQL["p1_loads"] = SQL["p1_found"]

def _inline(x: str) -> str:
    """SQL for a JSON value, read where it is a text that is JSON itself."""
    return f"case when json_type({x}) = 'VARCHAR' and regexp_matches({x}->>'$', '^\\s*[\\{{\\[]') and json_valid({x}->>'$') then ({x}->>'$')::json else {x} end"


_CHILD = "json_extract(v, '$.\"' || k || '\"')"
# first all array paths of all records, then the elements, lone objects at such paths included
SQL["p4_found"] = f"""with recursive src as (select id, {_inline('raw_json::json')} v from businesses where json_valid(raw_json)),
w1 as (select v, '' g from src union all select * from (select {_inline('c')} v, g || case when e and json_type({_inline('c')}) = 'ARRAY' then '.[]' when e then '' else '.' || k end g from
  (select {_CHILD} c, k, g, false e from (select v, g, unnest(json_keys(v)) k from w1 where json_type(v) = 'OBJECT') union all select unnest(v::json[]), '', g, true from w1 where json_type(v) = 'ARRAY')) where json_type(v) in ('OBJECT', 'ARRAY')),
ar as (select distinct g from w1 where json_type(v) = 'ARRAY'),
w2 as (select id, case when json_type(v) = 'ARRAY' then 'A' else 'O' end t, v, '' g, '' at_path, '' near, '' parent, false found from src where json_type(v) in ('OBJECT', 'ARRAY') union all
  select * from (select id, case when json_type(v) = 'ARRAY' then 'A' when g in (select g from ar) then 'L' else 'O' end t, v, g, at_path, near, '' parent, false found from (select id, {_inline('c')} v, g || '.' || k g, case when at_path = '' then k else at_path || '.' || k end at_path, near from (select id, {_CHILD} c, k, g, at_path, near from (select *, unnest(json_keys(v)) k from w2 where t = 'O'))) where json_type(v) in ('OBJECT', 'ARRAY')
  union all select id, case when json_type(v) = 'ARRAY' then 'A' else 'O' end, v, case when json_type(v) = 'ARRAY' then g || '.[]' else g end, at_path || '[' || i || ']', case when json_type(v) = 'ARRAY' then near else at_path || '[' || i || ']' end, near, json_type(v) = 'OBJECT' from (select id, {_inline('c')} v, g, at_path, near, i from (select id, unnest(v::json[]) c, unnest(range(0, len(v::json[]))) i, g, at_path, near from w2 where t = 'A')) where json_type(v) in ('OBJECT', 'ARRAY')
  union all select id, 'O', v, g, at_path || '[0]', at_path || '[0]', near, true from w2 where t = 'L'))
select distinct id business_id, parent parent_path, at_path as path from w2 where found"""
