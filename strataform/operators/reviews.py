"""Reviews: one shape for all, and the collapse of repeated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import clean_text

RAW = (
    "review_id string, source string, language string, text_original string, text_translated string, translated_lang string, Description string, `When` string, Rating double, rating_float double, rating_scale long, "
    "posted_at_unix_micros long, updated_at_unix_micros long, reply_text_original string, reply_text string, reply_language string, reply_posted_at_unix_micros long, published_at string"
)


def micros(c: Column) -> Column:
    """Micros since the epoch; 0 and negative count as missing."""
    return F.when(c > 0, c)


def normalise(raw: Column) -> Column:
    """The review's fields without its author's name and picture."""
    j = F.from_json(raw, RAW)
    return F.struct(
        clean_text(j["review_id"]).alias("review_id"), clean_text(j["source"]).alias("source"),
        F.coalesce(F.when(j["rating_float"] != 0, j["rating_float"]), j["Rating"]).alias("rating"), j["rating_scale"].alias("rating_scale"),
        F.coalesce(clean_text(j["text_original"]), clean_text(j["Description"])).alias("text_original"), clean_text(j["text_translated"]).alias("text_translated"),
        clean_text(j["language"]).alias("language"), clean_text(j["translated_lang"]).alias("translated_language"),
        micros(j["posted_at_unix_micros"]).alias("posted_us"), micros(j["updated_at_unix_micros"]).alias("updated_us"), clean_text(j["When"]).alias("source_when"),
        F.coalesce(clean_text(j["reply_text_original"]), clean_text(j["reply_text"])).alias("reply_text"), clean_text(j["reply_language"]).alias("reply_language"),
    )


def nested(raw: Column) -> Column:
    """The review as ``normalise`` gives it, with the owner's response as an object of its own and a check of the rating."""
    j, n = F.from_json(raw, RAW), normalise(raw)
    response = F.struct(n["reply_text"].alias("text"), n["reply_language"].alias("language"), micros(j["reply_posted_at_unix_micros"]).alias("posted_us"))
    fits = F.coalesce(n["rating"] <= F.coalesce(n["rating_scale"].cast("double"), F.lit(5.0)), F.lit(True))
    return F.struct(
        n["review_id"].alias("review_id"), n["source"].alias("source"), n["rating"].alias("rating"), n["rating_scale"].alias("rating_scale"), n["text_original"].alias("text_original"), n["text_translated"].alias("text_translated"),
        n["language"].alias("language"), n["translated_language"].alias("translated_language"), clean_text(j["published_at"]).alias("published_at"), n["updated_us"].alias("updated_us"), n["source_when"].alias("source_when"),
        F.when(response["text"].isNotNull() | response["language"].isNotNull(), response).alias("owner_response"), fits.alias("rating_in_scale"),
    )


def collapse(parsed: DataFrame) -> DataFrame:
    """One row per (identity_key, raw_sha256): all its source paths, sorted; variants of one review stay apart.

    Paths are made distinct before they are gathered; a variant has as many as its record has places for it.
    """
    d = parsed.select("identity_key", "raw_sha256", F.explode_outer("source_paths").alias("p")).distinct()
    return d.groupBy("identity_key", "raw_sha256").agg(F.array_sort(F.collect_list("p")).alias("paths"))


def variants(collapsed: DataFrame) -> DataFrame:
    """(identity_key, variants) of reviews that occur in several spellings."""
    return collapsed.groupBy("identity_key").agg(F.count("*").alias("variants")).filter("variants > 1")
