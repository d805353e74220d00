"""Streaming ingest of records into the latest row per key.

Every micro-batch is reduced to one row per key and appended under its batch number; a batch that runs twice overwrites
its own part only. The table is the merge of all parts, which is associative, so lateness is unbounded: a record that
arrives years late changes first sightings and never newer values. ``compact`` folds old parts into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.sources import shared


def reduce_batch(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key: first and last instant, number of records and the latest record (ties by its fields)."""
    rest = [c for c in df.columns if c not in (key, at)]
    return df.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"), F.max(F.struct(at, *rest)).alias("latest"))


def merge(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"), F.max("latest").alias("latest"))


def _parts(root: str) -> list[tuple[int, str]]:
    """Committed parts: the newest compacted one and the batches after it; on whatever file system the root lies."""
    done = [(n.split("-")[0], int(n.split("-")[1])) for n in shared.names(root) if "-" in n and shared.exists(f"{root}/{n}/_SUCCESS")]
    base = max((k for kind, k in done if kind == "upto"), default=-1)
    return sorted((k, f"{root}/{kind}-{k}") for kind, k in done if (kind == "upto" and k == base) or (kind == "batch" and k > base))


def latest_table(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    parts = _parts(root)
    return merge(spark.read.parquet(*[p for _, p in parts]), key) if parts else None


def compact(spark: SparkSession, root: str, key: str) -> None:
    """Folds all parts into one and removes them; readers see the old parts or the new one."""
    parts = _parts(root)
    if len(parts) > 1:
        latest_table(spark, root, key).write.mode("overwrite").parquet(f"{root}/upto-{parts[-1][0]}")
        for _, p in parts:
            shared.delete(p)


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, key: str, at: str):
    """Starts the stream; ``latest_table(spark, root, key)`` is its result so far."""

    def each(batch: DataFrame, number: int) -> None:
        reduce_batch(batch, key, at).write.mode("overwrite").parquet(f"{root}/batch-{number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and value; a window closes once the watermark passes it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
