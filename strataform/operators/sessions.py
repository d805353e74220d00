"""Histories of runs and sessions: streaks, windows, newest rows and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.operators.history import previous


def failure_streaks(sessions: DataFrame, key: str, at: str, failed: Column, now_us: int, horizon_us: int) -> DataFrame:
    """(key, streak, streak_recent): failures since the last success, and those of them within the horizon.

    A success ends the streak, so it is the failures later than the newest success: an aggregation, no window.
    Failures at the instant of a success are not counted.
    """
    ok = sessions.filter(~failed).groupBy(key).agg(F.max(at).alias("_ok"))
    every = sessions.groupBy(key).agg(F.count("*").alias("sessions"))
    bad = sessions.filter(failed).join(ok, key, "left").filter(F.col("_ok").isNull() | (F.col(at) > F.col("_ok")))
    bad = bad.groupBy(key).agg(F.count("*").alias("streak"), F.count_if(F.col(at) >= now_us - horizon_us).alias("streak_recent"))
    return every.join(bad, key, "left").select(key, "sessions", F.coalesce("streak", F.lit(0)).alias("streak"), F.coalesce("streak_recent", F.lit(0)).alias("streak_recent"))


def retry_window(sessions: DataFrame, key: str, at: str, status: str, now_us: int, window_us: int, fresh_us: int, skew_us: int) -> DataFrame:
    """(key, retries, in_flight_fresh, in_flight_orphaned, in_flight_future) at a given instant."""
    age = F.lit(now_us) - F.col(at)
    live = F.col(status).isin("planned", "running")
    return sessions.groupBy(key).agg(
        F.count_if(F.col(status).isin("failed", "interrupted", "partial") & (age <= window_us) & (age >= 0)).alias("retries"),
        F.count_if(live & age.between(-skew_us, fresh_us)).alias("in_flight_fresh"),
        F.count_if(live & (age > fresh_us)).alias("in_flight_orphaned"),
        F.count_if(live & (age < -skew_us)).alias("in_flight_future"),
    )


def completion(expected: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """(matched, missing, unexpected): an expected multiset against a completed set; every completed id is used once."""
    e = expected.groupBy(key).agg(F.count("*").alias("e"))
    c = completed.select(key).distinct().withColumn("c", F.lit(1))
    j = e.join(c, key, "full_outer").select(F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("c", F.lit(0)).alias("c"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return j.agg(total(F.least("e", "c")).alias("matched"), total(F.col("e") - F.least("e", "c")).alias("missing"), total(F.when(F.col("e") == 0, F.col("c"))).alias("unexpected"))


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n newest rows."""
    return df.orderBy(*order).limit(n)


def latest_or_tie(df: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """(key, latest, at, ties): the row with the greatest instant; ``ties`` above 1 means it isn't unique. One read: rows
    are counted per instant, then the greatest instant of each key is taken."""
    n = df.filter(F.col(at).isNotNull()).groupBy(key, at).agg(F.min(ident).alias("latest"), F.count("*").alias("ties"))
    return n.groupBy(key).agg(F.max(F.struct(at, "latest", "ties")).alias("m")).select(key, "m.latest", F.col(f"m.{at}").alias(at), "m.ties")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, by ``min_by``."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def status_moves(sessions: DataFrame, key: str, at: str, tie: str, status: str, hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """(before, after, n): counts of status changes along each key's history by (at, tie); hot keys in time chunks."""
    d = previous(sessions.select(key, F.col(at).alias("_at"), tie, status), [key], ["_at", tie], status, "_p", hot_rows, chunk_rows)
    d = d.select(F.col("_p")["value"].alias("before"), F.col(status).alias("after"))
    return d.filter("before is not null and before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


def backoff(attempt: Column, asked: Column, base: float, cap: float, most_asked: float) -> Column:
    """Seconds to wait after an attempt: base doubled per attempt up to a cap, or the delay asked for (up to its own cap) if longer."""
    return F.greatest(F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1)), F.least(F.lit(most_asked), F.coalesce(asked, F.lit(0.0))))


def latest_status_moves(rows: DataFrame, keys: list[str], status: str, allowed: tuple[tuple[str, str], ...], hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """(before, after, allowed, n): status changes along each key's history by (_at, id), judged by the moves allowed."""
    d = previous(rows, keys, ["_at", "id"], status, "_p", hot_rows, chunk_rows).select(F.col("_p")["value"].alias("before"), F.col(status).alias("after"))
    ok = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    d = d.filter("before is not null and before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))
    return d.select("before", "after", F.array_contains(ok, F.concat_ws(">", "before", "after")).cast("int").alias("allowed"), "n")
