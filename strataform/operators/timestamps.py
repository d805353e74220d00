"""Timestamps of many notations and zones as one UTC instant.

Method. Every value is read under each notation that fits it; a reading that needs a zone takes it from the value,
else from the row. Day and month with slashes fit two notations. Expectation-maximisation over each source's mixture of
notations settles them: a value adds to every notation under which it is valid, in proportion to the current mixture
times the prior its locale gives the notation; at the end the posterior picks the reading, or the value is marked
ambiguous where no reading reaches ``sure``. A locale leaves the other order a prior of ``AGAINST``, so small that no
mixture outweighs it; a value that only reads against its locale is marked contradicted, not read. The mixture sees
counts per (source, set of valid notations, priors) only, at most a few dozen rows per source, gathered with a partial
aggregation.

Defined results: null, empty, relative and date-only values and local times without a zone have no instant
(``reading`` says why); a wall time that occurs twice is the earlier instant; one that is skipped moves forward by the
gap; digits finer than microseconds are cut; repeated rows are read alike; an unknown zone name counts as no zone.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import materialize

#: Offsets in minutes of zone abbreviations with one usual meaning.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "JST": 540, "AEST": 600, "AEDT": 660, "NPT": 345,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s?(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s?(?P<off>[+-]\d{2}(?::?\d{2})?)|\s?(?P<abbr>[A-Za-z]{1,5}))?(?:\s?\[(?P<region>[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?"
_SHAPES = {
    "iso": re.compile(r"(?P<y>\d{4})-(?P<mo>\d{1,2})-(?P<d>\d{1,2})[Tt ]\s?" + _CLOCK + _ZONE),
    "compact": re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[Tt](?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?(?P<ap>)" + _ZONE),
    "named": re.compile(r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[ -](?P<mn>[A-Za-z]{3,9})\.?[ -](?P<y>\d{4}),?\s+" + _CLOCK + _ZONE),
    "dotted": re.compile(r"(?P<d>\d{1,2})\.(?P<mo>\d{1,2})\.(?P<y>\d{4}),?\s+" + _CLOCK + _ZONE),
    "slashed": re.compile(r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}),?\s+" + _CLOCK + _ZONE),
    "yslashed": re.compile(r"(?P<y>\d{4})/(?P<mo>\d{1,2})/(?P<d>\d{1,2})[T ]\s?" + _CLOCK + _ZONE),
}
_EPOCH = {10: ("epoch_s", 10**6, 1), 13: ("epoch_ms", 10**3, 1), 16: ("epoch_us", 1, 1), 19: ("epoch_ns", 1, 1000)}
_FAST = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{6}))?\+00:00\Z")
#: Locales that write the month first; all others write the day first.
MONTH_FIRST = ("en-us", "en_us", "us", "en-ph", "en_ph")
DAY, US = 86_400, 1_000_000
#: Prior of an order of day and month that the locale speaks against.
AGAINST = 1e-30
#: Evidence below which a value counts as contradicted: between ``AGAINST`` and the least weight of any notation.
LEAST_EVIDENCE = 1e-20


@lru_cache(maxsize=4096)
def _zone(name: str):
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any unknown or malformed name
        return None


@lru_cache(maxsize=200_000)
def _local_offset(name: str, y: int, mo: int, d: int, h: int, mi: int, s: int) -> int | None:
    """Seconds east of UTC of a wall time: the earlier instant of two, the offset before the gap of none."""
    zone = _zone(name)
    if zone is None:
        return None
    return int(dt.datetime(y, mo, d, h, mi, s, tzinfo=zone, fold=0).utcoffset().total_seconds())


@lru_cache(maxsize=20_000)
def _days(y: int, mo: int, d: int) -> int:
    return dt.date(y, mo, d).toordinal() - 719_163


def _instant(g: dict, y: int, mo: int, d: int, tz: str | None) -> tuple[str, int | None]:
    """(why, instant) of one reading."""
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if ap := g.get("ap"):
        if not 1 <= h <= 12:
            return "invalid", None
        h = h % 12 + (12 if ap in "pP" else 0)
    leap = s == 60
    s -= leap
    day_end = h == 24 and mi == s == 0
    h = 0 if day_end else h
    if h > 23 or mi > 59 or s > 59:
        return "invalid", None
    try:
        base = (_days(y, mo, d) + day_end) * DAY + h * 3600 + mi * 60 + s + leap
    except ValueError:
        return "invalid", None
    off, abbr, region = g.get("off"), g.get("abbr"), g.get("region")
    if off:
        digits = off[1:].replace(":", "").ljust(4, "0")
        if int(digits[2:]) > 59:
            return "invalid", None
        shift = (int(digits[:2]) * 60 + int(digits[2:])) * (60 if off[0] == "+" else -60)
    elif abbr:
        if abbr.upper() not in ABBREVIATIONS:
            return "unknown_zone", None
        shift = ABBREVIATIONS[abbr.upper()] * 60
    else:
        name = region or tz
        shift = _local_offset(name, y, mo, d, h, mi, s) if name else None
        if shift is None:
            return "no_zone", None
    frac = int((g["f"] or "0")[:6].ljust(6, "0"))
    return "ok", (base - shift) * US + frac


def readings(value: str | None, tz: str | None, locale: str | None) -> tuple[str, list[tuple[str, int, float]]]:
    """(state, [(notation, instant_us, prior)]). State: canonical, read, or why there is no reading."""
    if value is None:
        return "null", []
    if m := _FAST.match(value):
        y, mo, d, h, mi, s, f = m.groups()
        why, at = _instant({"h": h, "mi": mi, "s": s, "f": f, "off": "+00:00"}, int(y), int(mo), int(d), None)
        return ("canonical", [("iso", at, 1.0)]) if at is not None else (why, [])
    text = value.strip()
    if text.isdigit() and len(text) in _EPOCH:
        name, mul, div = _EPOCH[len(text)]
        return "read", [(name, int(text) * mul // div, 1.0)]
    why = "unread"
    for name, shape in _SHAPES.items():
        m = shape.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        y = int(g["y"])
        if name == "slashed":
            a, b = int(g["a"]), int(g["b"])
            first = locale is not None and locale.lower() in MONTH_FIRST
            found = []
            for k, (mo, d) in (("mdy", (a, b)), ("dmy", (b, a))):
                why, at = _instant(g, y, mo, d, tz)
                if at is not None:
                    found.append((k, at, 1.0 if not locale or (k == "mdy") == first else AGAINST))
            # equal instants need no choice
            if len(found) == 2 and found[0][1] == found[1][1]:
                found = [max(found, key=lambda f: f[2])]
            found.sort(key=lambda f: -f[2])
        else:
            mo = MONTHS.get(g["mn"][:3].lower(), 0) if name == "named" else int(g["mo"])
            why, at = _instant(g, y, mo, int(g["d"]), tz)
            found = [(name, at, 1.0)] if at is not None else []
        if found:
            return "read", found
    return why, []


def read_values(df: DataFrame) -> DataFrame:
    """Adds (state, notations, instants, priors) to (…, value, time_zone, locale); the last three columns by position."""
    names = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            out = [readings(*r) for r in zip(*[batch.column(k).to_pylist() for k in (n - 3, n - 2, n - 1)])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n - 3], pa.array([s for s, _ in out], pa.string()), pa.array([[k for k, _, _ in r] for _, r in out], pa.list_(pa.string())), pa.array([[at for _, at, _ in r] for _, r in out], pa.list_(pa.int64())), pa.array([[p for _, _, p in r] for _, r in out], pa.list_(pa.float64()))],
                [*names[:-3], "state", "notations", "instants", "priors"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-3])
    return df.mapInArrow(scan, f"{kept}, state string, notations array<string>, instants array<bigint>, priors array<double>")


def em_weights(counts: dict[tuple, int], rounds: int = 50, prior: float = 0.5, tol: float = 1e-9) -> dict[str, float]:
    """Mixture weights of notations from counts per set of notations under which a value is valid, given as names or as
    (name, prior of the value) pairs."""
    sets = [(tuple(v if isinstance(v, tuple) else (v, 1.0) for v in valid), c) for valid, c in counts.items()]
    names = sorted({n for valid, _ in sets for n, _ in valid})
    w = {n: 1.0 / len(names) for n in names}
    for _ in range(rounds):
        gain = {n: prior for n in names}
        for valid, c in sets:
            total = sum(w[n] * p for n, p in valid)
            if total < LEAST_EVIDENCE:
                continue
            for n, p in valid:
                gain[n] += c * w[n] * p / total
        total = sum(gain.values())
        new = {n: g / total for n, g in gain.items()}
        moved = max(abs(new[n] - w[n]) for n in names)
        w = new
        if moved < tol:
            break
    return w


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    w = em_weights({tuple((n, float(p)) for n, p in zip(v, ps)): int(n) for v, ps, n in zip(pdf["notations"], pdf["priors"], pdf["n"])})
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "weights": [w]})


def normalise(values: DataFrame, sure: float = 0.9) -> DataFrame:
    """(table_name, row_key, source, value, time_zone, locale) → (table_name, row_key, state, instant_us, posterior).

    ``state`` is canonical, read, ambiguous, contradicted, or the reason for having no instant.
    """
    read = materialize(read_values(values.select("table_name", "row_key", "source", "value", "time_zone", "locale")), "readings")
    counts = read.filter(F.size("notations") > 0).groupBy("source", "notations", "priors").agg(F.count("*").alias("n"))
    weights = counts.groupBy("source").applyInPandas(_fit, "source string, weights map<string,double>")
    joined = read.join(weights.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    weight = F.zip_with("notations", "priors", lambda n, p: F.coalesce(F.try_element_at("weights", n), F.lit(0.0)) * p)
    scored = joined.withColumn("w", weight).withColumn("top", F.array_max("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    best = F.element_at("instants", F.array_position("w", F.col("top")).cast("int"))
    scored = scored.select("table_name", "row_key", "state", "instants", F.when(F.size("w") > 0, best).alias("best"), (F.col("top") / total).alias("p"), "top")
    against = F.coalesce(F.col("top") < LEAST_EVIDENCE, F.lit(False))
    unsure = (F.size("instants") > 1) & (F.coalesce("p", F.lit(0.0)) < sure)
    return scored.select("table_name", "row_key", F.when(against, "contradicted").when(unsure, "ambiguous").otherwise(F.col("state")).alias("state"), F.when(~unsure & ~against, F.col("best")).alias("instant_us"), F.col("p").alias("posterior"))
