"""Full history of changing attributes: insert-only satellites with lead-based end dates.

Method. Statements (key, instant, value) are reduced to one per key and instant, a hash of the value is compared
with that of the statement before, and only rows whose hash differs are appended to a satellite. Attributes are
split over two satellites, each a table of its own, by how often they change, so that the slow one stays small. No end
date is stored: the view over both computes it as the start of the next row of the key.

Further loads only append (``loaded_rows``). A statement later than all its key's statements adds a row if it changes the
value. One that comes late may part a run of equal values of which the satellite keeps the first only, so the key's rows
are appended anew from all its statements under the number of the load; the view takes each key's highest load.

Skew. All but hot keys are windowed by key. A key with more than ``hot_rows`` statements is cut at quantiles of its
instants into chunks of about ``chunk_rows`` each, however its statements cluster in time; every chunk is windowed alone
and the borders are joined from a summary with one row per chunk. No task holds an unbounded group.

Defined results: rows without a readable instant state nothing and are left out; nulls in key columns are a key value
of their own; a repeated row counts once; of rows tied on instant and reconciliation the largest ``tie`` stands; an
empty table gives an empty history; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.jsons import canonical_json, instant_us
from strataform.session import materialize

NO_VALUE = ("unknown", "not_observed", "not_applicable")


def statements(df: DataFrame, keys: list[str], at: Column, value_hash: Column, rank: list[Column]) -> DataFrame:
    """One row per key and instant: (keys, _at, _hash); ``_hash`` null states that no value holds."""
    base = df.select(*keys, at.alias("_at"), F.struct(*rank).alias("_rank"), F.struct(value_hash.alias("h")).alias("_v"))
    return (
        base.filter(F.col("_at").isNotNull())
        .groupBy(*keys, "_at")
        .agg(F.max_by("_v", "_rank")["h"].alias("_hash"))
    )


#: Hot keys are cut at so many quantiles at most; a chunk is that share of its key where ``chunk_rows`` would be less.
QUANTILES = 256


def _same(df: DataFrame, other: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null equal to null; the other frame's are named _k0, _k1 and so on."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= df[k].eqNullSafe(other[f"_k{i}"])
    return on


def _named(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _edges(df: DataFrame, keys: list[str], hot_rows: int, chunk_rows: int, cold, hot) -> DataFrame:
    """Applies ``cold`` to all keys of up to ``hot_rows`` rows, ``hot`` to the others, which get a ``_chunk``."""
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(*_named(keys), "_n")
    if big.isEmpty():
        return cold(df)
    names = [f"_k{i}" for i in range(len(keys))]
    big = materialize(big, "hot_keys")
    few = df.join(big, _same(df, big, keys), "left_anti")
    many = df.join(big, _same(df, big, keys)).drop(*names)
    bounds = many.groupBy(*keys).agg(F.percentile_approx("_at", [k / QUANTILES for k in range(1, QUANTILES)], 10_000).alias("_q"), F.first("_n").alias("_n"))
    # as many of the quantiles as the key has chunks, evenly spread
    chunks = F.least(F.lit(QUANTILES), F.ceil(F.col("_n") / chunk_rows)).cast("int")
    at = F.transform(F.expr("sequence(1, greatest(_c - 1, 1))"), lambda k: F.element_at("_q", F.least(F.lit(QUANTILES - 1), F.greatest(F.lit(1), F.floor(k * QUANTILES / F.col("_c")).cast("int")))))
    bounds = bounds.withColumn("_c", chunks).select(*_named(keys), F.array_distinct(at).alias("_b"))
    bounds = materialize(bounds, "chunk_bounds")
    chunk = F.size(F.filter("_b", lambda b: b < F.col("_at")))
    many = many.drop("_n").join(bounds, _same(many, bounds, keys)).withColumn("_chunk", chunk).drop("_b", *names)
    return cold(few).unionByName(hot(many))


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """Adds ``out``: struct(value) of the key's row before by ``order``, which starts with ``_at``; null for the first."""
    held = F.struct(F.col(value).alias("value"))

    def cold(d: DataFrame) -> DataFrame:
        return d.withColumn(out, F.lag(held).over(Window.partitionBy(*keys).orderBy(*order)))

    def hot(d: DataFrame) -> DataFrame:
        d = d.withColumn(out, F.lag(held).over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
        last = d.groupBy(*keys, "_chunk").agg(F.max_by(held, F.struct(*order)).alias("_last"))
        # one row per chunk of about chunk_rows rows, so this window is smaller by that factor
        last = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_before"))
        on = d["_chunk"] == last["_kc"]
        for i, k in enumerate(keys):
            on &= d[k].eqNullSafe(last[f"_k{i}"])
        return d.join(last, on).withColumn(out, F.coalesce(out, "_before")).drop("_before", "_chunk", "_kc", *[f"_k{i}" for i in range(len(keys))])

    return _edges(df, keys, hot_rows, chunk_rows, cold, hot)


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """Adds ``out``: the last ``value`` that isn't null up to and with each row of the key by ``order``, which starts with ``_at``."""

    def cold(d: DataFrame) -> DataFrame:
        return d.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))

    def hot(d: DataFrame) -> DataFrame:
        d = d.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        ends = d.groupBy(*keys, "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
        before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*_named(keys), F.col("_chunk").alias("_kc"), before.alias("_before"))
        return d.join(ends, (d["_chunk"] == ends["_kc"]) & _same(d, ends, keys)).withColumn(out, F.coalesce(out, "_before")).drop("_before", "_chunk", "_kc", *[f"_k{i}" for i in range(len(keys))])

    return _edges(df, keys, hot_rows, chunk_rows, cold, hot)


def changes(stated: DataFrame, keys: list[str], hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """The rows a satellite gets: (keys, _at, _hash, _first), only where the hash differs from the one before."""
    d = previous(stated.select(*keys, "_at", "_hash"), keys, ["_at"], "_hash", "_p", hot_rows, chunk_rows)
    d = d.filter(F.col("_p").isNull() | ~F.col("_p")["value"].eqNullSafe(F.col("_hash")))
    return d.select(*keys, "_at", "_hash", F.col("_p").isNull().alias("_first"))


SATELLITES = ("slow", "fast")


def change_rates(changed: DataFrame, attribute: str, fast_from: float = 4.0) -> DataFrame:
    """(_attr, satellite): attributes from ``fast_from`` changes per key on are fast, the others slow."""
    rate = changed.groupBy(attribute).agg((F.count("*") / F.greatest(F.count_if("_first"), F.lit(1))).alias("_rate"))
    return rate.select(F.col(attribute).alias("_attr"), F.when(F.col("_rate") >= fast_from, "fast").otherwise("slow").alias("satellite"))


def split(rows: DataFrame, rates: DataFrame, attribute: str) -> DataFrame:
    """The rows with the ``satellite`` of their attribute; one not seen when the rates were counted is slow."""
    return rows.join(rates, rows[attribute].eqNullSafe(rates["_attr"]), "left").drop("_attr").withColumn("satellite", F.coalesce("satellite", F.lit("slow")))


def satellites(changed: DataFrame, attribute: str, fast_from: float = 4.0) -> dict[str, DataFrame]:
    """The changed rows as two tables by the change rates of their attributes."""
    kept = materialize(changed, "changes")
    tables = materialize(split(kept, change_rates(kept, attribute, fast_from), attribute), "satellites", ["satellite"])
    return {s: tables.filter(F.col("satellite") == s).drop("satellite") for s in SATELLITES}


def append(rows: DataFrame, path: str) -> None:
    """Appends rows to the satellites under ``path``, one folder each; nothing there is changed or removed."""
    rows.write.mode("append").partitionBy("satellite").parquet(path)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_k0 …, _end, _held): instant and hash of each key's last row."""
    last = rows.groupBy(*keys).agg(F.max("_at").alias("_end"), F.max_by(F.struct("_hash"), "_at").alias("_held"))
    return last.select(*_named(keys), "_end", "_held")


def new_rows(sat: DataFrame, stated: DataFrame, keys: list[str]) -> DataFrame:
    """The rows a further load of statements adds to a satellite: those that change what its key held last.

    For keys with late statements (see ``late_keys``) only those later than their last row count here.
    """
    last = _last(sat, keys)
    j = stated.join(last, _same(stated, last, keys), "left").filter(F.col("_end").isNull() | (F.col("_at") > F.col("_end")))
    j = j.select(*keys, "_at", "_hash", "_end", "_held")
    c = changes(j.select(*keys, "_at", "_hash"), keys)
    c = c.join(last, [c[k].eqNullSafe(last[f"_k{i}"]) for i, k in enumerate(keys)], "left")
    repeats = F.col("_first") & F.col("_held").isNotNull() & F.col("_held")["_hash"].eqNullSafe(F.col("_hash"))
    return c.filter(~repeats).select(*keys, "_at", "_hash", (F.col("_first") & F.col("_end").isNull()).alias("_first"))


def late_keys(held: DataFrame, stated: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with statements no later than their last one in ``held``: the statements loaded before, or a satellite whose
    statements all changed something."""
    last = _last(held, keys)
    return stated.join(last, (F.col("_at") <= F.col("_end")) & _same(stated, last, keys), "left_semi").select(*keys).distinct()


def loaded_rows(sat: DataFrame, before: DataFrame, stated: DataFrame, every: DataFrame, keys: list[str], load: int) -> DataFrame:
    """(keys, _at, _hash, _first, _load): what load number ``load`` appends to a satellite with such rows.

    ``before`` holds the statements of earlier loads, ``stated`` the new ones, ``every`` both, one per key and instant.
    """
    late = materialize(late_keys(before, stated, keys).select(*_named(keys)), "late_keys")
    anew = changes(every.join(late, _same(every, late, keys), "left_semi"), keys).withColumn("_load", F.lit(load))
    rest = stated.join(late, _same(stated, late, keys), "left_anti")
    stands = standing(sat, keys)
    number = stands.groupBy(*keys).agg(F.first("_load").alias("_load")).select(*_named(keys), "_load")
    more = new_rows(stands.drop("_load"), rest, keys)
    more = more.join(number, _same(more, number, keys), "left").select(*more.columns, F.coalesce("_load", F.lit(load)).alias("_load"))
    return anew.unionByName(more)


def standing(sat: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a satellite that count: of each key those of its highest load."""
    top = sat.groupBy(*keys).agg(F.max("_load").alias("_top")).select(*_named(keys), "_top")
    return sat.join(top, _same(sat, top, keys) & (sat["_load"] == top["_top"])).select(*sat.columns)


def next_start(df: DataFrame, keys: list[str], order: list[str], out: str, hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """Adds ``out``: the instant ``_at`` of the key's next row by ``order``, which starts with ``_at``; null for the last."""

    def cold(d: DataFrame) -> DataFrame:
        return d.withColumn(out, F.lead("_at").over(Window.partitionBy(*keys).orderBy(*order)))

    def hot(d: DataFrame) -> DataFrame:
        d = d.withColumn(out, F.lead("_at").over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
        first = d.groupBy(*keys, "_chunk").agg(F.min("_at").alias("_start"))
        nxt = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), F.lead("_start").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_next"))
        on = d["_chunk"] == nxt["_kc"]
        for i, k in enumerate(keys):
            on &= d[k].eqNullSafe(nxt[f"_k{i}"])
        return d.join(nxt, on).withColumn(out, F.coalesce(out, "_next")).drop("_next", "_chunk", "_kc", *[f"_k{i}" for i in range(len(keys))])

    return _edges(df, keys, hot_rows, chunk_rows, cold, hot)


def history_view(sat: DataFrame, keys: list[str], hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """Versions (keys, _at, _hash, _to) of one satellite: ``_to`` is the next row's start, null while open."""
    return next_start(sat, keys, ["_at"], "_to", hot_rows, chunk_rows).filter(F.col("_hash").isNotNull())


FACT_KEYS = ["subject_id", "predicate", "fact_slot"]


def fact_statements(facts: DataFrame) -> DataFrame:
    held = F.when(F.col("status").isin(*NO_VALUE), None).otherwise(F.xxhash64(canonical_json(F.col("value_json"))))
    held = F.when(F.col("value_json").isNotNull(), held)
    return statements(facts, FACT_KEYS, instant_us(F.col("valid_from")), held, [instant_us(F.col("reconciled_at")), F.col("id")])


def _versions(view: DataFrame, *more: str) -> DataFrame:
    seconds = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    return view.select(*FACT_KEYS, seconds("_at").alias("valid_from_s"), F.coalesce(seconds("_to"), F.lit(-1)).cast("long").alias("valid_to_s"), *more)


def fact_history(facts: DataFrame, hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """Versions of every (subject_id, predicate, fact_slot): valid_from_s, valid_to_s (-1 while open), satellite."""
    stated = materialize(fact_statements(facts), "statements")
    sat = satellites(changes(stated, FACT_KEYS, hot_rows, chunk_rows), "predicate")
    views = [history_view(sat[s], FACT_KEYS, hot_rows, chunk_rows).withColumn("satellite", F.lit(s)) for s in SATELLITES]
    return _versions(views[0].unionByName(views[1]), "satellite")


def fact_history_in_loads(facts: DataFrame, loads: list[Column], hot_rows: int = 1_000_000, chunk_rows: int = 200_000) -> DataFrame:
    """As ``fact_history``, with the facts arriving in several loads, each told by a condition, into insert-only satellites.

    The first load's change rates say which satellite an attribute belongs to from then on.
    """
    sat, before, rates, so_far = None, None, None, F.lit(False)
    for number, mine in enumerate(loads):
        so_far = so_far | mine
        every = materialize(fact_statements(facts.filter(so_far)), "statements")
        if sat is None:
            rows = materialize(changes(every, FACT_KEYS, hot_rows, chunk_rows).withColumn("_load", F.lit(number)), "changes")
            rates = materialize(change_rates(rows, "predicate"), "rates")
        else:
            rows = loaded_rows(sat.drop("satellite"), before, fact_statements(facts.filter(mine)), every, FACT_KEYS, number)
        rows = materialize(split(rows, rates, "predicate"), "satellites", ["satellite"])
        sat, before = rows if sat is None else sat.unionByName(rows), every
    views = [history_view(standing(sat.filter(F.col("satellite") == s).drop("satellite"), FACT_KEYS), FACT_KEYS, hot_rows, chunk_rows) for s in SATELLITES]
    return _versions(views[0].unionByName(views[1]))
