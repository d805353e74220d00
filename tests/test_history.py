import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from strataform.functions.jsons import canonical_json
from strataform.operators import history
from strataform.operators.history import NO_VALUE, fact_history
from strataform.plans.problems import p1_found

COLS = "id string, subject_id string, predicate string, fact_slot string, value_json string, status string, valid_from string, reconciled_at string, valid_to string, _at string"


def brute(rows):
    """Versions by walking the statements of each slot in order."""
    best = {}
    at = lambda s: dt.datetime.fromisoformat(s.replace("Z", "+00:00")) if s else dt.datetime.min.replace(tzinfo=dt.timezone.utc)
    for r in rows:
        if r["valid_from"] is None:
            continue
        k = (r["subject_id"], r["predicate"], r["fact_slot"], at(r["valid_from"]))
        rank = (at(r["reconciled_at"]), r["id"] or "")
        if k not in best or rank > best[k][0]:
            v = r["value_json"]
            v = None if r["status"] in NO_VALUE or v is None else json.dumps(json.loads(v, parse_float=Decimal, parse_int=Decimal), sort_keys=True, default=lambda d: format(d.normalize(), "f"))
            best[k] = (rank, v)
    slots = {}
    for (s, p, f, t), (_, v) in best.items():
        slots.setdefault((s, p, f), []).append((t, v))
    out = set()
    for key, seq in slots.items():
        seq.sort(key=lambda x: x[0])
        starts = [x for i, x in enumerate(seq) if i == 0 or seq[i - 1][1] != x[1]]
        for i, (t, v) in enumerate(starts):
            if v is not None:
                out.add((*key, int(t.timestamp()), int(starts[i + 1][0].timestamp()) if i + 1 < len(starts) else -1))
    return out


def test_whole_table(spark, data):
    rows = [r.asDict() for r in spark.read.parquet(f"{data}/facts.parquet").collect()]
    got = [tuple(r) for r in p1_found(spark, data).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_hot_keys_in_chunks(spark, data):
    facts = spark.read.parquet(f"{data}/facts.parquet")
    got = {tuple(r) for r in fact_history(facts, hot_rows=3, chunk_rows=2).drop("satellite").collect()}
    assert got == brute([r.asDict() for r in facts.collect()])


def test_values_compare_by_meaning(spark):
    same = [('{"a":1,"b":[1.50,"x"]}', '{ "b": [1.5,"\\u0078"], "a": 1.0 }'), ("100", "1e2"), ("3.70", "3.7"), ('"1e2"', '"1e2"'), ("-0.0", "0"), ('{"k":1.5E10}', '{"k":15000000000}')]
    differ = [('"1"', "1"), ("[1,2]", "[2,1]"), ("1.0001", "1.0002"), ('"1e2"', '"100"')]
    df = spark.createDataFrame([(*p, True) for p in same] + [(*p, False) for p in differ], "a string, b string, eq boolean")
    bad = df.filter((canonical_json(F.col("a")) == canonical_json(F.col("b"))) != F.col("eq")).collect()
    assert bad == []


def test_edges(spark):
    r = lambda i, v, frm, rec="2024-01-01T00:00:00Z", st="confirmed", s="s": (i, s, "p", None, v, st, frm, rec, "9", "x")
    rows = [
        r("1", "1", "2024-01-01T00:00:00Z"),
        r("1", "1", "2024-01-01T00:00:00Z"),  # delivered twice
        r("2", "1.0", "2024-01-02T01:00:00+01:00"),
        r("3", "2", "2024-01-03T00:00:00Z", rec=None),
        r("4", "3", "2024-01-03T00:00:00Z"),  # reconciled later than the one above
        r("5", None, "2024-01-04T00:00:00Z", st="unknown"),
        r("6", "3", "2024-01-05T00:00:00Z"),
        r("7", "9", None),
        r("8", "9", "no time"),
        r("9", "not json", "2024-01-01T00:00:00Z", s=None),
    ]
    got = {(x.subject_id, x.valid_from_s, x.valid_to_s) for x in fact_history(spark.createDataFrame(rows, COLS)).collect()}
    day = 86_400
    t = 1_704_067_200
    assert got == {("s", t, t + 2 * day), ("s", t + 2 * day, t + 3 * day), ("s", t + 4 * day, -1), (None, t, -1)}
    assert fact_history(spark.createDataFrame([], COLS)).count() == 0


def test_loads_in_order_append_what_one_load_gives(spark, data, tmp_path):
    keys = ["subject_id", "predicate", "fact_slot"]
    facts = spark.read.parquet(f"{data}/facts.parquet")
    held = F.when(~F.col("status").isin(*NO_VALUE), F.xxhash64(canonical_json(F.col("value_json"))))
    at = history.instant_us(F.col("valid_from"))
    stated = history.statements(facts, keys, at, held, [history.instant_us(F.col("reconciled_at")), F.col("id")]).cache()
    mid = stated.approxQuantile("_at", [0.5], 0.0)[0]
    path = str(tmp_path / "sat")
    first = history.changes(stated.filter(F.col("_at") <= mid), keys)
    rates = history.change_rates(first, "predicate").cache()
    history.append(history.split(first, rates, "predicate"), path)
    later = stated.filter(F.col("_at") > mid)
    sat = spark.read.parquet(path)
    assert history.late_keys(sat, later, keys).count() == 0
    history.append(history.split(history.new_rows(sat, later, keys), rates, "predicate"), path)
    whole = lambda d: {tuple(r) for r in history.history_view(d, keys).select(*keys, "_at", "_to").collect()}
    assert whole(spark.read.parquet(path)) == whole(history.changes(stated, keys))
    early = stated.orderBy("_at").limit(1)
    assert history.late_keys(spark.read.parquet(path), early, keys).count() == 1


def test_late_statements_only_append(spark):
    """A statement between two equal ones parts them, though the satellite kept but the first."""
    r = lambda i, v, day, rec: (i, "s", "p", None, v, "confirmed", f"2024-01-{day:02}T00:00:00Z", f"2024-0{rec}-01T00:00:00Z", "9", "x")
    rows = [r("1", "1", 1, 2), r("2", "1", 9, 2), r("3", "2", 5, 3), r("4", "3", 12, 3), r("5", "7", 5, 4), r("6", "3", 14, 4)]
    facts = spark.createDataFrame(rows, COLS)
    loads = [F.col("reconciled_at").startswith(f"2024-0{k}") for k in (2, 3, 4)]
    got = {tuple(x) for x in history.fact_history_in_loads(facts, loads).collect()}
    assert got == brute([x.asDict() for x in facts.collect()]) and len(got) == 4
    first = history.changes(history.fact_statements(facts.filter(loads[0])), history.FACT_KEYS).withColumn("_load", F.lit(0))
    every = history.fact_statements(facts.filter(loads[0] | loads[1]))
    added = history.loaded_rows(first, history.fact_statements(facts.filter(loads[0])), history.fact_statements(facts.filter(loads[1])), every, history.FACT_KEYS, 1)
    assert added.count() == 4 and first.count() == 1  # nothing of the first load is touched


def test_burst_of_a_hot_key_is_cut(spark):
    """All but two of a key's instants fall into one second of forty years; no chunk exceeds what it should hold."""
    n = 40_000
    d = spark.range(n).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 0).when(F.col("id") == 1, 1_262_304_000_000_000).otherwise(700_000_000_000_000 + F.col("id") * 25).alias("_at"), (F.col("id") % 3).alias("_hash"))
    sizes = []

    def hot(chunked):
        sizes.extend(r["count"] for r in chunked.groupBy("_chunk").count().collect())
        return chunked.drop("_chunk")

    assert history._edges(d, ["k"], 1000, 2000, lambda x: x, hot).count() == n
    assert max(sizes) <= 2 * 2000 and len(sizes) >= 18
    got = history.changes(d, ["k"], 1000, 2000)
    assert got.count() == history.changes(d, ["k"]).count()
