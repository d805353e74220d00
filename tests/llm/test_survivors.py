import datetime as dt
import json

from pyspark.sql import functions as F

from strataform.functions.text import ID_PLACEHOLDERS, PLACEHOLDERS
from strataform.llm.queries import p5_found, p5_records
from strataform.llm.survivors import FIELDS, decayed_votes, duplicate_groups, strict_votes, votes, winners


def brute(rows, complete):
    parent = {r["id"]: r["id"] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for r in rows:
        for c in ("place_id", "cid", "data_id"):
            v = (r[c] or "").strip()
            if v.lower() in PLACEHOLDERS + ID_PLACEHOLDERS:
                continue
            a, b = find(seen.setdefault((c, v), r["id"])), find(r["id"])
            parent[max(a, b)] = min(a, b)
    groups = {}
    for r in rows:
        groups.setdefault(find(r["id"]), []).append(r)
    out = set()
    for g, members in groups.items():
        if len(members) < 2:
            continue
        at = lambda r: dt.datetime.fromisoformat(r["last_seen_at"].replace("Z", "+00:00")).timestamp()
        members.sort(key=lambda r: (r["last_run_id"] not in complete, -at(r), r["id"]))
        for f in FIELDS:
            for r in members:
                try:
                    o = json.loads(r["raw_json"])
                except ValueError:
                    continue
                vs = [str(o[k]).strip().lower() for k in ((f, "web_site") if f == "website" else (f,)) if o.get(k) is not None]
                if any(v not in PLACEHOLDERS for v in vs):
                    out.add((g, f, r["id"]))
                    break
    return out


def test_whole_table(spark, data):
    rows = [r.asDict() for r in spark.read.parquet(f"{data}/businesses.parquet").collect()]
    done = {r.id for r in spark.read.parquet(f"{data}/runs.parquet").filter("status = 'complete'").collect()}
    got = [tuple(r) for r in p5_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, done)
    assert p5_records(spark, data).count() == len({g for g, _, _ in got})


COLS = "id long, place_id string, cid string, data_id string, raw_json string, at long, value string"


def test_votes_add_up_and_edges(spark):
    raw = lambda t: json.dumps({"title": t})
    rows = [
        (1, "a", None, None, raw("Old"), 0, "x"), (2, "a", "c", None, raw(" new  name"), 10**13, "x"), (3, None, "c", "d", raw("New name"), 10**13, "x"),
        (4, None, None, "d", "{broken", None, "x"), (5, "n/a", "0", None, raw("alone"), 1, "x"), (6, "N/A", "0", "0x0:0x0", raw("alone"), 1, "x"), (4, None, None, "d", "{broken", None, "x"),
        (7, None, None, None, None, None, "x"),
    ]
    df = spark.createDataFrame(rows, COLS)
    g = duplicate_groups(df)
    assert {tuple(r) for r in g.collect()} == {(k, 1) for k in (1, 2, 3, 4)}
    v = votes(df, g, F.lit(1.0), F.col("at"))
    assert [(r.group_id, r.value, r.id) for r in winners(decayed_votes(v, 365.0)).collect()] == [(1, "new  name", 2)]
    assert [r.id for r in winners(strict_votes(v)).collect()] == [2]
    assert duplicate_groups(df.limit(0)).count() == 0


def test_strict_order_is_a_sum_of_votes(spark):
    """Untrusted crowds, older crowds and later ids lose; the scores are sums over rows of a value."""
    v = "group_id long, field_name string, value string, norm string, id long, trust double, at long"
    rows = [(1, "f", "crowd", "crowd", k, 0.25, 100) for k in range(1, 400)] + [(1, "f", "one", "one", 900, 1.0, 5)]
    rows += [(2, "f", "old", "old", k, 1.0, 10) for k in range(1, 400)] + [(2, "f", "new", "new", 900, 1.0, 11)]
    rows += [(3, "f", "late", "late", k, 1.0, 10) for k in range(8, 400)] + [(3, "f", "first", "first", 7, 1.0, 10)]
    rows += [(4, "f", "a", "a", 5, 0.25, None), (4, "f", "b", "b", 6, 0.25, None)]
    rows += [(5, "f", "a", "a", 3, 1.0, 7), (5, "f", "A", "a", 2, 1.0, 7)]
    df = spark.createDataFrame(rows, v)
    got = {r.group_id: (r.value, r.id) for r in winners(strict_votes(df)).collect()}
    assert got == {1: ("one", 900), 2: ("new", 900), 3: ("first", 7), 4: ("a", 5), 5: ("A", 2)}
    scores = {(r.group_id, r.norm): r.score for r in strict_votes(df).collect()}
    single = {(r.group_id, r.norm): r.score for r in strict_votes(df.filter("id <> 3 or group_id <> 5")).collect()}
    assert scores[5, "a"]["sum"] > single[5, "a"]["sum"]
    decayed = {r.group_id: r.value for r in winners(decayed_votes(df, 180.0)).collect()}
    assert decayed[1] == "crowd" and decayed[2] == "old" and decayed[3] == "late"
