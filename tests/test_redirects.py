import os
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataform.plans.registry import queries

IDS = ("place_id", "cid", "data_id")
BLANK = {"", "-", "--", "---", ".", "?", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "undefined", "not available", "tbd", "0", "0x0", "0x0:0x0", "-1"}


@pytest.fixture(scope="module")
def linked(data, tmp_path_factory):
    """The tables, where one listing shares its place_id with one root and its cid with another, and a group has two data_ids."""
    out = str(tmp_path_factory.mktemp("linked"))
    for f in os.listdir(data):
        os.symlink(f"{data}/{f}", f"{out}/{f}")
    t = pq.read_table(f"{data}/businesses.parquet")
    rows = t.to_pylist()
    top = max(r["id"] for r in rows)
    for k, (place, cid, other) in enumerate([("pA", None, "dA"), (None, "cB", "dB"), ("pA", "cB", None)]):
        rows.append({**rows[0], "id": top + 1 + k, "place_id": place, "cid": cid, "data_id": other, "review_count": k + 1})
    os.remove(f"{out}/businesses.parquet")
    pq.write_table(pa.Table.from_pylist(rows, t.schema), f"{out}/businesses.parquet")
    link = pq.read_table(f"{data}/maps_business_location_links.parquet")
    more = [{**link.slice(0, 1).to_pylist()[0], "business_id": top + k, "location_id": f"linked_{k}"} for k in (1, 2, 3)]
    os.remove(f"{out}/maps_business_location_links.parquet")
    pq.write_table(pa.Table.from_pylist(link.to_pylist() + more, link.schema), f"{out}/maps_business_location_links.parquet")
    parent = {r["id"]: r["id"] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first: dict = {}
    for r in rows:
        for c in IDS:
            v = (r[c] or "").strip()
            if v.lower() not in BLANK:
                a, b = find(first.setdefault((c, v), r["id"])), find(r["id"])
                parent[max(a, b)] = min(a, b)
    return out, rows, {r["id"]: find(r["id"]) for r in rows}, top + 1


def test_whole_groups(spark, linked):
    """Links through other listings count, in every query over redirects."""
    d, rows, root, a = linked
    q = queries()
    members = Counter(root.values())
    assert members[a] == 3
    assert {r.root: r.members for r in q["redirect_closure"](spark, d).collect()} == members
    want = {i: "sole" if members[g] == 1 else "current" if i == g else "merged_alias" for i, g in root.items()}
    assert {r.id: r.relation for r in q["alias_status"](spark, d).collect()} == want
    assert {r.root: r.locations for r in q["duplicate_locations"](spark, d).collect()}[a] == 3
    outcomes = {r.root: r.outcome for r in q["reconcile_groups"](spark, d).collect()}
    assert outcomes[a] == "mixed" and a + 1 not in outcomes


def test_conflicts_of_every_id(spark, linked):
    d, rows, root, a = linked
    values: dict = {}
    for r in rows:
        for c in (*IDS, "phone", "website"):
            if r[c] and r[c].strip():
                values.setdefault((root[r["id"]], c), set()).add(r[c].strip())
    got = {(r.group_id, r.field): r.n for r in queries()["identity_conflicts"](spark, d).collect()}
    assert got[a, "data_id"] == 2
    assert got == {k: len(v) for k, v in values.items() if len(v) > 1}
