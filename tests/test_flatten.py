import json
from collections import Counter

from strataform.operators.flatten import KEYS, array_paths, child_table, flat_table, nested_objects
from strataform.plans.problems import P4_TABLES, QUERIES, p4_found, p4_images, p4_reviews


def walk(v, gen, path, near, arrays, out):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return
        if isinstance(w, (dict, list)):
            walk(w, gen, path, near, arrays, out)
    elif isinstance(v, dict):
        for k, x in v.items():
            walk(x, gen + "." + k, f"{path}.{k}".strip("."), near, arrays, out)
    elif isinstance(v, list):
        arrays.add(gen)
        for i, x in enumerate(v):
            here = f"{path}[{i}]"
            y = json.loads(x) if isinstance(x, str) and x[:1] == "{" else x
            if isinstance(y, dict):
                out.add((near, here))
                walk(y, gen, here, here, arrays, out)


def lone(v, gen, arrays):
    """Wraps lone objects that stand where others hold arrays, JSON text first read."""
    if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
        try:
            v = json.loads(v)
        except ValueError:
            return v
    if isinstance(v, dict):
        v = {k: lone(x, gen + "." + k, arrays) for k, x in v.items()}
        return [v] if gen in arrays else v
    if isinstance(v, list):
        return [w[0] if isinstance(w := lone(x, gen, arrays), list) and len(w) == 1 and isinstance(w[0], dict) else w for x in v]
    return v


def test_whole_table(spark, data):
    recs, arrays = [], set()
    for r in spark.read.parquet(f"{data}/businesses.parquet").select("id", "raw_json").collect():
        try:
            recs.append((r.id, json.loads(r.raw_json)))
        except ValueError:
            continue
        walk(recs[-1][1], "", "", "", arrays, set())
    want = set()
    for i, v in recs:
        out = set()
        walk(lone(v, "", arrays), "", "", "", set(), out)
        want |= {(i, *x) for x in out}
    got = [tuple(r) for r in p4_found(spark, data).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_shapes(spark):
    rows = [
        (1, '{"a":[{"b":[{"c":1},null,{"c":2}]},null,"{\\"c\\":3}"],"o":{"x":[{"k":1}]}}', "clash"),
        (2, '{"a":{"b":{"c":9}}}', None),
        (3, '{"a":[', None),
        (4, None, None),
        (5, "", None),
        (6, '{"a":[],"m":[[{"z":1}],[]]}', None),
        (7, '"{\\"a\\":[{\\"b\\":[]}]}"', None),
        (8, "[" * 50_000, None),
        (9, json.dumps({"a": [{"b": None, "t": "x" * 200_000}]}), None),
    ]
    df = spark.createDataFrame(rows, "id long, raw string, path string")
    got = {(r.id, r.parent_path, r.path) for r in nested_objects(df, "id", "raw").collect()}
    assert got == {
        (1, "", "a[0]"), (1, "a[0]", "a[0].b[0]"), (1, "a[0]", "a[0].b[2]"), (1, "", "a[2]"), (1, "", "o.x[0]"),
        (2, "", "a[0]"), (2, "a[0]", "a[0].b[0]"), (6, "", "m[0][0]"), (7, "", "a[0]"), (9, "", "a[0]"),
    }
    assert ("a", "b") in array_paths(df, "raw")
    t = child_table(nested_objects(df, "id", "raw"), "a.b", "c int").orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.c) for r in t] == [(1, 0, 1), (1, 2, 2), (2, 0, 9)] and all(r.parent_key for r in t)
    assert nested_objects(df.limit(0), "id", "raw").count() == 0


def test_children_find_their_parents(spark, data):
    r, i = p4_reviews(spark, data), p4_images(spark, data)
    assert r.count() == r.select("row_key").distinct().count() > 0
    assert i.count() > 0 and i.join(r, i["parent_key"] == r["row_key"], "left_anti").count() == 0


def leaves(v, at=()):
    """Every scalar of a record that is not null, with its path; JSON text read."""
    if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
        try:
            v = json.loads(v)
        except ValueError:
            pass
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, (*at, k))
    elif isinstance(v, list):
        for x in v:
            yield from leaves(x, at)
    elif v is not None:
        yield ".".join(at), str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_no_scalar_is_lost(spark, data):
    """Each scalar of each record is in a registered table, once."""
    want, got = Counter(), Counter()
    for r in spark.read.parquet(f"{data}/businesses.parquet").select("id", "raw_json").collect():
        try:
            want.update((r.id, *x) for x in leaves(json.loads(r.raw_json)))
        except ValueError:
            continue
    tables = {name: QUERIES[name](spark, data) for name in P4_TABLES}
    for name, t in tables.items():
        for r in t.collect():
            for c, v in list(zip(t.columns, r))[len(KEYS) :]:
                path = ".".join(x for x in (P4_TABLES[name], "" if c == "value" else c.removesuffix("_")) if x)
                got.update((r.id, *x) for x in leaves(v, (path,)))
    assert got == want
    assert {"owner_response.text", "Name", "When"} <= set(tables["p4_reviews"].columns)
    rows = QUERIES["p4_rows"](spark, data)
    assert {r[0] for r in rows.select("table").distinct().collect()} <= set(P4_TABLES.values())
    assert rows.count() == sum(t.count() for t in tables.values())
    assert rows.filter("table != ''").join(rows.select(rows["row_key"].alias("parent_key")).distinct(), "parent_key", "left_anti").count() == 0


def test_flat_shapes(spark):
    rows = [
        (1, '{"id":7,"o":{"p":{"q":true}},"s":["x",null,"y"],"n":[[1,2],[3]],"a":[{"b":1,"B":"z"},5],"w":1}'),
        (2, '{"s":"lone","a":{"b":2.5},"w":"t","o":"flat"}'),
        (3, '[{"id":8},{"id":9}]'),
        (4, "[1"),
        (5, "null"),
    ]
    df = spark.createDataFrame(rows, "id long, raw string")
    held = lambda t, *c: sorted((tuple(r[k] for k in ("id", "path", *c)) for r in flat_table(df, "id", "raw", t).collect()), key=str)
    assert held("", "id_", "o.p.q", "o", "w") == [(1, "", 7, True, None, "1"), (2, "", None, None, "flat", "t"), (3, "[0]", 8, None, None, None), (3, "[1]", 9, None, None, None)]
    assert held("s", "ordinal", "value") == [(1, "s[0]", 0, "x"), (1, "s[2]", 2, "y"), (2, "s[0]", 0, "lone")]
    assert held("n.[]", "value") == [(1, "n[0][0]", 1), (1, "n[0][1]", 2), (1, "n[1][0]", 3)]
    assert held("a", "B", "b_", "value") == [(1, "a[0]", "z", 1.0, None), (1, "a[1]", None, None, 5), (2, "a[0]", None, 2.5, None)]
