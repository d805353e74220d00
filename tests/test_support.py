import random

from pyspark.sql import functions as F

from strataform.operators import history, subjects, support

OBS = "subject_id string, predicate string, observation_id string, evidence_id string, source_id string, session_id string, status string, at_us long"
FACT = "id string, subject_id string, predicate string, status string, value_json string, at_us long, rank long"


def rows(seed=1, n=400):
    rng = random.Random(seed)
    facts = [(f"f{k}", rng.choice("ab"), rng.choice("pq"), rng.choice(["confirmed", "not_observed"]), "1", rng.choice([None, *range(50)]), k) for k in range(n)]
    obs = [(rng.choice("abc"), rng.choice("pq"), f"o{k}", f"e{k // 2}", rng.choice("xy"), rng.choice([None, "s"]), rng.choice(["usable", "blocked"]), rng.randint(-3, 60)) for k in range(n)]
    return facts, obs


def brute(facts, obs):
    out = set()
    for s, p, o, *_, at in obs:
        held = [(t, r, i) for i, fs, fp, _, _, t, r in facts if (fs, fp) == (s, p) and t is not None and t <= at]
        if held:
            out.add((o, max(held)[2]))
    return out


def test_edges_hold_what_stood_at_the_instant(spark):
    facts, obs = rows()
    f, o = spark.createDataFrame(facts, FACT), spark.createDataFrame(obs, OBS)
    for hot in (1_000_000, 20):
        got = [(r.observation_id, r.fact_id) for r in support.edges(o, f, hot_rows=hot, chunk_rows=10).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(facts, obs)
    assert support.edges(o.limit(0), f).count() == 0 and support.edges(o, f.limit(0)).count() == 0


def test_carried_over_chunks_without_values(spark):
    d = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("_at"), F.when(F.col("id").isin(3, 150), F.col("id")).alias("v"))
    want = [None] * 3 + [3] * 147 + [150] * 50
    for hot in (1_000_000, 10):
        got = history.carried(d, ["k"], ["_at"], "v", "last", hot, 20).orderBy("_at").collect()
        assert [r["last"] for r in got] == want


def test_facts_without_edges_have_zeros(spark):
    f = spark.createDataFrame([("f1", "a", "p", "confirmed", "1", 5, 1), ("f2", "z", "p", "not_observed", None, 5, 1)], FACT)
    o = spark.createDataFrame([("a", "p", "o1", "e1", "x", "s", "usable", 9), ("a", "p", "o2", "e2", "x", "s", "blocked", 9)], OBS)
    e = support.edges(o, f)
    got = {r.id: (r.observations, r.usable, r.searched, r.sources) for r in support.per_fact(f, e).collect()}
    assert got == {"f1": (2, 1, 1, 1), "f2": (0, 0, 0, 0)}
    p = support.per_fact(f.withColumn("verified_us", F.lit(1)).withColumn("reconciled_us", F.lit(None).cast("long")), e).select("id", support.codes().alias("c"))
    assert {r.id: r.c for r in p.collect()} == {"f1": "confirmed_by_one_source,unusable_evidence,verified_before_start,supported_after_verification", "f2": "no_observation,absence_without_search,verified_before_start"}


B = "id long, place_id string, cid string, data_id string, first_seen_at long"


def test_merges_and_upserts(spark):
    b = spark.createDataFrame([(1, "p", None, None, 9), (2, "p", "c", None, 3), (3, None, "c", "d", 3), (4, "q", "n/a", None, 1), (5, None, "n/a", None, None), (6, "r", "z", None, 1), (7, "s", "z", None, 2)], B)
    g = subjects.groups(b)
    assert {tuple(r) for r in g.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 6)}
    t = subjects.canonical_targets(b, g, F.col("first_seen_at"))
    assert {(r.root, r.target) for r in t.collect()} == {(1, 2), (4, 4), (5, 5), (6, 6)}
    m = subjects.merges(g, t, spark.createDataFrame([(6,), (7,), (2,)], "id long"))
    assert {tuple(r) for r in m.collect()} == {(1, 1, 2, "redirected"), (1, 3, 2, "redirected"), (6, 7, 6, "refused")}
    links = subjects.repointed(spark.createDataFrame([(1, "l1"), (7, "l7")], "business_id long, location_id string"), m)
    assert {tuple(r) for r in links.collect()} == {("l1", 2, 1), ("l7", 7, 7)}
    assert {(r.root, r.outcome) for r in subjects.upserts(b.join(g, "id")).collect()} == {(1, "merged"), (4, "inserted"), (5, "inserted"), (6, "conflict")}


def test_loads_and_comparisons(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (3, None)], "id long, v string")
    assert {tuple(r) for r in subjects.load_outcomes(new, held, "id", ["id", "v"]).collect()} == {("repeated", 1), ("collision", 1), ("inserted", 1)}
    assert {tuple(r) for r in subjects.compared(held, new, "id", ["v"]).collect()} == {("unchanged", 1), ("changed", 1), ("added", 1)}
    assert subjects.load_outcomes(new.limit(0), held, "id", ["v"]).count() == 0
