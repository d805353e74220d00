import random

import pytest

from strataform.llm.addresses import alignment_cost, buildings, candidate_pairs, city_spellings, parse, parsed, same_building, with_city
from strataform.session import materialize

COLS = "id long, address string, city string"


@pytest.mark.parametrize(
    "text,number,street",
    [
        ("226B Plouklin Drive, Drurenin, Selimouth 100018", "226b", "plouklin t:drive"),
        ("Calehaven - Lobram Avenue #66 - Unit 16 - 100712", "66", "lobram t:avenue"),
        ("100111 TAMUMINSTER, VEZILETH SQUARE, 100, 3RD FLOOR", "100", "vezileth t:square"),
        ("Twelfth Str. 127 - Kealioklouv - Selimouth", "127", "#12 t:street"),
        ("119 5th Av.\nTeapahiork\nUlelidale 100215", "119", "#5 t:avenue"),
        ("no 111B S. Hilipealm St, Tamuminster 100115", "111b", "d:south hilipealm t:street"),
        ("106 E BEHIOTH STR., TAMUMINSTER 100116", "106", "d:east behioth t:street"),
        ("Geavrioklolm Nr. 105B, 100018 Selimouth", "105b", "geavrioklolm"),
        ("Selimouth, Gaibrith Rd, 179, Kealioklouv", "179", "gaibrith t:road"),
        ("Apt. 20 - no 145 Stögraivat Drive - Tamuminster 100 117", "145", "stograivat t:drive"),
    ],
)
def test_parts(text, number, street):
    assert parse(text)[:2] == (number, street)


def test_costs():
    same = [("bregrur t:square", "breggrur t:square"), ("brabrat", "brbrat t:boulevard"), ("#5 t:avenue", "#5 t:avenue")]
    differ = [("brabrat t:avenue", "brabrat t:boulevard"), ("d:south behioth t:street", "d:east behioth t:street"), ("#5 t:avenue", "#6 t:avenue"), ("klamirk t:road", "dekisin t:road")]
    assert all(alignment_cost(a.split(), b.split()) <= 0.58 for a, b in same)
    assert all(alignment_cost(a.split(), b.split()) > 0.58 for a, b in differ)


def test_pairs(spark):
    base = [(k, f"{k} Plain Road, Oldtown, Riverton 10000{k % 3 + 1}", "x") for k in range(100, 130)]
    rows = base + [
        (1, "12 Mill Lane, Oldtown, Riverton 100001", "x"), (2, "MILL LN NO. 12, RIVERTON", "x"), (3, "100001 Riverton; Milll Lane, 12; Apt. 4", "x"),
        (4, "12A Mill Lane, Riverton 100001", "x"), (5, "12 Mill Court, Riverton 100001", "x"), (6, "13 Mill Lane, Riverton", "x"),
        (7, None, "x"), (8, "n/a", "x"), (9, "", "x"), (10, "somewhere", "x"), (1, "12 Mill Lane, Oldtown, Riverton 100001", "x"), (11, "12 Mill Lane" + ", x" * 30_000, "x"),
    ]
    got = {tuple(r) for r in same_building(spark.createDataFrame(rows, COLS), block_rows=1).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    assert same_building(spark.createDataFrame([], COLS)).count() == 0


def test_hot_building(spark):
    rows = [(k, "7 Mill Lane, Riverton 100001" if k % 2 else "7 Mill Ln, Riverton", "x") for k in range(60)]
    assert same_building(spark.createDataFrame(rows, COLS), block_rows=7).count() == 60 * 59 // 2


@pytest.mark.parametrize(
    "text,want",
    [
        ("10 Downing Street, London SW1A 2AA", ("10", "downing t:street", "sw1a2aa", "london")),
        ("12345 Main Street, Reno 89501", ("12345", "main t:street", "89501", "reno")),
        ("7 Main St, Reno 89501-1234", ("7", "main t:street", "89501", "reno")),
        ("10115 Berlin, Invalidenstr 5", ("5", "invalidenstr", "10115", "berlin")),
    ],
)
def test_other_postcodes(text, want):
    assert parse(text)[:4] == want


def test_misspelt_city_and_buildings(spark):
    base = [(k, f"{k} Plain Road, Riverton 10000{k % 3 + 1}", "x") for k in range(100, 180)]
    rows = base + [(1, "12 Mill Lane, Riverton 100001", "x"), (2, "12 Mill Ln, Rivreton", "x"), (3, "12 Mill Lane, Rivertonn", "x"), (4, "12 Mill Lane, Otherplace", "x"), (5, "12 Mil Lane, Riverton 100001", "x")]
    df = spark.createDataFrame(rows, COLS)
    assert {tuple(r) for r in same_building(df).collect()} == {(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)}
    got = {r.id: (r.building_id, r.spellings) for r in buildings(df).collect()}
    assert {got[k][0] for k in (1, 2, 3, 5)} == {1} and 4 not in got and got[100] == (100, 1)
    assert buildings(df.limit(0)).count() == 0


def test_recall_of_bands_and_a_city_of_ten_thousand_streets(spark):
    """One number, one city, ten thousand streets: spellings with typing errors meet, and few others do."""
    rng = random.Random(8)
    letters = "abcdefghiklmnoprstuvw"
    streets = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(10_000)]

    def typo(w):
        k = rng.randrange(1, len(w) - 1)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])

    pairs = [(s, typo(s)) for s in streets[:1000]]
    rows = [(k, s + " t:road") for k, s in enumerate(streets)] + [(20_000 + k, b + " t:road") for k, (_, b) in enumerate(pairs)]
    df = spark.createDataFrame([(c, "city", "7", s, None) for c, s in rows], "cls long, city string, number string, street string, zone string")
    got = {(r.a, r.b) for r in candidate_pairs(df, 72).select("a", "b").collect()}
    want = {(k, 20_000 + k) for k, (a, b) in enumerate(pairs) if a != b}
    assert want <= got  # one typing error each
    assert len(got) < 0.05 * len(rows) ** 2 / 2  # one value a band made half of all pairs candidates


def test_no_table_that_grows_is_broadcast(spark):
    """However small the files are said to be: buckets, places and classes are many more rows than their size tells."""
    df = spark.createDataFrame([(k, f"{k % 90} Mill Lane, Oldtown, Riverton 100001", "x") for k in range(200)], COLS)
    p = materialize(parsed(df), "read")
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (city_spellings(p), with_city(p), same_building(df), buildings(df))]
    assert all("SortMergeJoin" in x and "Broadcast" not in x for x in plans)
