import hashlib

import pytest

from strataform.llm import encoding_repair as R


@pytest.fixture(scope="module")
def model(spark):
    return R.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_round_trip_of_every_chain(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 200 and 1500").select("text").collect()
    clean = [r.text for r in rows if not r.text.isascii() and R.repair(r.text, model)[0] == "clean"]
    tried = right = 0
    for chain in R.CHAINS:
        if not chain.startswith("utf8"):
            continue
        for t in clean[:120]:
            bad = R.garble(t, chain)
            if bad and bad != t and "�" not in bad and R.invert(bad, chain) == t:
                tried += 1
                right += R.repair(bad, model)[2] == t
    assert tried > 300 and right / tried > 0.97


def test_one_byte_chains(model):
    for text, chain in [("Der Geschäftsführer hat sofort zurückgerufen, obwohl der Laden voll war.", "cp1252_as_macroman"), ("Le gérant a oublié deux fois notre commande.", "cp1252_as_cp437"), ("Владелец дважды забыл наш заказ. Мастер подробно объяснил весь счёт.", "cp1251_as_cp1252")]:
        assert R.repair(R.garble(text, chain), model)[2] == text


def test_correct_rarities_stay(model):
    for t in ["The hall holds 88 m³ ± 2 and 20 °C.", "SALÃO São João, 28ª sala.", "Schild: „ÄÖÜ 37“ – ©.", "È difficile parcheggiare vicino a Lesketin dopo le 15."]:
        assert R.repair(t, model)[0] == "clean"


def test_edges(spark, model):
    good = "Le propriétaire a été très patient avec nous. " * 2000
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, "caf� noir", "x"), (5, R.garble(good, "utf8_as_cp1252"), "x"), (5, R.garble(good, "utf8_as_cp1252"), "x"), (6, "퟿ ok é", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, state string")
    got = [(r.key, r.state, r.restored_sha256) for r in R.repaired(df, model=model).collect()]
    assert sorted(set(got)) == [(4, "lost", ""), (5, "restored", hashlib.sha256(good.encode()).hexdigest())]
    assert R.repaired(df.limit(0), model=model).count() == 0


def test_words_damaged_among_good_ones(model):
    good = "Le propriétaire a été très patient avec nous, ce que je n'attendais pas après la crème brûlée."
    bad = good.replace("propriétaire", R.garble("propriétaire", "utf8_as_cp1252")).replace("crème", R.garble("crème", "utf8_as_cp1252")).replace("brûlée", R.garble("brûlée", "utf8_as_cp1252"))
    assert R.repair(bad, model)[2] in (good, None)


def test_the_classifier_decides(model):
    """A chain it ranks low is not tried, and what it holds for garbled is no result."""
    text = R.garble("Le propriétaire a été très patient avec nous après la fête.", "utf8_as_cp1252")
    assert R._best(model, text)[0].startswith("utf8_as")
    worse = R.Model(model.log_p.copy(), model.log_prior.copy(), model.seen)
    worse.log_prior[[i for i, c in enumerate(R.LABELS) if c.startswith("utf8_as")]] -= 10_000
    assert R._best(worse, text)[1] == text
    blind = R.Model(model.log_p.copy(), model.log_prior.copy(), model.seen)
    blind.log_prior[0] -= 10_000  # nothing is clean to this one, restored texts neither
    assert R._best(blind, text)[1] in (None, text)


def test_latin1_reading(model):
    good = "Филиал переехал на первый этаж, управляющий извинился за задержку."
    assert R.repair(R.garble(good, "utf8_as_latin1"), model)[2] == good
