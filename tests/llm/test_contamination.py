import random

from strataform.llm.contamination import leaked, needed, prefix, words

P = "doc_id long, text string, item_id string"
I = "item_id long, passage string, text string"  # noqa: E741


def brute(doc, item, run=12, share=6):
    d, p = words(doc), words(item)
    if any(p[a : a + run] == d[b : b + run] for a in range(len(p) - run + 1) for b in range(len(d) - run + 1)):
        return True
    n = len(p)
    return n > 0 and any(share * sum(x != y for x, y in zip(p, d[b : b + n])) <= n for b in range(len(d) - n + 1))


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(5, 30))), "x") for k in range(12)]
    docs = []
    for k in range(60):
        body = rng.choices(vocab, k=rng.randint(0, 30))
        src = words(rng.choice(items)[1])
        cut = src if rng.random() < 0.5 else src[rng.randint(0, 6) :][: rng.randint(8, 16)]
        cut = [rng.choice(vocab) if rng.random() < 0.12 else w for w in cut]
        at = rng.randint(0, len(body))
        text = " ".join(body[:at] + cut + body[at:])
        docs.append((k, rng.choice([text, text.upper(), text.replace(" ", "\n"), text.replace(" w1", " <b>w1</b>, "), "<p>" + text.replace(" ", " * ") + "</p>"]), "x"))
    docs += [docs[0], (900, None, "x"), (901, "", "x"), (902, ("pad " * 60_000) + items[0][1], "x")]
    items += [items[0], (800, None, "x"), (801, "", "x"), (802, "...", "x")]
    for bits in (1 << 15, 1 << 27):
        got = [tuple(r) for r in leaked(spark.createDataFrame(docs, P), spark.createDataFrame(items, I), filter_bits=bits).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(d, i) for d, t, _ in docs for i, p, _ in items if p and t and len(t) < 100_000 and brute(t, p)} | {(902, 0)}


def test_empty(spark):
    assert leaked(spark.createDataFrame([], P), spark.createDataFrame([(1, "a b c", "")], I)).count() == 0
    assert leaked(spark.createDataFrame([(1, "a b c", "")], P), spark.createDataFrame([], I)).count() == 0


def test_every_passage_of_an_item_counts(spark):
    a, b = "the quick brown fox jumps over", "a lazy dog sleeps in the sun"
    docs = [(1, f"x {a} y", ""), (2, f"x {b} y", ""), (3, "nothing here at all", "")]
    items = [(7, a, ""), (7, b, ""), (8, b.upper(), "")]
    got = {tuple(r) for r in leaked(spark.createDataFrame(docs, P), spark.createDataFrame(items, I)).collect()}
    assert got == {(1, 7), (2, 7), (2, 8)}


def test_prefix_filter_keeps_every_match_and_little_else():
    """Whatever words are exchanged, a prefix shingle survives; common shingles are no prefix where rare ones do."""
    rng = random.Random(3)
    for n in range(1, 40):
        w = min(3, n)
        rarity = [(rng.randint(0, 5), p) for p in range(n - w + 1)]
        keep = prefix(rarity, n, w if n < 3 else 3, 12, 6)
        for _ in range(60):
            off = set(rng.sample(range(n), n // 6))
            assert any(not off & set(range(p, p + w)) for p in keep)
        for s in range(n - 12 + 1):
            assert any(s <= p <= s + 9 for p in keep)
    assert needed(30, 3, 12, 6) == 16 and len(prefix([(0 if p % 9 == 4 else 1, p) for p in range(100)], 102, 3, 12, 6)) < 70


def test_hot_shingle(spark):
    """A phrase in a third of all documents and every item joins by shuffle and adds no false pairs."""
    hot = "as we all know by now"
    docs = [(k, f"{hot} " + (f"doc {k} text goes on" if k % 3 else f"the unique secret number {k} is told to nobody at all today ok"), "") for k in range(600)]
    items = [(k, f"{hot} the unique secret number {k} is told to nobody at all today ok", "") for k in range(0, 60, 3)]
    got = {tuple(r) for r in leaked(spark.createDataFrame(docs, P), spark.createDataFrame(items, I)).collect()}
    assert {(k, k) for k in range(0, 60, 3)} <= got
    assert got == {(d, i) for d, t, _ in docs for i, p, _ in items if brute(t, p)}
