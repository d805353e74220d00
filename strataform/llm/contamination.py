"""Evaluation passages that occur in training text.

Method. A prefix-filtered set join over shingles of ``size`` words. The shingles of the passages are ordered by rarity,
as counted over all documents. For whole passages of n words of which n // ``share`` may be exchanged, every exchanged
word breaks at most ``size`` shingles, so a match keeps one of the size * (n // share) + 1 rarest; an excerpt of ``run``
words keeps the rarest shingle of its window. These prefix shingles, and the documents' equal ones, are joined on the
shingle. Where they stand fixes where the passage would start in the document (positional bound); places that leave
neither room for the whole passage nor for a run are dropped (length bound). Documents with places left are read again
and verified exactly over windows as long as the passage.

Why three words and not five: with one word in six exchanged evenly, no shingle of five or more words need survive in a
passage of six to twenty-three words; one of three always does.

Scale. Documents are read twice, whatever the number of passages: for the counts and for the places; texts with places
are read a third time. What does not occur in passages is dropped where it is read, by a filter of at most ``filter_bits``
bits (16 MB); what passes by chance is dropped in the joins. Neither words nor shingles of documents are gathered. Equal
passages are one class however many items have them, and classes and places meet in shuffled joins.

Defined results: texts are compared without case, punctuation, markup and spacing (ß counts as ss); null or empty texts
match nothing; passages shorter than ``run`` words match only as a whole; of several passages of one item each counts;
rows whose id is null are left out; repeated documents and items give their rows once; a passage that differs by inserted
or missing words is found through its excerpts only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import materialize

_TAG = re.compile(r"<[^<>]{0,2000}>")
_DROP = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")
#: Bits of one bitmap of the built-in bitmap functions.
_PAGE = 32_768


def words(text: str | None) -> list[str]:
    """Comparable words: without markup, case and punctuation."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _DROP.sub("", text)
    return _WORD.findall(text.casefold())


class _Known(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Hasher:
    """Hashes of shingles; those of words are remembered for a while, as words recur."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self):
        self.known = _Known()

    def of(self, ws: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))

    def shingles(self, h: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, as signed numbers."""
        n = len(h) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = (out ^ h[k : k + n]) * self._MIX
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


class Filter:
    """A set of hashes as bits; it may take a strange hash for a known one, never the other way round."""

    def __init__(self, bits: int, pages: dict[int, bytes]):
        self.bits = bits
        self.map = np.zeros(max(bits, _PAGE) // 8, np.uint8)
        for page, held in pages.items():
            self.map[page * (_PAGE // 8) : page * (_PAGE // 8) + len(held)] = np.frombuffer(held, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h & np.int64(self.bits - 1)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def filter_of(df: DataFrame, column: str, most_bits: int) -> Filter:
    """The filter of a column of hashes: 16 bits a row, up to ``most_bits``; the driver gets no more than these bits."""
    rows = df.count()
    bits = _PAGE
    while bits < most_bits and bits < 16 * rows:
        bits *= 2
    at = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long"))
    # bitmap functions count positions and pages from 1
    pages = df.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("held"))
    return Filter(bits, {r.page - 1: bytes(r.held) for r in pages.collect()})


def needed(n: int, size: int, run: int, share: int) -> int:
    """How many of a whole passage's rarest shingles hold one that every match keeps."""
    return min(n - size + 1, size * (n // share) + 1) if n >= size else 1


def prefix(rarity: list[tuple], n: int, size: int, run: int, share: int) -> list[int]:
    """Positions of the shingles of a passage of ``n`` words of which every match keeps at least one.

    ``rarity`` holds a sortable rarity per shingle. The rarest of each window of ``run`` words serve excerpts.
    """
    order = sorted(range(len(rarity)), key=lambda p: (rarity[p], p))
    rank = {p: k for k, p in enumerate(order)}
    keep = set(order[: needed(n, size, run, share)])
    for s in range(n - run + 1):
        keep.add(min(range(s, s + run - size + 1), key=rank.__getitem__))
    return sorted(keep)


def holds(item: list[str], text: list[str], o: int, run: int, share: int) -> bool:
    """Whether the passage laid at offset ``o`` of the text matches as a whole or in a run of words."""
    n = len(item)
    lo, hi = max(0, -o), min(n, len(text) - o)
    whole = o >= 0 and o + n <= len(text)
    if hi - lo < run and not whole:
        return False
    off = now = best = 0
    for p in range(lo, hi):
        if item[p] == text[o + p]:
            now += 1
            best = max(best, now)
        else:
            now = 0
            off += 1
    return best >= run or whole and n > 0 and off * share <= n


def passages(items: DataFrame, item_id: str, passage: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members): classes (cls, words) of equal passages, members (cls, item_id)."""
    kind = items.schema[item_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ws, pa.list_(pa.string()))], ["item_id", "words"])

    stated = items.select(F.col(item_id).alias("i"), F.col(passage).alias("p")).filter("p is not null and i is not null").distinct()
    read = stated.mapInArrow(scan, f"item_id {kind}, words array<string>").filter("size(words) > 0")
    read = materialize(read.select("item_id", "words", F.sha2(F.array_join("words", " "), 256).alias("cls")), "passages")
    return read.groupBy("cls").agg(F.first("words").alias("words")), read.select("cls", "item_id").distinct()


def _class_shingles(classes: DataFrame, size: int) -> DataFrame:
    """(cls, n, w, p, h): shingles of each class with their positions; w words each, fewer in shorter passages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out: list[tuple] = []
            for cls, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = min(size, len(ws))
                out += [(cls, len(ws), w, p, h) for p, h in enumerate(hasher.shingles(hasher.of(ws), w).tolist())]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cls", "n", "w", "p", "h"])

    return classes.select("cls", "words").mapInArrow(scan, "cls string, n int, w int, p int, h long")


def _document_counts(docs: DataFrame, sizes: list[int], known: Filter) -> DataFrame:
    """(h, df): in how many documents each shingle that passes the filter occurs; added up per task first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["h", "df"])
            seen.clear()
            return rows

        for batch in batches:
            for t in batch.column(1).to_pylist():
                hs = hasher.of(words(t))
                for w in sizes:
                    s = hasher.shingles(hs, w)
                    seen.update(set(s[known.holds(s)].tolist()))
            if len(seen) > 500_000:
                yield out()
        yield out()

    return docs.mapInArrow(scan, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def _prefixes(shingled: DataFrame, counts: DataFrame, size: int, run: int, share: int) -> DataFrame:
    """(h, cls, n, p): the prefix shingles of every class. A class's shingles are as many as its passage has words."""

    def pick(pdf):
        pdf = pdf.sort_values("p", kind="stable")
        n, w = int(pdf["n"].iloc[0]), int(pdf["w"].iloc[0])
        keep = prefix(list(zip(pdf["df"].tolist(), pdf["h"].tolist())), n, w, run, share)
        return pdf.iloc[keep][["h", "cls", "n", "p"]]

    d = shingled.join(counts, "h", "left").select("cls", "n", "w", "p", "h", F.coalesce("df", F.lit(0)).alias("df"))
    return d.groupBy("cls").applyInPandas(pick, "h long, cls string, n int, p int")


def _places(docs: DataFrame, kind: str, sizes: list[int], known: Filter) -> DataFrame:
    """(h, doc_id, q, m): where documents hold shingles that pass the filter; m is the document's length in words."""
    names = ["h", "doc_id", "q", "m"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            row, h, q, m = [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                hs = hasher.of(words(t))
                for w in sizes:
                    s = hasher.shingles(hs, w)
                    at = np.flatnonzero(known.holds(s))
                    if len(at):
                        row.append(np.full(len(at), k))
                        h.append(s[at])
                        q.append(at)
                        m.append(np.full(len(at), len(hs)))
            flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(h), pa.int64()), batch.column(0).take(pa.array(flat(row).astype(np.int64))), pa.array(flat(q), pa.int32()), pa.array(flat(m), pa.int32())], names)

    return docs.mapInArrow(scan, f"h long, doc_id {kind}, q int, m int")


def candidates(places: DataFrame, prefixes: DataFrame, run: int) -> DataFrame:
    """(doc_id, cls, o): where a passage may start in a document, by one shared prefix shingle; ``o`` may be negative."""
    j = places.join(prefixes, "h").select("doc_id", "cls", (F.col("q") - F.col("p")).alias("o"), "n", "m")
    shared = F.least("n", F.col("m") - F.col("o")) - F.greatest(F.lit(0), -F.col("o"))
    whole = (F.col("o") >= 0) & (F.col("o") + F.col("n") <= F.col("m"))
    return j.filter(whole | (shared >= run)).select("doc_id", "cls", "o").distinct()


def _verified(docs: DataFrame, cands: DataFrame, classes: DataFrame, kind: str, run: int, share: int, bits: int) -> DataFrame:
    """(doc_id, cls) of candidates that match. Only texts that pass a filter of the candidates' ids are read and sent."""
    known = filter_of(cands.select("doc_id").distinct().select(F.xxhash64("doc_id").alias("h")), "h", bits)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(known.holds(np.asarray(batch.column(2))), pa.bool_())
            doc, text, _ = [c.filter(keep) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([doc, pa.array([words(t) for t in text.to_pylist()], pa.list_(pa.string()))], ["doc_id", "text"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws, os, ts = (batch.column(k).to_pylist() for k in (2, 3, 4))
            keep = pa.array([any(holds(w, t, o, run, share) for o in at) for w, at, t in zip(ws, os, ts)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["doc_id", "cls"])

    read = docs.select("d", "t", F.xxhash64("d").alias("x")).mapInArrow(likely, f"doc_id {kind}, text array<string>")
    # windows of a long text are as long as the passage: only they travel on
    o = F.col("o")
    c = cands.join(classes.select("cls", F.size("words").alias("n")), "cls")
    cut = read.join(c, "doc_id").select("doc_id", "cls", F.greatest(o, F.lit(0)).alias("from"), "n", "o", "text")
    cut = cut.select("doc_id", "cls", (o - F.col("from")).alias("o"), F.slice("text", F.col("from") + 1, F.col("n") + o - F.col("from")).alias("text"))
    cut = cut.join(classes, "cls").select("doc_id", "cls", "words", F.array("o").alias("os"), "text")
    return cut.mapInArrow(scan, f"doc_id {kind}, cls string").distinct()


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run: int = 12, share: int = 6, size: int = 3, filter_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item's passage, whole or in an excerpt of ``run`` words."""
    kind = docs.schema[doc_id].dataType.simpleString()
    classes, members = passages(items, item_id, passage, size)
    classes = materialize(classes, "passage_classes")
    shingled = materialize(_class_shingles(classes, size), "passage_shingles")
    sizes = sorted(r.w for r in shingled.select("w").distinct().collect())
    d = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null")
    counts = _document_counts(d, sizes, filter_of(shingled, "h", filter_bits))
    pre = materialize(_prefixes(shingled, counts, size, run, share), "prefixes")
    places = _places(d, kind, sizes, filter_of(pre, "h", filter_bits))
    cands = materialize(candidates(places, pre, run), "candidates")
    return _verified(d, cands, classes, kind, run, share, filter_bits).join(members, "cls").select("doc_id", "item_id").distinct()
