"""Text that was decoded with a wrong encoding: find it and restore it.

Method. A multinomial classifier over byte bigrams (the 65 536 pairs of UTF-8 bytes are their own hash) tells, for each
sentence with non-ASCII characters, which chain of encodings garbled it, or that it is clean. It is fitted on clean
sentences of a bounded sample of documents (``fit_docs``, by hash of the id) that are garbled synthetically with every
chain; a second round drops the sample's own garbled sentences. The ``tries`` likeliest chains are inverted, in the
classifier's order; a result counts only if every byte decodes strictly, garbling it again gives the text as found, and
the classifier takes it for clean: no chain leads clean by more than ``slack``, or by more than
a share of the lead that the text as found had, a quarter where strict UTF-8 speaks for the result, else three. A chain the classifier ranks lower is not tried. Sentences are cut at ASCII marks,
which every chain leaves alone. One chain tends to rule a document, so the chains of a document's clear sentences weigh
on its unclear ones. Chains between one-byte encodings decode anything, so there the restored words must also be the more
frequent ones, as counted over all documents.

Defined results: null, empty and pure ASCII texts are clean; a text with U+FFFD, or one whose garbling can't be
inverted, is damaged for good (restored text null); copies of a text get equal results; texts of any length are read
whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import fitted, materialize

#: Chains as (written in, read as); read from left to right they garble a text.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8_as_cp1252": (("utf-8", "cp1252"),),
    "utf8_as_cp1252_twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8_as_cp1252_thrice": (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8_as_latin1": (("utf-8", "latin-1"),),
    "utf8_as_latin1_twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8_as_macroman": (("utf-8", "mac_roman"),),
    "utf8_as_cp437": (("utf-8", "cp437"),),
    "utf8_as_cp850": (("utf-8", "cp850"),),
    "utf8_as_cp1250": (("utf-8", "cp1250"),),
    "utf8_as_cp1251": (("utf-8", "cp1251"),),
    "utf8_as_cp1254": (("utf-8", "cp1254"),),
    "utf8_as_koi8r": (("utf-8", "koi8-r"),),
    "utf8_as_cp866": (("utf-8", "cp866"),),
    "cp1252_as_macroman": (("cp1252", "mac_roman"),),
    "cp1252_as_cp437": (("cp1252", "cp437"),),
    "cp1252_as_cp850": (("cp1252", "cp850"),),
    "cp1252_as_cp1250": (("cp1252", "cp1250"),),
    "cp1252_as_cp1251": (("cp1252", "cp1251"),),
    "macroman_as_cp1252": (("mac_roman", "cp1252"),),
    "cp437_as_cp1252": (("cp437", "cp1252"),),
    "cp850_as_cp1252": (("cp850", "cp1252"),),
    "cp1250_as_cp1252": (("cp1250", "cp1252"),),
    "latin2_as_cp1252": (("iso8859-2", "cp1252"),),
    "cp1251_as_cp1252": (("cp1251", "cp1252"),),
    "koi8r_as_cp1251": (("koi8-r", "cp1251"),),
    "cp1251_as_koi8r": (("cp1251", "koi8-r"),),
    "koi8r_as_cp1252": (("koi8-r", "cp1252"),),
    "cp866_as_cp1251": (("cp866", "cp1251"),),
    "cp1254_as_cp1252": (("cp1254", "cp1252"),),
    "cp1256_as_cp1252": (("cp1256", "cp1252"),),
}
CLEAN = "clean"
LABELS = (CLEAN, *CHAINS)
_CUT = re.compile(r"(?<=[.!?:;])(?=\s)|(?<=\n)")
_C1 = re.compile("[\x80-\x9f]")
#: A character beyond ASCII between ASCII ones: misread UTF-8 has at least two in a row.
_LONE = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")
_LOST = "�"

_TABLES: dict[str, tuple[dict[str, int], list[str]]] = {}


def _codec(name: str) -> tuple[dict[str, int], list[str]]:
    """Byte of every character and character of every byte; undefined bytes stand for the control of their number."""
    if name not in _TABLES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(chr(b))
        back = {c: b for b, c in enumerate(chars)}
        for b in range(128, 160):
            back.setdefault(chr(b), b)
        _TABLES[name] = back, chars
    return _TABLES[name]


def _encode(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        try:
            return text.encode()
        except UnicodeEncodeError:
            return None
    back = _codec(name)[0]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def _decode(data: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None
    chars = _codec(name)[1]
    return "".join([chars[b] for b in data])


def garble(text: str, chain: str) -> str | None:
    """The text as the chain leaves it; null where it can't be written in the chain's encodings."""
    for written, read in CHAINS[chain]:
        data = _encode(text, written)
        text = None if data is None else _decode(data, read)
        if text is None:
            return None
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain; null where a byte doesn't decode strictly."""
    for written, read in reversed(CHAINS[chain]):
        data = _encode(text, read)
        text = None if data is None else _decode(data, written)
        if text is None:
            return None
    return text


def sentences(text: str) -> list[str]:
    return _CUT.split(text)


def _bigrams(text: str) -> np.ndarray:
    """Codes of the byte pairs with at least one byte that isn't ASCII; the others say nothing of a chain."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int32)
    code = b[:-1] << 8 | b[1:]
    return code[(b[:-1] | b[1:]) > 127]


_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


def _tokens(text: str) -> list[str]:
    """Words with characters that aren't ASCII, in lower case."""
    return [w.strip(_STRIP).lower() for w in text.split() if not w.isascii()]


class Model:
    """Log likelihood of byte pairs per chain, and how often words with non-ASCII characters occur in all texts."""

    def __init__(self, log_p: np.ndarray, log_prior: np.ndarray, seen: dict[str, int]):
        self.log_p, self.log_prior, self.seen = log_p, log_prior, seen
        self._read: dict[str, tuple] = {}

    def __getstate__(self):
        return self.log_p, self.log_prior, self.seen

    def __setstate__(self, state):
        self.__init__(*state)

    def read(self, sentence: str) -> tuple[str, str | None, float]:
        """``_best`` of a sentence; sentences recur over documents, so short ones are remembered for a while."""
        got = self._read.get(sentence)
        if got is None:
            got = _best(self, sentence)
            if len(sentence) < 400:
                if len(self._read) > 50_000:
                    self._read.clear()
                self._read[sentence] = got
        return got

    def scores(self, text: str) -> np.ndarray:
        return self.log_p[_bigrams(text)].sum(axis=0) + self.log_prior

    def clean_rate(self, text: str) -> float:
        """Mean log likelihood per informative pair under the clean class; 0 for pure ASCII."""
        g = _bigrams(text)
        return float(self.log_p[g, 0].mean()) if len(g) else 0.0

    def familiar(self, text: str) -> float:
        """Sum of the log frequencies of the text's non-ASCII words."""
        return sum(math.log(self.seen.get(t, 0) + 0.05) for t in _tokens(text))


def fit(clean: list[str], garbled: int = 6000, smoothing: float = 0.02, prior_clean: float = 0.97, seen: dict[str, int] | None = None) -> Model:
    """Counts byte pairs of clean sentences and of up to ``garbled`` of them under every chain; ``seen`` counts words, by default those of the sentences."""
    counts = np.full((len(LABELS), 65_536), smoothing)
    for k, chain in enumerate(LABELS):
        parts = []
        for text in clean if k == 0 else clean[:garbled]:
            made = text if k == 0 else garble(text, chain)
            if made is not None and (k == 0 or made != text):
                parts.append(_bigrams(made))
        if parts:
            counts[k] += np.bincount(np.concatenate(parts), minlength=65_536)
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
    prior = np.full(len(LABELS), (1 - prior_clean) / (len(LABELS) - 1))
    prior[0] = prior_clean
    return Model(np.ascontiguousarray(log_p), np.log(prior), dict(Counter(t for text in clean for t in _tokens(text))) if seen is None else seen)


_UTF8 = tuple(c for c in CHAINS if CHAINS[c][0][0] == "utf-8")


def _looks_clean(text: str) -> bool:
    """No trace of a lost or control character, and no reading as misread UTF-8."""
    if _LOST in text or _C1.search(text):
        return False
    return not any(invert(text, c) is not None for c in _UTF8)


def word_counts(df: DataFrame, text: str, most_words: int) -> dict[str, int]:
    """How often words with characters beyond ASCII occur over all texts, those aside that read as misread UTF-8.

    Counted in the JVM with a partial step; words rarer than one in ``most_words`` of all such words, or single, are left
    out, so that the driver gets at most ``most_words``.
    """
    edge = "[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]+"
    w = df.select(F.explode(F.filter(F.split(text, r"\s+"), lambda x: x.rlike(r"[^\x00-\x7F]"))).alias("w"))
    w = w.select(F.lower(F.regexp_replace("w", f"^{edge}|{edge}$", "")).alias("w")).filter(F.length("w") < 60).groupBy("w").agg(F.count("*").alias("n"))
    w = materialize(w.filter("n > 1"), "word_counts")
    total = w.agg(F.sum("n")).first()[0] or 0
    rows = w.filter(F.col("n") >= max(2, -(-total // most_words))).collect()
    return {r.w: r.n for r in rows if _looks_clean(r.w)}


def fit_on(df: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int = 4000, fit_sentences: int = 20_000, most_words: int = 200_000) -> Model:
    """Fits on about ``fit_docs`` documents with non-ASCII text, chosen by a hash of the key, and up to ``fit_sentences``
    of their sentences of at most 1000 characters, cut in the JVM."""
    d = df.filter(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(text).alias("t"), F.col(key).alias("k"))
    share = min(1.0, fit_docs / max(1, d.count()))
    some = d.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else d
    s = some.select(F.explode(F.split("t", r"(?<=[.!?:;])(?=\s)|(?<=\n)")).alias("s")).filter(F.col("s").rlike(r"[^\x00-\x7f]") & (F.length("s") <= 1000)).distinct()
    pool = [r.s for r in s.orderBy(F.xxhash64("s"), "s").limit(fit_sentences + fit_sentences // 2).collect()]
    clean = [x for x in pool if _looks_clean(x)][:fit_sentences]
    seen = word_counts(d, "t", most_words)
    rough = fit(clean, garbled=1500, seen=seen)
    return fit([x for x in clean if _best(rough, x)[0] == CLEAN], seen=seen)


def _plausible(model: Model, chain: str, text: str, back: str, lead: float) -> bool:
    """Whether the restored text is the better one. Strictly decoded UTF-8 hardly arises by chance; chains between
    one-byte encodings decode anything, so there the restored words must be the more familiar ones."""
    if CHAINS[chain][0][0] == "utf-8":
        return True
    gain = model.familiar(back) - model.familiar(text)
    return gain > 2.5 or gain >= 0 and lead > 25 and model.clean_rate(back) > model.clean_rate(text) + 2


def _taken_for_clean(model: Model, text: str, most: float) -> bool:
    """Whether no chain leads clean by more than ``most``."""
    score = model.scores(text)
    return bool(score.max() - score[0] <= most)


def _best(model: Model, text: str, bonus: np.ndarray | None = None, slack: float = 15.0, tries: int = 8) -> tuple[str, str | None, float]:
    """(label, restored text, lead over clean) of one sentence; restored is null where no chain can be inverted.

    Only the ``tries`` likeliest chains are tried, and of those none that trails clean by more than ``slack``.
    """
    score = model.scores(text)
    if bonus is not None:
        score = score + bonus
    lead = score - score[0]
    if lead[1:].max() < -slack:
        return CLEAN, text, 0.0
    order = np.argsort(-score)
    # misread UTF-8 has no lone character beyond ASCII, so a sentence with one wasn't misread as a whole
    lone = _LONE.search(text) is not None
    for k in [k for k in order if k][:tries]:
        chain = LABELS[k]
        if lead[k] < -slack or lone and chain in _UTF8:
            continue
        back = invert(text, chain)
        if back is None or back == text or _C1.search(back) or garble(back, chain) != text:
            continue
        if _taken_for_clean(model, back, max(slack, lead[k] * (0.25 if chain in _UTF8 else 0.75))) and _plausible(model, chain, text, back, lead[k]):
            return chain, back, float(lead[k])
    # some words damaged, others not: word by word, where each decodes strictly
    for k in order:
        if k == 0 or lead[k] <= 0:
            break
        if CHAINS[LABELS[k]][0][0] == "utf-8":
            back = "".join(p if p.isascii() else invert(p, LABELS[k]) or p for p in re.split(r"(\s+)", text))
            if back != text and not _C1.search(back) and model.familiar(back) > model.familiar(text) + 2.5 and _taken_for_clean(model, back, slack):
                return LABELS[k], back, float(lead[k])
    top = int(order[0])
    broken = top and CHAINS[LABELS[top]][0][0] == "utf-8" and model.familiar(text) < 0
    return (LABELS[top], None, float(lead[top])) if broken else (CLEAN, text, 0.0)


def repair(text: str | None, model: Model, sure: float = 6.0) -> tuple[str, str | None, str | None]:
    """(state, chains, restored text); state is clean, restored or lost."""
    if not text or text.isascii():
        return "clean", None, text
    lost = _LOST in text
    parts = sentences(text)
    first: dict[str, tuple[str, str | None, float]] = {}
    for s in parts:
        if s not in first and not s.isascii():
            first[s] = model.read(s)
    heard = [(LABELS.index(label), lead) for label, back, lead in first.values() if label != CLEAN and back is not None and lead > sure]
    if heard:
        bonus = np.zeros(len(LABELS))
        for k in {k for k, _ in heard}:
            bonus[k] = 3.0
        for s, (_, _, lead) in list(first.items()):
            if lead <= sure:
                first[s] = _best(model, s, bonus)
    used = {label for label, _, _ in first.values() if label != CLEAN}
    if lost:
        return "lost", "+".join(sorted(used)) or None, None
    if not used:
        return "clean", None, text
    if any(label != CLEAN and back is None and lead > 3 * sure for label, back, lead in first.values()):
        return "lost", "+".join(sorted(used)), None
    back = "".join(first[s][1] if s in first and first[s][1] is not None else s for s in parts)
    return ("restored", "+".join(sorted(used)), back) if back != text else ("clean", None, text)


def repaired(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, with_text: bool = False, **fit_args) -> DataFrame:
    """One row per damaged text: key, state (restored, lost), chains, restored_sha256 ('' if lost) and, on demand, restored."""
    model = model or fitted(df, "encoding_repair", lambda: fit_on(df, text, key, **fit_args), text, key, sorted(fit_args.items()))
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "state", "chains", "restored_sha256", *["restored"] * with_text]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                state, chains, back = repair(t, model)
                if state != "clean":
                    rows.append(i)
                    out.append((state, chains, hashlib.sha256(back.encode()).hexdigest() if back is not None else "", back))
            cols = [batch.column(0).take(pa.array(rows, pa.int64()))]
            cols += [pa.array([o[k] for o in out], pa.string()) for k in range(3 + with_text)]
            yield pa.RecordBatch.from_arrays(cols, names)

    # pure ASCII texts never leave the JVM
    d = df.filter(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return d.mapInArrow(scan, f"key {kind}, state string, chains string, restored_sha256 string" + ", restored string" * with_text)
