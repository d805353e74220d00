"""Languages of texts and of their segments, with confidence.

Method. A linear-chain conditional random field labels every word of a text. A word's features are its affixes, its
character n-grams and itself (the lexicon), hashed to ``DIM`` weights per language; transitions are learned. Forward and
backward passes give each word's posterior; maximal runs of one label are the segments, their confidence the mean
posterior. The field is fitted on a bounded sample of labelled texts (``fit_texts``, by hash of the key). Since some of their labels are wrong
and some texts are mixed, each sentence first takes the label its words have most often in the sample.

Defined results: null texts and texts without letters have no segments; a text with a single short segment keeps it
however unsure; longer texts drop segments of fewer than ``min_words`` words or below ``min_confidence`` (names,
quotes); a field fitted without any labelled text finds no segments; copies get equal results; texts of any length are read whole, in windows that overlap.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("ar", "de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru", "tr")
#: Other notations of the languages.
NOTATIONS = {
    "ar": ("ara", "arabic"), "de": ("deu", "ger", "german"), "en": ("eng", "english"), "es": ("spa", "spanish"), "fr": ("fra", "fre", "french"), "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"), "pl": ("pol", "polish"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "tr": ("tur", "turkish"),
}
DIM = 1 << 16
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?؟。…]+(?=\s|$)|\n+")
_L = len(LANGUAGES)
WINDOW, OVERLAP = 400, 40


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any usual notation; null for a missing, undetermined or other one."""
    head = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    names = {n: c for c, ns in NOTATIONS.items() for n in (c, *ns)}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, head)


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]


def features(word: str) -> list[int]:
    """Hashed features of a word; 0 is kept for padding."""
    w = word.lower().replace("’", "'")
    b = f"^{w}$"
    names = ["w" + w, "c" + ("U" if word[:1].isupper() else "l")]
    names += ["p" + w[:k] for k in (1, 2, 3)] + ["s" + w[-k:] for k in (1, 2, 3, 4)]
    names += ["g" + b[i : i + n] for n in (2, 3) for i in range(min(len(b), 40) - n + 1)]
    return [zlib.crc32(n.encode()) % (DIM - 1) + 1 for n in names]


class Field:
    """The fitted field: ``weights`` per feature and language, ``moves`` between languages, ``start``."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.weights, self.moves, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, ws: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > 300_000:
            known.clear()
        for w in ws:
            if w not in known:
                known[w] = self.weights[features(w)].sum(axis=0)
        return np.array([known[w] for w in ws], np.float32).reshape(len(ws), _L)

    def posteriors(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """Posterior per word and language of several score matrices; sequences of like length share a pass."""
        out: list = [None] * len(many)
        order = sorted(range(len(many)), key=lambda i: len(many[i]))
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            e, mask = _padded([many[i] for i in part])
            _, post = _passes(e, mask, self.moves, self.start)
            for row, i in enumerate(part):
                out[i] = post[row, : len(many[i])]
        return out


def _padded(mats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(1, max(len(m) for m in mats))
    e = np.zeros((len(mats), t, _L), np.float32)
    mask = np.zeros((len(mats), t), bool)
    for i, m in enumerate(mats):
        e[i, : len(m)] = m
        mask[i, : len(m)] = True
    return e, mask


def _passes(e: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward and backward passes, scaled: (expected moves or None, posteriors)."""
    b, t, _ = e.shape
    x = np.exp(np.maximum(e - e.max(axis=2, keepdims=True), -40.0))
    a = np.exp(moves)
    fwd = np.empty_like(x)
    cur = x[:, 0] * np.exp(start)
    fwd[:, 0] = cur / cur.sum(axis=1, keepdims=True)
    for i in range(1, t):
        cur = (fwd[:, i - 1] @ a) * x[:, i]
        cur /= cur.sum(axis=1, keepdims=True)
        fwd[:, i] = np.where(mask[:, i, None], cur, fwd[:, i - 1])
    bwd = np.empty_like(x)
    bwd[:, t - 1] = 1.0
    moved = np.zeros((_L, _L)) if pairs else None
    for i in range(t - 2, -1, -1):
        on = mask[:, i + 1, None]
        y = x[:, i + 1] * bwd[:, i + 1]
        cur = y @ a.T
        cur /= cur.sum(axis=1, keepdims=True)
        bwd[:, i] = np.where(on, cur, bwd[:, i + 1])
        if pairs:
            joint = fwd[:, i, :, None] * a[None] * y[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            moved += (joint * on[:, :, None]).sum(axis=0)
    post = fwd * bwd
    post /= post.sum(axis=2, keepdims=True)
    return moved, post


def fit(texts: list[list[str]], labels: list[np.ndarray], rounds: int, field: Field | None = None, rate: float = 0.1, decay: float = 1e-3, batch: int = 64, seed: int = 7) -> Field:
    """Raises the conditional likelihood of the labels by AdaGrad."""
    rng = np.random.default_rng(seed)
    field = field or Field(np.zeros((DIM, _L), np.float32), np.where(np.eye(_L) > 0, 0.0, -3.0), np.zeros(_L))
    w, moves, start = field.weights.copy(), field.moves.copy(), field.start.copy()
    gw, gm, gs = np.full((DIM, _L), 10.0, np.float32), np.full((_L, _L), 100.0), np.full(_L, 100.0)
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(x, len(vocab)) for x in t]) for t in texts]
    feats = [np.array(features(x)) for x in vocab]
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            part = [i for i in part if len(ids[i])]
            if not part:
                continue
            used, back = np.unique(np.concatenate([ids[i] for i in part]), return_inverse=True)
            flat = np.concatenate([feats[u] for u in used])
            owner = np.repeat(np.arange(len(used)), [len(feats[u]) for u in used])
            score = np.zeros((len(used), _L), np.float32)
            np.add.at(score, owner, w[flat])
            cuts = np.cumsum([len(ids[i]) for i in part])[:-1]
            own = np.split(back, cuts)
            e, mask = _padded([score[o] for o in own])
            moved, post = _passes(e, mask, moves, start, pairs=True)
            grad = np.zeros((len(used), _L), np.float32)
            want = np.zeros((_L, _L))
            first = np.zeros(_L)
            for row, (i, o) in enumerate(zip(part, own)):
                y = labels[i]
                g = -post[row, : len(o)]
                g[np.arange(len(o)), y] += 1
                np.add.at(grad, o, g)
                np.add.at(want, (y[:-1], y[1:]), 1)
                first[y[0]] += 1
                first -= post[row, 0]
            rows, inv = np.unique(flat, return_inverse=True)
            step = np.zeros((len(rows), _L), np.float32)
            np.add.at(step, inv, grad[owner])
            step -= decay * w[rows]
            gw[rows] += step**2
            w[rows] += rate * step / np.sqrt(gw[rows])
            m = want - moved
            gm += m**2
            moves += rate * m / np.sqrt(gm)
            gs += first**2
            start += rate * first / np.sqrt(gs)
            np.clip(moves, -9, 9, out=moves)
            np.clip(start, -3, 3, out=start)
    return Field(w, moves, start)


def _sentence_of(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Number of the sentence that holds each word."""
    ends = np.array([m.end() for m in _STOP.finditer(text)], np.int64)
    return np.searchsorted(ends, [s for _, s, _ in spans], side="right") if len(ends) else np.zeros(len(spans), np.int64)


def fit_on(df: DataFrame, text: Column, label: Column, key: Column, fit_texts: int = 4000, fit_words: int = 120, fit_chars: int = 4000) -> Field:
    """Fits on up to ``fit_texts`` labelled texts, chosen by a hash of the key, and their first ``fit_words`` words, of
    which the JVM sends at most ``fit_chars`` characters a text."""
    rows = df.select(F.substring(text, 1, fit_chars).alias("t"), label_code(label).alias("l"), key.alias("k")).filter("t is not null and l is not null")
    rows = rows.orderBy(F.xxhash64("k"), "k").limit(fit_texts).select("t", "l").distinct().collect()
    code = {c: i for i, c in enumerate(LANGUAGES)}
    spans = [(r.t, words(r.t)[:fit_words], code[r.l]) for r in rows]
    spans = [s for s in spans if s[1]]
    texts = [[w for w, _, _ in sp] for _, sp, _ in spans]
    given = [np.full(len(t), y) for t, (_, _, y) in zip(texts, spans)]
    if not texts:
        return fit([], [], 0)
    return fit(texts, settled(texts, [_sentence_of(t, sp) for t, sp, _ in spans], given), 4)


def settled(texts: list[list[str]], sentence: list[np.ndarray], given: list[np.ndarray], rounds: int = 3, smooth: float = 0.1) -> list[np.ndarray]:
    """Labels per word after each sentence took the language its words have most often elsewhere.

    A chain fitted to delivered labels would learn the wrong ones by heart; counts of words per label outvote them.
    """
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w.lower(), len(vocab)) for w in t]) for t in texts]
    labels = given
    for _ in range(rounds):
        count = np.full((len(vocab), _L), smooth)
        for i, y in zip(ids, labels):
            np.add.at(count, (i, y), 1)
        log_p = np.log(count / count.sum(axis=0))
        labels = []
        for i, s in zip(ids, sentence):
            total = np.zeros((int(s.max()) + 1, _L))
            np.add.at(total, s, log_p[i])
            labels.append(total.argmax(axis=1)[s])
    return labels


def runs(post: np.ndarray, min_words: int, min_confidence: float) -> list[tuple[int, int, int, float]]:
    """(first word, last word + 1, language, confidence) of the segments of one text."""
    best = post.argmax(axis=1)
    cuts = np.flatnonzero(np.diff(best)) + 1
    parts = [(int(a), int(b), int(best[a]), float(post[a:b, best[a]].mean())) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(best)])]
    if len(parts) > 1:
        kept = [p for p in parts if p[1] - p[0] >= min_words and p[3] >= min_confidence]
        parts = kept or [max(parts, key=lambda p: (p[1] - p[0], p[3]))]
    out: list = []
    for a, b, y, c in parts:
        if out and out[-1][2] == y:
            a0, b0, _, c0 = out[-1]
            out[-1] = (a0, b, y, (c0 * (b0 - a0) + c * (b - a)) / (b0 - a0 + b - a))
        else:
            out.append((a, b, y, c))
    return out


def segments(texts: list[str | None], field: Field, min_words: int = 3, min_confidence: float = 0.6) -> list[list[tuple[int, int, str, float, int]]]:
    """Per text: (start, end, language, confidence, words) of its segments, in characters."""
    if not field.weights.any():
        return [[] for _ in texts]
    spans = [words(t) if t else [] for t in texts]
    jobs, owner = [], []
    for i, sp in enumerate(spans):
        ws = [w for w, _, _ in sp]
        # windows of a long text overlap; each keeps the words away from its inner edges
        at = 0
        while at < len(ws):
            lo, hi = max(0, at - OVERLAP), min(len(ws), at + WINDOW + OVERLAP)
            jobs.append(field.scores(ws[lo:hi]))
            owner.append((i, at - lo, min(len(ws), at + WINDOW) - lo))
            at += WINDOW
    post: list = [[] for _ in texts]
    for (i, a, b), p in zip(owner, field.posteriors(jobs) if jobs else []):
        post[i].append(p[a:b])
    out = []
    for sp, ps in zip(spans, post):
        out.append([(sp[a][1], sp[b - 1][2], LANGUAGES[y], c, b - a) for a, b, y, c in runs(np.concatenate(ps), min_words, min_confidence)] if ps else [])
    return out


SEGMENT = "array<struct<start:int,end:int,lang:string,confidence:double,words:int>>"


def labelled(df: DataFrame, text: str, field: Field, min_words: int = 3, min_confidence: float = 0.6) -> DataFrame:
    """All columns but the text (and any ``segments`` of the input), and ``segments``: per segment start, end (characters), language, confidence, words."""
    keep = [c for c in df.columns if c not in (text, "segments")]
    d = df.select(*keep, text)
    n = len(keep)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                found = segments(part.column(n).to_pylist(), field, min_words, min_confidence)
                rows = [[{"start": a, "end": b, "lang": y, "confidence": c, "words": w} for a, b, y, c, w in x] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(rows, kind)], [*keep, "segments"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:n])
    return d.mapInArrow(scan, f"{fields}, segments {SEGMENT}")
