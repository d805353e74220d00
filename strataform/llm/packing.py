"""Items of varying length in containers of fixed capacity.

Method. Conflict-constrained best fit. Items are taken largest first; bins are ordered by what is left in them and
carry a bitmap of their sources and one of their duplicate clusters. The successor search starts at the tightest bin
that is large enough and goes on until one is compatible: no other member of the item's cluster, no source in conflict
with the item's. Items longer than the capacity are cut into full pieces and a rest.

Scale. Items are written once with their sizes, however many capacities there are. They are spread by hash over shards of
about ``shard_tokens`` tokens and at most about ``shard_items`` items, each packed in one task; copies of one text spread
alike. The bins left less than ``full`` full are then taken apart and packed again in as few shards as their
tokens need, so that no shard leaves its own open bins behind. The number of shards follows the totals.

Defined results: null and empty texts have no tokens and are in no container, nor are rows without an id; a row without
a cluster is its own; a null source conflicts with none; a repeated id counts once;
ties in size are broken by cluster and id; capacities that are null or not positive hold nothing.
"""

from __future__ import annotations

import base64
import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """All columns but the text (and any ``tokens`` of the input), and ``tokens``: its length in tokens of the tokenizer at ``path``."""
    keep = [c for c in df.columns if c not in (text, "tokens")]
    d = df.select(*keep, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*keep, "tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(scan, f"{fields}, tokens long")


def pack(sizes: list[int], clusters: list, sources: list, capacity: int, conflicts: dict | None = None) -> list[int]:
    """Bin of every item, by best fit, largest first.

    Equal members of a cluster are placed in one sweep over the ordered bins, which gives what placing them one by one
    gives: a bin that took one takes no other.
    """
    conflicts = conflicts or {}
    repeated = {c: 1 << k for k, c in enumerate(sorted(c for c, n in Counter(clusters).items() if n > 1))}
    bit = {s: 1 << k for k, s in enumerate(sorted({s for s in sources if s is not None}))}
    pairs = {(s, o) for s, others in conflicts.items() for o in others}
    against = {s: sum(b for o, b in bit.items() if (s, o) in pairs or (o, s) in pairs) for s in bit}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], str(clusters[i]), str(sources[i]), i))
    out = [-1] * len(sizes)
    ordered: list[tuple[int, int]] = []  # (left, bin)
    held: list[int] = []
    heard: list[int] = []
    k = 0
    while k < len(order):
        i = order[k]
        size, src = sizes[i], sources[i]
        dup = repeated.get(clusters[i], 0)
        end = k + 1
        if dup:
            while end < len(order) and sizes[order[end]] == size and clusters[order[end]] == clusters[i] and sources[order[end]] == src:
                end += 1
        group, k = order[k:end], end
        at, taken, g = bisect.bisect_left(ordered, (size, -1)), [], 0
        bad = against.get(src, 0)
        while at < len(ordered) and g < len(group):
            b = ordered[at][1]
            if not (held[b] & dup or heard[b] & bad):
                out[group[g]] = b
                taken.append(at)
                g += 1
            at += 1
        moved = []
        for a in reversed(taken):
            left, b = ordered.pop(a)
            moved.append((left - size, b))
        for i in group[g:]:
            b = len(held)
            held.append(0)
            heard.append(0)
            out[i] = b
            moved.append((capacity - size, b))
        for left, b in moved:
            held[b] |= dup
            heard[b] |= bit.get(src, 0)
            bisect.insort(ordered, (left, b))
    return out


def _packer(conflicts: dict | None, round_no: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        sources = [s if isinstance(s, str) else None for s in pdf["source"]]
        bins = pack(pdf["tokens"].tolist(), pdf["cluster"].tolist(), sources, cap, conflicts)
        pdf["container"] = [f"{round_no}-{shard}-{b}" for b in bins]
        return pdf[["target_id", "capacity", "container", "doc_id", "piece", "start_token", "tokens", "source", "cluster"]]

    return run


PACKED = "target_id long, capacity long, container string, doc_id long, piece long, start_token long, tokens long, source string, cluster long"


def _round(items: DataFrame, shard_tokens: int, shard_items: int, round_no: int, conflicts: dict | None) -> DataFrame:
    shards = F.greatest(F.lit(1), F.ceil(F.sum("tokens") / shard_tokens), F.ceil(F.count("*") / shard_items))
    need = items.groupBy("target_id").agg(shards.alias("shards"))
    spread = items.join(need, "target_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_no)), F.col("shards")).cast("long")).drop("shards")
    return spread.groupBy("target_id", "shard").applyInPandas(_packer(conflicts, round_no), PACKED)


def packed(items: DataFrame, targets: DataFrame, shard_tokens: int = 4_000_000, full: float = 0.98, conflicts: dict | None = None, shard_items: int = 100_000, targets_at_once: int = 100) -> DataFrame:
    """(target_id, capacity, container, doc_id, piece, start_token, tokens) for items (doc_id, source, cluster, tokens).

    ``conflicts`` names for each source those it must not share a container with, both ways round. Capacities, which are
    stated and few, are taken in turns of ``targets_at_once``.
    """
    each = targets.select("target_id", F.col("capacity_tokens").alias("capacity")).filter("capacity > 0 and target_id is not null").distinct().orderBy("target_id", "capacity").collect()
    own = F.coalesce("cluster", F.xxhash64("doc_id", F.lit("alone"))).alias("cluster")
    sized = items.filter("tokens > 0 and doc_id is not null").dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own, F.col("tokens").cast("long").alias("tokens"))
    sized = materialize(sized, "sized")
    turns = [each[k : k + targets_at_once] for k in range(0, len(each), targets_at_once)] or [[]]
    return reduce(DataFrame.unionByName, [_packed(sized, turn, shard_tokens, shard_items, full, conflicts) for turn in turns])


def _packed(sized: DataFrame, turn: list, shard_tokens: int, shard_items: int, full: float, conflicts: dict | None) -> DataFrame:
    each = F.array(*[F.struct(F.lit(r.target_id).cast("long").alias("target_id"), F.lit(r.capacity).cast("long").alias("capacity")) for r in turn])
    each = each if turn else F.expr("cast(array() as array<struct<target_id:bigint,capacity:bigint>>)")
    pieces = sized.select("doc_id", "source", "cluster", "tokens", F.explode(each).alias("t")).select("doc_id", "source", "cluster", "tokens", "t.target_id", "t.capacity")
    pieces = pieces.withColumn("piece", F.explode(F.expr("sequence(0L, (tokens - 1) div capacity)")))
    pieces = pieces.withColumn("start_token", F.col("piece") * F.col("capacity")).withColumn("tokens", F.least("capacity", F.col("tokens") - F.col("start_token")))
    pieces = pieces.select("target_id", "capacity", "doc_id", "piece", "start_token", "tokens", "source", "cluster")
    # a full piece is a container of its own
    whole = pieces.filter("tokens = capacity").withColumn("container", F.concat_ws("-", F.lit("whole"), "doc_id", "piece"))
    first = materialize(_round(pieces.filter("tokens < capacity"), shard_tokens, shard_items, 0, conflicts), "packed")
    filled = first.groupBy("target_id", "container").agg(F.sum("tokens").alias("filled"))
    state = first.join(filled, ["target_id", "container"]).withColumn("open", F.col("filled") < F.col("capacity") * full)
    again = _round(state.filter("open").select(*pieces.columns), shard_tokens, shard_items, 1, conflicts)
    out = state.filter("not open").select(*first.columns).unionByName(again).unionByName(whole.select(*first.columns))
    return out.select("target_id", "capacity", "container", "doc_id", "piece", "start_token", "tokens")
