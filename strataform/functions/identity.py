"""Identity keys, opaque ids and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataform.functions.text import clean_text

SEP = chr(31)


def opaque_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 32 hex digits over parts joined by a unit separator; null parts count as empty."""
    text = F.concat_ws(SEP, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 32))


def terminated_digest(*parts: Column) -> Column:
    """SHA-256 over parts each ended by a NUL."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")) for p in parts]), 256)


def fallback_key(*parts: Column) -> Column:
    """``fallback:`` and SHA-256 over lower-cased parts joined by a pipe; null where all are empty."""
    low = [F.lower(F.coalesce(clean_text(p.cast("string")), F.lit(""))) for p in parts]
    return F.when(F.concat(*low) != "", F.concat(F.lit("fallback:"), F.sha2(F.concat_ws("|", *low), 256)))


def identity_key(place_id: Column, cid: Column, data_id: Column, fallback: Column) -> Column:
    """The strongest key a record has: place, then cid, then data id, then the fallback."""
    return F.coalesce(*[F.concat(F.lit(f"{n}:"), clean_text(c)) for n, c in (("place", place_id), ("cid", cid), ("data", data_id))], fallback)


def seal(*sets: Column) -> Column:
    """SHA-256 of sorted ids, set after set, a unit separator between all."""
    return F.sha2(F.concat_ws(SEP, *[F.concat_ws(SEP, F.array_sort(s)) for s in sets]), 256)


def row_hashes(*cols: Column) -> tuple[Column, Column]:
    """Two times 60 bits of a row's MD5, for order-free fingerprints."""
    text = F.md5(F.concat_ws(SEP, *[F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]))
    part = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(20,0)")
    return part(1), part(17)
