"""JSON values compared by meaning, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = r'"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|[^"\d-]+|-'
_EXPONENT = r"\d[eE][-+]?\d"


def _plain_number(token: Column) -> Column:
    """A number token without exponent and without trailing zeros; as it is where 38 digits don't hold it."""
    text = token.try_cast("decimal(38,15)").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), token)


def canonical_json(text: Column) -> Column:
    """One spelling per JSON value: sorted keys, no blanks, plain characters, numbers compared as numbers.

    Text that is no JSON (duplicate keys included) becomes ``raw:`` and the trimmed text; null stays null.
    """
    parsed = F.to_json(F.try_parse_json(text))
    # only exponents make the parser choose a double, whose text differs from that of an equal decimal
    pieces = F.transform(
        F.regexp_extract_all(parsed, F.lit(_TOKENS), F.lit(0)),
        lambda t: F.when(t.rlike(r"^-?\d"), _plain_number(t)).otherwise(t),
    )
    plain = F.when(text.rlike(_EXPONENT), F.array_join(pieces, "")).otherwise(parsed)
    return F.coalesce(plain, F.concat(F.lit("raw:"), F.trim(text)))


def instant_us(text: Column) -> Column:
    """Microseconds since the epoch of an ISO text with offset (UTC where the session is UTC); null if none."""
    return F.unix_micros(text.try_cast("timestamp"))
