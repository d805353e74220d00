"""Postal addresses that denote the same building.

Method. An address is cut into parts (house number, street, localities, postcode; suites, floors and the like are
dropped). Which names are cities, and which city a district or postcode belongs to, is counted over all addresses; a
rare name one or two letters from a frequent city counts as that city. Addresses become classes of equal (city, number,
street). Classes are banded by MinHash over street tokens and q-grams that carry city and number, so that only spellings
of one number in one city can meet: another number is another building by the task's own terms. A band is two MinHash
values; of two spellings that share a quarter of their shingles ``bands`` of them find 99 in a hundred, and spellings one
typing error apart meet in any case, by an equal deletion of one letter. Candidates
are verified by an affine-gap alignment of street tokens whose substitution costs know abbreviations, ordinals and
typing errors.

Skew. Equal spellings are one class however many rows have them; bands see classes only, as pairs of numbers, and meet
in shuffled joins that AQE splits where a bucket is hot. ``same_building`` expands classes to pairs of rows, in blocks of
``block_rows``, so that no task takes a whole hot class; that result grows with the square of a building by its
definition. ``buildings`` gives one row per address and its building instead.

Memory. Tables that grow with the rows are joined by sort and merge at every size, so none of them is gathered in the
driver: the size checks for broadcasts go by compressed files and do not see how many rows an ``explode`` makes of one.

Defined results: null, empty and placeholder addresses, and those without a number, a street or any locality that
tells the city, take no part; a repeated row counts once; an address is never paired with itself; very long texts are
read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import no_placeholder
from strataform.operators.components import components
from strataform.session import materialize

#: Street types and their abbreviations.
TYPES = {
    "street": "street", "st": "street", "str": "street", "avenue": "avenue", "ave": "avenue", "av": "avenue", "boulevard": "boulevard",
    "blvd": "boulevard", "bd": "boulevard", "boul": "boulevard", "road": "road", "rd": "road", "drive": "drive", "dr": "drive", "drv": "drive",
    "lane": "lane", "ln": "lane", "square": "square", "sq": "square", "court": "court", "ct": "court", "crt": "court", "place": "place",
    "pl": "place", "terrace": "terrace", "ter": "terrace", "highway": "highway", "hwy": "highway", "parkway": "parkway", "pkwy": "parkway",
    "way": "way", "alley": "alley", "aly": "alley", "circle": "circle", "cir": "circle", "row": "row", "strasse": "strasse", "platz": "platz",
}
#: Compass points.
POINTS = {"n": "north", "north": "north", "s": "south", "south": "south", "e": "east", "east": "east", "w": "west", "west": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
_UNITS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
ORDINALS = {w: k for k, w in enumerate(_UNITS, 1)}

_SUB = re.compile(
    r"\b(?:suite|ste|unit|shop|apt|apartment|flat|room|rm|office|floor|level|lvl|fl)\b\.?\s*(?:no\.?\s*|nr\.?\s*)?#?\s*\d+[a-z]?\b"
    r"|\b(?:\d+(?:st|nd|rd|th)|ground|first|second|third|fourth|fifth|top|upper|lower)\s+(?:floor|fl|level)\b\.?"
)
_CUT = re.compile(r"[,;\n\r\t|]+|\s+[-–—]\s+")
_NO = r"(?:(?:number|num|no|nr)\b\.?\s*|#\s*)?"
_POST = re.compile(r"(?:(?P<a>[^\d]*?)\s*\b)?(?P<p>\d{3}\s?\d{3}|\d{5}(?:-\d{4})?|[a-z]{1,2}\d[a-z\d]?\s?\d[a-z]{2})(?:\b\s*(?P<b>[^\d]*))?")
#: Five digits are a house number only beside a street type; alone they are a postcode.
_LONG_FRONT = re.compile(r"(?:(?:number|num|no|nr)\b\.?\s*|#\s*)?(\d{5}[a-z]?)\s+(.*[^\W\d].*)")
_LONG_BACK = re.compile(r"(.*?[^\W\d].*?)\s+(?:(?:number|num|no|nr)\b\.?\s*|#\s*)?(\d{5}[a-z]?)\.?")
_ALONE = re.compile(_NO + r"(\d{1,4}[a-z]?)\.?")
_FRONT = re.compile(_NO + r"(\d{1,4}[a-z]?)\.?\s+(.*[^\W\d].*)")
_BACK = re.compile(r"(.*?[^\W\d].*?)\s+" + _NO + r"(\d{1,4}[a-z]?)\.?")


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """Lower case, without diacritics, single blanks between words."""
    text = text.casefold().replace("ø", "o").replace("ł", "l").replace("ı", "i").replace("æ", "ae").replace("œ", "oe")
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text


def street_tokens(text: str) -> list[str]:
    """Tokens of a street with types, compass points and ordinals in one spelling; marked ``t:`` and ``d:``."""
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)?", text)
    out = []
    for k, w in enumerate(words):
        if w in TYPES and k == len(words) - 1 and k > 0:
            out.append("t:" + TYPES[w])
        elif w in POINTS and len(words) > 1 and (k == 0 or k == len(words) - 1):
            out.append("d:" + POINTS[w])
        elif w in ORDINALS:
            out.append(f"#{ORDINALS[w]}")
        elif m := re.fullmatch(r"(\d+)(?:st|nd|rd|th)", w):
            out.append(f"#{m[1]}")
        else:
            out.append(w)
    return out


def _ends_in_type(street: str) -> bool:
    words = re.findall(r"[^\W\d_]+", street)
    return len(words) > 1 and words[-1] in TYPES


def parse(address: str | None) -> tuple[str | None, str | None, str | None, str | None, list[str]]:
    """(number, street tokens joined by blanks, postcode, city next to the postcode, other names)."""
    number = street = post = hint = None
    names: list[str] = []
    last = None
    for raw in _CUT.split(fold(address or "")):
        part = " ".join(_SUB.sub(" ", raw).split()).strip(" .")
        if not part:
            continue
        if number is None and (m := _LONG_FRONT.fullmatch(part)) and _ends_in_type(m[2]):
            number, street = m[1], m[2]
        elif number is None and (m := _LONG_BACK.fullmatch(part)) and _ends_in_type(m[1]):
            street, number = m[1], m[2]
        elif post is None and (m := _POST.fullmatch(part)):
            post = re.sub(r"\s|-\d{4}$", "", m["p"])
            town = ((m["a"] or "") + " " + (m["b"] or "")).strip(" .")
            if town:
                hint = town
        elif number is None and (m := _ALONE.fullmatch(part)):
            number = m[1]
            if last is not None and street is None:
                street = last
                names.remove(last)
        elif number is None and (m := _FRONT.fullmatch(part)) and not re.match(r"\d+(st|nd|rd|th)\b", part):
            number, street = m[1], m[2]
        elif number is None and (m := _BACK.fullmatch(part)):
            street, number = m[1], m[2]
        else:
            names.append(part)
            last = part
    tokens = street_tokens(street) if street else []
    return (number.lstrip("0") or None if number else None), (" ".join(tokens) or None), post, hint, names


def _edit(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours; 3 stands for 3 and more."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            c = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, two[j - 2] + 1)
            row.append(c)
    return min(row[-1], 3)


@lru_cache(maxsize=500_000)
def substitution(a: str, b: str) -> float:
    """Cost of one token standing for another."""
    if a == b:
        return 0.0
    if a[:2] in ("t:", "d:") or b[:2] in ("t:", "d:") or a[0] == "#" or b[0] == "#":
        return 2.0
    d, n = _edit(a, b), max(len(a), len(b))
    return 0.15 if d == 1 and n >= 4 else 0.25 if d == 2 and n >= 6 else 2.0


def _gap(t: str) -> float:
    return 0.3 if t[:2] == "t:" else 0.8 if t[:2] == "d:" else 1.5


def alignment_cost(a: list[str], b: list[str], extend: float = 0.5) -> float:
    """Least cost of a global alignment with affine gaps: a gap's first token costs in full, further ones a share."""
    inf = float("inf")
    n, m = len(a), len(b)
    best = [[inf] * (m + 1) for _ in range(n + 1)]
    up = [[inf] * (m + 1) for _ in range(n + 1)]
    left = [[inf] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                up[i][j] = min(best[i - 1][j] + _gap(a[i - 1]), up[i - 1][j] + extend * _gap(a[i - 1]))
            if j:
                left[i][j] = min(best[i][j - 1] + _gap(b[j - 1]), left[i][j - 1] + extend * _gap(b[j - 1]))
            if i and j:
                best[i][j] = min(best[i][j], best[i - 1][j - 1] + substitution(a[i - 1], b[j - 1]))
            best[i][j] = min(best[i][j], up[i][j], left[i][j])
    return best[n][m]


def parsed(df: DataFrame, id_col: str = "id", address: str = "address") -> DataFrame:
    """(id, number, street, post, hint, names) of addresses with a number and a street."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[parse(t) for t in batch.column(1).to_pylist()])) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in cols[:4]], pa.array(cols[4], pa.list_(pa.string()))], ["id", "number", "street", "post", "hint", "names"])

    d = df.select(F.col(id_col).cast("long").alias("id"), no_placeholder(F.col(address)).alias("a")).filter("id is not null and a is not null")
    return d.mapInArrow(scan, "id long, number string, street string, post string, hint string, names array<string>")


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of which neither side is broadcast."""
    return left.hint("merge").join(right, on, how)


def city_spellings(p: DataFrame, often: int = 20) -> DataFrame:
    """(place, right): rare names that misspell a city by one letter, or by two from eight letters on.

    Distinct names only are compared, by equal deletions of one letter; the city must occur ``often`` times as often.
    """
    names = p.select("hint", F.explode(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array_compact(F.array("hint")))).alias("place"))
    seen = materialize(names.filter(F.length("place").between(5, 60)).groupBy("place").agg(F.count("*").alias("n"), F.count_if(F.col("place").eqNullSafe(F.col("hint"))).alias("as_city")), "place_names")
    less = F.transform(F.expr("sequence(1, length(place))"), lambda i: F.concat(F.substring(F.col("place"), F.lit(1), i - 1), F.substring(F.col("place"), i + 1, F.length("place"))))
    cut = lambda d: d.withColumn("v", F.explode(F.array_distinct(F.concat(F.array("place"), less))))
    cities = cut(seen.filter(F.col("as_city") >= often)).select(F.col("place").alias("right"), F.col("n").alias("m"), "v")
    met = _merged(cut(seen), cities, "v").filter((F.col("place") != F.col("right")) & (F.col("m") >= often * F.col("n")))
    near = F.levenshtein("place", "right")
    met = met.filter((near == 1) | (near == 2) & (F.length("place") >= 8)).withColumn("near", near)
    return met.groupBy("place").agg(F.min_by("right", F.struct("near", -F.col("m"), "right")).alias("right"))


def spelled(p: DataFrame) -> DataFrame:
    """The parsed addresses with misspelt cities put right; the table of spellings is met on its names."""
    wrong = materialize(city_spellings(p), "spellings")
    if wrong.isEmpty():
        return p
    fix = wrong.select(F.col("place").alias("hint"), F.col("right").alias("_hint"))
    p = p.join(fix, "hint", "left").withColumn("hint", F.coalesce("_hint", "hint")).drop("_hint")
    each = p.select("id", F.explode("names").alias("place")).join(wrong, "place").groupBy("id").agg(F.collect_set("right").alias("_more"))
    more = F.array_union(F.coalesce("names", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))
    return _merged(p, each, "id", "left").withColumn("names", more).select("id", "number", "street", "post", "hint", "names")


def with_city(p: DataFrame, sure: float = 0.9) -> DataFrame:
    """(id, number, street, city, zone). City by name, else by postcode, else by district, as counted over all rows.

    The zone is the postcode, else that of a name which occurs with one postcode in at least ``sure`` of its rows.
    """
    places = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array_compact(F.array("hint", F.concat(F.lit("post:"), F.col("post")))))
    seen = p.filter("hint is not null or post is not null").select("hint", "post", F.explode(places).alias("place"))
    counted = seen.groupBy("place", "hint", "post").agg(F.count("*").alias("n"))
    cities = counted.filter("hint is not null").groupBy("place", "hint").agg(F.sum("n").alias("n")).groupBy("place").agg(F.max_by("hint", F.struct("n", "hint")).alias("city"))
    posts = counted.filter("post is not null").groupBy("place", "post").agg(F.sum("n").alias("n")).groupBy("place").agg(F.max_by("post", F.struct("n", "post")).alias("zone"), (F.max("n") / F.sum("n")).alias("share"))
    of = _merged(cities, posts.filter(F.col("share") >= sure).drop("share"), "place", "left")
    rank = F.when(F.col("place") == F.col("city"), 3).when(F.col("place").startswith("post:"), 2).otherwise(1)
    mine = p.select("id", "number", "street", "post", F.explode(places).alias("place")).filter("number is not null and street is not null")
    found = _merged(mine, of, "place").groupBy("id", "number", "street", "post").agg(F.max_by("city", F.struct(rank, "city")).alias("city"), F.max("zone").alias("zone"))
    return found.select("id", "number", "street", "city", F.coalesce("post", "zone").alias("zone"))


def candidate_pairs(classes: DataFrame, bands: int, rows: int = 2, q: int = 2) -> DataFrame:
    """(a, b, street_a, street_b) of classes that share a band; classes: (cls, city, number, street, zone).

    Shingles are the tokens and q-grams of the street without type and compass point; a band is ``rows`` MinHash values. Equal deletions of one letter are buckets too.
    A street lies in one zone, so different spellings in two known zones are no candidates.
    """
    core = F.regexp_replace(F.regexp_replace("street", r"\b[td]:\S+", ""), r"\s+", " ")
    core = F.concat(F.lit("^"), F.when(F.trim(core) != "", F.trim(core)).otherwise(F.col("street")), F.lit("$"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("core") - (q - 1))), lambda i: F.substring(F.col("core"), i, F.lit(q))))
    shingles = F.array_union(grams, F.filter(F.split("core", "[ ^$]+"), lambda t: t != ""))
    # spellings one typing error apart have an equal deletion of one letter, however few shingles they share
    less = F.transform(F.sequence(F.lit(1), F.length("core")), lambda i: F.concat(F.substring(F.col("core"), F.lit(1), i - 1), F.substring(F.col("core"), i + 1, F.length("core"))))
    c = classes.withColumn("core", core).select("cls", F.xxhash64("city", "number").alias("place"), F.array_distinct(F.concat(F.array("core"), less)).alias("less"), F.transform(shingles, lambda g: F.xxhash64(g)).alias("h"))

    def least(seed: int):
        return F.array_min(F.transform("h", lambda x: F.xxhash64(F.lit(seed), x)))

    sig = F.array(*[F.xxhash64("place", F.lit(s), *[least(s * rows + r) for r in range(rows)]) for s in range(bands)])
    sig = F.concat(sig, F.transform("less", lambda w: F.xxhash64("place", F.lit(-1), w)))
    c = c.select("cls", F.explode(sig).alias("bucket"))
    met = _merged(c.withColumnRenamed("cls", "a"), c.withColumnRenamed("cls", "b"), "bucket").filter("a < b").select("a", "b").distinct()
    of = lambda s: classes.select(F.col("cls").alias(s), F.col("street").alias(f"street_{s}"), F.col("zone").alias(f"zone_{s}"))
    met = _merged(_merged(met, of("a"), "a"), of("b"), "b")
    near = F.coalesce(F.col("zone_a") == F.col("zone_b"), F.lit(True)) | (F.col("street_a") == F.col("street_b"))
    return met.filter(near).select("a", "b", "street_a", "street_b")


def verified(pairs: DataFrame, most: float) -> DataFrame:
    """(a, b) of candidates whose streets align at a cost of at most ``most``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([alignment_cost(x.split(), y.split()) <= most for x, y in zip(sa, sb)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "street_a", "street_b").mapInArrow(scan, "a long, b long")


def _classed(df: DataFrame, id_col: str, address: str, bands: int, most: float) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): rows (id, cls, …) and the pairs (a, b) of classes that denote one building."""
    read = materialize(parsed(df, id_col, address), "addresses")
    rows = with_city(materialize(spelled(read), "spelled"))
    rows = materialize(rows.select("id", "city", "number", "street", "zone", F.xxhash64("city", "number", "street", "zone").alias("cls")), "located")
    classes = materialize(rows.groupBy("cls", "city", "number", "street", "zone").agg(F.countDistinct("id").alias("n")), "classes")
    return rows, verified(candidate_pairs(classes, bands), most)


def same_building(df: DataFrame, id_col: str = "id", address: str = "address", bands: int = 72, most: float = 0.58, block_rows: int = 2048) -> DataFrame:
    """(id_a, id_b), the smaller first, of rows whose addresses denote the same building."""
    rows, met = _classed(df, id_col, address, bands, most)
    size = rows.groupBy("cls").agg(F.countDistinct("id").alias("n")).select("cls", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), "n")
    own = size.filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    both = met.union(own)
    cut = _merged(_merged(both, size.select(F.col("cls").alias("a"), F.col("blocks").alias("blocks_a")), "a"), size.select(F.col("cls").alias("b"), F.col("blocks").alias("blocks_b")), "b")
    cut = cut.withColumn("block_a", F.explode(F.expr("sequence(0, blocks_a - 1)"))).withColumn("block_b", F.explode(F.expr("sequence(0, blocks_b - 1)")))
    member = _merged(rows, size, "cls").select("cls", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")).distinct()
    left = member.select(F.col("cls").alias("a"), F.col("block").alias("block_a"), F.col("id").alias("i"))
    right = member.select(F.col("cls").alias("b"), F.col("block").alias("block_b"), F.col("id").alias("j"))
    out = _merged(_merged(cut.select("a", "b", "block_a", "block_b"), left, ["a", "block_a"]), right, ["b", "block_b"])
    out = out.filter((F.col("a") != F.col("b")) | (F.col("i") < F.col("j"))).filter("i != j")
    return out.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def buildings(df: DataFrame, id_col: str = "id", address: str = "address", bands: int = 72, most: float = 0.58) -> DataFrame:
    """(id, building_id, spellings): one row per row with a readable address; the building is named by its smallest id.

    Spellings that denote one building directly or through others are one building.
    """
    rows, met = _classed(df, id_col, address, bands, most)
    group = components(met.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("id").alias("cls"), "group_id")
    named = _merged(rows.select("id", "cls").distinct(), group, "cls", "left").withColumn("group_id", F.coalesce("group_id", "cls"))
    named = materialize(named, "members")
    first = named.groupBy("group_id").agg(F.min("id").alias("building_id"), F.countDistinct("cls").alias("spellings"))
    return _merged(named, first, "group_id").select("id", "building_id", "spellings").distinct()
