"""Text, JSON lines and configuration sources, and sinks that never overwrite."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.sources import shared


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """(raw, ok[, record]) per non-blank line; ``ok`` is 0 for lines that aren't one JSON object.

    The raw text stays beside the parsed record, so unknown keys are kept. Bad lines are rows, not silent losses.
    """
    d = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "raw")
    v = F.schema_of_variant(F.try_parse_json("raw"))
    d = d.withColumn("ok", F.coalesce(v.startswith("OBJECT"), F.lit(False)).cast("int"))
    return d.withColumn("record", F.from_json("raw", schema)) if schema else d


def strict_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """As ``json_lines``; reading a bad line fails the job."""
    d = json_lines(spark, path, schema)
    return d.filter(F.when(F.col("ok") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("raw", 1, 80))).cast("boolean")))


def area(path: str) -> dict:
    """Name and box of an area file; the name defaults to the file's stem, the box is checked."""
    o = json.loads(shared.read(path).decode())
    b = {k: float(o["bbox"][k]) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    if not (-90 <= b["min_lat"] < b["max_lat"] <= 90 and -180 <= b["min_lon"] < b["max_lon"] <= 180):
        raise ValueError(f"not a box: {b}")
    return {"name": str(o.get("name") or PurePosixPath(path).stem), "bbox": b}


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, query): trimmed lines without blanks and comments, the first of equal ones."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "q")).withColumn("q", F.trim("q"))
    d = d.filter(~F.col("q").startswith("#") & (F.col("q") != "")).groupBy("q").agg(F.min("line").alias("line"))
    # a list of queries is written by hand; its order is one small sort
    return d.select((F.row_number().over(Window.orderBy("line")) - 1).alias("position"), F.col("q").alias("query"))


def completed_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a resume file (version 1); repeated or empty ids are an error; empty where the file is absent."""
    if not shared.exists(path):
        return spark.createDataFrame([], "input_id string")
    o = json.loads(shared.read(path).decode())
    ids = o.get("completed_inputs")
    if o.get("version") != 1 or not isinstance(ids, list) or len(set(ids)) != len(ids) or not all(isinstance(i, str) and i for i in ids):
        raise ValueError("not a resume file")
    return spark.createDataFrame([(i,) for i in ids], "input_id string")


def backup(df: DataFrame, path: str, replace: bool = False) -> None:
    """A copy of a table; refuses to overwrite unless told to."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def canonical(o) -> str:
    """One text per JSON document: sorted keys, no blanks."""
    return json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def strict_json(text: str):
    """A JSON document; repeated keys, NaN and infinities are errors."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys):
            raise ValueError(f"repeated keys in {keys}")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def read_plan(path: str, sha256: str) -> dict:
    """A plan whose bytes have the digest given; anything else is an error."""
    data = shared.read(path)
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the plan's bytes have another digest")
    o = strict_json(data.decode())
    if (canonical(o) + "\n").encode() != data:
        raise ValueError("the plan isn't in canonical form")
    return o


def write_plan(o: dict, path: str) -> str:
    """Writes a document to a new file and gives its SHA-256; an existing file is an error."""
    data = (canonical(o) + "\n").encode()
    shared.write_new(path, data)
    return hashlib.sha256(data).hexdigest()


def content_addressed(data: bytes, root: str, suffix: str = ".bin") -> str:
    """Writes bytes under their digest, atomically; the same content is written once."""
    path = f"{root}/{hashlib.sha256(data).hexdigest()}{suffix}"
    if not shared.exists(path):
        shared.write_new(path, data)
    return path


def write_queries(queries: list[str], path: str) -> str:
    """A snapshot of a query list, a line each, in a new file; gives its SHA-256. A query may not hold a line break."""
    if not queries or any(not q.strip() or "\n" in q or "\r" in q for q in queries):
        raise ValueError("queries are texts of one line")
    data = ("\n".join(queries) + "\n").encode()
    shared.write_new(path, data)
    return hashlib.sha256(data).hexdigest()


def write_report(make, path: str) -> dict:
    """Writes what ``make`` reports, or that it failed and why, as one JSON document in a new file; a failure is raised again."""
    try:
        report = {"ok": True, **make()}
    except Exception as x:
        shared.write_new(path, (canonical({"ok": False, "error": type(x).__name__, "message": str(x)}) + "\n").encode())
        raise
    shared.write_new(path, (canonical(report) + "\n").encode())
    return report


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON text per row, its keys sorted, as command lines print it; null fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias(out))
