"""Comparisons, fingerprints and checks of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.identity import row_hashes


def wide_digest(*cols: str) -> Column:
    """Of a bag of rows: two sums of 60 bits of each row's MD5, as text. Equal for equal bags in any order; no sort, no
    gathering; partial sums are added. Nulls and empty texts differ."""
    low, high = row_hashes(*[F.col(c) for c in cols])
    total = lambda h: F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string")
    return F.concat_ws("-", total(low), total(high))


def fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """(row_count, digest) of the columns, all by default."""
    return df.agg(F.count("*").alias("row_count"), wide_digest(*(cols or df.columns)).alias("digest"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows) left over when equal rows are matched one to one; empty where the bags are equal."""
    cols = a.columns
    n = a.select(*cols, F.lit(1).alias("n")).unionByName(b.select(*cols, F.lit(-1).alias("n"))).groupBy(*cols).agg(F.sum("n").alias("n")).filter("n <> 0")
    return n.groupBy(F.when(F.col("n") > 0, "missing").otherwise("unexpected").alias("side")).agg(F.sum(F.abs("n")).cast("long").alias("rows"))


def gaps(df: DataFrame, other: DataFrame, on: Column) -> DataFrame:
    """Rows of ``df`` without a partner."""
    return df.join(other, on, "left_anti")


def absent(new: DataFrame, held: DataFrame, *key: str) -> DataFrame:
    """The new rows, each key once, that may be appended without repeating what is held."""
    return new.dropDuplicates(list(key)).join(held.select(*key), list(key), "left_anti")


def unique_check(df: DataFrame, name: str, *key: str) -> DataFrame:
    bad = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return bad.agg(F.lit(name).alias("check_name"), F.count("*").alias("bad"))


def foreign_check(df: DataFrame, name: str, column: str, other: DataFrame, target: str) -> DataFrame:
    bad = df.filter(F.col(column).isNotNull()).join(other.select(F.col(target).alias(column)).distinct(), column, "left_anti")
    return bad.agg(F.lit(name).alias("check_name"), F.count("*").alias("bad"))


def rule_check(df: DataFrame, name: str, holds: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("check_name"), F.count_if(~F.coalesce(holds, F.lit(False))).alias("bad"))


def gate(checks: list[DataFrame]) -> DataFrame:
    """(check_name, bad, passed) of all checks."""
    return reduce(DataFrame.unionByName, checks).withColumn("passed", (F.col("bad") == 0).cast("int"))


def first_issue(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule that applies, null if none does."""
    out = F.lit(None).cast("string")
    for code, cond in reversed(rules):
        out = F.when(cond, code).otherwise(out)
    return out


def all_issues(rules: list[tuple[str, Column]]) -> Column:
    """Codes of all rules that apply."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))
