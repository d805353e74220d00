"""Parquet table scans by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataform.sources import shared


def table(spark: SparkSession, root: str, name: str, *columns) -> DataFrame:
    """Table ``name`` under ``root``; only ``columns`` where given, so that the scan prunes the rest."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


MODES = ("read", "existing", "create")


def write_table(df: DataFrame, root: str, name: str, mode: str = "create") -> None:
    """``create`` makes a table that must not exist, ``existing`` appends to one that must; ``read`` writes nothing, an error."""
    path = f"{root}/{name}.parquet"
    if mode not in MODES or mode == "read":
        raise ValueError(f"tables opened with {mode} are not written")
    if mode == "existing" and not shared.exists(path):
        raise FileNotFoundError(path)
    df.write.mode("errorifexists" if mode == "create" else "append").parquet(path)


def columns(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """(table_name, column_name, position, data_type) from the files' own schemas; reads no rows."""
    rows = [(n, f.name, k, f.dataType.simpleString()) for n in names for k, f in enumerate(table(spark, root, n).schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string")
