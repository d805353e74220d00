"""Session construction and the one place where intermediate results are written."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "strataform", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE); further settings by keyword."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests) is a folder of our own chosen.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not (conf.get("spark.master", "") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="strataform-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strataform/{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Removes what this application materialized; results that were not written or gathered yet are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, rebalance: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage, survives the loss of executors, and lets a result that is used twice be computed once. With
    ``rebalance`` the rows are first spread over files of the advisory size, so that a table that is read again and again
    is neither many tiny files nor a few huge ones.
    """
    spark = df.sparkSession
    if rebalance:
        df = df.hint("rebalance", *(partition_by or []))
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


_models: dict[str, Any] = {}


def _input_mark(df: DataFrame, dated: int = 1000) -> str:
    """A digest of the files a frame reads; of up to ``dated`` files the time of change counts too."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    marks = files
    if len(files) <= dated:
        conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        marks = [f"{f} {path(f).getFileSystem(conf).getFileStatus(path(f)).getModificationTime()}" for f in files]
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()


def fitted(df: DataFrame, name: str, make: Callable[[], Any], *params) -> Any:
    """What ``make`` fits on ``df``: made once per application, input files and parameters, then read from the shared folder.

    A frame that reads no files is fitted anew each time.
    """
    spark = df.sparkSession
    if not df.inputFiles():
        return make()
    key = hashlib.sha256(repr((name, params, _input_mark(df), df.schema.simpleString())).encode()).hexdigest()[:32]
    where = f"{_own_dir(spark)}/models/{name}-{key}"
    if where in _models:
        return _models[where]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        model = pickle.loads(bytes(spark.read.format("binaryFile").load(where).first()["content"]))
    else:
        model = make()
        out = fs.create(path, True)
        out.write(bytearray(pickle.dumps(model)))
        out.close()
    _models[where] = model
    return model


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="strataform-")) / "strataform_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)
