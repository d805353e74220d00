"""Files by the file system their path names, local or shared, as the session's Hadoop configuration resolves it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    sc = SparkSession.getActiveSession().sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def names(path: str) -> list[str]:
    """Names in a folder; none where it is absent."""
    fs, p = _at(path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def read(path: str) -> bytes:
    """A small file whole."""
    fs, p = _at(path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(SparkSession.getActiveSession().sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_new(path: str, data: bytes) -> None:
    """Writes a file that must not exist yet: under another name first, so that no reader sees a part of it."""
    fs, p = _at(path)
    if fs.exists(p):
        raise FileExistsError(path)
    tmp = p.suffix(".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(data))
    out.close()
    if not fs.rename(tmp, p):
        fs.delete(tmp, False)
        raise FileExistsError(path)
