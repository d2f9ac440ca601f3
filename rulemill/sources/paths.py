"""What the file system of a path says, whatever its scheme."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; a pattern has to match something."""
    fs, own = _fs(spark, path)
    return bool(fs.globStatus(own)) if any(c in path for c in "*?[{") else fs.exists(own)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, own = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(own)) if fs.exists(own) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a string."""
    fs, own = _fs(spark, path)
    stream = fs.open(own)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A small file under its name only when it is whole: written aside and renamed."""
    fs, own = _fs(spark, path)
    aside = own.suffix(".new")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(own) or not fs.rename(aside, own):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, own = _fs(spark, path)
    fs.delete(own, True)
