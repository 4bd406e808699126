"""Small driver-side file operations through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: a temporary file takes the place of the old one in a single rename."""
    fs, p, jvm = _at(spark, path)
    p = fs.makeQualified(p)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{p.toString()}.{uuid.uuid4().hex}.new")
    fs.mkdirs(p.getParent())
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, p, how)


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=1, sort_keys=True))


def delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _at(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in a folder that all executors share, spark.checkpoint.dir or else the warehouse, for a table that a
    lazy result reads; it goes when the application ends."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{where}/{name}-{uuid.uuid4().hex}"
    fs, p, _ = _at(spark, path)
    fs.deleteOnExit(p)
    return path


def children(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a directory, bytes), sorted by name; none if the path is missing."""
    fs, p, _ = _at(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p))


def grandchildren(spark: SparkSession, path: str) -> list[tuple[str, str, bool, int]]:
    """(folder, name, is a directory, bytes) of what the folders of a folder hold, sorted, from one call for all of them."""
    fs, p, jvm = _at(spark, path)
    if not fs.exists(p):
        return []
    found = fs.listStatus(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(p)))
    return sorted((*s.getPath().toString().rsplit("/", 2)[1:], s.isDirectory(), s.getLen()) for s in found)
