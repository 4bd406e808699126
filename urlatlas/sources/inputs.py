"""Inputs of an ingest: local or remote files of URLs, lists of dataset names, and what they must look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import files

FORMATS = {".parquet": ("parquet", {}), ".csv": ("csv", {"header": True}), ".tsv": ("csv", {"header": True, "sep": "\t"}), ".json": ("json", {}), ".jsonl": ("json", {})}


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its extension; it must have a `url` column."""
    for end, (kind, options) in FORMATS.items():
        if path.rstrip("/").endswith(end):
            df = spark.read.options(**options).format(kind).load(path)
            if "url" not in df.columns:
                raise ValueError(f"{path} has no column url")
            return df
    raise ValueError(f"unknown kind of file: {path}")


def validate(df: DataFrame, columns: tuple[str, ...] = ("url", "domain")) -> None:
    kinds = dict(df.dtypes)
    if missing := [c for c in columns if c not in kinds]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if wrong := [c for c in columns if kinds[c] != "string"]:
        raise ValueError(f"columns must be strings: {', '.join(wrong)}")


def read_names(spark: SparkSession, path: str, suffix: str = "", user: str | None = None) -> list[str]:
    """Dataset names, one a line; # begins a comment, a user before the name goes, a missing suffix is added."""
    text = files.read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    names = []
    for line in text.splitlines():
        name = line.split("#")[0].strip()
        if not name:
            continue
        owner, _, name = name.rpartition("/")
        if owner and user and owner != user:
            print(f"{owner}/{name}: another user than {user}")
        names.append(name if not suffix or name.endswith(suffix) else name + suffix)
    if not names:
        raise ValueError(f"{path} has no names")
    return names
