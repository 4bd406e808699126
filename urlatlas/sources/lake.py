"""The lake of canonical URLs: Parquet by dataset and by the first digits of the domain's hash."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..config import Settings

SCHEMA = "domain_id BIGINT, url_id BIGINT, scheme STRING, host STRING, path_query STRING, domain STRING, dataset_id INT, domain_prefix STRING"
PARTITION = ("dataset_id", "domain_prefix")
STORED = [c.split()[0] for c in SCHEMA.split(", ")][:-2]


def root(base: str) -> str:
    return f"{base}/urls"


def check_schema(df: DataFrame) -> None:
    kinds = dict(df.dtypes)
    for name, kind in (c.split() for c in SCHEMA.split(", ")):
        if name not in kinds:
            raise ValueError(f"missing required columns: {name}")
        if kinds[name] != kind.lower():
            raise ValueError(f"column {name} has type {kinds[name]}, not {kind.lower()}")


def write(df: DataFrame, base: str, settings: Settings = Settings(), mode: str = "append", dataset_id: int | None = None) -> None:
    """Rows are dealt by partition; a partition with very many rows is split rather than left to one task. Files are sorted
    by domain, so that row groups can be skipped by it. `mode` overwrite replaces only the partitions that `df` has."""
    check_schema(df)
    if dataset_id is not None:
        df = df.where(F.col("dataset_id") == dataset_id)
    options = {"compression": settings.compression, "parquet.compression.codec.zstd.level": settings.compression_level, "parquet.block.size": settings.row_group_bytes, "maxRecordsPerFile": settings.max_records_per_file, "partitionOverwriteMode": "dynamic"}
    ready = df.select(*STORED, *PARTITION).hint("rebalance", *PARTITION).sortWithinPartitions(*PARTITION, "domain")
    ready.write.options(**options).mode(mode).partitionBy(*PARTITION).parquet(root(base))


def read(spark: SparkSession, base: str) -> DataFrame:
    """All URLs. The schema is given: inferred partition values would turn prefixes such as 3d into numbers."""
    if not files.exists(spark, root(base)):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(root(base))


def read_files(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    """The URLs of these files, by their paths below the base; nothing else is listed or opened."""
    if not paths:
        return read(spark, base).where(F.lit(False))
    return spark.read.schema(SCHEMA).option("basePath", root(base)).parquet(*[f"{base}/{p}" for p in paths])


def replace(df: DataFrame, base: str, dataset_id: int, settings: Settings = Settings()) -> None:
    """The dataset's rows are those of `df` afterwards: its files of before go when the new ones are there."""
    spark = df.sparkSession
    old = list(files_of(spark, base, dataset_id))
    write(df, base, settings, "append", dataset_id)
    for path in old:
        files.delete(spark, path)


def partitions(spark: SparkSession, base: str, dataset_id: int | None = None) -> list[tuple[int, str]]:
    """(dataset, prefix) in order, empty folders too; other folders don't count."""
    out = []
    for name, folder, _ in files.children(spark, root(base)):
        if folder and (m := re.fullmatch(r"dataset_id=(\d+)", name)) and dataset_id in (None, int(m[1])):
            out += [(int(m[1]), p[1]) for child, inner, _ in files.children(spark, f"{root(base)}/{name}") if inner and (p := re.fullmatch(r"domain_prefix=(.+)", child))]
    return sorted(out)


def partition_path(base: str, dataset_id: int, prefix: str) -> str:
    return f"{root(base)}/dataset_id={dataset_id}/domain_prefix={prefix}"


def _is_part(name: str, folder: bool) -> bool:
    return not folder and name.startswith("part-") and name.endswith(".parquet")


def partition_files(spark: SparkSession, base: str, dataset_id: int, prefix: str) -> list[tuple[str, int]]:
    return [(name, size) for name, folder, size in files.children(spark, partition_path(base, dataset_id, prefix)) if _is_part(name, folder)]


def listing(spark: SparkSession, base: str, dataset_id: int | None = None) -> Iterator[tuple[int, str, list[tuple[str, int]]]]:
    """(dataset, prefix, names and bytes of its files) of each of `partitions`; the store is asked once for a dataset, not
    once for a partition."""
    held: dict[str, list[tuple[str, int]]] = {}
    last = None
    for d, p in partitions(spark, base, dataset_id):
        if d != last:
            held, last = defaultdict(list), d
            for parent, name, folder, size in files.grandchildren(spark, f"{root(base)}/dataset_id={d}"):
                if _is_part(name, folder):
                    held[parent].append((name, size))
        yield d, p, held.get(f"domain_prefix={p}", [])


def files_of(spark: SparkSession, base: str, dataset_id: int) -> dict[str, int]:
    """Paths of a dataset's files, with their sizes in bytes."""
    return {f"{partition_path(base, d, p)}/{name}": size for d, p, found in listing(spark, base, dataset_id) for name, size in found}


def read_partition(spark: SparkSession, base: str, dataset_id: int, prefix: str) -> DataFrame:
    if not files.exists(spark, partition_path(base, dataset_id, prefix)):
        raise FileNotFoundError(partition_path(base, dataset_id, prefix))
    return read(spark, base).where((F.col("dataset_id") == dataset_id) & (F.col("domain_prefix") == prefix)).select(*STORED)


def storage_stats(spark: SparkSession, base: str) -> dict:
    """Partitions (empty ones too), files and bytes, in all and by dataset."""
    out = {"partitions": 0, "files": 0, "bytes": 0, "datasets": {}}
    for dataset_id, _, found in listing(spark, base):
        own = out["datasets"].setdefault(dataset_id, {"partitions": 0, "files": 0})
        for x in (out, own):
            x["partitions"] += 1
            x["files"] += len(found)
        out["bytes"] += sum(size for _, size in found)
    return out
