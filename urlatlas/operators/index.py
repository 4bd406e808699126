"""Versioned index tables over the lake, each an aggregation of one scan.

Tables of a version, under index/<version>/: `domains` (domain, domain_id, dense and in order), `membership` (domain_id,
dataset ids in order), `postings` (domain_id, dataset_id, the file and row group pairs that hold it), `files` (file_id, path
and partition), `counts` (domain_id, dataset_id, urls). An incremental version reads new files only and keeps old ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..config import Settings
from ..functions import ids
from ..sources import lake
from .manifest import IndexVersion, Manifest

#: Files that are read by name, and whose row groups are broadcast.
MOST_PATHS = 20_000
TABLES = ("domains", "membership", "postings", "files", "counts")


def index_path(base: str, version: str, table: str) -> str:
    return f"{base}/index/{version}/{table}"


def dense_ids(df: DataFrame, key: str, column: str, first: int = 0) -> DataFrame:
    """Adds first, first + 1, ... in the order of a column of distinct values: range partitions, each numbered by itself,
    and the sizes of those before it. Only the sizes pass through one task. The ranges are sampled, so the numbered rows are
    written once and read from there: a persisted table isn't found again below a union with one inside, as `union` merges
    the two, and other ranges than those that were counted give wrong ids."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    path = files.scratch(spark, "dense-ids")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("at", 33).alias("p")).count().withColumnRenamed("count", "n").collect()}
    before, total = [], first
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(before, "p long, before long")
    return placed.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(offsets), "p").withColumn(column, F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("p", "at", "before")


def relative(path) -> F.Column:
    return F.regexp_extract(path, r"(urls/dataset_id=.*)$", 1)


def lake_files(spark: SparkSession, base: str) -> DataFrame:
    """path, dataset_id, domain_prefix of the lake's files."""
    found = [(f"urls/dataset_id={d}/domain_prefix={p}/{name}", d, p) for d, p, held in lake.listing(spark, base) for name, _ in held]
    return spark.createDataFrame(found, "path string, dataset_id int, domain_prefix string")


def row_group_starts(base: str, paths: DataFrame) -> DataFrame:
    """path, row_group, first and last row of each row group, from the files' footers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            out = []
            for path in b["path"]:
                where = f"{base}/{path}"
                if re.match(r"^[a-z0-9]+://", where):
                    store, inner = fs.FileSystem.from_uri(where)
                else:
                    store, inner = fs.LocalFileSystem(), where.removeprefix("file:")
                with store.open_input_file(inner) as f:
                    meta, at = pq.ParquetFile(f).metadata, 0
                    for g in range(meta.num_row_groups):
                        n = meta.row_group(g).num_rows
                        out.append((path, g, at, at + n - 1))
                        at += n
            yield pd.DataFrame(out, columns=["path", "row_group", "first", "last"])

    return paths.select("path").repartition(max(1, min(200, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).mapInPandas(run, "path string, row_group int, first long, last long")


def facts(spark: SparkSession, base: str, known: DataFrame, by_name: bool = False) -> DataFrame:
    """domain, dataset_id, path, row_group, urls of the known files, one row for each that has any. `by_name`: the files are
    read by their names, those of an incremental build; else the lake is read whole."""
    count = known.count()
    if by_name and count <= MOST_PATHS:
        rows = lake.read_files(spark, base, [r["path"] for r in known.select("path").toLocalIterator()])
    elif by_name:  # very many new files: their datasets' folders
        own = [r["dataset_id"] for r in known.select("dataset_id").distinct().collect()]
        rows = lake.read(spark, base).where(F.col("dataset_id").isin(own))
    else:
        rows = lake.read(spark, base)
    rows = rows.select("domain", "dataset_id", relative(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.row_index").alias("row"))
    groups = row_group_starts(base, known).groupBy("path").agg(F.sort_array(F.collect_list("last")).alias("lasts"))
    groups = F.broadcast(groups) if count <= MOST_PATHS else groups
    # the row group's number is how many row groups end before the row; other files than the known ones drop out
    placed = rows.join(groups, "path").withColumn("row_group", F.size(F.filter("lasts", lambda x: x < F.col("row"))).cast("int"))
    return placed.groupBy("domain", "dataset_id", "path", "row_group").agg(F.count(F.lit(1)).alias("urls"))


def membership(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("domain_id").agg(F.sort_array(F.collect_set("dataset_id")).alias("dataset_ids"))


def postings(refs: DataFrame) -> DataFrame:
    return refs.groupBy("domain_id", "dataset_id").agg(F.sort_array(F.collect_set(F.struct("file_id", "row_group"))).alias("refs"))


def _write(df: DataFrame, base: str, version: str, table: str, key: str) -> None:
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(index_path(base, version, table))


def read_table(spark: SparkSession, base: str, version: str, table: str) -> DataFrame:
    return spark.read.parquet(index_path(base, version, table))


def new_version_id(manifest: Manifest) -> str:
    """Without colons, which Hadoop's globs don't take; never the same twice."""
    now = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S_%fZ")
    while manifest.get(now):
        now = now[:-1] + "xZ"
    return now


def build(spark: SparkSession, base: str, settings: Settings = Settings(), incremental: bool = False, dataset_ids: list[int] | None = None) -> str:
    """Builds and publishes a version; gives its id. Incremental: the previous version itself if there are no new files, a
    full build if there is no previous one. `dataset_ids` restricts the domains of a full build."""
    manifest = Manifest(spark, base)
    old = manifest.current() if incremental else None
    present, table = lake_files(spark, base), lambda name: read_table(spark, base, old.version, name)
    if old:
        before = table("files")
        new = present.join(before.select("path"), "path", "left_anti")
        if not new.limit(1).count():
            return old.version
        start = 1 + (before.agg(F.max("file_id")).first()[0] if before.limit(1).count() else -1)
    else:
        new, start = present, 0
    version = new_version_id(manifest)
    numbered = dense_ids(new, "path", "file_id", start)
    _write((table("files").unionByName(numbered) if old else numbered).select("file_id", "dataset_id", "domain_prefix", "path"), base, version, "files", "file_id")
    numbered = read_table(spark, base, version, "files").where(F.col("file_id") >= start)

    if not files.exists(spark, lake.root(base)):
        found = spark.createDataFrame([], "domain string, dataset_id int, path string, row_group int, urls long")
    else:
        found = facts(spark, base, numbered, by_name=bool(old))
    found = found.persist()
    try:
        names = found if dataset_ids is None or old else found.where(F.col("dataset_id").isin(dataset_ids))
        names = names.select("domain").distinct()
        if old:
            domains = table("domains")
            first = 1 + (domains.agg(F.max("domain_id")).first()[0] if domains.limit(1).count() else -1)
            names = domains.unionByName(dense_ids(names.join(domains.select("domain"), "domain", "left_anti"), "domain", "domain_id", first))
        else:
            names = dense_ids(names, "domain", "domain_id")
        _write(names.select("domain", "domain_id"), base, version, "domains", "domain")
        known = read_table(spark, base, version, "domains")
        keyed = found.join(known, "domain")
        pairs = keyed.select("domain_id", "dataset_id").distinct()
        refs = keyed.join(numbered.select("path", "file_id"), "path").select("domain_id", "dataset_id", F.col("file_id").cast("int").alias("file_id"), "row_group")
        counts = keyed.groupBy("domain_id", "dataset_id").agg(F.sum("urls").alias("urls"))
        if old:
            pairs = pairs.unionByName(table("membership").select("domain_id", F.explode("dataset_ids").alias("dataset_id")))
            refs = refs.unionByName(table("postings").select("domain_id", "dataset_id", F.inline("refs")))
            counts = counts.unionByName(table("counts")).groupBy("domain_id", "dataset_id").agg(F.sum("urls").alias("urls"))
        _write(membership(pairs), base, version, "membership", "domain_id")
        _write(postings(refs), base, version, "postings", "domain_id")
        _write(counts, base, version, "counts", "domain_id")
    finally:
        found.unpersist()
    manifest.publish(IndexVersion(version=version, created_at=version, tables={t: f"index/{version}/{t}" for t in TABLES}, postings_shards=settings.postings_shards))
    return version


def build_stats(spark: SparkSession, base: str, version: str, shards: int) -> dict[str, int]:
    def of(name: str, value) -> int:
        path = index_path(base, version, name)
        return int(spark.read.parquet(path).agg(value).first()[0] or 0) if files.exists(spark, path) else 0

    return {
        "num_domains": of("domains", F.count(F.lit(1))), "num_files": of("files", F.count(F.lit(1))),
        "num_domain_dataset_pairs": of("membership", F.sum(F.size("dataset_ids"))),
        "num_postings_shards": of("postings", F.count_distinct(ids.shard(F.col("domain_id"), shards))),
    }
