"""Sharding along a Hilbert curve: metadata dimensions are quantised by quantiles over all rows, rows are sorted by their
index on the curve, and the sorted rows are cut into runs of equal counts. Rows close in all dimensions share few files,
so a reader prunes by any of them. Whole strings are quantised: each value has a cell of its own, or if there are more values
than cells, cells hold runs of values with about equal counts of rows. Quantiles of numbers are approximate.

Cases: null text counts as empty; a null dimension sorts before all values; very long texts only give a size and hashes; ties on the curve are ordered by the text's hash, then doc_id, so equal
texts of equal metadata are neighbours, and a hot cell is cut like any other run; repeated rows keep a place each; an empty
table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut_lineage


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def string_splitters(rows: DataFrame, column: str, cells: int) -> list[str]:
    """The values that begin a cell, in order; `cells` at most come to the driver."""
    spark, parts = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(counts.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("p", F.spark_partition_id()))
    before, values, total = [], 0, 0
    for r in placed.groupBy("p").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")).orderBy("p").collect():
        before.append((r["p"], values, total))
        values, total = values + r["values"], total + r["n"]
    own = Window.partitionBy("p").orderBy("value")
    ranked = placed.join(F.broadcast(spark.createDataFrame(before, "p int, values long, rows long")), "p")
    if values <= cells:
        cell = F.col("values") + F.row_number().over(own)
    else:
        cell = F.floor((F.col("rows") + F.sum("n").over(own) - F.col("n")) * F.lit(cells) / F.lit(total))
    return sorted(r["v"] for r in ranked.withColumn("cell", cell).groupBy("cell").agg(F.min("value").alias("v")).collect())


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of rows of cells (each dimension below 2**bits), by transposing and Gray-decoding the axes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the top bit down
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve(rows: DataFrame, dimensions: list[str], bits: int) -> Column:
    """The index of each row, its dimensions quantised over all rows: strings by their values, numbers by quantiles. A null
    has cell 0."""
    strings = [isinstance(rows.schema[d].dataType, StringType) for d in dimensions]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [F.percentile_approx(d, shares, 2000).alias(d) for d, text in zip(dimensions, strings, strict=True) if not text]
    found = rows.agg(*numbers).first() if numbers else None
    splitters = [np.array(string_splitters(rows, d, (1 << bits) - 1), object) if text else np.unique(np.array(found[d] or [0.0])) for d, text in zip(dimensions, strings, strict=True)]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        cells = []
        for of, c, text in zip(splitters, columns, strings, strict=True):
            if text:
                at, values = pd.factorize(c)  # a null is -1, which takes the last place
                cell = np.append(np.searchsorted(of, values.to_numpy(object), "right"), 0)[at]
            else:
                cell = np.searchsorted(of, c.fillna(-np.inf).to_numpy(), "left")
            cells.append(cell * ((1 << bits) - 1) // max(1, len(of)))  # over the whole range, so that few values count as much
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return index(*dimensions)


def global_rank(rows: DataFrame, order: list[str], column: str = "rank") -> tuple[DataFrame, int]:
    """Rows with their place (from 0) in the total order, and how many there are: range partitions, sorted, written once;
    only the partitions' counts come to the driver."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    counts = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    offsets = spark.createDataFrame(before, "p long, before long")
    ranked = placed.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(offsets), "p").withColumn(column, F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    return ranked.drop("p", "at", "before"), total


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 8, dimensions: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot: counts of shards differ by one at most. The size is a dimension too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), *[F.col(d).alias(f"d{k}") for k, d in enumerate(dimensions)]).withColumn("d_size", F.col("size").cast("double"))
    names = [*[f"d{k}" for k in range(len(dimensions))], "d_size"]
    ranked, total = global_rank(rows.withColumn("curve", curve(rows, names, bits)).drop(*names), ["curve", "hash", "doc_id", "size"])
    # exact in integers: the first rank of shard s is ceil(s * total / shards)
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).drop("hash", "rank")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Files by shard, sorted along the curve, for documents with distinct ids."""
    placed.select("doc_id", "shard", "slot").join(docs, "doc_id").repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
