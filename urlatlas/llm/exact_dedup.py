"""Exact dedup by content sort: sampled splitters range-partition the texts by their first 32 characters and a hash, an
external sort by the whole text brings equal texts together, and comparing whole neighbours finds the groups. DataFrame
functions only.

Texts of which a partition's fair share or more are copies are hot: their rows go to several ranges by a salt, and the
groups of the salts (few rows) are joined afterwards. Only the hot texts' 64-bit hashes are broadcast, fewer than
`hot_share` times the number of shuffle partitions.

Cases: null text counts as empty; the row with the largest (or smallest) doc_id stays, null ids last; of repeated rows with
the same id and text one is kept (copies of a hot text that share one id, or have none, share one salt); very long texts are
sorted whole; extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_copies(docs: DataFrame, normalise=lambda text: text, keep: str = "largest", hot_share: int = 4, least_hot: int = 500) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns of `docs` as struct `row`."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = F.max if keep == "largest" else F.min
    order: Column = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    rows = docs.select("doc_id", normalise(F.coalesce(F.col("text"), F.lit(""))).alias("norm"), F.struct(*others).alias("row")).withColumn("h", F.xxhash64("norm"))
    limit = max(least_hot, docs.count() // (hot_share * parts))
    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    hot = copies.select("h", F.ceil(F.col("n") / limit).cast("int").alias("ways"))
    salt = F.when(F.col("ways").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int"))
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", salt).drop("ways", "h")

    # The sampled splitters hold a bounded head of the text and a hash, so that they stay small on the driver; whole texts
    # are sorted and compared behind them.
    near = rows.withColumn("head", F.substring("norm", 1, 32)).withColumn("tail_hash", F.xxhash64("norm")).repartitionByRange(parts, "head", "tail_hash", "salt").sortWithinPartitions("head", "tail_hash", "norm", "salt", order)
    equal = Window.partitionBy("head", "tail_hash", "norm", "salt")  # a range holds all rows of a key: no further exchange
    runs = near.select(
        "doc_id", "row", "norm", "salt", best("doc_id").over(equal).alias("keep_id"), F.count(F.lit(1)).over(equal).alias("group_size"),
        F.row_number().over(equal.orderBy(order)).alias("nth"),
    ).withColumn("text_sha256", F.sha2("norm", 256))
    single = runs.where("salt = -1").select("doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "text_sha256", "norm", "row")
    leaders = runs.where("salt >= 0 and nth = 1").groupBy("text_sha256").agg(best("keep_id").alias("k"), F.sum("group_size").alias("g"), best(F.struct(F.col("keep_id"), F.col("salt")))["salt"].alias("s"))
    salted = runs.where("salt >= 0").join(F.broadcast(leaders), "text_sha256").select("doc_id", F.col("k").alias("keep_id"), F.col("g").alias("group_size"), ((F.col("nth") == 1) & (F.col("salt") == F.col("s"))).alias("kept"), "text_sha256", "norm", "row")
    return single.unionByName(salted)
