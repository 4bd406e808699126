"""From raw URLs to rows of the lake, in one pass without a shuffle; only the write deals rows by partition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import ids, suffixes
from ..functions.urls import parse as components
from ..sources import inputs, lake
from .registry import DatasetRegistry

#: Reasons for which a URL can't be stored.
REASONS = ("null", "empty", "no host", "bad port")


@dataclass
class Ingested:
    """What an ingest did: rows read, those left out by reason, rows stored, and the files that the dataset has gained."""

    name: str
    dataset_id: int
    rows: int = 0
    stored: int = 0
    rejected: dict[str, int] = field(default_factory=dict)
    files: int = 0
    bytes: int = 0


def normalise(df: DataFrame, dataset_id: int | Column, settings: Settings = Settings(), counts: Observation | None = None) -> DataFrame:
    """Rows of the lake. URLs that can't be stored are left out (see `rejected`); repeated URLs stay. `counts` gets the rows
    read and the rows of each reason while they pass, without a read of its own."""
    dataset = F.lit(dataset_id) if isinstance(dataset_id, int) else dataset_id
    parts = components(df.select("url", dataset.cast("int").alias("dataset_id")))
    if counts is not None:
        parts = parts.observe(counts, *_tally())
    named = parts.where(F.col("reject_reason").isNull()).withColumn("id", ids.named(suffixes.load(settings.suffix_list))("host")).withColumn("url_id", ids.url_id("url"))
    return named.select(
        F.col("id.domain_id").alias("domain_id"), "url_id", "scheme", F.col("id.host").alias("host"), "path_query",
        F.col("id.domain").alias("domain"), "dataset_id", ids.prefix(F.col("id.domain_id"), settings.prefix_digits).alias("domain_prefix"),
    )


def _tally() -> list[Column]:
    """Rows, and rows of each reason."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS]]


def rejected(df: DataFrame) -> DataFrame:
    """URLs that can't be stored, and why."""
    return components(df.select("url")).select("url", F.col("reject_reason").alias("reason")).where(F.col("reason").isNotNull())


def ingest_counted(spark: SparkSession, df: DataFrame, name: str, base: str, settings: Settings = Settings(), mode: str = "append") -> Ingested:
    """Registers a dataset and writes its URLs. `mode` overwrite replaces all that the dataset had. Counts are taken while the
    rows pass; where a lost executor has rows read again, they may count twice. Where nothing is stored, rows are counted by
    a read of their own."""
    inputs.validate(df, ("url",))
    out = Ingested(name, DatasetRegistry(spark, base).register(name))
    before = lake.files_of(spark, base, out.dataset_id)
    counts = Observation()
    rows = normalise(df, out.dataset_id, settings, counts)
    if mode == "overwrite":
        lake.replace(rows, base, out.dataset_id, settings)
    else:
        lake.write(rows, base, settings, mode)
    new = {path: size for path, size in lake.files_of(spark, base, out.dataset_id).items() if path not in before}
    out.files, out.bytes = len(new), sum(new.values())
    # where no row is left for the write, adaptive execution drops the plan below it, and the counts with it
    got = counts.get if new else components(df.select("url")).agg(*_tally()).first().asDict()
    out.rows, out.rejected = got["rows"], {r: got[r] for r in REASONS if got[r]}
    out.stored = out.rows - sum(out.rejected.values())
    return out


def ingest(spark: SparkSession, df: DataFrame, name: str, base: str, settings: Settings = Settings(), mode: str = "append") -> int:
    """As `ingest_counted`; gives the dataset's id."""
    return ingest_counted(spark, df, name, base, settings, mode).dataset_id


def already_ingested(spark: SparkSession, name: str, base: str) -> bool:
    known = DatasetRegistry(spark, base).to_dict()
    return name in known and bool(lake.partitions(spark, base, known[name]))
