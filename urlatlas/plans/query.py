"""Queries over the lake and a version of its index."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import ids, suffixes, urls
from ..operators.index import index_path, read_table, relative
from ..operators.manifest import Manifest
from ..sources import lake


#: Files that are read by name.
MOST_PATHS = 1000


class NotFound(ValueError):
    """A domain that no dataset has, or that a dataset doesn't have."""


class QueryService:
    """Reads one version, the current one by default, as long as it lives."""

    def __init__(self, spark: SparkSession, base: str, version: str | None = None, settings: Settings = Settings()):
        manifest = Manifest(spark, base)
        found = manifest.get(version) if version else manifest.current()
        if not found:
            raise RuntimeError(f"no index in {base}")
        self.spark, self.base, self.version, self.settings = spark, base, found.version, settings
        self.domain_id = lru_cache(1000)(self._domain_id)
        self.domain = lru_cache(1000)(self._domain)
        self.file = lru_cache(1000)(self._file)
        self.file_id = lru_cache(1000)(self._file_id)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, self.version, name)

    def _domain_id(self, domain: str) -> int | None:
        row = self.table("domains").where(F.col("domain") == domain).select("domain_id").first()
        return row and row[0]

    def _domain(self, domain_id: int) -> str | None:
        row = self.table("domains").where(F.col("domain_id") == domain_id).select("domain").first()
        return row and row[0]

    def _file(self, file_id: int) -> tuple[int, str, str] | None:
        """(dataset_id, domain_prefix, path) of a file; none for an unknown id."""
        row = self.table("files").where(F.col("file_id") == file_id).select("dataset_id", "domain_prefix", "path").first()
        return row and tuple(row)

    def _file_id(self, path: str) -> int | None:
        row = self.table("files").where(F.col("path") == path).select("file_id").first()
        return row and row[0]

    def _known(self, domain: str) -> int:
        found = self.domain_id(domain)
        if found is None:
            raise NotFound(f"Domain not found: {domain}")
        return found

    def datasets_for_domain(self, domain: str) -> DataFrame:
        """dataset_id in order, and the URLs it has of the domain. The domain is matched as it is; see `registered`."""
        return self.table("counts").where(F.col("domain_id") == self._known(domain)).select("dataset_id", "urls").orderBy("dataset_id")

    def postings(self, domain: str, dataset_id: int) -> list[tuple[int, int]]:
        row = self.table("postings").where((F.col("domain_id") == self._known(domain)) & (F.col("dataset_id") == dataset_id)).first()
        return [(r["file_id"], r["row_group"]) for r in row["refs"]] if row else []

    def _rows(self, domain: str, dataset_id: int) -> DataFrame:
        if not self.table("membership").where((F.col("domain_id") == self._known(domain)) & F.array_contains("dataset_ids", dataset_id)).limit(1).count():
            raise NotFound(f"dataset {dataset_id} does not contain domain {domain}")
        # the files that the postings name; where they are very many, the domain's partition
        prefix = ids.prefix_of(domain, self.settings.prefix_digits)
        held = sorted({file_id for file_id, _ in self.postings(domain, dataset_id)})
        names = self.table("files").where((F.col("dataset_id") == dataset_id) & (F.col("domain_prefix") == prefix)).select("path", "file_id")
        if len(held) <= MOST_PATHS:
            names = names.where(F.col("file_id").isin(held))
            rows = lake.read_files(self.spark, self.base, [r["path"] for r in names.collect()])
        else:
            rows = lake.read(self.spark, self.base).where((F.col("dataset_id") == dataset_id) & (F.col("domain_prefix") == prefix))
        rows = rows.where(F.col("domain") == domain)
        placed = rows.select("url_id", urls.rebuilt(F.col("scheme"), F.col("host"), F.col("path_query")).alias("url"), relative(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.row_index").alias("row"))
        return placed.join(F.broadcast(names), "path")

    def urls_page(self, domain: str, dataset_id: int, offset: int = 0, limit: int | None = None) -> tuple[DataFrame, int | None]:
        """A page of (url_id, url) in the order of files and rows, and the next offset if the page is full."""
        limit = self._limits(offset, limit)
        page = self._rows(domain, dataset_id).orderBy("file_id", "row").offset(offset).limit(limit).select("url_id", "url")
        rows = page.collect()  # a page is bounded
        out = self.spark.createDataFrame(rows, page.schema)
        return out, offset + limit if len(rows) == limit else None

    def urls_after(self, domain: str, dataset_id: int, last: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
        """A page after a (file_id, row), however deep, at the cost of the first page: file_id, row, url_id, url."""
        rows = self._rows(domain, dataset_id)
        if last:
            rows = rows.where((F.col("file_id") > last[0]) | ((F.col("file_id") == last[0]) & (F.col("row") > last[1])))
        return rows.orderBy("file_id", "row").limit(self._limits(0, limit)).select("file_id", "row", "url_id", "url")

    def _limits(self, offset: int, limit: int | None) -> int:
        limit = self.settings.default_limit if limit is None else limit
        if offset < 0 or not 1 <= limit <= self.settings.most_limit:
            raise IndexError(f"offset must not be negative, limit from 1 to {self.settings.most_limit}")
        return limit

    def registered(self, host: str) -> str:
        """The domain to ask for, given any host."""
        return suffixes.load(self.settings.suffix_list).registered(ids.ascii_host(host.strip().lower()))

    def allowed(self, datasets: DataFrame, acl: DataFrame) -> DataFrame:
        """Only datasets that the caller's list of dataset_id has."""
        return datasets.join(acl.select("dataset_id"), "dataset_id", "left_semi")

    def materialise_top(self, k: int = 1000) -> None:
        """Stores the k most frequent URLs of each domain and dataset beside the version's tables, sorted for point queries."""
        rows = lake.read(self.spark, self.base).select("domain", "dataset_id", urls.rebuilt(F.col("scheme"), F.col("host"), F.col("path_query")).alias("url"))
        counted = rows.groupBy("domain", "dataset_id", "url").agg(F.count(F.lit(1)).alias("n"))
        best = top_k(counted, ["domain", "dataset_id"], [F.desc("n"), F.asc("url")], k)
        best.repartitionByRange("domain", "dataset_id", "rank").sortWithinPartitions("domain", "dataset_id", "rank").write.mode("overwrite").option("compression", "zstd").parquet(index_path(self.base, self.version, "top_urls"))

    def top_urls(self, domain: str, dataset_id: int) -> DataFrame:
        """url, n, rank from the stored top URLs (see `materialise_top`)."""
        return self.table("top_urls").where((F.col("domain") == domain) & (F.col("dataset_id") == dataset_id)).select("url", "n", "rank")

    def top_paths(self, k: int = 10) -> DataFrame:
        """The k most frequent paths of each domain and dataset."""
        counted = lake.read(self.spark, self.base).groupBy("domain", "dataset_id", F.substring_index("path_query", "?", 1).alias("path")).agg(F.count(F.lit(1)).alias("n"))
        return top_k(counted, ["domain", "dataset_id"], [F.desc("n"), F.asc("path")], k)


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Spark keeps k rows of a group in each task before it deals them (WindowGroupLimit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
