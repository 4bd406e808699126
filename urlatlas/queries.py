"""Queries of the engine over the test corpus, and DuckDB's SQL for each that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .corpus import CORPUS_SQL, VOLUME_SQL, corpus
from .functions import ids, suffixes, urls
from .operators import index, ingest
from .plans.query import QueryService, top_k
from .sources import lake, tables


def datasets(rows: DataFrame) -> DataFrame:
    """Dense ids of dataset names, in order."""
    return index.dense_ids(rows.select("dataset").distinct(), "dataset", "dataset_id")


def normalised(spark: SparkSession, sf_dir: str, sql: str = CORPUS_SQL) -> DataFrame:
    """The corpus's components with the registered domain; rejected rows too."""
    parts = ingest.components(corpus(spark, sf_dir, sql))
    named = parts.withColumn("id", ids.named(suffixes.load())("host")).withColumn("url_id", ids.url_id("url"))
    return named.withColumn("domain", F.col("id.domain")).withColumn("host", F.col("id.host")).withColumn("domain_hash", F.col("id.domain_id")).drop("id")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir).where(F.col("reject_reason").isNull())


def domain_ids(rows: DataFrame) -> DataFrame:
    return index.dense_ids(rows.select("domain").distinct(), "domain", "domain_id")


def _text(column: str | Column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def normalize_components(spark, sf_dir):
    return normalised(spark, sf_dir).where(F.col("reject_reason").isNull()).select("dataset", "row_id", "scheme", "host", "port", "path", "query")


def canonical_url(spark, sf_dir):
    c = F.col
    return stored(spark, sf_dir).select("dataset", "row_id", "path_query", urls.canonical(c("scheme"), c("host"), c("port"), c("path"), c("query")).alias("canonical"), urls.rebuilt(c("scheme"), c("host"), c("path_query")).alias("rebuilt"))


def registered_domain(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("host", "domain").agg(F.count(F.lit(1)).alias("urls"))


def rejected_rows_by_reason(spark, sf_dir):
    return ingest.components(corpus(spark, sf_dir)).where(F.col("reject_reason").isNotNull()).groupBy("dataset", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


def url_dedup_counts(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("distinct_urls"), F.count_distinct("host", "path_query").alias("distinct_pages"))


def dataset_registry(spark, sf_dir):
    return datasets(corpus(spark, sf_dir))


def distinct_domains(spark, sf_dir):
    return stored(spark, sf_dir).select("domain").distinct()


def domain_dictionary(spark, sf_dir):
    return domain_ids(stored(spark, sf_dir))


def _pairs(spark, sf_dir) -> DataFrame:
    """Distinct domains of each dataset, by ids; the corpus is read once."""
    pairs = stored(spark, sf_dir).select("domain", "dataset").distinct().persist()
    return pairs.join(domain_ids(pairs), "domain").join(F.broadcast(datasets(corpus(spark, sf_dir))), "dataset")


def domain_membership(spark, sf_dir):
    return index.membership(_pairs(spark, sf_dir)).select("domain_id", _text("dataset_ids").alias("dataset_ids"), F.size("dataset_ids").cast("long").alias("datasets"))


def datasets_for_domain(spark, sf_dir):
    return stored(spark, sf_dir).where(F.col("domain") == "example.com").groupBy("dataset").agg(F.count(F.lit(1)).alias("urls"))


def domain_dataset_url_counts(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("domain", "dataset").agg(F.count(F.lit(1)).alias("urls"))


def index_stats(spark, sf_dir):
    return stored(spark, sf_dir).agg(F.count_distinct("domain").alias("num_domains"), F.count_distinct("domain", "dataset").alias("num_pairs"), F.count(F.lit(1)).alias("num_urls"))


def _page(offset: int, limit: int):
    def run(spark, sf_dir):
        rows = stored(spark, sf_dir).where((F.col("domain") == "example.co.uk") & (F.col("dataset") == "events-click"))
        return rows.select("row_id", urls.rebuilt(F.col("scheme"), F.col("host"), F.col("path_query")).alias("url")).orderBy("row_id").offset(offset).limit(limit)

    return run


def _new_domains(rows: DataFrame) -> DataFrame:
    return rows.where("half = 1").select("domain").distinct().join(rows.where("half = 0").select("domain").distinct(), "domain", "left_anti")


def _halves(spark, sf_dir) -> DataFrame:
    """The domains of even rows and those of odd ones."""
    return stored(spark, sf_dir).select("domain", (F.col("row_id") % 2).alias("half")).distinct()


def new_domains_antijoin(spark, sf_dir):
    return _new_domains(_halves(spark, sf_dir).persist())


def incremental_dictionary(spark, sf_dir):
    """Ids of the even rows' domains stay; new ones follow in order."""
    rows = _halves(spark, sf_dir).persist()
    old = domain_ids(rows.where("half = 0"))
    first = old.agg(F.count(F.lit(1))).first()[0]
    new = index.dense_ids(_new_domains(rows), "domain", "domain_id", first)
    rows.unpersist()
    return old.select("domain", "domain_id").unionByName(new)


def incremental_membership(spark, sf_dir):
    """The union of both halves' memberships is that of the whole."""
    rows = stored(spark, sf_dir)
    half = lambda k: rows.where(f"row_id % 2 = {k}").groupBy("domain").agg(F.collect_set("dataset").alias("d"))
    both = half(0).unionByName(half(1)).select("domain", F.explode("d").alias("dataset"))
    return both.groupBy("domain").agg(F.sort_array(F.collect_set("dataset")).alias("d")).select("domain", _text("d").alias("datasets"))


def dataset_contains_domain(spark, sf_dir):
    rows = stored(spark, sf_dir)
    return rows.select("dataset").distinct().join(rows.where(F.col("domain") == "example.co.uk").select("dataset"), "dataset", "left_semi")


def union_all_batches(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    parts = [rows.where(f"row_id % 3 = {k}") for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


def common_domains(spark, sf_dir):
    rows = stored(spark, sf_dir)
    return rows.where(F.col("dataset") == "events-click").select("domain").intersect(rows.where(F.col("dataset") == "events-view").select("domain"))


def shard_distribution(spark, sf_dir):
    return domain_ids(stored(spark, sf_dir)).groupBy(ids.shard(F.col("domain_id"), 16).alias("shard")).agg(F.count(F.lit(1)).alias("domains"))


def top_paths(spark, sf_dir):
    counted = stored(spark, sf_dir).groupBy("domain", "dataset", "path").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counted, ["domain", "dataset"], [F.desc("n"), F.asc("path")], 3)


def top_urls_per_domain(spark, sf_dir):
    rows = stored(spark, sf_dir).select("domain", "dataset", "row_id", urls.rebuilt(F.col("scheme"), F.col("host"), F.col("path_query")).alias("url"))
    return top_k(rows, ["domain"], [F.asc("url"), F.asc("dataset"), F.asc("row_id")], 5)


def url_volume(spark, sf_dir):
    rows = normalised(spark, sf_dir, VOLUME_SQL)
    return rows.groupBy("dataset", "domain").agg(F.count(F.lit(1)).alias("urls"), F.count_distinct("host").alias("hosts"), F.max("path_query").alias("last"))


def versions_keep_last_n(spark, sf_dir):
    versions = corpus(spark, sf_dir).select(F.concat("dataset", F.lit("@"), (F.col("row_id") % 4).cast("string")).alias("version")).distinct()
    return top_k(versions.withColumn("all", F.lit(1)), ["all"], [F.desc("version")], 5).drop("all")


# physical results: checked by tests, not by SQL


def ids_xxh3(spark, sf_dir):
    return stored(spark, sf_dir).select("dataset", "row_id", "url_id", "domain_hash", ids.prefix(F.col("domain_hash")).alias("domain_prefix"))


def distinct_datasets_approx(spark, sf_dir):
    """The sketch's number, exact number beside it, and whether both agree within a sixth (or one)."""
    found = stored(spark, sf_dir).groupBy("domain", "dataset").agg(F.count(F.lit(1)).alias("n"))
    both = found.groupBy("domain").agg(F.approx_count_distinct("dataset").alias("sketch"), F.count(F.lit(1)).alias("datasets"))
    return both.select("domain", "datasets", (F.abs(F.col("sketch") - F.col("datasets")) <= F.greatest(F.lit(1.0), F.col("datasets") / 6)).alias("close"))


@lru_cache
def _lake(spark: SparkSession, sf_dir: str) -> str:
    """A lake of the corpus in the warehouse, which a session shares."""
    base = _folder(spark)
    rows = corpus(spark, sf_dir)
    lake.write(ingest.normalise(rows.join(F.broadcast(datasets(rows)), "dataset"), F.col("dataset_id")), base)
    return base


@lru_cache
def _built(spark: SparkSession, sf_dir: str) -> str:
    """The lake and its index."""
    base = _lake(spark, sf_dir)
    index.build(spark, base)
    return base


def lake_partition_listing(spark, sf_dir):
    return spark.createDataFrame(lake.partitions(spark, _lake(spark, sf_dir)), "dataset_id int, domain_prefix string")


def postings(spark, sf_dir):
    """Pairs of the postings, and the prefixes of the files that they name: one each."""
    service = QueryService(spark, _built(spark, sf_dir))
    refs = service.table("postings").select("domain_id", "dataset_id", F.inline("refs")).join(service.table("files").select("file_id", "domain_prefix"), "file_id", "left")
    return refs.groupBy("domain_id", F.col("dataset_id").cast("long").alias("dataset_id")).agg(F.count_distinct("domain_prefix").alias("prefixes"))


def file_registry(spark, sf_dir):
    return QueryService(spark, _built(spark, sf_dir)).table("files").select("file_id", "dataset_id", "domain_prefix")


def storage_stats(spark, sf_dir):
    found = lake.storage_stats(spark, _lake(spark, sf_dir))
    return spark.createDataFrame([(k, v["partitions"], v["files"]) for k, v in found["datasets"].items()], "dataset_id int, partitions long, files long")


def _folder(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/urlatlas-{uuid.uuid4().hex}"


def ingest_statistics(spark, sf_dir):
    """What an ingest of one dataset reports of itself."""
    base, rows = _folder(spark), corpus(spark, sf_dir).where("dataset = 'orders-1'").select("url")
    found = ingest.ingest_counted(spark, rows, "orders-1", base)
    files.delete(spark, base)
    counts = [("stored", found.stored), *found.rejected.items()]
    return spark.createDataFrame([(found.rows, reason, n) for reason, n in counts], "rows long, outcome string, n long")


def registry_tsv(spark, sf_dir):
    """The dataset registry, written as tab-separated text and read back."""
    path = f"{_folder(spark)}.tsv"
    tables.write_tsv(datasets(corpus(spark, sf_dir)), path)
    return tables.read_tsv(spark, path, "dataset string, dataset_id long")


def allowed_datasets(spark, sf_dir):
    """Datasets of a domain that an access list holds."""
    service = QueryService(spark, _built(spark, sf_dir))
    names = datasets(corpus(spark, sf_dir))
    return service.allowed(service.datasets_for_domain("example.com"), names.where("dataset like 'pages-%'")).join(names, "dataset_id").select("dataset", "urls")


def stored_top_urls(spark, sf_dir):
    """Stored top URLs of a domain in a dataset."""
    service = QueryService(spark, _built(spark, sf_dir))
    service.materialise_top(1000)
    dataset_id = datasets(corpus(spark, sf_dir)).where(F.col("dataset") == "events-click").first()["dataset_id"]
    return service.top_urls("example.co.uk", dataset_id)


def served_domain(spark, sf_dir):
    """Datasets of a domain from the built index, by name."""
    service = QueryService(spark, _built(spark, sf_dir))
    return service.datasets_for_domain("example.com").join(datasets(corpus(spark, sf_dir)), "dataset_id").select("dataset", "urls")


def served_urls(spark, sf_dir):
    """All URLs of a domain in a dataset from the lake, counted."""
    service = QueryService(spark, _built(spark, sf_dir))
    dataset_id = datasets(corpus(spark, sf_dir)).where(F.col("dataset") == "events-click").first()["dataset_id"]
    return service._rows("example.co.uk", dataset_id).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


_NORM = f"""
WITH corpus AS ({CORPUS_SQL}),
cut AS (
  SELECT *, regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\\?([^#]*))?', ['s', 'n', 'p', 'q']) AS m
  FROM corpus WHERE url IS NOT NULL AND url <> ''
), hosted AS (
  SELECT *, lower(CASE WHEN m.s = '' THEN 'http' ELSE m.s END) AS scheme, regexp_replace(m.n, '^.*@', '') AS auth, regexp_replace(m.p, ';[^/]*$', '') AS raw FROM cut
), parts AS (
  SELECT *, lower(split_part(auth, ':', 1)) AS host,
    CASE WHEN contains(auth, ':') AND split_part(auth, ':', 2) <> '' THEN CAST(split_part(auth, ':', 2) AS INTEGER) END AS number,
    list_reduce(list_filter(string_split(raw, '/'), lambda x: x NOT IN ('', '.')), lambda acc, x: CASE WHEN x = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, x) END,
      CAST([] AS VARCHAR[])) AS kept,
    list_sort(list_transform(list_filter(string_split(m.q, '&'), lambda x: x <> ''), lambda x, i: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'i': i,
      'v': url_decode(replace(CASE WHEN contains(x, '=') THEN substr(x, instr(x, '=') + 1) ELSE '' END, '+', ' '))}})) AS pairs
  FROM hosted
), norm AS (
  SELECT dataset, row_id, url, scheme, host,
    CASE WHEN (scheme = 'http' AND number = 80) OR (scheme = 'https' AND number = 443) THEN NULL ELSE number END AS port,
    CASE WHEN len(kept) = 0 THEN '/' ELSE '/' || array_to_string(kept, '/') || CASE WHEN ends_with(raw, '/') THEN '/' ELSE '' END END AS path,
    coalesce(array_to_string(list_transform(pairs, lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&'), '') AS query,
    CASE WHEN host LIKE '%.co.uk' OR host LIKE '%.github.io' THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain
  FROM parts WHERE host <> '' AND (number IS NULL OR number <= 65535)
), stored AS (
  SELECT *, CASE WHEN query = '' THEN path ELSE path || '?' || query END AS path_query FROM norm
), names AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS dataset_id FROM (SELECT DISTINCT dataset FROM corpus)
), dictionary AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS domain_id FROM (SELECT DISTINCT domain FROM stored)
)
"""


def _page_sql(offset: int, limit: int) -> str:
    return f"SELECT row_id, scheme || '://' || host || path_query AS url FROM stored WHERE domain = 'example.co.uk' AND dataset = 'events-click' ORDER BY row_id LIMIT {limit} OFFSET {offset}"


_SQL = {
    "normalize_components": "SELECT dataset, row_id, scheme, host, port, path, query FROM stored",
    "canonical_url": "SELECT dataset, row_id, path_query, scheme || '://' || host || CASE WHEN port IS NULL THEN '' ELSE ':' || port END || path_query AS canonical, scheme || '://' || host || path_query AS rebuilt FROM stored",
    "registered_domain": "SELECT host, domain, count(*) AS urls FROM stored GROUP BY ALL",
    "rejected_rows_by_reason": "SELECT dataset, CASE WHEN url IS NULL THEN 'null' WHEN url = '' THEN 'empty' WHEN url LIKE '%:99999%' THEN 'bad port' ELSE 'no host' END AS reject_reason, count(*) AS n FROM corpus WHERE url IS NULL OR url NOT LIKE '%//%' OR url LIKE '%:99999%' GROUP BY ALL",
    "url_dedup_counts": "SELECT dataset, count(*) AS n, count(DISTINCT url) AS distinct_urls, count(DISTINCT (host, path_query)) AS distinct_pages FROM stored GROUP BY dataset",
    "dataset_registry": "SELECT dataset, dataset_id FROM names",
    "distinct_domains": "SELECT DISTINCT domain FROM stored",
    "domain_dictionary": "SELECT domain, domain_id FROM dictionary",
    "domain_membership": "SELECT domain_id, array_to_string(list_sort(list(DISTINCT dataset_id)), ',') AS dataset_ids, count(DISTINCT dataset_id) AS datasets FROM stored JOIN dictionary USING (domain) JOIN names USING (dataset) GROUP BY domain_id",
    "datasets_for_domain": "SELECT dataset, count(*) AS urls FROM stored WHERE domain = 'example.com' GROUP BY dataset",
    "domain_dataset_url_counts": "SELECT domain, dataset, count(*) AS urls FROM stored GROUP BY ALL",
    "index_stats": "SELECT count(DISTINCT domain) AS num_domains, count(DISTINCT (domain, dataset)) AS num_pairs, count(*) AS num_urls FROM stored",
    "urls_page": _page_sql(0, 20),
    "urls_deep_page": _page_sql(150, 50),
    "urls_missing_page": _page_sql(1_000_000, 50),
    "new_domains_antijoin": "SELECT DISTINCT domain FROM stored o WHERE row_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM stored e WHERE e.row_id % 2 = 0 AND e.domain = o.domain)",
    "incremental_dictionary": "SELECT domain, row_number() OVER (ORDER BY late, domain) - 1 AS domain_id FROM (SELECT domain, min(row_id % 2) AS late FROM stored GROUP BY domain)",
    "incremental_membership": "SELECT domain, array_to_string(list_sort(list(DISTINCT dataset)), ',') AS datasets FROM stored GROUP BY domain",
    "dataset_contains_domain": "SELECT DISTINCT dataset FROM stored WHERE domain = 'example.co.uk'",
    "union_all_batches": "SELECT dataset, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM corpus GROUP BY dataset",
    "common_domains": "SELECT DISTINCT domain FROM stored WHERE dataset = 'events-click' INTERSECT SELECT DISTINCT domain FROM stored WHERE dataset = 'events-view'",
    "shard_distribution": "SELECT domain_id % 16 AS shard, count(*) AS domains FROM dictionary GROUP BY 1",
    "top_paths": "SELECT *, CAST(row_number() OVER (PARTITION BY domain, dataset ORDER BY n DESC, path) AS INTEGER) AS rank FROM (SELECT domain, dataset, path, count(*) AS n FROM stored GROUP BY ALL) QUALIFY rank <= 3",
    "top_urls_per_domain": "SELECT domain, dataset, row_id, scheme || '://' || host || path_query AS url, CAST(row_number() OVER (PARTITION BY domain ORDER BY scheme || '://' || host || path_query, dataset, row_id) AS INTEGER) AS rank FROM stored QUALIFY rank <= 5",
    "versions_keep_last_n": "SELECT version, CAST(row_number() OVER (ORDER BY version DESC) AS INTEGER) AS rank FROM (SELECT DISTINCT dataset || '@' || (row_id % 4) AS version FROM corpus) QUALIFY rank <= 5",
    "served_domain": "SELECT dataset, count(*) AS urls FROM stored WHERE domain = 'example.com' GROUP BY dataset",
    "distinct_datasets_approx": "SELECT domain, count(DISTINCT dataset) AS datasets, true AS close FROM stored GROUP BY domain",
    "postings": "SELECT DISTINCT domain_id, dataset_id, CAST(1 AS BIGINT) AS prefixes FROM stored JOIN dictionary USING (domain) JOIN names USING (dataset)",
    "ingest_statistics": "SELECT sum(n) OVER ()::BIGINT AS rows, outcome, n FROM (SELECT CASE WHEN url IS NULL THEN 'null' WHEN url = '' THEN 'empty' WHEN url LIKE '%:99999%' THEN 'bad port' WHEN url NOT LIKE '%//%' THEN 'no host' ELSE 'stored' END AS outcome, count(*) AS n FROM corpus WHERE dataset = 'orders-1' GROUP BY 1)",
    "registry_tsv": "SELECT dataset, dataset_id FROM names",
    "allowed_datasets": "SELECT dataset, count(*) AS urls FROM stored WHERE domain = 'example.com' AND dataset LIKE 'pages-%' GROUP BY dataset",
    "stored_top_urls": "SELECT url, n, CAST(row_number() OVER (ORDER BY n DESC, url) AS INTEGER) AS rank FROM (SELECT scheme || '://' || host || path_query AS url, count(*) AS n FROM stored WHERE domain = 'example.co.uk' AND dataset = 'events-click' GROUP BY ALL) QUALIFY rank <= 1000",
    "served_urls": "SELECT scheme || '://' || host || path_query AS url, count(*) AS n FROM stored WHERE domain = 'example.co.uk' AND dataset = 'events-click' GROUP BY ALL",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        normalize_components, canonical_url, registered_domain, rejected_rows_by_reason, url_dedup_counts, dataset_registry, distinct_domains, domain_dictionary,
        domain_membership, datasets_for_domain, domain_dataset_url_counts, index_stats, new_domains_antijoin, incremental_dictionary, incremental_membership,
        dataset_contains_domain, union_all_batches, common_domains, shard_distribution, top_paths, top_urls_per_domain, url_volume, versions_keep_last_n,
        ids_xxh3, distinct_datasets_approx, lake_partition_listing, postings, file_registry, storage_stats, ingest_statistics, registry_tsv, allowed_datasets, stored_top_urls, served_domain, served_urls,
    )
    return {f.__name__: f for f in plain} | {"urls_page": _page(0, 20), "urls_deep_page": _page(150, 50), "urls_missing_page": _page(1_000_000, 50)}


def oracle_sql() -> dict[str, str]:
    out = {name: _NORM + sql for name, sql in _SQL.items()}
    out["url_volume"] = f"""
SELECT dataset, 'example.com' AS domain, count(*) AS urls, count(DISTINCT host) AS hosts, max(path_query) AS last FROM (
  SELECT dataset, lower(regexp_extract(url, '//([^:]*):', 1)) AS host, regexp_replace(regexp_replace(url, '^.*:443/s/[0-9]+/\\.\\./o//([0-9]+)\\?z=([0-9]+)&a=1$', '/s/o/\\1?a=1&z=\\2'), '^$', '') AS path_query
  FROM ({VOLUME_SQL})) GROUP BY dataset"""
    return out
