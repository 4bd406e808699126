"""A corpus of URLs from the test tables, as one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORPUS_SQL = """
SELECT 'pages-' || CASE WHEN url LIKE '%/en/%' THEN 'en' WHEN url LIKE '%/de/%' THEN 'de' WHEN url LIKE '%/fr/%' THEN 'fr' WHEN url LIKE '%/es/%' THEN 'es' ELSE 'other' END AS dataset,
  CAST(page_id AS BIGINT) AS row_id, url FROM pages
UNION ALL
SELECT 'events-' || event_type AS dataset, CAST(event_id AS BIGINT) AS row_id, CASE event_id % 6
  WHEN 0 THEN 'HTTPS://Shop' || CAST(user_id AS STRING) || '.Example.co.uk:443/a/../b/' || CAST(event_id % 50 AS STRING) || '?z=1&a=' || CAST(event_id % 7 AS STRING)
  WHEN 1 THEN 'http://u' || CAST(user_id % 40 AS STRING) || '.github.io//x//' || CAST(event_id % 100 AS STRING) || '/'
  WHEN 2 THEN 'http://www.site' || CAST(user_id AS STRING) || '.com/p;v=1?b=2&a=3&b=1&c'
  WHEN 3 THEN 'https://user:pw@www.site' || CAST(user_id % 90 AS STRING) || '.org/./q/../r?x=%7Ea+b%20c#frag'
  WHEN 4 THEN '//cdn' || CAST(user_id % 15 AS STRING) || '.net'
  ELSE 'http://api.site' || CAST(user_id % 60 AS STRING) || '.co.uk:8080/v' || CAST(event_id % 3 AS STRING) || '/items/' || CAST(event_id % 500 AS STRING) || '/' END AS url FROM events
UNION ALL
SELECT 'orders-' || substr(o_orderpriority, 1, 1) AS dataset, CAST(o_orderkey AS BIGINT) AS row_id, CASE o_orderkey % 10
  WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'not a url' WHEN 3 THEN 'mailto:a@b.c' WHEN 4 THEN 'http://e.com:99999/'
  ELSE 'http://shop' || CAST(o_custkey % 500 AS STRING) || '.com:8080/o/' || CAST(o_orderkey AS STRING) END AS url FROM orders
"""

#: More rows for measurements: every line item is a URL of its part's shop.
VOLUME_SQL = """
SELECT 'lineitem-' || l_returnflag AS dataset, CAST(l_orderkey AS BIGINT) AS row_id,
  'HTTPS://Part' || CAST(l_partkey % 5000 AS STRING) || '.Example.com:443/s/' || CAST(l_suppkey AS STRING) || '/../o//' || CAST(l_orderkey AS STRING) || '?z=' || CAST(l_linenumber AS STRING) || '&a=1' AS url
FROM lineitem
"""


def corpus(spark: SparkSession, sf_dir: str, sql: str = CORPUS_SQL) -> DataFrame:
    for t in ("pages", "events", "orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
