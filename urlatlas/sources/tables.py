"""Tables as tab-separated text with a header, for tools that don't read Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Tabs, quotes and line ends inside values are quoted; an empty string and a null stay apart.
OPTIONS = {"sep": "\t", "header": True, "nullValue": "\\N", "quote": '"', "escape": '"', "lineSep": "\n"}


def write_tsv(df: DataFrame, path: str, compression: str = "gzip") -> bool:
    """One folder of text files, as many as the table has partitions. Nothing is written for an empty table; tells if
    there was anything to write."""
    if not df.limit(1).count():
        return False
    df.write.options(**OPTIONS, emptyValue='""', compression=compression).mode("overwrite").csv(path)
    return True


def read_tsv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The schema is given: inferred types would turn prefixes such as 00 into numbers."""
    return spark.read.schema(schema).options(**OPTIONS, emptyValue="", multiLine=True, enforceSchema=False).csv(path)
