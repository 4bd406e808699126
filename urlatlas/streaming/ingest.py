"""Ingest as a stream of files: the checkpoint says which files are done, so a run that was cut off goes on where it was,
and files that were ingested are not ingested again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import index
from ..operators.ingest import normalise
from ..operators.registry import DatasetRegistry
from ..sources import lake


def stream_urls(spark: SparkSession, folder: str, schema: str = "url string", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_ingest(spark: SparkSession, folder: str, name: str, base: str, settings: Settings = Settings(), build_index: bool = False, once: bool = True) -> StreamingQuery:
    """Writes the folder's files, and those that come later, to the lake; with `build_index` each batch extends the index.
    A batch that is tried again writes to the lake again only if its commit was not recorded."""
    dataset_id = DatasetRegistry(spark, base).register(name)
    state = f"{base}/streams/{dataset_id}"

    def write(batch: DataFrame, number: int) -> None:
        from .. import files

        done = f"{state}/done/{number}"
        if not files.exists(spark, done):
            lake.write(normalise(batch, dataset_id, settings), base, settings)
            files.write_text(spark, done, name)
        if build_index:
            index.build(spark, base, settings, incremental=True)

    writer = stream_urls(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
