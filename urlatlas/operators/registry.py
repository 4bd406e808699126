"""Dataset names and their ids, kept in one JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import files

#: Ids are stored as 32-bit integers.
MOST = 2**31


class DatasetRegistry:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.path = spark, f"{base}/registry.json"
        self.ids: dict[str, int] = {}
        self.next = 0
        try:
            if found := files.read_json(spark, self.path):
                self.ids = {k: int(v) for k, v in found["datasets"].items()}
                self.next = max(int(found.get("next_dataset_id", 0)), 1 + max(self.ids.values(), default=-1))
        except (ValueError, KeyError, AttributeError, TypeError) as e:
            # ids that start anew would put a new dataset into another one's partitions
            raise ValueError(f"{self.path} can't be read; mend it, or reset the registry of an empty lake") from e

    def register(self, name: str) -> int:
        """The name's id, a new one if it has none."""
        if not name:
            raise ValueError("a dataset needs a name")
        if name not in self.ids:
            if self.next >= MOST:
                raise ValueError("no ids are left")
            self.ids[name], self.next = self.next, self.next + 1
            files.write_json(self.spark, self.path, {"datasets": self.ids, "next_dataset_id": self.next})
        return self.ids[name]

    def id_of(self, name: str) -> int:
        return self.ids[name]

    def to_dict(self) -> dict[str, int]:
        return dict(self.ids)

    def reset(self) -> None:
        self.ids, self.next = {}, 0
        if files.exists(self.spark, self.path):
            files.delete(self.spark, self.path)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(sorted((v, k) for k, v in self.ids.items()), "dataset_id int, dataset string")
