"""Settings, with overrides from the environment (URLATLAS_<NAME>)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """`row_group_bytes` and `compression_level` are for lake files; `prefix_digits` names their partitions."""

    base: str = "./data"
    row_group_bytes: int = 128 << 20
    compression: str = "zstd"
    compression_level: int = 6
    max_records_per_file: int = 20_000_000
    prefix_digits: int = 2
    postings_shards: int = 1024
    default_limit: int = 1000
    most_limit: int = 10_000
    suffix_list: str | None = None

    @classmethod
    def load(cls, **given) -> Settings:
        found = {}
        for f in fields(cls):
            if (value := os.environ.get(f"URLATLAS_{f.name.upper()}")) is not None:
                found[f.name] = int(value) if isinstance(f.default, int) else value
        return cls(**(found | given))
