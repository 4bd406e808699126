"""Several datasets, then one index: python -m urlatlas.batch LIST --inputs FOLDER --base BASE."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import Settings
from .operators import index, ingest
from .sources import inputs


def run(spark: SparkSession, names: list[str], folder: str, base: str, settings: Settings = Settings(), force: bool = False, kind: str = ".parquet", report: dict[str, ingest.Ingested] | None = None) -> tuple[list[str], str | None]:
    """Ingests <folder>/<name><kind> of each name that isn't there yet (all with `force`, which replaces what they had);
    one that fails is left out. Gives the names that went in, and the index version; `report` gets what each ingest did."""
    done = []
    for name in names:
        if not force and ingest.already_ingested(spark, name, base):
            print(f"{name}: there already")
            continue
        try:
            found = ingest.ingest_counted(spark, inputs.read_urls(spark, f"{folder}/{name}{kind}"), name, base, settings, "overwrite" if force else "append")
            done.append(name)
            if report is not None:
                report[name] = found
        except Exception as e:
            print(f"{name}: {str(e)[:300]}")
    return done, index.build(spark, base, settings, incremental=not force) if done else None


def main() -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("list")
    p.add_argument("--inputs", required=True)
    p.add_argument("--base", default=Settings.load().base)
    p.add_argument("--suffix", default="")
    p.add_argument("--force", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("urlatlas").getOrCreate()
    report: dict[str, ingest.Ingested] = {}
    done, version = run(spark, inputs.read_names(spark, a.list, a.suffix), a.inputs, a.base, Settings.load(base=a.base), a.force, report=report)
    for found in report.values():
        print(f"{found.name} ({found.dataset_id}): {found.rows} rows, {found.stored} stored, rejected {found.rejected}, {found.files} files, {found.bytes} bytes")
    print(f"{len(done)} datasets, version {version}")
    return 0 if done else 1


if __name__ == "__main__":
    raise SystemExit(main())
