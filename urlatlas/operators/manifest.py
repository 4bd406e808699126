"""Which index versions there are, and the one that readers take."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from .. import files


@dataclass
class IndexVersion:
    version: str
    created_at: str = ""
    tables: dict[str, str] = field(default_factory=dict)
    postings_shards: int = 1024

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> IndexVersion:
        return cls(d["version"], d.get("created_at", ""), dict(d.get("tables", {})), int(d.get("postings_shards", 1024)))


class Manifest:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.path = spark, base, f"{base}/index/manifest.json"
        found = files.read_json(spark, self.path) or {}
        self.current_version: str | None = found.get("current_version")
        self.versions = [IndexVersion.from_dict(v) for v in found.get("versions", [])]

    def save(self) -> None:
        files.write_json(self.spark, self.path, {"current_version": self.current_version, "versions": [v.to_dict() for v in self.versions]})

    def add(self, version: IndexVersion) -> None:
        """One of the same id goes."""
        self.versions = [v for v in self.versions if v.version != version.version] + [version]

    def set_current(self, version: str) -> None:
        if not self.get(version):
            raise ValueError(f"no such version: {version}")
        self.current_version = version

    def get(self, version: str) -> IndexVersion | None:
        return next((v for v in self.versions if v.version == version), None)

    def current(self) -> IndexVersion | None:
        return self.get(self.current_version) if self.current_version else None

    def list(self) -> list[IndexVersion]:
        return sorted(self.versions, key=lambda v: (v.created_at, v.version))

    def publish(self, version: IndexVersion) -> None:
        """The last step of a build: readers see the new version or the old one."""
        self.add(version)
        self.set_current(version.version)
        self.save()

    def keep_last(self, n: int = 5) -> list[str]:
        """Forgets older versions, never the current one; gives those that went. Files stay until `collect`."""
        kept = {v.version for v in self.list()[::-1][:n]} | {self.current_version}
        gone = [v.version for v in self.versions if v.version not in kept]
        self.versions = [v for v in self.versions if v.version in kept]
        self.save()
        return gone

    def collect(self) -> list[str]:
        """Deletes the files of versions that the manifest doesn't name."""
        known = {v.version for v in self.versions}
        gone = [name for name, folder, _ in files.children(self.spark, f"{self.base}/index") if folder and name not in known]
        for name in gone:
            files.delete(self.spark, f"{self.base}/index/{name}")
        return gone
