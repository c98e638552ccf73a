"""Datasets as versioned, complete snapshots.

A tenant's dataset is a folder with ``snapshots/{version}/`` (Parquet objects), ``records/{version}.json`` and
``manifests/{version}.manifest``. Objects are written by Spark, then the record, then the manifest, both create-only: the
manifest is the commit, so an unfinished write is never seen. The newest version with a manifest is current.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from hushframe.errors import LimitExceeded, SnapshotBroken
from hushframe.model import DatasetSlug, DeclaredSchema, SnapshotVersion

SUITE = "plain-parquet"
MAX_RECORD_BYTES = 256 << 10
MAX_LISTING = 1000


@dataclass(frozen=True)
class Snapshot:
    version: SnapshotVersion
    objects: tuple[str, ...]
    row_cap: int | None
    declared: DeclaredSchema | None


class Vault:
    """Snapshots under a root folder that the driver can open; data is read and written by Spark alone."""

    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def _home(self, tenant: uuid.UUID, slug: DatasetSlug) -> Path:
        return self.root / str(uuid.UUID(str(tenant))) / str(slug)

    def commit(self, tenant: uuid.UUID, slug: DatasetSlug, df: DataFrame, row_cap: int | None = None, declared: DeclaredSchema | None = None, version: SnapshotVersion | None = None, prune: bool = True) -> SnapshotVersion:
        """Write df as a new complete snapshot, commit it, and prune older ones."""
        version = version or SnapshotVersion.new()
        home = self._home(tenant, slug)
        folder = home / "snapshots" / str(version)
        df.write.mode("overwrite").parquet(str(folder))
        objects = sorted(p.name for p in folder.glob("*.parquet"))
        record = {"version": str(version), "suite": SUITE} | ({"row_cap": row_cap} if row_cap is not None else {}) | ({"schema": declared.to_json()} if declared else {})
        self._create(home / "records" / f"{version}.json", record)
        self._create(home / "manifests" / f"{version}.manifest", {"version": str(version), "objects": objects})
        if prune:
            self.prune(tenant, slug, version)
        return version

    @staticmethod
    def _create(path: Path, value: dict) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("x") as f:
            f.write(json.dumps(value))

    @staticmethod
    def _read(path: Path, allowed: set[str]) -> dict:
        try:
            text = path.read_text()
            value = json.loads(text)
        except (OSError, ValueError):
            raise SnapshotBroken from None
        if len(text) > MAX_RECORD_BYTES or not isinstance(value, dict) or set(value) - allowed:
            raise SnapshotBroken
        return value

    def versions(self, tenant: uuid.UUID, slug: DatasetSlug) -> list[SnapshotVersion]:
        """Committed versions, oldest first."""
        return sorted(SnapshotVersion(p.stem) for p in (self._home(tenant, slug) / "manifests").glob("*.manifest"))

    def current(self, tenant: uuid.UUID, slug: DatasetSlug) -> Snapshot | None:
        """The newest committed snapshot, checked; None if nothing was committed. SnapshotBroken if it cannot be trusted."""
        known = self.versions(tenant, slug)
        if not known:
            return None
        version, home = known[-1], self._home(tenant, slug)
        manifest = self._read(home / "manifests" / f"{version}.manifest", {"version", "objects"})
        record = self._read(home / "records" / f"{version}.json", {"version", "suite", "row_cap", "schema"})
        objects = manifest.get("objects")
        if manifest.get("version") != str(version) or record.get("version") != str(version) or record.get("suite") != SUITE or not isinstance(objects, list) or len(set(objects)) != len(objects):
            raise SnapshotBroken
        paths = tuple(str(home / "snapshots" / str(version) / o) for o in objects)
        if not all(Path(p).is_file() for p in paths):
            raise SnapshotBroken
        declared = DeclaredSchema.from_json(json.dumps(record["schema"])) if "schema" in record else None
        return Snapshot(version, paths, record.get("row_cap"), declared)

    def prune(self, tenant: uuid.UUID, slug: DatasetSlug, keep: SnapshotVersion) -> None:
        """Remove what is older than keep: manifests first, then objects, then records. Failures are left for the next time."""
        home = self._home(tenant, slug)
        for part in ("manifests/*.manifest", "snapshots/*/*", "snapshots/*", "records/*.json"):
            for p in sorted(home.glob(part)):
                name = p.parent.name if part.endswith("/*/*") else p.name.removesuffix(".manifest").removesuffix(".json")
                if name < str(keep):
                    try:
                        p.rmdir() if p.is_dir() else p.unlink()
                    except OSError:
                        continue

    def held(self, tenant: uuid.UUID) -> list[DatasetSlug]:
        """Datasets with a committed snapshot."""
        home = self.root / str(tenant)
        return sorted(DatasetSlug(p.name) for p in home.iterdir() if any((p / "manifests").glob("*.manifest"))) if home.is_dir() else []

    def listing(self, spark: SparkSession, tenant: uuid.UUID) -> DataFrame:
        """A row for each held dataset: slug, version, written_at, suite (null if its record is unreadable), object_count, bytes."""
        rows = []
        slugs = self.held(tenant)
        if len(slugs) > MAX_LISTING:
            raise LimitExceeded("listing")
        for slug in slugs:
            version, home = self.versions(tenant, slug)[-1], self._home(tenant, slug)
            objects = self._read(home / "manifests" / f"{version}.manifest", {"version", "objects"})["objects"]
            try:
                suite = self._read(home / "records" / f"{version}.json", {"version", "suite", "row_cap", "schema"}).get("suite")
            except SnapshotBroken:
                suite = None
            written = datetime.fromtimestamp(version.nanos / 1e9, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
            rows.append((str(slug), str(version), written, suite, len(objects), sum((home / "snapshots" / str(version) / o).stat().st_size for o in objects)))
        return spark.createDataFrame(rows, "slug string, version string, written_at string, suite string, object_count long, bytes long")
