"""Full syncs of connectors: on request, at an interval, or as new payload files arrive (Structured Streaming)."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hushframe.model import DatasetSlug, SnapshotVersion
from hushframe.sources.mappers import Mapper
from hushframe.sources.snapshots import Vault


@dataclass(frozen=True)
class SyncJob:
    """fetch returns a frame with a column payload of whole JSON documents."""

    tenant: uuid.UUID
    slug: DatasetSlug
    mapper: Mapper
    fetch: Callable[[SparkSession], DataFrame]


def run_sync(spark: SparkSession, vault: Vault, job: SyncJob) -> SnapshotVersion:
    """Fetch, map and commit one complete snapshot."""
    return vault.commit(job.tenant, job.slug, job.mapper.rows(job.fetch(spark)))


def run_all(spark: SparkSession, vault: Vault, jobs: list[SyncJob]) -> list[SnapshotVersion | Exception]:
    """Every job once; one that fails leaves the others be."""
    out: list[SnapshotVersion | Exception] = []
    for job in jobs:
        try:
            out.append(run_sync(spark, vault, job))
        except Exception as e:  # each job's outcome is its own
            out.append(e)
    return out


class Scheduler:
    """Runs all jobs each interval; stop lets the sync in flight finish and starts no other."""

    def __init__(self, spark: SparkSession, vault: Vault, jobs: list[SyncJob], interval: float):
        self.spark, self.vault, self.jobs, self.interval = spark, vault, jobs, interval
        self.stopped = threading.Event()

    def run(self) -> int:
        ticks = 0
        while not self.stopped.is_set():
            run_all(self.spark, self.vault, self.jobs)
            ticks += 1
            self.stopped.wait(self.interval)
        return ticks

    def stop(self) -> None:
        self.stopped.set()


def stream_sync(spark: SparkSession, vault: Vault, tenant: uuid.UUID, slug: DatasetSlug, mapper: Mapper, folder: str, checkpoint: str) -> StreamingQuery:
    """Commit each batch of payload files that arrives in folder as a complete snapshot; ends when no file is left."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).withColumnRenamed("value", "payload")
    commit = lambda batch, _: None if batch.isEmpty() else vault.commit(tenant, slug, mapper.rows(batch))
    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
