"""The query service: own-data and research queries over current snapshots, with slots, budgets, audit and metrics."""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter

from pyspark.sql import SparkSession

from hushframe.control.registry import Control
from hushframe.errors import Busy, QueryError
from hushframe.limits import QueryLimits
from hushframe.model import DatasetSlug
from hushframe.operators.disclosure import DEFAULT_COHORT, MinimumCount
from hushframe.plans.scope import Result, Scope
from hushframe.sources.snapshots import Vault


class Service:
    """slots: queries that may run at once. cohort: smallest group of research and gated queries."""

    def __init__(self, spark: SparkSession, vault: Vault, control: Control | None = None, cohort: int = DEFAULT_COHORT, limits: QueryLimits | None = None, slots: int = 4):
        self.spark, self.vault, self.control = spark, vault, control or Control()
        self.cohort, self.limits = cohort, (limits or QueryLimits()).checked()
        self._slots = threading.BoundedSemaphore(slots) if slots else None
        self.audit: list[dict] = []
        self.metrics: Counter = Counter()

    def _note(self, event: str, **fields) -> None:
        """Identifiers and outcomes only; never SQL or data."""
        self.audit.append({"event": event} | {k: str(v) for k, v in fields.items()})
        self.metrics[event] += 1

    def _run(self, tenant: uuid.UUID, slug: DatasetSlug, sql: str, gated: bool) -> tuple[Result, int]:
        began = time.monotonic()
        if self._slots is None or not self._slots.acquire(timeout=self.limits.slot_wait):
            raise Busy
        self.metrics["slot_wait_ms"] += int((time.monotonic() - began) * 1000)
        try:
            snapshot = self.vault.current(tenant, slug)  # the one committed while this query waited
            if snapshot is None or not snapshot.objects:
                return Result([], "[]", 0), 0
            policy = MinimumCount(self.cohort) if gated else None
            with Scope(self.spark, gated, policy, self.limits) as scope:
                scope.register(str(slug), *snapshot.objects, declared=snapshot.declared, row_cap=snapshot.row_cap)
                return scope.sql(sql), len(snapshot.objects)
        finally:
            self._slots.release()

    def query(self, tenant: uuid.UUID, slug: str, sql: str, zero_knowledge: bool = True) -> dict:
        """A tenant's query over their own dataset; gated unless zero_knowledge is off."""
        try:
            result, objects = self._run(tenant, DatasetSlug(slug), sql, zero_knowledge)
        except QueryError as e:
            self._note("query_refused", tenant=tenant, dataset=slug, kind=e.kind)
            raise
        self._note("query_run", tenant=tenant, dataset=slug, rows=result.row_count)
        return {"rows": result.rows, "row_count": result.row_count, "suppressed_rows": result.suppressed_rows, "object_count": objects, "zk_mode": zero_knowledge}

    def research_query(self, researcher: uuid.UUID, steward: uuid.UUID, slug: str, sql: str) -> dict:
        """A granted researcher's query: always gated; one unit is charged before it runs and never given back."""
        name = DatasetSlug(slug)
        try:
            grant = self.control.find_active(steward, researcher, name)
            self.vault.current(steward, name)  # an unreadable snapshot costs nothing
            left = self.control.charge(grant.id)
            result, objects = self._run(steward, name, sql, True)
        except QueryError as e:
            self._note("research_refused", researcher=researcher, dataset=slug, kind=e.kind)
            raise
        self._note("research_run", researcher=researcher, grant=grant.id, dataset=slug, rows=result.row_count)
        return {"rows": result.rows, "row_count": result.row_count, "suppressed_rows": result.suppressed_rows, "object_count": objects, "min_cohort": self.cohort, "mode": "research", "budget_remaining": left.remaining}

    def publish(self, steward: uuid.UUID, slug: str, title: str):
        listing = self.control.publish(steward, DatasetSlug(slug), title, self.vault.held(steward))
        self._note("listing_published", steward=steward, dataset=slug)
        return listing
