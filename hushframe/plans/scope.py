"""A query scope: one session with its tables, its mode, its policy and its limits; and the life of one query in it."""

from __future__ import annotations

import json
import math
import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession

from hushframe.errors import ExecutionFailed, LimitExceeded, PolicyMissing, QueryError, Unplannable, masked
from hushframe.limits import QueryLimits
from hushframe.model import DatasetSlug, DeclaredSchema, read_footers
from hushframe.operators.disclosure import DisclosurePolicy, MinimumCount
from hushframe.plans import gate
from hushframe.plans.statements import verify_statement

# Settings that every scope's session needs. Integers wrap and nothing throws on a value; no files by path in SQL.
SESSION = {"spark.sql.ansi.enabled": "false", "spark.sql.runSQLOnFiles": "false", "spark.sql.session.timeZone": "UTC"}


@dataclass(frozen=True)
class Result:
    """Released rows, as a JSON array of row objects, and how many rows were suppressed."""

    rows: list[dict]
    json: str
    suppressed_rows: int

    @property
    def row_count(self) -> int:
        return len(self.rows)


def _plain(value):
    """A cell as JSON has it; NaN and infinities are null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def capped_json(rows: list[dict], most: int) -> str:
    """Rows as a JSON array of at most most bytes; LimitExceeded beyond that."""
    parts, size = [], 2
    for row in rows:
        part = json.dumps(row, ensure_ascii=False, separators=(",", ":"))
        size += len(part.encode()) + (1 if parts else 0)
        if size > most:
            raise LimitExceeded("result_bytes")
        parts.append(part)
    return f"[{','.join(parts)}]"


@dataclass
class Scope:
    """gated: only disclosure-controlled aggregates. A policy gates the scope whatever gated says."""

    spark: SparkSession
    gated: bool = True
    policy: DisclosurePolicy | None = None
    limits: QueryLimits = field(default_factory=QueryLimits)

    def __post_init__(self):
        self.session = self.spark.newSession()
        for key, value in SESSION.items():
            self.session.conf.set(key, value)
        self.leaves: dict[str, set[str]] = {}
        self.frames: dict[str, DataFrame] = {}

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *exc) -> None:
        for name in self.frames:
            self.session.catalog.dropTempView(name)
        self.frames.clear()

    def register(self, name: str, *paths: str, declared: DeclaredSchema | None = None, row_cap: int | None = None) -> int:
        """Make Parquet files one table, and return their rows; no path is an empty no-op. Footers are checked before any row is read."""
        if not paths:
            return 0
        try:
            footers, count, size = read_footers(list(paths))
        except QueryError:
            raise
        except Exception:
            raise ExecutionFailed("loading the table") from None
        footers.check(declared, row_cap)
        for limit, value in (("input_objects", count), ("input_bytes", size), ("decoded_rows", footers.rows), ("decoded_bytes", footers.bytes)):
            if value > getattr(self.limits, limit):
                raise LimitExceeded(limit)
        try:
            self.register_frame(name, self.session.read.parquet(*paths))
        except Exception:
            raise ExecutionFailed("loading the table") from None
        return footers.rows

    def register_frame(self, name: str, df: DataFrame) -> None:
        """Make a frame of this scope's session a table."""
        slug = str(DatasetSlug(name))
        df.createOrReplaceTempView(f"`{slug}`" if "-" in slug else slug)
        self.frames[slug] = df
        self.leaves[slug] = gate.leaf_ids(df._jdf.queryExecution().analyzed())

    @property
    def disclosed(self) -> bool:
        return self.gated or self.policy is not None

    def dataframe(self, sql: str) -> tuple[DataFrame, list[Observation]]:
        """The checked query, with suppression on top, not yet run; and observations of what is suppressed."""
        verify_statement(self.session, sql, set(self.frames))
        try:
            df = self.session.sql(sql)
            analyzed = df._jdf.queryExecution().analyzed()
        except Exception:
            raise Unplannable from None
        if not self.disclosed:
            return df, []
        error: QueryError | None = None
        for leaf in self.leaves.values():
            try:
                gate.check(self.session, analyzed, leaf)
                break
            except QueryError as e:
                error = error if error is not None and type(e) is gate.NotAggregate else e
        else:
            raise error or Unplannable()
        if self.policy is None or isinstance(self.policy, MinimumCount) and self.policy.k < 1:
            raise PolicyMissing
        return self.policy.apply(df)

    def sql(self, sql: str) -> Result:
        """Run a query: checks, then a job under the time limit, then the result limits. Over a limit is refused, never cut."""
        try:
            df, seen = self.dataframe(sql)
            names = df.columns
            with self._timed() as late:
                try:
                    # One row over the limit is enough to refuse. Under the limit, limit() has read every partition to
                    # its end, so suppressed rows are counted whole.
                    found = df.limit(self.limits.result_rows + 1).collect()
                except Exception as e:
                    if late():
                        raise LimitExceeded("time") from None
                    raise (LimitExceeded("memory") if "OutOfMemory" in str(e) else ExecutionFailed()) from None
            if len(found) > self.limits.result_rows:
                raise LimitExceeded("result_rows")
            rows = [{name: _plain(value) for name, value in zip(names, row)} for row in found]
            suppressed = sum(o.get.get("suppressed") or 0 for o in seen)
            return Result(rows, capped_json(rows, self.limits.result_bytes), int(suppressed))
        except QueryError as e:
            raise (masked(e) if self.disclosed else e) from None

    @contextmanager
    def _timed(self):
        """Cancel this thread's jobs after the time limit; yields a function that says whether that happened."""
        context, tag, fired = self.session.sparkContext, f"scope-{uuid.uuid4().hex}", threading.Event()

        def stop():
            fired.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.limits.time, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            yield fired.is_set
        finally:
            timer.cancel()
            context.removeJobTag(tag)
