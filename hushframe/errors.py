"""Refusals and failures. Messages are fixed: none quotes data, SQL, a column or an engine's own message."""

from __future__ import annotations


class QueryError(Exception):
    """kind names the refusal for callers; public is the message that may leave the engine."""

    kind, status, public = "internal", 500, "the query failed"

    def __init__(self, public: str | None = None):
        super().__init__(public or self.public)
        self.public = public or self.public


class StatementNotAllowed(QueryError):
    kind, status, public = "statement", 422, "only read-only queries over the registered tables are allowed"


class Unplannable(QueryError):
    kind, status, public = "planning", 422, "the query could not be planned"


class NotAggregate(QueryError):
    kind, status, public = "disclosure", 422, "only one aggregate over one dataset is allowed"


class CountMissing(QueryError):
    kind, status, public = "disclosure", 422, "queries must include COUNT(*) AS n"


class ExpressionMayFail(QueryError):
    kind, status, public = "disclosure", 422, "the query uses an expression that could fail on some rows"


class PolicyMissing(QueryError):
    kind, status, public = "disclosure", 422, "no cohort threshold is configured"


class LimitExceeded(QueryError):
    kind, status = "limit", 422

    def __init__(self, limit: str):
        super().__init__(f"the query is over its {limit} limit")
        self.limit = limit


class DeclarationMismatch(QueryError):
    kind, status = "declaration", 422

    def __init__(self, what: str):
        super().__init__(f"the data does not match its declared {what}")
        self.what = what


class ExecutionFailed(QueryError):
    kind, status = "execution", 500

    def __init__(self, stage: str = "executing"):
        super().__init__(f"the query failed while {stage}")
        self.stage = stage


class Malformed(QueryError):
    kind, status, public = "malformed", 422, "the payload is malformed"


class NotFound(QueryError):
    kind, status, public = "not_found", 404, "not found"


class Forbidden(QueryError):
    kind, status, public = "forbidden", 403, "no active grant for this dataset"


class Conflict(QueryError):
    kind, status, public = "conflict", 409, "the request conflicts with the present state"


class BudgetExhausted(QueryError):
    kind, status, public = "budget", 429, "the query budget is exhausted"


class Busy(QueryError):
    kind, status, public = "busy", 503, "all query slots are in use"


class SnapshotBroken(QueryError):
    kind, status, public = "snapshot", 502, "the dataset's snapshot cannot be read"


def masked(error: QueryError) -> QueryError:
    """What a gated caller sees: memory and time refusals look like a disclosure refusal."""
    if isinstance(error, LimitExceeded) and error.limit in ("memory", "time"):
        return NotAggregate()
    return error
