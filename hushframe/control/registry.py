"""Grants, query budgets and the catalogue of listings: small transactional state behind one lock, with an append-only ledger."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from hushframe.errors import BudgetExhausted, Conflict, Forbidden, NotFound
from hushframe.model import DatasetSlug

MAX_BUDGET = (1 << 63) - 1


@dataclass(frozen=True)
class Budget:
    limit: int
    spent: int = 0

    @property
    def remaining(self) -> int:
        return max(0, self.limit - self.spent)


@dataclass(frozen=True)
class Grant:
    id: uuid.UUID
    steward: uuid.UUID
    researcher: uuid.UUID
    slug: DatasetSlug
    created_at: float
    revoked_at: float | None = None
    active: bool = True


@dataclass(frozen=True)
class Listing:
    id: uuid.UUID
    steward: uuid.UUID
    slug: DatasetSlug
    title: str
    published: bool = True


@dataclass(frozen=True)
class AccessRequest:
    """state: pending, approved or denied; budget is recorded when it is approved."""

    id: uuid.UUID
    listing: uuid.UUID
    researcher: uuid.UUID
    state: str = "pending"
    budget: int | None = None


class Control:
    """All control-plane state. Spent units are never given back; limits only rise; foreign ids look like unknown ones."""

    def __init__(self):
        self._lock = threading.RLock()
        self.budgets: dict[uuid.UUID, Budget] = {}
        self.grants: dict[uuid.UUID, Grant] = {}
        self.listings: dict[uuid.UUID, Listing] = {}
        self.requests: dict[uuid.UUID, AccessRequest] = {}
        self._topped: set[tuple[uuid.UUID, str]] = set()
        self.ledger: list[tuple[str, str, int, int, int]] = []

    def _note(self, grant: uuid.UUID, what: str, units: int) -> Budget:
        now = self.budgets[grant]
        self.ledger.append((str(grant), what, units, now.limit, now.spent))
        return now

    # budgets

    def open_budget(self, grant: uuid.UUID, limit: int) -> Budget:
        """Insert if absent."""
        with self._lock:
            if grant not in self.budgets:
                self.budgets[grant] = Budget(limit)
                self._note(grant, "open", limit)
            return self.budgets[grant]

    def charge(self, grant: uuid.UUID, units: int = 1) -> Budget:
        """Spend units or refuse; never a part of them."""
        with self._lock:
            now = self.budgets.get(grant)
            if now is None or now.remaining < units:
                raise BudgetExhausted
            self.budgets[grant] = replace(now, spent=now.spent + units)
            return self._note(grant, "charge", units)

    def top_up(self, grant: uuid.UUID, units: int, key: str | None = None) -> Budget:
        """Raise the limit; with a key, once for each key."""
        with self._lock:
            if grant not in self.budgets:
                raise NotFound
            if units < 0 or key is not None and (grant, key) in self._topped:
                return self.budgets[grant]
            if key is not None:
                self._topped.add((grant, key))
            now = self.budgets[grant]
            self.budgets[grant] = replace(now, limit=min(MAX_BUDGET, now.limit + units))
            return self._note(grant, "top_up", units)

    def ledger_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.ledger, "grant string, event string, units long, limit long, spent long")

    # grants

    def create_grant(self, steward: uuid.UUID, researcher: uuid.UUID, slug: DatasetSlug, unless_revoked: bool = False) -> Grant:
        """One grant for each steward, researcher and dataset; a revoked one becomes active again, or is refused if asked so."""
        with self._lock:
            if steward == researcher:
                raise Conflict("a steward needs no grant to their own data")
            known = next((g for g in self.grants.values() if (g.steward, g.researcher, g.slug) == (steward, researcher, slug)), None)
            if known is None:
                known = Grant(uuid.uuid4(), steward, researcher, slug, time.time())
            elif not known.active:
                if unless_revoked:
                    raise Conflict("the grant was revoked")
                known = replace(known, active=True)
            self.grants[known.id] = known
            return known

    def find_active(self, steward: uuid.UUID, researcher: uuid.UUID, slug: DatasetSlug) -> Grant:
        with self._lock:
            for g in self.grants.values():
                if g.active and (g.steward, g.researcher, g.slug) == (steward, researcher, slug):
                    return g
        raise Forbidden

    def revoke(self, steward: uuid.UUID, grant: uuid.UUID) -> Grant:
        with self._lock:
            known = self.grants.get(grant)
            if known is None or known.steward != steward:
                raise NotFound
            if known.active:
                self.grants[grant] = known = replace(known, active=False, revoked_at=time.time())
            return known

    def grants_for(self, party: uuid.UUID) -> list[Grant]:
        with self._lock:
            return sorted((g for g in self.grants.values() if party in (g.steward, g.researcher)), key=lambda g: (g.created_at, g.id))

    def budget_of(self, party: uuid.UUID, grant: uuid.UUID) -> Budget:
        """For the grant's two parties only."""
        with self._lock:
            known = self.grants.get(grant)
            if known is None or party not in (known.steward, known.researcher) or grant not in self.budgets:
                raise NotFound
            return self.budgets[grant]

    # catalogue

    def publish(self, steward: uuid.UUID, slug: DatasetSlug, title: str, held: list[DatasetSlug]) -> Listing:
        """Upsert under a stable id; only datasets that the steward holds."""
        with self._lock:
            if slug not in held:
                raise NotFound
            known = next((x for x in self.listings.values() if (x.steward, x.slug) == (steward, slug)), None)
            known = replace(known, title=title, published=True) if known else Listing(uuid.uuid4(), steward, slug, title)
            self.listings[known.id] = known
            return known

    def unpublish(self, steward: uuid.UUID, listing: uuid.UUID) -> None:
        with self._lock:
            known = self.listings.get(listing)
            if known is None or known.steward != steward:
                raise NotFound
            self.listings[listing] = replace(known, published=False)

    def browse(self) -> list[Listing]:
        with self._lock:
            return sorted((x for x in self.listings.values() if x.published), key=lambda x: (x.title, x.id))

    def request(self, researcher: uuid.UUID, listing: uuid.UUID) -> AccessRequest:
        """Ask for access to a published listing of somebody else; a pending request is returned again."""
        with self._lock:
            known = self.listings.get(listing)
            if known is None or not known.published:
                raise NotFound
            if known.steward == researcher:
                raise Conflict("a steward needs no access to their own data")
            for r in self.requests.values():
                if (r.listing, r.researcher, r.state) == (listing, researcher, "pending"):
                    return r
            made = AccessRequest(uuid.uuid4(), listing, researcher)
            self.requests[made.id] = made
            return made

    def resolve(self, steward: uuid.UUID, request: uuid.UUID, approve: bool, budget: int = 0) -> Grant | None:
        """Deny for good, or approve: the grant is made and its budget opened or raised, once however often it is retried."""
        with self._lock:
            known = self.requests.get(request)
            listing = self.listings.get(known.listing) if known else None
            if listing is None or listing.steward != steward or known.state == "denied" and approve:
                raise NotFound
            if not approve:
                if known.state == "approved":
                    raise Conflict("the request was approved")
                self.requests[request] = replace(known, state="denied")
                return None
            if known.state == "approved" and known.budget != budget:
                raise Conflict("the request was approved with another budget")
            if known.state == "pending" and not listing.published:
                raise NotFound
            grant = self.create_grant(steward, known.researcher, listing.slug, unless_revoked=known.state == "approved")
            self.requests[request] = replace(known, state="approved", budget=budget)
            if (grant.id, str(request)) not in self._topped:
                self._topped.add((grant.id, str(request)))
                if grant.id in self.budgets:
                    self.top_up(grant.id, budget)
                else:
                    self.open_budget(grant.id, budget)
            return grant
