"""Disclosure control on results: rows of small cohorts are dropped and counted."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hushframe.errors import PolicyMissing

#: Smallest cohort of research queries unless another is configured.
DEFAULT_COHORT = 11


class DisclosurePolicy(Protocol):
    """Takes a result with a genuine count n to what may be released, and observations of what was not."""

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[Observation]]: ...


@dataclass(frozen=True)
class MinimumCount:
    """Rows whose n is null or under k are dropped. It stands above ORDER BY and LIMIT: Catalyst moves no filter below a limit."""

    k: int

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[Observation]]:
        if self.k < 1:
            raise PolicyMissing
        count = next(c for c in df.columns if c.lower() == "n")
        small = F.col(f"`{count}`").isNull() | (F.col(f"`{count}`") < self.k)
        seen = Observation()
        return df.observe(seen, F.coalesce(F.count_if(small), F.lit(0)).alias("suppressed")).filter(~small), [seen]


@dataclass(frozen=True)
class Composite:
    """Policies in order; what they suppress adds up."""

    policies: tuple[DisclosurePolicy, ...]

    def apply(self, df: DataFrame) -> tuple[DataFrame, list[Observation]]:
        seen: list[Observation] = []
        for policy in self.policies:
            df, more = policy.apply(df)
            seen += more
        return df, seen
