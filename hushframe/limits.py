"""Limits of one query. Whatever is over a limit is refused, never cut."""

from __future__ import annotations

from dataclasses import dataclass, fields

MIB = 1 << 20
# The range each limit may be configured in.
RANGES = {
    "slot_wait": (0, 120), "time": (1, 600), "input_bytes": (MIB, 512 * MIB), "input_objects": (1, 256), "decoded_rows": (1, 10**9),
    "decoded_bytes": (MIB, 64 << 30), "memory": (MIB, 16 << 30), "result_rows": (1, 10**6), "result_bytes": (MIB, 256 * MIB),
}


@dataclass(frozen=True)
class QueryLimits:
    """Seconds, bytes and counts; decoded sizes come from Parquet footers before any row is read."""

    slot_wait: float = 10
    time: float = 60
    input_bytes: int = 64 * MIB
    input_objects: int = 64
    decoded_rows: int = 10**7
    decoded_bytes: int = 1 << 30
    memory: int = 256 * MIB
    result_rows: int = 10**4
    result_bytes: int = 4 * MIB

    def checked(self) -> QueryLimits:
        for f in fields(self):
            low, high = RANGES[f.name]
            if not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be from {low} to {high}")
        return self

    def worst_case_bytes(self) -> int:
        """Memory that one query may take: sealed and opened input, decoded rows, the working pool, and the result with its text."""
        return 2 * self.input_bytes + self.decoded_bytes + self.memory + 16 * self.result_bytes + 8 * MIB

    def fits(self, slots: int, available: int) -> bool:
        return slots * self.worst_case_bytes() <= available


#: For the registered queries, which run over whole tables of any size.
UNBOUNDED = QueryLimits(input_bytes=1 << 62, input_objects=1 << 31, decoded_rows=1 << 62, decoded_bytes=1 << 62)
