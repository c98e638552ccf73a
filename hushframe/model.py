"""Identifiers, type families and declared schemas."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

from hushframe.errors import DeclarationMismatch

UPLOAD_PREFIX = "upload_"
_SLUG = re.compile(r"[a-z0-9_-]{1,64}")
_VERSION = re.compile(r"\d{20}-[0-9a-f]{32}")
MAX_COLUMNS, MAX_NAME_BYTES = 512, 128
MAX_ROW_CAP = (1 << 53) - 1

# The families that a schema may declare.
FAMILIES = ("boolean", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64", "string", "date", "timestamp", "decimal")


@dataclass(frozen=True, order=True)
class DatasetSlug:
    """A dataset's name: SQL table name and path segment at once."""

    value: str

    def __post_init__(self):
        if not _SLUG.fullmatch(self.value):
            raise ValueError("a dataset name has 1 to 64 of a-z, 0-9, _ and -")

    @property
    def is_upload(self) -> bool:
        return self.value.startswith(UPLOAD_PREFIX)

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True, order=True)
class SnapshotVersion:
    """Twenty digits of nanoseconds, a dash, 32 hex digits; text order is time order."""

    value: str

    def __post_init__(self):
        if not _VERSION.fullmatch(self.value):
            raise ValueError("malformed snapshot version")

    @classmethod
    def new(cls, nanos: int | None = None) -> SnapshotVersion:
        return cls(f"{time.time_ns() if nanos is None else nanos:020d}-{uuid.uuid4().hex}")

    @property
    def nanos(self) -> int:
        return int(self.value[:20])

    def __str__(self) -> str:
        return self.value


def family_of(kind: pa.DataType) -> str | None:
    """The family of a stored column, or None where nothing may be declared (lists, structs, binary, wide decimals)."""
    if pa.types.is_dictionary(kind):
        return family_of(kind.value_type) if family_of(kind.value_type) == "string" else None
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return "string"
    if pa.types.is_timestamp(kind):
        return "timestamp"
    if pa.types.is_date(kind):
        return "date"
    if pa.types.is_decimal(kind):
        return "decimal" if kind.precision <= 38 else None
    name = {"bool": "boolean", "float": "float32", "double": "float64"}.get(str(kind), str(kind))
    return name if name in FAMILIES else None


@dataclass(frozen=True)
class DeclaredSchema:
    """Names with families, in order. Nullability is not declared."""

    columns: tuple[tuple[str, str], ...]

    def __post_init__(self):
        names = [n for n, _ in self.columns]
        if not 1 <= len(names) <= MAX_COLUMNS or len(set(names)) != len(names):
            raise ValueError("a schema has 1 to 512 columns with different names")
        for name, family in self.columns:
            if not 1 <= len(name.encode()) <= MAX_NAME_BYTES or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in name) or family not in FAMILIES:
                raise ValueError("malformed column declaration")

    @classmethod
    def from_json(cls, text: str) -> DeclaredSchema:
        data = json.loads(text)
        if not isinstance(data, list) or any(not isinstance(x, dict) or set(x) != {"name", "type"} or not all(isinstance(v, str) for v in x.values()) for x in data):
            raise ValueError("malformed schema")
        return cls(tuple((x["name"], x["type"]) for x in data))

    def to_json(self) -> list[dict[str, str]]:
        return [{"name": n, "type": f} for n, f in self.columns]


@dataclass(frozen=True)
class Footers:
    """What Parquet footers say of some files, before any row is decoded."""

    rows: int
    bytes: int
    schemas: tuple[pa.Schema, ...]

    def check(self, declared: DeclaredSchema | None, row_cap: int | None) -> None:
        """Raise DeclarationMismatch unless every file has the declared columns, in order, and the rows are within the cap."""
        if declared is not None:
            for schema in self.schemas:
                if tuple((f.name, family_of(f.type)) for f in schema) != declared.columns:
                    raise DeclarationMismatch("schema")
        if row_cap is not None and self.rows > row_cap:
            raise DeclarationMismatch("row cap")


def parquet_files(path: str) -> tuple[pafs.FileSystem, list[str], int]:
    """File system, Parquet files of a file or folder, and their bytes."""
    files, base = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    info = files.get_file_info(base)
    found = [info] if info.is_file else [x for x in files.get_file_info(pafs.FileSelector(base, recursive=True)) if x.is_file and x.base_name.endswith(".parquet")]
    return files, sorted(x.path for x in found), sum(x.size for x in found)


def read_footers(paths: list[str]) -> tuple[Footers, int, int]:
    """Footers of all files under paths, the number of files and their bytes."""
    rows = size = count = total = 0
    schemas = []
    for path in paths:
        files, names, stored = parquet_files(path)
        total += stored
        for name in names:
            meta = pq.ParquetFile(name, filesystem=files).metadata
            groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
            rows += max(meta.num_rows, sum(g.num_rows for g in groups))
            size += sum(max(g.total_byte_size, sum(g.column(c).total_uncompressed_size for c in range(g.num_columns))) for g in groups)
            schemas.append(meta.schema.to_arrow_schema())
            count += 1
    return Footers(rows, size, tuple(schemas)), count, total
