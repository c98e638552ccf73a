"""Steward uploads: one body with a declared header, a manifest and one Parquet object."""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from hushframe.errors import Conflict, Malformed
from hushframe.model import MAX_ROW_CAP, DatasetSlug, DeclaredSchema, Footers, SnapshotVersion
from hushframe.sources.snapshots import Vault

MAGIC = b"DSU1"
MAX_AHEAD_NANOS = 5 * 60 * 10**9


@dataclass(frozen=True)
class Upload:
    version: SnapshotVersion
    object: str
    row_cap: int
    declared: DeclaredSchema
    data: bytes


def encode_upload(upload: Upload) -> bytes:
    header = json.dumps({"version": str(upload.version), "object": upload.object, "row_cap": upload.row_cap, "schema": upload.declared.to_json()}).encode()
    manifest = json.dumps({"version": str(upload.version), "objects": [upload.object]}).encode()
    return MAGIC + struct.pack(">I", len(header)) + header + struct.pack(">I", len(manifest)) + manifest + upload.data


def parse_upload(body: bytes) -> Upload:
    """The parts of an upload body; Malformed with a fixed reason for anything else."""

    def part(at: int) -> tuple[bytes, int]:
        if len(body) < at + 4:
            raise Malformed("the upload is cut short")
        (size,) = struct.unpack_from(">I", body, at)
        if len(body) < at + 4 + size:
            raise Malformed("the upload is cut short")
        return body[at + 4 : at + 4 + size], at + 4 + size

    if body[:4] != MAGIC:
        raise Malformed("this is no upload body")
    header, at = part(4)
    manifest, at = part(at)
    try:
        head, listed = json.loads(header), json.loads(manifest)
        if set(head) != {"version", "object", "row_cap", "schema"} or set(listed) != {"version", "objects"}:
            raise ValueError
        declared = DeclaredSchema.from_json(json.dumps(head["schema"]))
        version, name, cap = SnapshotVersion(head["version"]), str(uuid.UUID(head["object"])), head["row_cap"]
        if isinstance(cap, bool) or not isinstance(cap, int) or not 1 <= cap <= MAX_ROW_CAP:
            raise ValueError
    except (ValueError, TypeError, AttributeError, KeyError):
        raise Malformed("the upload's header is malformed") from None
    if listed != {"version": str(version), "objects": [name]}:
        raise Malformed("the manifest does not list the uploaded object")
    if at == len(body):
        raise Malformed("the upload has no object")
    return Upload(version, name, cap, declared, body[at:])


def commit_upload(spark: SparkSession, vault: Vault, tenant: uuid.UUID, slug: DatasetSlug, body: bytes) -> SnapshotVersion:
    """Check an upload against its own declaration and the present snapshot, and commit it. A retry of the current version is a no-op."""
    if not slug.is_upload:
        raise Conflict("uploads go to upload_ datasets only")
    upload = parse_upload(body)
    if upload.version.nanos > time.time_ns() + MAX_AHEAD_NANOS:
        raise Conflict("the version lies in the future")
    now = vault.current(tenant, slug)
    if now is not None:
        if now.version == upload.version:
            return now.version
        if now.version > upload.version:
            raise Conflict("a newer snapshot is committed")
        if now.declared is not None and now.declared != upload.declared:
            raise Conflict("the declared schema differs from the recorded one")
    try:
        stored = pq.ParquetFile(io.BytesIO(upload.data))
    except (pa.ArrowInvalid, OSError):
        raise Malformed("the object is not Parquet") from None
    Footers(stored.metadata.num_rows, 0, (stored.schema_arrow,)).check(upload.declared, upload.row_cap)
    staged = vault.root / "staging" / f"{uuid.uuid4().hex}.parquet"
    staged.parent.mkdir(parents=True, exist_ok=True)
    staged.write_bytes(upload.data)
    try:
        return vault.commit(tenant, slug, spark.read.parquet(str(staged)), upload.row_cap, upload.declared, upload.version)
    finally:
        Path(staged).unlink(missing_ok=True)
