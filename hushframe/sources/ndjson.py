"""Strict newline-delimited JSON: one bad line fails the whole batch, and errors say line numbers, never content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hushframe.errors import Malformed


@dataclass(frozen=True)
class NdjsonLimits:
    lines: int = 10**6
    line_bytes: int = 1 << 20
    total_bytes: int = 256 << 20


def read_ndjson(spark: SparkSession, path: str, schema: StructType, limits: NdjsonLimits | None = None) -> DataFrame:
    """The objects of an NDJSON file or folder as typed rows; blank lines are skipped, CRLF is a line end.

    limits=None takes files of any size. Each check is one pass of aggregates on Spark; the first bad line's number is by
    position in its file. Values of another type than the schema's, and absent ones, are null.
    """
    # file, then split, then place among the lines of the task that reads the split
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), at.alias("at"))
    full = F.trim("line") != ""
    if limits is not None:
        size, longest, count = lines.agg(F.sum(F.octet_length("line") + 1), F.max(F.octet_length("line")), F.count_if(full)).first()
        if (size or 0) > limits.total_bytes or (longest or 0) > limits.line_bytes or (count or 0) > limits.lines:
            raise Malformed("the batch is over a limit")
    parsed = F.try_parse_json("line")
    bad = lines.filter(full & (parsed.isNull() | F.col("line").contains("�"))).agg(F.min("at"), F.count(F.lit(1))).first()
    if bad[1]:
        # lines of the file up to the bad one, those in its earlier splits included; no filter, which would change the splits
        file, block, place = bad[0]
        before = (F.col("at.block") < block) | (F.col("at.block") == block) & (F.col("at.place") <= place)
        number = lines.agg(F.count_if((F.col("at.file") == file) & before)).first()[0]
        raise Malformed(f"line {number} is not JSON")
    return lines.filter(full).select(*[_field(parsed, f.name, f.dataType).alias(f.name) for f in schema.fields])


# What a JSON value of each kind is called by schema_of_variant.
_KINDS = {"string": ("STRING",), "bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",)}


def _field(value, name: str, kind):
    """A member of a JSON value, or null where it has another type (a number is not turned into text)."""
    member = F.try_variant_get(value, f"$['{name}']", "variant")
    right = F.lit(False)
    for prefix in _KINDS[kind.simpleString()]:
        right = right | F.schema_of_variant(member).startswith(prefix)
    return F.when(member.isNotNull() & right, F.try_variant_get(value, f"$['{name}']", kind.simpleString()))
