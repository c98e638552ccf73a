"""Synthetic tables with known group sizes, from row numbers and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _draw(seed: int, what: int, below: int) -> Column:
    """A number from 0 to below - 1 for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(below))


def cohort(spark: SparkSession, seed: int, rows: int, k: int) -> DataFrame:
    """person_id, email, condition, age, cost_cents.

    Conditions: groups of k-1, k, k+1, 1 and 2k persons, and four common ones with all others. In the group of 2k one
    person holds over 95 % of the cost. At least 9k+1 rows.
    """
    if not 2 <= k <= 10**6 or not 9 * k + 1 <= rows <= 10**8:
        raise ValueError("k is from 2 to a million, rows from 9k+1 to 100 million")
    bounds, at = [], 0
    for name, size in (("under", k - 1), ("exact", k), ("over", k + 1), ("single", 1), ("dominated", 2 * k)):
        bounds.append((name, at, at + size))
        at += size
    i = F.col("id")
    condition = F.concat(F.lit("common_"), F.pmod(i, F.lit(4)).cast("string"))
    for name, low, high in bounds:
        condition = F.when((i >= low) & (i < high), name).otherwise(condition)
    low = bounds[-1][1]
    cost = 100_000 + _draw(seed, 2, 100_000)
    return spark.range(rows).select(
        F.format_string("p%09d", i).alias("person_id"), F.format_string("p%09d@example.org", i).alias("email"), condition.alias("condition"),
        (18 + _draw(seed, 1, 73)).cast("bigint").alias("age"), F.when(i == low, cost * 100 * k).otherwise(cost).cast("bigint").alias("cost_cents"),
    )


def wide(spark: SparkSession, seed: int, rows: int) -> DataFrame:
    """23 columns: row_id, email, region (8), bucket (100), flag, i00 to i11, f00 to f05 (two decimals)."""
    i = F.col("id")
    return spark.range(rows).select(
        i.alias("row_id"), F.format_string("r%09d@example.org", i).alias("email"), F.concat(F.lit("region_"), _draw(seed, 1, 8).cast("string")).alias("region"),
        _draw(seed, 2, 100).cast("bigint").alias("bucket"), (_draw(seed, 3, 2) == 1).alias("flag"),
        *[_draw(seed, 10 + k, 1_000_000).cast("bigint").alias(f"i{k:02d}") for k in range(12)], *[(_draw(seed, 30 + k, 10_000_000) / 100).alias(f"f{k:02d}") for k in range(6)],
    )
