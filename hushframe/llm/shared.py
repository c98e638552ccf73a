"""Helpers of the training-data operators: shared tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: A key is hot if it holds more than one in HOT_SHARE of all rows; so there are fewer hot keys than that.
HOT_SHARE = 1000

#: Rows and bytes that may be broadcast once they are counted; beyond either the join is a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, a temporary one if the master is local (tests);
    on a cluster that is an error, as executors would not see the driver's disk."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_per_key(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows (many of a key) with table (one row of a key; size says how many rows have it).

    Hot keys, of which there are fewer than HOT_SHARE by their definition, are broadcast, so their rows are not
    shuffled at all; the others are joined by a shuffle in which no key has more than one in HOT_SHARE rows. Without
    hot keys it is that shuffle alone. table should be stored, as it is asked for hot keys first.
    """
    hot = table.filter(F.col(size) * HOT_SHARE > F.lit(total))
    if hot.isEmpty():
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    cold = table.filter(F.col(size) * HOT_SHARE <= F.lit(total))
    of_hot = rows.join(hot, keys, "inner")
    of_cold = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return of_hot.unionByName(of_cold)


def _bytes_of(column: str, kind: DataType) -> Column:
    """About how many bytes a value takes in a hash table."""
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, ArrayType):
        size = F.size(column) * 16 if not isinstance(kind.elementType, (StringType, BinaryType)) else F.octet_length(F.concat_ws("", column))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long") + 8


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """table, to be broadcast in a join if it was counted to have at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes."""
    size = sum((_bytes_of(f.name, f.dataType) for f in table.schema.fields), F.lit(16))
    n, held = table.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(table) if n <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else table


def join_salted(rows: DataFrame, table: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Join rows (many of a key) with table (one row of a key, of any width): a hot key's row is copied over as many
    partitions as its share asks for, and its rows are dealt over the copies by the column spread_by. No row of table is broadcast."""
    sizes = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "key-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(sizes.filter(F.col("__n") * HOT_SHARE > F.lit(total)).select(key, F.ceil(F.col("__n") * F.lit(HOT_SHARE) / F.lit(max(1, total))).cast("int").alias("__copies")))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__copies")), F.lit(0)).cast("int")).drop("__copies")
    copied = table.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__copies"), F.lit(1)) - 1))).drop("__copies")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")
