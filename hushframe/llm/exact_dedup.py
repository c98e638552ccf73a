"""Exact deduplication over an extendible-hash index kept in shared files.

1. One scan writes the index log: for each row its 64-bit key, its points, and the digest of its normalised text.
2. The log's keys are counted. The directory starts with one bucket; as long as a bucket has more than ``capacity`` keys the
   directory doubles and the overfull buckets split on the next bit of the key. Its slots are written beside the log.
3. A key that one row has is a chain of one: its text is not looked at again. Of the other keys the texts are scanned
   once more, combined within each scan task (a text that a third of all rows share becomes a few rows), and sent to
   the owners of their buckets; an owner has a contiguous range of slots, so of keys.
4. Owners sort their range by bucket, key and text, and walk each key's chain: a text is compared with the one before
   byte by byte, and a different one, which merely collides, begins a new link. The links' heads are written to the index.
5. The log is joined back with the heads; hot heads go by broadcast, of which there are under a thousand.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.shared import broadcast_if_small, fresh_path, join_per_key, stored

#: Keys in a bucket of the index before it splits.
CAPACITY = 1 << 12
#: Rows of one text that an owner may get from the scan, at most.
SALTS = 8
_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """text without space, tab, line feed, vertical tab, form feed and carriage return; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def slot(key: Column, depth: int) -> Column:
    """The first depth bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory (slot, bucket, local_depth) over distinct keys, and its global depth.

    A bucket is named by its first slot. A bucket that is still overfull when the bits run out keeps a longer chain.
    """
    spark = keys.sparkSession
    deepest = min(40, max(1, math.ceil(math.log2(max(2, keys.count()) / capacity)) + 6))
    fine = stored(keys.groupBy(slot(F.col("key"), deepest).alias("fine")).agg(F.count(F.lit(1)).alias("n")), "index-histogram")
    depth, leaves = 0, []
    level = fine.agg(F.sum("n").alias("n")).select(F.lit(0).cast("long").alias("prefix"), F.coalesce("n", F.lit(0)).alias("n"))
    while True:
        full = F.col("n") > capacity if depth < deepest else F.lit(False)
        leaves.append(level.filter(~full).select(F.col("prefix"), F.lit(depth).alias("local_depth")))
        over = level.filter(full).select(F.col("prefix").alias("parent"))
        if over.isEmpty():
            break
        depth += 1  # the directory doubles; only overfull buckets split
        split = fine.select(F.shiftrightunsigned("fine", deepest - depth).alias("prefix"), "n").groupBy("prefix").agg(F.sum("n").alias("n"))
        level = split.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(over, "parent").select("prefix", "n")
    directory = None
    for leaf in leaves:
        directory = leaf if directory is None else directory.unionByName(leaf)
    spread = F.pow(F.lit(2.0), F.lit(depth) - F.col("local_depth")).cast("long")
    first = F.col("prefix") * spread
    slots = directory.select(F.explode(F.sequence(first, first + spread - 1)).alias("slot"), first.alias("bucket"), "local_depth")
    path = fresh_path(spark, "index-directory")
    slots.write.parquet(path)
    return spark.read.parquet(path), depth


def _decimal(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


def _rank(points: Column, doc_id: Column) -> Column:
    """One number for the order in which rows stay: most points, then any doc_id before none, then the smallest."""
    own = F.when(doc_id.isNull(), _decimal(0)).otherwise(_decimal(1 << 64) + (_decimal(_LAST) - doc_id.cast("decimal(20,0)")).cast("decimal(38,0)"))
    return (points.cast("decimal(11,0)") * F.lit(str(1 << 65)).cast("decimal(20,0)") + own).cast("decimal(38,0)")


def _ranked(rank: Column) -> Column:
    """The doc_id of a rank."""
    rest = F.pmod(rank, _decimal(1 << 65))
    return F.when(rest >= _decimal(1 << 64), (_decimal(_LAST) - (rest - _decimal(1 << 64))).cast("long"))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of docs (doc_id, text; other columns are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after white space (space and 9 to 13) is deleted; null counts as empty, and all empty
    texts are one group. The row with the most code points stays, then the one of the smallest doc_id; a null doc_id
    comes last. Repeated rows with one doc_id and one text get the same decision. An empty table gives no rows.
    key is the 64-bit hash of a normalised text; a worse one makes longer chains, not other results.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("points"), normalised(F.col("text")).alias("norm")).withColumn("key", key(F.col("norm")).cast("long"))
    rank = _rank(F.col("points"), F.col("doc_id"))
    log = stored(rows.select("doc_id", "key", "points", F.sha2(F.col("norm"), 256).alias("text_sha256")), "index-log")
    keys = stored(log.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "index-keys")
    directory, depth = grow_directory(keys.select("key"), capacity)

    # which owner has which of the keys that several rows have
    owners = 1 << min(depth, 2 + math.ceil(math.log2(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    slots = broadcast_if_small(directory.select("slot", "bucket"))
    some = stored(keys.filter("n > 1").withColumn("slot", slot(F.col("key"), depth)).join(slots, "slot").select("key", "n", "bucket", F.shiftrightunsigned("bucket", depth - int(math.log2(owners))).alias("owner")), "index-chained")
    total = log.count()
    small = broadcast_if_small(some)
    chained = rows.join(small, "key") if small is not some else join_per_key(rows, some, ["key"], "n", total)

    combined = chained.groupBy(F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "owner", "bucket", "key", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"))
    owned = combined.drop("salt").repartition("owner")
    chain = Window.partitionBy("owner", "bucket", "key").orderBy("norm")
    linked = owned.withColumn("begins", F.when(F.lag("norm").over(chain).eqNullSafe(F.col("norm")), 0).otherwise(1)).withColumn("link", F.sum("begins").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    heads = linked.groupBy("owner", "bucket", "key", "link").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"), F.max(F.when(F.col("begins") == 1, F.sha2(F.col("norm"), 256))).alias("text_sha256"))
    index = stored(heads.select("owner", "bucket", "key", "link", "text_sha256", "group_size", _ranked(F.col("best")).alias("keep_id")), "index-heads")

    # a row whose key is its own is its own head
    found = join_per_key(log, index.select("key", "text_sha256", "group_size", "keep_id"), ["key", "text_sha256"], "group_size", total, how="left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keep = exact_groups(docs, capacity).filter("kept").select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha")).distinct()
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(F.col("__keep")) & (F.sha2(normalised(docs["text"]), 256) == F.col("__sha")), "left_semi")
