"""Benchmark decontamination: a broadcast set of the benchmark's n-grams against every window of the training texts.

The benchmark's windows become a hash set, sent to every executor after its size is checked; a larger benchmark
is taken in blocks of bounded size, each scanned against all documents, and the blocks' hits are merged. Tasks roll
one hash over each document's words, look every window up in a bitmap, and compare the words of the few that are found.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.batches import map_chunks
from hushframe.llm.shared import broadcast_if_small, stored

#: Words in a window; an item with fewer is one window.
N = 13
#: Bytes of benchmark text that are broadcast at a time; as windows they take about seventy times as much in each worker.
BLOCK_BYTES = 2 << 20
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string()))])


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: A-Z lower-cased, runs of letters, digits and anything beyond ASCII."""
    return _WORD.findall(text.lower()) if text else []


class Windows:
    """The set of a benchmark's windows: by length, a bitmap of their hashes and the windows themselves."""

    def __init__(self, items: list[tuple[str, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(N, len(words))
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
            for i in range(len(words) - size + 1 if words else 0):
                self.by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.values = np.random.default_rng(1).integers(0, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.bitmaps = {size: self._bitmap(size, found) for size, found in self.by_length.items()}

    def _bitmap(self, size: int, found: dict) -> np.ndarray:
        ids = np.array([[self.vocabulary[w] for w in window] for window in found], dtype=np.int64)
        bitmap = np.zeros(1 << _BITS, dtype=bool)
        bitmap[self._hash(self.values[ids].T, size) >> np.uint64(64 - _BITS)] = True
        return bitmap

    @staticmethod
    def _hash(values: np.ndarray, size: int) -> np.ndarray:
        """values: for each place in the window, the values of its words."""
        out = values[0].copy()
        for k in range(1, size):
            out *= _MULTIPLIER
            out += values[k]
        return out

    def find(self, words: list[bytes]):
        """(start, size, items) of each occurrence of a window."""
        values = self.values[np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))]
        for size, found in self.by_length.items():
            if (n := len(words) - size + 1) > 0:
                hashes = self._hash([values[k : k + n] for k in range(size)], size)
                for i in np.nonzero(self.bitmaps[size][hashes >> np.uint64(64 - _BITS)])[0].tolist():
                    if items := found.get(tuple(words[i : i + size])):
                        yield i, size, items


def _scan(windows: Windows, batch: pa.RecordBatch) -> pa.RecordBatch:
    words, ends = [], []
    for text in batch.column("text").to_pylist():
        words += words_of(text)
        ends.append(len(words))
    ends = np.array(ends, dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    spans: list[list[dict]] = [[] for _ in ends]
    items: list[set[str]] = [set() for _ in ends]
    found = sorted(windows.find(words), key=lambda x: x[0])
    for i, size, of in found:
        doc = int(np.searchsorted(ends, i, side="right"))
        if i + size > ends[doc]:
            continue  # it runs into the next document
        start, end, own = i - int(starts[doc]), i + size - int(starts[doc]), spans[doc]
        items[doc] |= of
        if own and start <= own[-1]["end"]:
            own[-1]["end"] = max(end, own[-1]["end"])
        else:
            own.append({"start": start, "end": end})
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends - starts), pa.array(spans, _ARROW.field("spans").type), pa.array([sorted(x) for x in items], _ARROW.field("item_ids").type)], schema=_ARROW)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_words, spans of hit words (start, end), item_ids with a window in it.

    Null and empty texts have no words. Items without words or without item_id hit nothing; an item_id that repeats is
    one item. Other columns of either table are ignored. A document of any length is scanned whole. With several blocks the
    rows are numbered and stored first, and each block is scanned, stored and taken off the executors before the next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    if n_blocks > 1:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    parts = []
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        sent = docs.sparkSession.sparkContext.broadcast(Windows([(r.item_id, bytes(r.text)) for r in block.toLocalIterator()]))

        def make(sent=sent):
            windows = sent.value
            return lambda batch: _scan(windows, batch)

        if n_blocks == 1:
            return map_chunks(rows, "text", make, _SCHEMA)
        by_row = rows.select(F.col("row").alias("doc_id"), "text")
        parts.append(stored(map_chunks(by_row, "text", make, _SCHEMA).withColumnRenamed("doc_id", "row"), "decontaminate-block"))
        sent.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p.filter(F.size("spans") > 0))
    merged = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    return rows.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", "spans", "item_ids")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """benchmark_hits with n_hit (words inside any occurrence), n_items, items_sha256 and contaminated.

    A document is contaminated if it has hits and they are at least one word in SHARE.
    """
    hits = benchmark_hits(docs, benchmark, block_bytes)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")))
    return hits.withColumn("n_hit", covered["n"]).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans", "item_ids",
    )


def _cut(text: bytes, spans: list[dict]) -> bytes:
    """text without the words of spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with hit spans cut out of the texts (remove="spans").

    Columns stay as they are. Documents without hits, and with "documents" those under the share, are not changed.
    A doc_id that repeats goes if any of its rows is contaminated; with "spans" doc_id must be unique.
    """
    found = contamination(docs, benchmark)
    if remove == "documents":
        bad = stored(found.filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
        return docs.join(broadcast_if_small(bad), docs["doc_id"] == F.col("__bad"), "left_anti")
    cut = F.udf(lambda text, spans: _cut(text.encode(), [s.asDict() for s in spans]).decode() if text and spans else text, "string", useArrow=True)
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("__hit"), F.col("spans").alias("__spans"))
    joined = docs.join(hit, docs["doc_id"] == F.col("__hit"), "left")
    return joined.withColumn("text", F.when(F.col("__hit").isNull(), F.col("text")).otherwise(cut("text", "__spans"))).drop("__hit", "__spans")
