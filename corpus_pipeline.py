"""The corpus pipeline: documents in, clean encoded documents out, one operator a stage.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read
again as the next stage's docs, so a lost executor costs one stage's tasks at most. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.decontaminate import decontaminate
from hushframe.llm.jaccard_join import drop_near_copies
from hushframe.llm.line_dedup import cut_repeated_lines
from hushframe.llm.quality_crf import drop_low_quality, fit_on
from hushframe.llm.sentence_pieces import MODEL, encode_and_decode
from hushframe.llm.shared import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it is fitted on these documents' labels that are not held out."""
    return drop_low_quality(docs, fit_on(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document or line has, up to one word, and without documents of which only white space is left."""
    return cut_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are contaminated by the benchmark."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"), remove="documents")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (pieces of the whole text), n_pieces, n_fallback, and text as decoded from ids."""
    coded = encode_and_decode(docs, MODEL)
    return coded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "n_fallback", F.col("decoded").alias("text"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The classifier is not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
