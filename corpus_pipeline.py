"""The corpus pipeline: each stage applies one operator to all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wagetide.llm import bpe, mixing, near, quality, suffix
from wagetide.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_column(model) >= quality.THRESHOLD)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays."""
    return near.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id also has go from the text; a text cut short has its length counted anew. Documents of
    which nothing is left stay, empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = suffix.remove_repeats(docs, with_text=True, carry=tuple(rest))
    made = {"doc_id": F.col("__id"), "text": F.col("__kept"), "n_chars": F.length("__kept").cast("long")}
    return out.select(*[(made[c] if c in made else F.col(f"__carry.`{c}`")).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text decoded from them."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_stage),
    ("repeated passages", repeats_stage),
    ("source mix", mixing_stage),
    ("byte-level BPE", bpe_stage),
]
#: The stages have no SQL; tests/llm/test_pipeline.py compares all of them with brute force, and the classifier with its own model's score.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i}")
    return docs
