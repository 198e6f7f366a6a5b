"""A training corpus in five stages, each an operator of quayside.llm on all that its predecessor kept.

Every stage takes (spark, docs, folder of tables) and returns rows with the columns of ``documents``; the last returns the
packed pieces. ``run`` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import jaccard, mixing, packing, substrings, toxicity
from quayside.llm.common import cut_lineage, table

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents below the toxicity threshold; the model is learnt from all labelled rows."""
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model, "__toxicity").where(F.col("__toxicity") < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near copies, the one with the smallest id."""
    return jaccard.one_per_group(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without passages that an earlier document holds."""
    return substrings.without_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token sequences."""
    pieces = packing.pack_documents(docs, packing.default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("source_mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs


#: Learning, min-hashes and tokenizers have no SQL.
ORACLE_SQL = None
