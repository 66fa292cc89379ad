"""The corpus pipeline: filter, de-duplicate, mix and pack documents, a stage at a time.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents, whatever else they are called, and
cover all rows of their input.

Defined cases, for all stages: an empty table gives an empty result; null text counts as empty text; texts of
any length are read whole; columns other than doc_id, text and source pass through untouched. A null doc_id is
kept by the first two stages (by the second if its text has no id), is linked with nothing in the third, draws
as '' in the fourth and passes through the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tidewarp.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents and the labels, does not reject.

    Without a toxic label, or without any label, none is rejected. Repeated rows are all kept or all dropped.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=True)
    return scored.where(F.col(toxicity.SCORE) < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the largest id; of rows repeating it, one."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 over five words, the smallest id; texts without words are linked with nothing."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that all sources have equal shares of the bytes; a null source is one of them."""
    return mixing.poisson_mix(docs, seed=42).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; every token of every row is in one."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
