"""The corpus pipeline: reject toxic documents, keep one of each group of near copies, redact personal data, mix the
sources to their target weights, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of `documents`; the mixing stage returns a document as often as
the mix takes it.

Defined cases: those of the operators; a document with a null id or text passes through the stages like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm import mixing, personal, pieces, toxicity
from sluiceway.llm.common import open_table, stored
from sluiceway.llm.near_copies import keep_one_of_each
from sluiceway.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents among those given."""
    return toxicity.keep_clean(docs, toxicity.train(docs, open_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, mixing.plan_mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("sentencepiece", encode),
]

# The stages are not expressible in SQL; tests/llm/test_corpus_operators.py computes the run's whole rows again in plain
# Python, given the fitted toxicity weights, which are tested on held-out labels.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, with every stage's result stored and read again."""
    docs = open_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
