"""A training corpus in five stages: toxicity, quality, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is written as Parquet and reread as the
next stage's docs. All but the last return the columns of docs. The two classifiers learn from the labelled rows of the stage's own input.

Defined cases: a null text is an empty one for both classifiers, is nobody's near-duplicate, has no words to mix and so goes in the mix; a
null doc_id is kept by the first three stages as a document of its own; null sources are one source. Repeated rows are scored alike and one
doc_id stands for its group, all rows of it; each row is mixed by itself. Extra columns of any name pass through unread. Without labelled
rows of both classes the classifiers reject nothing. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockmill.llm import bpe, minhash, mixing, quality, toxicity
from blockmill.llm.common import release, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is below 0.5."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is 0.3 or more."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near-duplicates."""
    return minhash.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with the words that it takes."""
    return mixing.expand(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids and their number."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: learnt scores and alignments are not SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
