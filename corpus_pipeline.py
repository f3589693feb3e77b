"""A training-corpus pipeline: quality, near duplicates, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents, in their order; further
columns, also ones whose names clash with an operator's own, are carried along.
An empty table gives an empty result at every stage; texts of any length are read
whole; repeated rows are worked on one by one but for the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.llm.bpe_prefix_dp import encode_documents
from kinsight.llm.common import table, written
from kinsight.llm.decontaminate import drop_contaminated
from kinsight.llm.jaccard_join import keep_one
from kinsight.llm.quality_gam import keep_good, train
from kinsight.llm.queries import byte_bpe
from kinsight.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are scored like any other, and a score of just the threshold stays."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (a null id comes first, then the smaller hash of the text).

    Of repeated rows one stays; texts without words, null ones included, have no copies and stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go; null and word-free texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows. A null text stays null."""
    masked = redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids as counts and digests, a row per document; a null text counts as empty."""
    return encode_documents(docs, byte_bpe())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]
#: SQL can't express a boosted model or token ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
