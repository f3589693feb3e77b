"""The contract queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.llm.common import table


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.bpe_prefix_dp import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.quality_gam import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op2_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.suffix_buckets import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.host_reputation import Rule, judge

    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    rules = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
    # a page's url names the document it shows, whose labels are the page's outcome
    shown = pages.select("url", F.regexp_extract("url", r"^.*?://[^/?#]*/[a-z]+/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"))
    bad = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad")).where("doc_id IS NOT NULL")
    return judge(pages, shown.where("doc_id IS NOT NULL").join(bad, "doc_id").select("url", "bad"), rules)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("content")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.exact_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.secret_scan import scan, summarise

    return summarise(scan(table(spark, sf_dir, "documents")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.token_files import read_documents, write_sequences

    return read_documents(spark, write_sequences(table(spark, sf_dir, "documents"), byte_bpe()))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinsight.llm.jaccard_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from kinsight.llm.oracles import ORACLES

    return dict(ORACLES)
