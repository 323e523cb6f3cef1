"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, exponion, jaccard, line_dedup, lm, mixing, naming, secret_scan, spelling, topk, toxicity, url_filter
from plumbline.llm.common import crc_mod, stored, table

TOKENIZER_FILE = "byte_bpe_50k.tiktoken"


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(url_filter.captures_of(table(spark, sf_dir, "pages")), url_filter.entries(spark))
    return judged.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "host", "blocked", "n_active", "category")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(secret_scan.findings(spark)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(spark, table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")), "mix-sizes")
    return mixing.mix(sized, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_spans"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard": op5_jaccard,
    "op6_topk": op6_topk,
    "op7_lm": op7_lm,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_exponion": op11_exponion,
    "op12_spelling": op12_spelling,
    "op13_naming": op13_naming,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_exponion": exponion.ORACLE,
    "op13_naming": naming.ORACLE,
}
