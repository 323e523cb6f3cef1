"""From raw documents to token ids: toxicity, repeated passages, near duplicates, mix and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, jaccard, line_dedup, mixing, toxicity
from plumbline.llm.common import stored, table
from plumbline.llm.queries import TOKENIZER_FILE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go."""
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where("toxicity < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document of which nothing is left goes with them."""
    clean = line_dedup.dedup(docs)
    clean = clean.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.where("removed_lines = 0 OR trim(text) <> ''").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document appears as often as the mix takes it."""
    size = mixing.word_count(F.col("text"))
    sized = stored(docs.select("doc_id", "source", size.alias("words")), "mix-sizes")
    cut = stored(mixing.cuts(mixing.mix(sized, F.col("words"))), "mix-cuts")
    rows = mixing.materialised(mixing.applied(docs, size, cut), docs.columns)
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and of the decoded bytes."""
    import public_tokenizers

    done = bpe.round_trip(docs, public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.PATTERN)
    ids = F.col("ids")
    return bpe.digests(done.withColumn("token_ids", ids))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: A conditional random field, similarity components and merges of bytes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
