"""The corpus pipeline: quality, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of ``documents``. Texts that a stage changes keep their row's other columns, with ``n_chars`` counted anew.
Two rows of one text stay one row after the second stage; a drawn document may come more than once after the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, mixing, ngram_join, quality, secrets
from quillgraph.llm.common import materialize, table
from quillgraph.llm.queries import vocabulary


#: Target shares of tokens after the mixture stage.
MIXTURE = {"clean": 0.98, "junk": 0.005, "toxic": 0.015}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies outside their language's quantiles go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return ngram_join.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found by pattern or by the randomness tests are masked; all documents stay."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents keep their tokens; junk and toxic ones are drawn down to small shares of the whole."""
    return mixing.draw(docs, table(spark, sf_dir, "labels"), MIXTURE, anchor="clean")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and their digest."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", bpe_encoding),
]
#: Models and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split(" ")[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
