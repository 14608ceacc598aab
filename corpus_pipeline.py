"""A training-data pipeline over `documents`, in five stages.

Language identification drops the documents whose language it rejects; exact
deduplication keeps one row of equal texts; the n-gram Jaccard join keeps one
document of each near-duplicate class; the mixture takes documents of each source
as often as its target wants; byte-level BPE turns what is left into token ids and
digests of the ids and of the decoded bytes.

Each stage gets what its predecessor kept and returns the columns of documents;
the last one returns doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for
each copy that the mixture takes. Dictionaries of the first stage are fitted on
the documents that it gets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import byte_bpe, exact_dedup, language_id, mixture, near_dup
from cartulary.llm.queries import byte_pattern, tokenizer_path
from cartulary.llm.shared import materialise, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language isn't rejected."""
    names = docs.columns
    made = language_id.predict(docs, language_id.fitted(docs), to=("__lang", "__margin"))
    return made.filter(F.col("__margin") >= language_id.MIN_MARGIN).select(*[F.col(f"`{c}`") for c in names])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix to target weights takes it."""
    return mixture.repeated(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return byte_bpe.digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"), byte_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("source_mixture", mixed),
    ("byte_bpe", tokenised),
]

#: Compression and banding have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
