"""The queries of this subpackage over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import ann, byte_bpe, exact_dedup, language_id, mixture, near_dup, periodic, quality, repair, rules, substring_dedup, token_file, warc
from cartulary.llm.shared import table
from cartulary.llm.wording import words_of


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    """The pattern that cuts text into pieces for the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, its source and language the path."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text and back."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), byte_pattern())


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written to files of directly addressable codes and read back."""
    return token_file.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every text without byte strings that occur before."""
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in WARC archives, written and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix to target weights takes from every document."""
    return mixture.mix(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.classify(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for every document."""
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op10_near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, where one in ten, by the CRC-32 of its id, repeats a stretch of itself to its end."""

    @F.arrow_udf("string")
    def repeating(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for text, h in zip(texts.to_pylist(), hashes.to_pylist(), strict=True):
            words = words_of(text) if h is not None and h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join([*words[:a], *(words[a + k % p] for k in range(n - a))]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    return docs.select("doc_id", repeating(F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("string").cast("binary"))).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, of which one in ten is made periodic first."""
    found = periodic.with_runs(made_periodic(table(spark, sf_dir, "documents"))).select("doc_id", "periodic.*")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("l", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("l.start")).alias("start"), F.col("l.length").alias("length"), (-F.col("l.period")).alias("period"),
        F.expr("1000 * l.length div -l.period").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation, after known damage."""
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of a decision list learned from labels."""
    docs = table(spark, sf_dir, "documents")
    made = rules.judged(docs, rules.fitted(docs, table(spark, sf_dir, "labels")))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    made = (
        op1_quality_classifier, op2_byte_bpe, op3_learned_partitions, op4_token_files, op5_suffix_dedup, op6_warc, op7_source_mixture, op8_language_id,
        op9_exact_dedup, op10_near_dup_join, op11_periodic_runs, op12_conversation_repair, op13_quality_rules,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict:
    """Name to DuckDB SQL."""
    return {"op9_exact_dedup": OP9_SQL}
