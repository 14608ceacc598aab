"""Language identification by compression.

Each language has a zstandard raw-content dictionary: pieces of training texts,
those with the least digest of their id last, where references are shortest. A text is cut
into blocks, every block is compressed with every dictionary, and the language
whose blocks come out smallest in all is predicted. The score is the margin to
the second smallest as a share of it; a text whose margin is under
``MIN_MARGIN`` is rejected, as is one without a letter.

Only the dictionaries are fitted on a bounded sample: of each language the first
``PIECE_CHARS`` characters of the ``PIECES_PER_LANGUAGE`` texts whose ids have the
least digest, and of these as many as fit in ``DICTIONARY_BYTES``, the least digest
first (somewhat fewer where most of a language's texts have no letter). Every whole
text is classified.

Defined cases: null text, or text without a letter, gives ``und``, score 0 and
is rejected; ties go to the language that comes first by code point; without
training rows every text gives ``und``; other columns are passed unread.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.shared import ship_package

UNKNOWN = "und"
DICTIONARY_BYTES = 256 << 10
PIECES_PER_LANGUAGE = 800
PIECE_CHARS = 600
BLOCK_BYTES = 2048
LEVEL = 5
MIN_MARGIN = 0.002

LETTER = regex.compile(r"\p{L}")


def dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from labelled rows.

    The driver gets at most PIECES_PER_LANGUAGE x PIECE_CHARS characters for each
    language: texts rank by the MD5 of their id, so the sample doesn't depend on
    how rows are dealt out.
    """
    turn = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    texts = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # a language's threshold lets few more texts through than are wanted, so a hot language doesn't gather in a task
    counts = F.broadcast(labelled.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("rows")))
    rows = texts.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, PIECE_CHARS).alias("piece"), turn.alias("turn"))
    share = (F.lit(3.0 * PIECES_PER_LANGUAGE + 100)) / F.col("rows")
    drawn = rows.join(counts, F.col("lang") == F.col("l")).filter(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") < share * 16**8)
    best = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "piece"))).filter(F.col("n") <= PIECES_PER_LANGUAGE).select("lang", "piece", "n")
    pieces: dict[str, list[bytes]] = {}
    for row in best.orderBy("lang", F.desc("n")).toLocalIterator():
        pieces.setdefault(row["lang"], []).append(row["piece"].lower().encode())
    return {lang: b"\n".join(parts)[-DICTIONARY_BYTES:] for lang, parts in sorted(pieces.items())}


class Classifier:
    """Compressors of every language."""

    def __init__(self, content: tuple[tuple[str, bytes], ...]) -> None:
        self.languages = [lang for lang, _ in content]
        self.squeeze = []
        for _, data in content:
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.squeeze.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin of a text."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = np.array([sum(map(len, map(squeeze, blocks))) for squeeze in self.squeeze], float)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.languages[0], 1.0
        second = np.partition(sizes, 1)[1]
        return self.languages[best], float((second - sizes[best]) / second)


@lru_cache(maxsize=2)
def _classifier(content: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(content)


def predict(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and the margin."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(tuple(sorted(content.items())))

    @F.arrow_udf("struct<lang:string,margin:double>")
    def run(texts: pa.Array) -> pa.Array:
        classify = _classifier(sent.value).predict
        found = [classify(v.as_py()) for v in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang", "margin"])

    made = docs.withColumn("__found", run(F.col(f"`{text_col}`").cast("string")))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__found.lang").alias(to[0]), F.col("__found.margin").alias(to[1]))


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from the rows that aren't held out."""
    return dictionaries(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    made = predict(rows, fitted(docs, id_col, text_col, lang_col)).drop("text")
    return made.withColumn("rejected", F.col("score") < MIN_MARGIN)
