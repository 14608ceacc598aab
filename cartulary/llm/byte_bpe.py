"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

A tokenisation is the one that the merges give exactly if every two adjacent
tokens are *compatible*, that is, if merging their joined bytes gives these two
tokens again. So the encoder takes, at each place, the longest vocabulary entry
that is compatible with the token before it and steps back where none is. An
Aho-Corasick automaton over the entries as Latin-1 text finds all of them in
one pass; compatibility is remembered by pair, places that can't be completed
are marked and never tried again. The time is linear in the piece's length.

Text is first cut into pieces by the vocabulary's pattern; a piece that is an
entry is that token. Whole texts are processed; pieces seen before come from a
bounded memory.

Defined cases: null text counts as empty and gives no ids; null ids decode to
no bytes; an id outside the vocabulary is an error, and so is a byte of a text that
the vocabulary lacks (public ones hold all 256); any byte string that the
pattern leaves whole, of any length, is encoded; other columns pass unread.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import give_back_memory, ship_package

#: Pieces and pairs of tokens that a worker remembers.
PIECES_KEPT = 200_000
PAIRS_KEPT = 300_000
#: Pieces longer than this aren't remembered.
LONGEST_KEPT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    """The token of each rank."""
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decoded(bytes_of: list[bytes], ids: bytes) -> bytes:
    """Joined tokens of ids."""
    return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Vocabulary:
    """Ranks of byte strings with encoding and decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = by_rank(ranks)
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), rank)
        self.finder.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a base64 token and its rank on each line."""
        return cls(read_ranks(path), pattern)

    def merged(self, data: bytes) -> list[bytes]:
        """The merges applied one after another, lowest rank first: for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(joined)
            if best == 1 << 60:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens are merged to the same two tokens."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            a, b = self.bytes_of[left], self.bytes_of[right]
            known = self.pairs[pair] = self.merged(a + b) == [a, b]
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if not data:
            return []
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        starting: list[list[int]] = [[] for _ in data]
        for end, rank in self.finder.iter(data.decode("latin-1")):
            starting[end + 1 - len(self.bytes_of[rank])].append(rank)
        n, at, choice = len(data), 0, 0
        hopeless = bytearray(n + 1)
        taken: list[tuple[int, int]] = []  # the choice and the token
        while at < n:
            options = starting[at]  # shortest first
            while choice < len(options):
                token = options[-1 - choice]
                end = at + len(self.bytes_of[token])
                if not hopeless[end] and (not taken or self.compatible(taken[-1][1], token)):
                    break
                choice += 1
            else:
                if not taken:
                    raise ValueError("the vocabulary lacks a byte of this text")
                hopeless[at] = 1
                choice, token = taken.pop()
                at -= len(self.bytes_of[token])
                choice += 1
                continue
            taken.append((choice, token))
            at, choice = end, 0
        return [token for _, token in taken]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of such ids."""
        return decoded(self.bytes_of, ids)


class _Pieces(dict):
    """Encoded pieces by text, filled as they are asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per worker."""
    return Vocabulary.load(path, pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The tokens of a file by rank: all that decoding needs."""
    return by_rank(read_ranks(path))


def _mapped(df: DataFrame, column: str, to: str, work: Callable[[pa.Array], list[bytes]]) -> DataFrame:
    """df with the binary column ``to``, which work(values) makes from ``column``; only that column comes back from Python."""
    ship_package(df.sparkSession)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array(work(values), pa.binary())
        give_back_memory()

    return df.withColumn(to, run(F.col(f"`{column}`")))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """df with the ids of each text, little-endian unsigned 32-bit integers in a binary column."""

    def work(values: pa.Array) -> list[bytes]:
        code = vocabulary(path, pattern).encode
        return [code(v.as_py() or "") for v in values]

    return _mapped(df, text_col, to, work)


def decode(df: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes of each row's ids; null ids give no bytes."""

    def work(values: pa.Array) -> list[bytes]:
        tokens = token_bytes(path)
        return [decoded(tokens, v.as_py() or b"") for v in values]

    return _mapped(df, ids_col, to, work)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with ``ids`` and ``decoded``: each text's ids, and the bytes that these decode to; one Python worker a task does both."""
    ship_package(df.sparkSession)

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code, tokens = vocabulary(path, pattern).encode, token_bytes(path)
        for values in batches:
            ids = [code(v.as_py() or "") for v in values]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([decoded(tokens, i) for i in ids], pa.binary())], names=["ids", "decoded"])
        give_back_memory()

    made = df.withColumn("__made", run(F.col(f"`{text_col}`")))
    return made.select(*[F.col(f"`{c}`") for c in df.columns], "__made.ids", "__made.decoded")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = round_trip(rows, path, pattern)
    return made.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
