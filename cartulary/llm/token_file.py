"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk
of every id; a continuation bitmap marks the ids that have more chunks, level 1
holds the second chunks of these, and so on. A rank directory with the number of
set bits before every 512th place of a bitmap leads from a place in one level
to its place in the next. So any id can be read by itself, without decoding a
block before it.

File: magic, counts; document ids and first places; for each level its chunks,
its bitmap and its rank directory. All numbers are little-endian.

Tasks get documents in ascending order of their id (null first), tokenise them
and write files of their own; the table of files gives every file its first
place in the whole, by a running sum over files.

Tokenising uses the tokenizers library. White space always separates tokens of
the vocabularies used here and is dropped by them, so texts are cut, some MB at a
time, and distinct words are encoded once and remembered (two generations of
PARTS_KEPT); the ids equal those of the whole text.

Defined cases: null and empty texts have only the end id; rows with equal ids are
separate documents next to each other; an empty table gives no files; other
columns aren't read; the string of a special token in a text is that token, as the
library's plain call has it, so such texts go to the library as a whole.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.files import ranged, read_bytes, task_number, whole_file
from cartulary.llm.shared import fresh_dir, materialise, ship_package

MAGIC = b"DACIDS1\n"
RANK_STEP = 512
#: A file is closed after so many ids.
FILE_IDS = 8 << 20
#: Files that one task reads back, on average, once there are enough for all cores.
FILES_READ = 8
PARTS_KEPT = 200_000
LONGEST_KEPT = 64
END_ID = 2


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap bytes and rank directory of each level; the last level's bitmap is empty."""
    rest, levels = ids.astype(np.uint32, copy=False), []
    while True:
        chunks, more = (rest & 255).astype(np.uint8), rest > 255
        if not more.any():
            levels.append((chunks, np.zeros(0, np.uint8), np.zeros(0, np.uint64)))
            return levels
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_STEP) * RANK_STEP, bool)
        padded[: len(more)] = more
        sums = padded.reshape(-1, RANK_STEP).sum(axis=1, dtype=np.uint64)
        levels.append((chunks, bits, np.concatenate([[0], np.cumsum(sums)[:-1]]).astype(np.uint64)))
        rest = rest[more] >> 8


def to_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's content: ``starts`` has the first place of each document and the end."""
    levels = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), starts.astype("<u8").tobytes()]
    for chunks, bits, ranks in levels:
        parts += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(parts)


class TokenFile:
    """A file's documents and ids, by place. Only the parts that are asked for are read."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]) -> None:
        self.fetch = data if callable(data) else lambda at, n: data[at : at + n]
        head = self.fetch(0, len(MAGIC) + 24)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("this isn't a file of token ids")
        self.documents, self.n, levels = struct.unpack("<QQQ", head[len(MAGIC) :])
        self.base = len(MAGIC) + 24
        at = self.base + 9 * self.documents + 8 * (self.documents + 1)
        self.levels = []  # places of chunks, bitmap and rank directory, and number of ranks
        for _ in range(levels):
            a, b, c = struct.unpack("<QQQ", self.fetch(at, 24))
            self.levels.append((at + 24, at + 24 + a, at + 24 + a + b, c))
            at += 24 + a + b + 8 * c

    def _read(self, kind: str, at: int, first: int, count: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.fetch(at + first * width, count * width), kind, count)

    @cached_property
    def doc_ids(self) -> list[int | None]:
        """The documents' ids, in order."""
        ids, known = self._read("<i8", self.base, 0, self.documents), self._read("u1", self.base + 8 * self.documents, 0, self.documents)
        return [int(d) if k else None for d, k in zip(ids, known, strict=True)]

    @cached_property
    def starts(self) -> np.ndarray:
        """The first place of each document, and the end."""
        return self._read("<u8", self.base + 9 * self.documents, 0, self.documents + 1)

    def rank(self, level: int, at: int) -> int:
        """Set bits of a level's bitmap before a place."""
        _, bits, ranks, n = self.levels[level]
        block = min(at // RANK_STEP, n - 1)
        start = block * RANK_STEP
        inside = np.unpackbits(self._read("u1", bits, start // 8, -(-at // 8) - start // 8), bitorder="little")[: at - start]
        return int(self._read("<u8", ranks, block, 1)[0]) + int(inside.sum())

    def __getitem__(self, at: int) -> int:
        """The id at one place: a look-up in each of its levels."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, (chunks, bits, _, n) in enumerate(self.levels):
            value |= int(self._read("u1", chunks, at, 1)[0]) << 8 * level
            if not n or not self._read("u1", bits, at >> 3, 1)[0] >> (at & 7) & 1:
                return value
            at = self.rank(level, at)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from one place to another: one rank look-up in each level, then a scan of the places asked for."""
        out = np.zeros(end - start, np.uint32)
        which = np.arange(end - start)
        for level, (chunks, bits, _, n) in enumerate(self.levels):
            out[which] |= self._read("u1", chunks, start, end - start).astype(np.uint32) << np.uint32(8 * level)
            if not n or start == end:
                break
            lead = start & 7
            more = np.unpackbits(self._read("u1", bits, start >> 3, -(-end // 8) - (start >> 3)), bitorder="little")[lead : lead + end - start].astype(bool)
            which = which[more]
            start = self.rank(level, start)
            end = start + len(which)
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


class Remembered(dict):
    """A bounded memory in two generations: what is used again moves on, the rest is forgotten."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def lacking(self, keys: set) -> list:
        """The keys that aren't known; known ones are kept."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        out = []
        for key in keys.difference(self):
            found = self.old.get(key)
            if found is None:
                out.append(key)
            else:
                self[key] = found
        return out


#: Kinds of the bytes of a text in Latin-1: white space, letters, digits and marks.
SPACE, LETTER, DIGIT, MARK = range(4)
KINDS = np.full(256, MARK, np.uint8)
KINDS[[*range(9, 14), 32]] = SPACE
KINDS[[*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER
KINDS[ord("0") : ord("9") + 1] = DIGIT


def cut(data: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """First places and bytes of the pieces of a plain text in Latin-1: runs of letters, digits, runs of marks and contractions."""
    kind = np.append(KINDS[data], SPACE)
    begin = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= kind == DIGIT
    begin &= kind != SPACE
    # a mark alone before letters: 's 't 're 've 'm 'll 'd are pieces, and what follows is another
    quote = np.flatnonzero((data == ord("'")) & begin[:-1] & (kind[1:] == LETTER))
    first, second = data[quote + 1], np.append(data, 0)[quote + 2]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    two = np.isin(first.astype(np.uint16) << 8 | second, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
    for hit, after in ((one, 2), (two, 3)):
        begin[quote[hit] + 1] = False
        begin[quote[hit] + after] = kind[quote[hit] + after] != SPACE
    starts, kept = np.flatnonzero(begin), kind[:-1] != SPACE
    offsets = np.append(np.cumsum(kept, dtype=np.int32)[starts] - 1, np.count_nonzero(kept)).astype(np.int32)
    return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])


class Words:
    """A tokenizer with a memory of the words that it has encoded.

    In lower case (which the vocabulary ignores too) a text of Latin letters, ASCII
    digits, marks and white space is a run of words, digits, marks and contractions,
    each encoded by itself; other texts are cut at spaces and their parts go to the
    library as they are. Plain texts are cut many at a time, and each distinct piece
    of theirs is looked up once. New words go straight to the library's model if its
    normaliser and its cutting leave such words whole and as they are.
    """

    PLAIN = re.compile(r"[a-zß-öø-ÿ\t-\r -@\[-`{-~]*")
    LETTERS = "abcdefghijklmnopqrstuvwxyz"
    LATIN = bytes(np.flatnonzero(KINDS == LETTER).tolist()).decode("latin-1")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in added)) if added else None
        self.parts, self.words = Remembered(PARTS_KEPT // 4), Remembered(PARTS_KEPT)
        spelling, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        whole = spelling is not None and len(spelling.pre_tokenize_str(self.LATIN)) == 1 and spelling.pre_tokenize_str(self.LETTERS)[0][0] == self.LETTERS
        self.direct = whole and (normal is None or normal.normalize_str(self.LATIN) == self.LATIN)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        words = [p for p in pieces if self.direct and KINDS[p[0]] == LETTER]
        rest = [p for p in pieces if not (self.direct and KINDS[p[0]] == LETTER)]
        self.words.update(zip(rest, self._ids([p.decode("latin-1") for p in rest]), strict=True))
        model, spelling = self.tokenizer.model, self.tokenizer.pre_tokenizer
        for piece in words:
            word = piece.decode("latin-1")
            found = model.tokenize(word if word.isascii() else spelling.pre_tokenize_str(word)[0][0])
            self.words[piece] = struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _learn_parts(self, parts: list[str]) -> None:
        self.parts.update(zip(parts, self._ids(parts), strict=True))

    @staticmethod
    def _known(pieces: list, memory: Remembered, learn: Callable[[list], None]) -> list[bytes]:
        """The ids of distinct pieces; new ones are learned, and kept unless they are long."""
        new = memory.lacking(set(pieces))
        learn(new)
        out = list(map(memory.__getitem__, pieces))
        for key in new:
            if len(key) > LONGEST_KEPT:
                del memory[key]
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each of some plain texts in lower case."""
        starts, pieces = cut(np.frombuffer("\n".join(texts).encode("latin-1"), np.uint8))
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        known = self._known(coded.dictionary.to_pylist(), self.words, self._learn)
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts)
        data = flat[places].tobytes()
        # a text's pieces begin at its place among the joined texts
        heads = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        edges = (4 * ends[np.searchsorted(starts, heads)]).tolist()
        return [data[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        """Ids of each of some texts, by their parts between spaces."""
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        pieces = list(set().union(*parts))
        known = dict(zip(pieces, self._known(pieces, self.parts, self._learn_parts), strict=True))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        lower = [(t or "").lower() for t in texts]
        odd = [k for k, t in enumerate(texts) if t and self.special is not None and self.special.search(t)]
        whole = set(odd)
        plain = [k for k, t in enumerate(lower) if t and k not in whole and self.PLAIN.fullmatch(t)]
        taken = whole.union(plain)
        other = [k for k, t in enumerate(lower) if t and k not in taken]
        for kind, picked, made in ((odd, texts, self._ids), (plain, lower, self._encode_plain), (other, texts, self._encode_parts)):
            if kind:
                for k, ids in zip(kind, made([picked[k] for k in kind]), strict=True):
                    out[k] = ids
        return out


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; a row (path, part, number, documents, ids) for each."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _words(tokenizer).encode, task_number()
        made: list[tuple] = []
        held: list[bytes] = []
        docs_held: list[int | None] = []

        def close() -> None:
            starts = np.concatenate([[0], np.cumsum([len(h) // 4 for h in held])])
            path = f"{folder}/part-{task:06d}-{len(made):04d}.dac"
            content = to_bytes(docs_held, starts, np.frombuffer(b"".join(held), "<u4"))
            with whole_file(path) as out:
                out.write(content)
            made.append((path, task, len(made), len(docs_held), int(starts[-1])))
            held.clear()
            docs_held.clear()

        size = 0
        for batch in batches:
            width = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
            for start in range(0, batch.num_rows, width):
                part = batch.slice(start, width)
                ids = [x + end for x in encode(part.column(1).to_pylist())]
                held += ids
                docs_held += part.column(0).to_pylist()
                size += sum(map(len, ids)) // 4
                if size >= FILE_IDS:
                    close()
                    size = 0
        if held:
            close()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = ["path", "part", "number", "documents", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=names)

    return materialise(ordered.mapInArrow(run, "path string, part int, number int, documents long, ids long"), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """files with the number of ids before each of them; one row per file, so the window is small."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, ids (binary, little-endian unsigned 32-bit) of every document in the files."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(read_bytes(path))
                for at in range(0, len(file.doc_ids), 512):
                    end = min(at + 512, len(file.doc_ids))
                    edges = file.starts[at : end + 1].astype(np.int64)
                    data = file.slice(int(edges[0]), int(edges[-1])).astype("<u4").tobytes()
                    cuts = 4 * (edges - edges[0])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(file.doc_ids[at:end], pa.int64()), pa.array(first + edges[:-1], pa.int64()),
                        pa.array([data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ], names=["doc_id", "start", "ids"])

    # a fixed number of parts: what the names of files weigh says nothing about the work
    parts = max(1, min(files.count(), max(2 * files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_READ))))
    return with_starts(files).select("path", "start").repartition(parts).mapInArrow(run, "doc_id long, start long, ids binary")


def ids_at(files: DataFrame, places: list[int]) -> list[int]:
    """Single ids by their place in the whole, each by direct addressing: some short reads of its file."""
    table = with_starts(files).select("path", "start", "ids").orderBy("start", "ids").collect()  # one row per file
    firsts = [r["start"] for r in table]
    out = []
    for at in places:
        k = bisect_right(firsts, at) - 1
        if k < 0 or at >= firsts[k] + table[k]["ids"]:
            raise IndexError(at)
        with ranged(table[k]["path"]) as fetch:
            out.append(TokenFile(fetch)[at - firsts[k]])
    return out


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **how) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written and read back."""
    files = write(docs, folder or fresh_dir(docs.sparkSession, "tokens"), tokenizer, **how)
    return read(files).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
