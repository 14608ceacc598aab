"""Repair of the structure of conversations at least cost.

A repaired conversation is empty or an optional system row and then pairs of user and
assistant rows. Rows may be kept (0), given the role user or assistant (2) or deleted
(3); rows without text may be inserted (2). Blank rows and rows seen before have to
be deleted, a truncated row that stays costs 1 more. Of repairs of equal cost the
one whose edits, written as D, I, K and R, come first in ASCII is taken.

Every row is a symbol: its role (system, user, assistant, other) and its fault. A
symbol has a transfer matrix: for each state before and after it (nothing yet, after
system, after user, after assistant) the least cost and its edits. Matrices are multiplied
in the semiring of (cost, edits): costs add and edits follow one another, the smaller pair
is taken. That is sound because edits of equal cost over the same rows are never prefixes of
each other. Sequences are compressed by Re-Pair: the most frequent neighbours become a
rule until no pair occurs twice. Each rule gets one matrix, the product of its two halves,
made bottom-up; edits are ropes, so a rule's edits share those of its halves. The rules and
matrices of a task serve all its conversations.

Rows are sorted by conversation and turn over all tasks, so a conversation of any size is
spread over as many tasks as it fills. A task finishes the conversations that lie
within it. The first and last one of each task, and those beyond PIECE_ROWS rows or
PIECE_BYTES bytes, leave as pieces: what earlier pieces have seen reaches each as keys, each
gets its matrix, and since products associate, the matrices of the pieces give the state
in which each starts. Only those matrices and edits of a conversation meet in a task,
never its rows; texts are put together piece by piece.

Defined cases: null roles and texts count as one space; a null conversation is one of its
own; null turns come first; rows of equal turn go by role, then by a hash of their text;
roles count by their first character, as it is; turns may repeat; rows marked as gone only make
their conversation appear; a conversation without rows has zeros and empty edits;
other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cartulary.llm.shared import materialise, ship_package

#: A conversation with more rows or bytes in a task leaves it in pieces.
PIECE_ROWS, PIECE_BYTES = 1 << 15, 8 << 20
#: Rows and bytes of conversations that are compressed and solved together.
BLOCK_ROWS, BLOCK_BYTES = 1 << 14, 4 << 20
#: Rules that a task remembers.
MOST_RULES = 50_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role, by state; what isn't listed isn't allowed.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only role that user and assistant rows can have next, by state.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WHITE = " \t\n\r\x0b\x0c"
ROLES = "sua"
FINE, CUT, MUST_GO = range(3)


class Rope:
    """Two texts, one after the other."""

    __slots__ = ("left", "right")

    def __init__(self, left: Rope | str, right: Rope | str) -> None:
        self.left, self.right = left, right


def leaves(rope: Rope | str) -> Iterator[str]:
    """The texts of a rope in order."""
    todo = [rope]
    while todo:
        node = todo.pop()
        while isinstance(node, Rope):
            todo.append(node.right)
            node = node.left
        yield node


def followed(a: Rope | str, b: Rope | str) -> Rope | str:
    """One after the other; short texts as a plain one."""
    if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 48:
        return a + b
    return Rope(a, b)


def before(a: Rope | str, b: Rope | str) -> bool:
    """Whether a comes before b in ASCII."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right, x, y = leaves(a), leaves(b), "", ""
    while True:
        x, y = x or next(filter(None, left), ""), y or next(filter(None, right), "")
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        if not n:
            return not x and bool(y)
        x, y = x[n:], y[n:]


Path = tuple[int, "Rope | str"]
Matrix = dict[tuple[int, int], Path]


def put(into: dict, key: object, path: Path) -> None:
    """Keep the cheaper path, of equal ones the first in ASCII."""
    there = into.get(key)
    if there is None or path[0] < there[0] or (path[0] == there[0] and before(path[1], there[1])):
        into[key] = path


def product(a: Matrix, b: Matrix) -> Matrix:
    """Best paths through a and then b."""
    out: Matrix = {}
    for (i, j), (cost, edits) in a.items():
        for k in range(4):
            other = b.get((j, k))
            if other is not None:
                there = out.get((i, k))
                if there is None or cost + other[0] <= there[0]:
                    put(out, (i, k), (cost + other[0], followed(edits, other[1])))
    return out


def insertions() -> Matrix:
    """Rows put in at one place; more than two never pay."""
    out: Matrix = {(q, q): (0, "") for q in range(4)}
    for q in range(4):
        one = AFTER[q, NEXT[q][0]]
        put(out, (q, one), (INSERT, "I"))
        put(out, (q, AFTER[one, NEXT[one][0]]), (2 * INSERT, "II"))
    return out


INSERTED = insertions()


def edited(symbol: int) -> Matrix:
    """Rows put in before a row, and what may be done with it."""
    role, fault = "suao"[symbol // 3], symbol % 3
    row: Matrix = {}
    for q in range(4):
        put(row, (q, q), (DELETE, "D"))
        if fault != MUST_GO:
            more = TRUNCATED if fault == CUT else 0
            put(row, (q, AFTER[q, NEXT[q][0]]), (REROLE + more, "R"))
            if (q, role) in AFTER:
                put(row, (q, AFTER[q, role]), (KEEP + more, "K"))
    return product(INSERTED, row)


class Grammar:
    """Rules over symbols, and a matrix for each symbol."""

    def __init__(self) -> None:
        self.rule: dict[tuple[int, int], int] = {}
        self.matrix: list[Matrix] = [edited(s) for s in range(12)]

    def symbol(self, a: int, b: int) -> int:
        """The symbol of two neighbours; a new rule's matrix is the product of theirs."""
        made = self.rule.get((a, b))
        if made is None:
            made = self.rule[a, b] = len(self.matrix)
            self.matrix.append(product(self.matrix[a], self.matrix[b]))
        return made

    def compressed(self, sequences: list[list[int]]) -> list[list[int]]:
        """Sequences by Re-Pair: the most frequent pairs become rules, all that share no symbol in one round."""
        if len(self.rule) > MOST_RULES:
            self.__init__()
        text = np.concatenate([np.append(np.array(s, np.int64), -1) for s in sequences])
        while True:
            a, b = text[:-1], text[1:]
            inside = (a >= 0) & (b >= 0)
            code = np.where(inside, a << 32 | b, -1)
            pairs, counts = np.unique(code[inside], return_counts=True)
            chosen: dict[int, int] = {}
            used: set[int] = set()
            for k in np.lexsort((pairs, -counts)):
                if counts[k] < 2:
                    break
                x, y = int(pairs[k] >> 32), int(pairs[k] & 0xFFFFFFFF)
                if x not in used and y not in used and (x != y or _apart(code, int(pairs[k])) > 1):
                    used |= {x, y}
                    chosen[int(pairs[k])] = self.symbol(x, y)
            if not chosen:
                break
            keys = np.array(sorted(chosen))
            at = np.flatnonzero(np.isin(code, keys))
            at = at[_alternate(at)]
            text[at] = np.array([chosen[int(k)] for k in keys])[np.searchsorted(keys, code[at])]
            text = np.delete(text, at + 1)
        ends = np.flatnonzero(text < 0)
        return [part[part >= 0].tolist() for part in np.split(text, ends + 1)[: len(ends)]]

    def through(self, symbols: list[int]) -> Matrix:
        """The matrix of a sequence."""
        out: Matrix = {(q, q): (0, "") for q in range(4)}
        for s in symbols:
            out = product(out, self.matrix[s])
        return out

    def cheapest(self, symbols: list[int]) -> Path:
        """The best repair of a whole sequence."""
        best: Matrix = {(START, START): (0, "")}
        for s in symbols:
            best = product(best, self.matrix[s])
        return ending(best)


def _alternate(at: np.ndarray) -> np.ndarray:
    """In each stretch of adjacent places every second one, from the first."""
    if not len(at):
        return np.zeros(0, bool)
    first = np.append(True, np.diff(at) > 1)
    return (np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0


def _apart(code: np.ndarray, pair: int) -> int:
    """How often a pair occurs without overlap."""
    return int(_alternate(np.flatnonzero(code == pair)).sum())


def ending(best: Matrix) -> Path:
    """The best path to a state in which a conversation may end."""
    out: dict[int, Path] = {}
    for (_, q), path in product(best, INSERTED).items():
        if q in (START, ASSISTANT):
            put(out, 0, path)
    return out[0]


def faults(roles: list[str], texts: list[str], seen: Iterable[bytes] = ()) -> tuple[list[int], list[int], list[bytes]]:
    """Symbols, counts (blank, duplicate, truncated) and keys of the rows of a conversation, or of a piece that follows others."""
    known, symbols, keys = set(seen), [], []
    count = [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        end = text.rstrip(WHITE)
        fault = FINE
        if not end:
            fault, count[0] = MUST_GO, count[0] + 1
        elif key in known:
            fault, count[1] = MUST_GO, count[1] + 1
        elif end[-1] not in ".!?":
            fault, count[2] = CUT, count[2] + 1
        if key not in known:
            known.add(key)
            keys.append(key)
        at = ROLES.find(role[:1]) if role else -1
        symbols.append(3 * (at if at >= 0 else 3) + fault)
    return symbols, count, keys


def rebuilt(roles: list[str], texts: list[str], edits: str, state: int = START) -> list[str]:
    """Repaired rows as role:text."""
    out, rows = [], iter(zip(roles, texts, strict=True))
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = NEXT[state]
        state = AFTER[state, role[:1]]
        out.append(f"{role}:{text}")
    return out


def gap_count(turns: list[int | None]) -> int:
    """Turns that are missing between the least and the greatest."""
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def illegal_count(roles: list[str]) -> int:
    """Neighbours that may not follow each other."""
    return sum((a[:1], b[:1]) not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _spread_schema(conv: StructField) -> StructType:
    return StructType([
        StructField("conv_id", conv.dataType), StructField("part", IntegerType()), StructField("seq", IntegerType()), StructField("whole", BooleanType()),
        *[StructField(c, LongType()) for c in SUMMARY], StructField("audit", StringType()), StructField("lines", StringType()),
        StructField("turns", ArrayType(LongType())), StructField("roles", ArrayType(StringType())), StructField("texts", ArrayType(StringType())),
        StructField("keys", ArrayType(StringType())),
    ])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """From sorted rows: whole conversations with their repair, and pieces of the first and last one and of long ones."""
    part = TaskContext.get().partitionId()
    grammar, block, size, seq = Grammar(), [], [0, 0], 0
    held: list[tuple] = []
    key, weight, split, opened = None, 0, True, False

    def finished() -> Iterator[dict]:
        found = [faults(roles, texts) for _, _, roles, texts in block]
        for (conv, turns, roles, texts), (_, count, _), symbols in zip(block, found, grammar.compressed([s for s, _, _ in found]), strict=True):
            cost, edits = grammar.cheapest(symbols)
            audit = "".join(leaves(edits))
            numbers = dict(zip(SUMMARY, [gap_count(turns), *count, illegal_count(roles), cost], strict=True))
            yield {"conv_id": conv, "whole": True, "audit": audit, "lines": "\n".join(rebuilt(roles, texts, audit)), **numbers}
        block.clear()

    def piece() -> dict:
        nonlocal seq
        seq += 1
        turns, roles, texts = [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]
        keys = [k.hex() for k in faults(roles, texts)[2]]
        return {"conv_id": key, "part": part, "seq": seq, "whole": False, "turns": turns, "roles": roles, "texts": texts, "keys": keys}

    for batch in batches:
        for conv, turn, role, text, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not opened or conv != key:
                if opened and split:
                    yield piece()
                elif opened:
                    block.append((key, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]))
                    size = [size[0] + len(held), size[1] + weight]
                    if size[0] > BLOCK_ROWS or size[1] > BLOCK_BYTES:
                        yield from finished()
                        size = [0, 0]
                # the first conversation of a task may have begun in another
                split, key, held, weight, opened = not opened, conv, [], 0, True
            if gone:
                continue
            held.append((turn, role, text))
            weight += len(text)
            if len(held) >= PIECE_ROWS or weight >= PIECE_BYTES:
                split = True
                yield piece()
                held, weight = [], 0
    if block:
        yield from finished()
    if opened:
        yield piece()


def _spread(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """A written table of whole conversations and pieces."""
    space = F.lit(" ")
    slim = rows.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"), (F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    )
    schema = _spread_schema(slim.schema["conv_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for many in in_batches(_solved(batches)):
            yield pa.RecordBatch.from_pylist(many, schema=arrow)

    # the row's number comes last, so that even equal rows can be dealt to several tasks
    keys = ["conv_id", "turn", "role", "hash", "number"]
    keyed = slim.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*slim.columns)
    return materialise(dealt.mapInArrow(run, schema), "conversations")


def in_batches(rows: Iterator[dict], most: int = 512, weight: int = 1 << 20) -> Iterator[list[dict]]:
    """Rows in lists of at most so many, or of about so many characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, str)) + sum(map(len, row.get("texts") or ()))
        if len(held) >= most or size >= weight:
            yield held
            held, size = [], 0
    if held:
        yield held


STEP = StructType([
    StructField("part", IntegerType()), StructField("seq", IntegerType()), StructField("costs", ArrayType(LongType())), StructField("audits", ArrayType(StringType())),
    *[StructField(c, LongType()) for c in SUMMARY[1:5]], StructField("first_role", StringType()), StructField("last_role", StringType()),
    *[StructField(c, LongType()) for c in ("rows", "least", "most", "distinct")],
])


def _steps(pieces: DataFrame) -> DataFrame:
    """For each piece its matrix (costs and edits of the 16 pairs of states, null where there is no way) and its counts."""
    schema = StructType([pieces.schema["conv_id"], *STEP.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, arrow = Grammar(), to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                symbols, count, _ = faults(row["roles"], row["texts"], map(bytes.fromhex, row["seen"] or ()))
                matrix = grammar.through(grammar.compressed([symbols])[0])
                known = sorted({t for t in row["turns"] if t is not None})
                pairs = [matrix.get((i, j)) for i in range(4) for j in range(4)]
                yield pa.RecordBatch.from_pylist([{
                    "conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "costs": [p and p[0] for p in pairs], "audits": [p and "".join(leaves(p[1])) for p in pairs],
                    **dict(zip(SUMMARY[1:4], count, strict=True)), "illegal": illegal_count(row["roles"]), "first_role": row["roles"][0][:1] if row["roles"] else None,
                    "last_role": row["roles"][-1][:1] if row["roles"] else None, "rows": len(row["roles"]),
                    "least": known[0] if known else None, "most": known[-1] if known else None, "distinct": len(known),
                }], schema=arrow)

    return pieces.mapInArrow(run, schema)


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """The repair of a conversation from the matrices of its pieces: a row per piece, the first with the conversation's own numbers."""
    group = group.sort_values(["part", "seq"], kind="stable")
    best: dict[int, tuple[int, Rope | str, tuple | None]] = {START: (0, "", None)}
    illegal, last, gaps, newest, oldest, distinct = int(group["illegal"].sum()), None, 0, None, None, 0
    for row in group.itertuples():
        reached: dict[int, tuple] = {}
        for q, (cost, edits, way) in best.items():
            for r in range(4):
                if row.audits[4 * q + r] is not None:
                    put(reached, r, (cost + int(row.costs[4 * q + r]), followed(edits, row.audits[4 * q + r]), (way, q, row.audits[4 * q + r])))
        best = reached
        if row.rows:
            illegal += last is not None and (last, row.first_role) not in LEGAL
            last = row.last_role
        if row.distinct:
            # turns are in order, so pieces share at most the turn where they meet
            distinct += int(row.distinct) - (newest is not None and newest == int(row.least))
            oldest, newest = int(row.least) if oldest is None else oldest, int(row.most)
    gaps = newest - oldest + 1 - distinct if newest is not None else 0
    ways: dict[int, tuple] = {}
    for q, (cost, edits, way) in best.items():
        for (i, r), (more, put_in) in INSERTED.items():
            if i == q and r in (START, ASSISTANT):
                put(ways, 0, (cost + more, followed(edits, put_in), way, put_in))
    cost, edits, way, tail = ways[0]
    steps = []
    while way is not None:
        way, q, own = way
        steps.append((q, own))
    steps.reverse()
    out = group[["conv_id", "part", "seq"]].copy()
    out["entry"] = [q for q, _ in steps]
    out["edits"] = [own + (tail if k == len(steps) - 1 else "") for k, (_, own) in enumerate(steps)]
    out["lead"] = [k == 0 for k in range(len(steps))]
    totals = [gaps, *(int(group[c].sum()) for c in SUMMARY[1:4]), illegal, cost]
    for name, value in zip(SUMMARY, totals, strict=True):
        out[name] = value
    out["audit"] = ["".join(leaves(edits)), *[None] * (len(steps) - 1)]
    return out


def _put_together(spread: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For conversations in pieces: conv_id, SUMMARY and audit of each; conv_id, part, seq and lines (null if there are none) of each piece."""
    pieces = spread.filter("not whole").select("conv_id", "part", "seq", "turns", "roles", "texts", "keys")
    # a key stands once in a piece, so a group has no more rows than its conversation has pieces
    order = Window.partitionBy("conv_id", "key").orderBy("part", "seq")
    later = pieces.select("conv_id", "part", "seq", F.explode("keys").alias("key")).withColumn("n", F.row_number().over(order)).filter("n > 1")
    seen = later.groupBy("part", "seq").agg(F.collect_list("key").alias("seen"))
    conv = spread.schema["conv_id"].dataType.simpleString()
    steps = materialise(_steps(pieces.drop("keys").join(seen, ["part", "seq"], "left")), "matrices")
    numbers = ", ".join(f"{c} bigint" for c in SUMMARY)
    made = materialise(steps.groupBy("conv_id").applyInPandas(_joined, f"conv_id {conv}, part int, seq int, entry int, edits string, lead boolean, {numbers}, audit string"), "edits")

    @F.arrow_udf("string")
    def lines(roles: pa.Array, texts: pa.Array, edits: pa.Array, entry: pa.Array) -> pa.Array:
        rows = zip(roles.to_pylist(), texts.to_pylist(), edits.to_pylist(), entry.to_pylist(), strict=True)
        return pa.array(["\n".join(out) if (out := rebuilt(*row)) else None for row in rows], pa.string())

    met = pieces.select("part", "seq", "roles", "texts").join(made.select("conv_id", "part", "seq", "edits", "entry"), ["part", "seq"])
    return made.filter("lead").select("conv_id", *SUMMARY, "audit"), met.select("conv_id", "part", "seq", lines("roles", "texts", "edits", "entry").alias("lines"))


def repairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role:text, a line each) of every conversation."""
    ship_package(rows.sparkSession)
    spread = _spread(rows, conv, turn, role, text, gone)
    summary, lines = _put_together(spread)
    texts = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "lines"))).alias("p"))
    joined = texts.select(F.col("conv_id").alias("c"), F.array_join(F.transform("p", lambda x: x["lines"]), "\n").alias("repaired"))
    split = summary.join(joined, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return spread.filter("whole").select("conv_id", *SUMMARY, "audit", F.col("lines").alias("repaired")).unionByName(split)


def digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = "gone") -> DataFrame:
    """As ``repairs``, with repaired_sha256 in place of the text, which streams through one hash piece by piece."""
    ship_package(rows.sparkSession)
    spread = _spread(rows, conv, turn, role, text, gone)
    summary, lines = _put_together(spread)
    kind = spread.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, any_ = None, None, False
        for batch in batches:
            done = []
            for conv_id, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv_id != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    state, key, any_ = hashlib.sha256(), conv_id, False
                if part is not None:
                    state.update(("\n" if any_ else "").encode() + part.encode())
                    any_ = True
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.column(0).type), pa.array([h for _, h in done], pa.string())], names=["c", "repaired_sha256"])
            last = batch.column(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], last), pa.array([state.hexdigest()], pa.string())], names=["c", "repaired_sha256"])

    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "lines").mapInArrow(hashed, f"c {kind}, repaired_sha256 string")
    split = summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return spread.filter("whole").select("conv_id", *SUMMARY, "audit", F.sha2("lines", 256).alias("repaired_sha256")).unionByName(split)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with known damage: by the CRC-32 of conversation and turn a row is gone, emptied, cut, repeated, or the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"), (kind == 3).alias("twice"),
    )
    return rows.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "copy")
