"""Merkle trees over canonical records: distributed root, proofs, verification.

Leaves are hashed with a 0 byte in front, nodes with a 1 byte; an odd node moves
up as it is. Aligned blocks of 2^10 nodes are reduced ten levels at a time, each
in a task of its own, which gives the same root as one tree over all leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cartulary.schemas import PART_MARK
from cartulary.storage import written

BLOCK_LEVELS = 10
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def leaf(table: Column, id_: Column, byte_hash: Column) -> Column:
    """A record's leaf as hex."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.concat(table, F.lit(PART_MARK), id_, F.lit(PART_MARK), byte_hash).cast("binary")), 256)


def leaves(records: DataFrame, *trees: str) -> DataFrame:
    """idx, table, id, hash: leaves numbered in order of (table, id), from 0 on in each tree.

    ``trees`` are columns that say to which tree a record belongs; without them
    there is one. Rows are range-partitioned and sorted; a partition's first number
    is the sum of the sizes before it, over one row per partition.
    """
    order = [*trees, "table", "id"]
    ordered = records.select(*order, leaf(F.col("table"), F.col("id"), F.col("byte_hash")).alias("hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ordered.select(*order, "hash", F.monotonically_increasing_id().alias("at")), "leaves")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    inside = F.col("at") - F.shiftleft(F.col("part"), 33)
    # a row for each part or tree is sent to the leaves: they stay where they are
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part").select(*trees, (F.col("start") + inside).cast("long").alias("idx"), "table", "id", "hash")
    if not trees:
        return out
    first = out.groupBy(*trees).agg(F.min("idx").alias("first"))
    return out.join(F.broadcast(first), [*trees]).select(*trees, (F.col("idx") - F.col("first")).alias("idx"), "table", "id", "hash")


def node(left: str, right: str) -> str:
    """The parent of two nodes."""
    return hashlib.sha256(b"\x01" + bytes.fromhex(left) + bytes.fromhex(right)).hexdigest()


def climb(nodes: list[str], levels: int) -> list[str]:
    """The nodes so many levels up."""
    for _ in range(levels):
        if len(nodes) == 1:
            break
        nodes = [node(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes


def _reduce(group: pd.DataFrame, trees: tuple[str, ...] = ()) -> pd.DataFrame:
    group = group.sort_values("idx")
    return pd.DataFrame({**{t: [group[t].iloc[0]] for t in trees}, "idx": [group["idx"].iloc[0] >> BLOCK_LEVELS], "hash": climb(group["hash"].tolist(), BLOCK_LEVELS)})


def levels(numbered: DataFrame, *trees: str) -> list[DataFrame]:
    """Tables (trees, idx, hash) of the leaves and of every tenth level above them, up to the roots."""
    out = [numbered.select(*trees, "idx", "hash")]
    kinds = ", ".join(f"{t} {numbered.schema[t].dataType.simpleString()}" for t in trees)
    schema = f"{kinds}, idx long, hash string" if trees else "idx long, hash string"
    count = (out[0].agg(F.max("idx")).first()[0] or 0) + 1
    while count > 1:
        up = out[-1].groupBy(*trees, F.shiftright("idx", BLOCK_LEVELS).alias("block")).applyInPandas(lambda g: _reduce(g, trees), schema)
        out.append(written(up, "tree"))
        count = -(-count // (1 << BLOCK_LEVELS))
    return out


def root(records: DataFrame) -> DataFrame:
    """One row: root (hex) and the number of records."""
    numbered = leaves(records)
    tree = levels(numbered)
    spark = records.sparkSession
    top = tree[-1].first()
    return spark.createDataFrame([(top["hash"] if top else EMPTY_ROOT, numbered.count())], "root string, records long")


def roots(records: DataFrame, *trees: str) -> DataFrame:
    """trees, root, records: a row for each tree, all of them in the same jobs."""
    numbered = leaves(records, *trees)
    top = levels(numbered, *trees)[-1].filter("idx = 0").select(*trees, F.col("hash").alias("root"))
    return top.join(numbered.groupBy(*trees).agg(F.count("*").alias("records")), [*trees])


@dataclass(frozen=True)
class Step:
    """A sibling on the way to the root, and the side on which it stands."""

    hash: str
    side: str


def rows_above(nodes: Sequence[str]) -> list[list[str]]:
    """The nodes and every row above them, without their single ancestor."""
    out, row = [], list(nodes)
    while len(row) > 1:
        out.append(row)
        row = climb(row, 1)
    return out


def along(rows: Sequence[Sequence[str]], at: int) -> list[Step]:
    """Siblings on the way from a place in the first row up through all rows."""
    out = []
    for row in rows:
        other = at ^ 1
        if other < len(row):
            out.append(Step(row[other], "left" if other < at else "right"))
        at >>= 1
    return out


def path(nodes: Sequence[str], at: int) -> list[Step]:
    """Siblings from one of the nodes up to their single ancestor."""
    return along(rows_above(nodes), at)


def proof(tree: list[DataFrame], at: int) -> list[Step]:
    """The inclusion proof of a leaf; reads one block of at most 1024 nodes of each stored level."""
    out = []
    for table in tree:
        block = at >> BLOCK_LEVELS
        rows = table.filter(F.shiftright("idx", BLOCK_LEVELS) == block).orderBy("idx").collect()
        inside = at - (block << BLOCK_LEVELS)
        if not 0 <= inside < len(rows):
            raise IndexError(at)
        out += path([r["hash"] for r in rows], inside)
        at = block
    return out


def verify(leaf_hash: str, steps: Sequence[Step], expected: str) -> bool:
    """Whether the steps lead from a leaf to the root."""
    for s in steps:
        leaf_hash = node(s.hash, leaf_hash) if s.side == "left" else node(leaf_hash, s.hash)
    return leaf_hash == expected


def verified(proofs: DataFrame) -> DataFrame:
    """proofs (hash, steps array<struct<hash,side>>, root) with the column ok, in the JVM."""
    start = F.unhex("hash")
    one = F.unhex(F.lit("01"))

    def up(acc: Column, s: Column) -> Column:
        other = F.unhex(s["hash"])
        return F.unhex(F.sha2(F.when(s["side"] == "left", F.concat(one, other, acc)).otherwise(F.concat(one, acc, other)), 256))

    return proofs.withColumn("ok", F.lower(F.hex(F.aggregate("steps", start, up))) == F.col("root"))


def _asked(tree: list[DataFrame], wanted: DataFrame, *trees: str) -> list[DataFrame]:
    """The rows of each table whose block holds a wanted node, or the block of one, with the column wanted.

    Blocks of a table meet the wanted numbers by a semi-join, so what is read goes by
    the wanted leaves: at most 1024 rows of each table for each of them. A block brings the
    numbers that are wanted in it, so a table's rows are dealt out once, by their block.
    """
    out, asked = [], wanted.select(*trees, F.col("idx").cast("long")).distinct()
    for table in tree:
        asked = written(asked, "asked")
        blocks = asked.groupBy(*trees, F.shiftright("idx", BLOCK_LEVELS).alias("block")).agg(F.collect_list("idx").alias("__asked"))
        rows = table.withColumn("block", F.shiftright("idx", BLOCK_LEVELS)).join(blocks, [*trees, "block"])
        out.append(rows.withColumn("wanted", F.array_contains("__asked", F.col("idx"))).drop("__asked"))
        asked = blocks.select(*trees, F.col("block").alias("idx"))
    return out


def proofs(tree: list[DataFrame], *trees: str, wanted: DataFrame | None = None) -> DataFrame:
    """trees, idx, hash, steps, root: the leaves of levels(), or those that are wanted (trees, idx), with their paths to their roots.

    From the roots down, each table's blocks meet the one path that leads on from
    their block in the table above, so a task holds 1024 nodes and one path.
    """
    kinds = "".join(f"{t} {tree[0].schema[t].dataType.simpleString()}, " for t in trees)
    schema = f"{kinds}idx long, hash string, others array<string>, sides array<string>"

    def work(group: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        on = (list(up["others"].iloc[0]), list(up["sides"].iloc[0])) if len(up) else ([], [])
        rows = rows_above(group["hash"].tolist())
        places = [k for k, asked in enumerate(group["wanted"]) if asked]
        steps = [along(rows, k) for k in places]
        mine = group.iloc[places]
        return pd.DataFrame({**{t: mine[t] for t in trees}, "idx": mine["idx"], "hash": mine["hash"], "others": [[s.hash for s in p] + on[0] for p in steps], "sides": [[s.side for s in p] + on[1] for p in steps]})

    if wanted is None:
        tables = [table.withColumn("wanted", F.lit(True)).withColumn("block", F.shiftright("idx", BLOCK_LEVELS)) for table in tree]
    else:
        tables = _asked(tree, wanted, *trees)
    none = F.array().cast("array<string>")
    out = tables[-1].filter("wanted").select(*trees, "idx", "hash", none.alias("others"), none.alias("sides"))
    for table in reversed(tables[:-1]):
        out = table.groupBy(*trees, "block").cogroup(out.groupBy(*trees, "idx")).applyInPandas(work, schema)
    steps = F.zip_with("others", "sides", lambda h, s: F.struct(h.alias("hash"), s.alias("side"))).alias("steps")
    top = tree[-1].filter("idx = 0").select(*trees, F.col("hash").alias("root"))
    made = out.select(*trees, "idx", "hash", steps)
    return made.join(top, [*trees]) if trees else made.crossJoin(F.broadcast(top))  # one row


def _siblings(base: int, trees: tuple[str, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of a block's nodes, ``base`` levels up: those that prove its wanted ones."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        first = int(group["idx"].iloc[0])
        known = {k for k, asked in enumerate(group["wanted"]) if asked}
        found = []
        for level, row in enumerate(rows_above(group["hash"].tolist())):
            found += [(base + level, (first >> level) + (k ^ 1), row[k ^ 1]) for k in sorted(known) if k ^ 1 < len(row) and k ^ 1 not in known]
            known = {k >> 1 for k in known}
        made = pd.DataFrame(found, columns=["level", "idx", "hash"])
        return made.assign(**{t: group[t].iloc[0] for t in trees})[[*trees, "level", "idx", "hash"]]

    return work


def frontier(tree: list[DataFrame], wanted: DataFrame, *trees: str) -> DataFrame:
    """trees, level, idx, hash: the nodes that prove all wanted leaves (trees, idx) of a tree together.

    Level by level a node is needed if it is the sibling of a known one and isn't
    known itself; siblings that several leaves share are there once.
    """
    kinds = "".join(f"{t} {tree[0].schema[t].dataType.simpleString()}, " for t in trees)
    schema = f"{kinds}level int, idx long, hash string"
    out = tree[0].sparkSession.createDataFrame([], schema)
    for number, table in enumerate(_asked(tree, wanted, *trees)[:-1]):
        out = out.unionByName(table.groupBy(*trees, "block").applyInPandas(_siblings(number * BLOCK_LEVELS, trees), schema))
    return out


def _known_above(base: int, trees: tuple[str, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function of known nodes of a block from ``base`` levels up on: what follows from them BLOCK_LEVELS higher; null if it can't be told."""

    def agreed(row: dict[int, str | None], k: int, hash_: str) -> None:
        row[k] = hash_ if row.get(k, hash_) == hash_ else None

    def work(group: pd.DataFrame) -> pd.DataFrame:
        records = int(group["records"].iloc[0])
        said: dict[int, list[tuple[int, str]]] = {}
        for level, idx, hash_ in zip(group["level"], group["idx"], group["hash"], strict=True):
            said.setdefault(int(level) - base, []).append((int(idx), hash_))
        row: dict[int, str | None] = {}
        for level in range(BLOCK_LEVELS + 1):
            for k, hash_ in said.get(level, ()):
                agreed(row, k, hash_)
            size = -(-records // (1 << (base + level)))
            if level == BLOCK_LEVELS or size <= 1:
                break
            pairs = {k >> 1: (row.get(k & ~1), row.get(k | 1)) for k in row}
            row = {k: a if 2 * k + 1 >= size else node(a, b) if a and b else None for k, (a, b) in pairs.items()}
        made = pd.DataFrame({"idx": list(row), "hash": list(row.values())}).astype({"idx": "int64", "hash": "object"})
        return made.assign(**{t: group[t].iloc[0] for t in trees})[[*trees, "idx", "hash"]]

    return work


def proven_together(leaves_: DataFrame, siblings: DataFrame, sizes: DataFrame, *trees: str) -> DataFrame:
    """trees, ok: whether leaves (trees, idx, hash) and the nodes of ``frontier`` lead to each tree's root; sizes have trees, records, root.

    Ten levels are climbed in a step, from known nodes alone. A node that is missing
    or altered anywhere fails its tree; a tree of which no leaf is asked for holds.
    """
    kinds = "".join(f"{t} {leaves_.schema[t].dataType.simpleString()}, " for t in trees)
    most = sizes.agg(F.max("records")).first()[0] or 0
    known = leaves_.select(*trees, "idx", "hash")
    for base in range(0, max(1, (most - 1).bit_length()), BLOCK_LEVELS):
        here = siblings.filter((F.col("level") >= base) & (F.col("level") < base + BLOCK_LEVELS)).select(*trees, "level", "idx", "hash")
        rows = known.select(*trees, F.lit(base).alias("level"), "idx", "hash").unionByName(here)
        counted = rows.join(sizes.select(*trees, "records"), [*trees]) if trees else rows.crossJoin(F.broadcast(sizes.select("records")))  # one row
        block = F.expr(f"shiftright(idx, {base + BLOCK_LEVELS} - level)").alias("block")
        known = counted.withColumn("block", block).groupBy(*trees, "block").applyInPandas(_known_above(base, trees), f"{kinds}idx long, hash string")
    ends = known.groupBy(*trees).agg(F.count("*").alias("ends"), F.max("hash").alias("top"), F.count("hash").alias("told"))
    met = sizes.join(ends, [*trees], "left") if trees else sizes.crossJoin(ends)  # one row each
    right = (F.col("ends") == 1) & (F.col("told") == 1) & (F.col("top") == F.col("root"))
    return met.select(*trees, (F.coalesce(F.col("ends"), F.lit(0)) == 0).alias("none"), right.alias("right")).select(*trees, F.when(F.col("none"), True).otherwise(F.coalesce("right", F.lit(False))).alias("ok"))
