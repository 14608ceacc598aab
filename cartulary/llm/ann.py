"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample (``SAMPLE`` vectors, least MD5 of their id first): the
graph of each sampled vector's nearest others is cut into balanced parts, by
halving along principal directions and then moving vertices to the part of most of
their neighbours while it has room. A small network learns, for a vector, the
parts in which its neighbours lie. How many parts a query visits is the least
number that holds ``TARGET`` of the k nearest of sampled vectors that the network
hasn't seen. Tables of so few vectors that they have LEAST_PARTS parts are searched
in all of them, so their results are exact.

Parts that hold more than twice PART_ROWS vectors are cut once more, each from a
sample of its own vectors and with a network of its own, in a task for each part.
So the number of parts grows with the table, up to MOST_PARTS squared (65,536, of
PART_ROWS vectors each for 10^8 vectors; beyond that parts grow). Networks are
broadcast; their number and size are bounded by MOST_PARTS.

Indexing: every vector goes to its most probable part. A part is cut into blocks of
bounded size. Searching: each query goes to all blocks of its most probable
parts, is compared exactly there, and the best of all blocks are ranked again. The
likeliest parts come first: their k-th best score bounds what the others return.
Queries of a part come in groups of bounded size; only parts that very many queries
visit are compared with several groups.

Of equal vectors only the k + 1 with the least ids can be among any query's k
nearest (one may be the query itself), so the others are left out first; no group
of equal vectors grows in a block.

Nearness is the inner product in double precision. Defined cases: vectors that are
null, zero or hold a null or a number that isn't finite take no part, nor do null
ids and vectors whose length isn't the most frequent (the longer, of several); ties
go to the smaller id; rows that share an id are separate candidates; with
fewer than k candidates all are returned; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.shared import likely_first, materialise, ship_package

K = 20
SAMPLE = 16_384
#: Vectors for a part: of the sample at least, and of the table about.
PART_SAMPLE, PART_ROWS = 64, 1500
MOST_PARTS = 256
#: Small tables have so many parts all the same, and every query visits them all.
LEAST_PARTS = 4
NEIGHBOURS = 10
HIDDEN = 96
#: Shares of the sampled vectors' neighbours that the parts visited have to hold, and of those within a part its own parts.
TARGET, INNER_TARGET = 0.95, 0.98
BLOCK = 8192
#: Queries of a part that are compared with a block at once.
QUERIES = 16_384
TILE = 256
#: One of so many of a query's parts, the likeliest, are searched first.
LEAD_SHARE = 6


def nearest(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """For each row (or each of the rows numbered in ``of``) the k other rows of largest inner product."""
    of = np.arange(len(x)) if of is None else of
    out = np.zeros((len(of), k), np.int64)
    for i in range(0, len(of), 1024):
        some = of[i : i + 1024]
        s = x[some] @ x.T
        s[np.arange(len(s)), some] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row, by halving along principal directions; parts are of equal size."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        at, first, count = todo.pop()
        if count == 1:
            label[at] = first
            continue
        y = x[at] - x[at].mean(axis=0)
        _, axes = np.linalg.eigh(y.T @ y)
        order = at[np.argsort(y @ axes[:, -1], kind="stable")]
        low = count // 2
        cut = len(order) * low // count
        todo += [(order[:cut], first, low), (order[cut:], first + low, count - low)]
    return label


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of the graph's vertices with few edges between them and at most 1.1 times the mean size."""
    label = halved(x, parts)
    room = int(np.ceil(1.1 * len(x) / parts))
    ends = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    starts = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(rounds):
        near = np.zeros((len(x), parts), np.int32)
        np.add.at(near, (ends, label[starts]), 1)
        best = near.argmax(axis=1)
        gain = near[np.arange(len(x)), best] - near[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if moved < len(x) // 1000 + 1:
            break
    return label


class Router:
    """A network with one hidden layer from vectors to probabilities of parts."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, probes: int) -> None:
        self.w1, self.b1, self.w2, self.b2, self.probes = w1, b1, w2, b2, probes

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities up to a constant; x is scaled to unit length."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each row."""
        return self.scores(x).argmax(axis=1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The parts that each row visits as a query."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, : self.probes]


def train(x: np.ndarray, wanted: np.ndarray, epochs: int = 40, rate: float = 0.01) -> Router:
    """A router fitted to the wanted probabilities by Adam; the same for the same input."""
    rng = np.random.default_rng(7)
    parts = wanted.shape[1]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    params = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            some = order[i : i + 256]
            z = x[some] @ params[0] + params[1]
            h = np.maximum(z, 0)
            out = h @ params[2] + params[3]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d_out = (p - wanted[some]) / len(some)
            d_h = d_out @ params[2].T * (z > 0)
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in enumerate((x[some].T @ d_h, d_h.sum(axis=0), h.T @ d_out, d_out.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*params, probes=parts)


def fit(sample: np.ndarray, rows: int, target: float = TARGET, k: int = K) -> Router:
    """A router for a table of so many rows, from a sample of its vectors; queries look for their k nearest."""
    dim = sample.shape[1] if len(sample) else 1
    parts = int(min(MOST_PARTS, len(sample) // PART_SAMPLE, max(LEAST_PARTS, rows // PART_ROWS)))
    if parts <= 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = nearest(sample, min(NEIGHBOURS, len(sample) - 1))
    label = balanced(sample, graph, parts)
    wanted = np.zeros((len(sample), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph.ravel()]), 1.0)
    wanted[np.arange(len(sample)), label] += 1
    seen = np.arange(len(sample)) % 5 > 0
    router = train(sample[seen], wanted[seen] / wanted[seen].sum(axis=1, keepdims=True))
    if parts <= LEAST_PARTS:
        return router
    # probes are set on vectors that the network hasn't seen
    held = np.flatnonzero(~seen)
    ranks = np.argsort(np.argsort(-router.scores(sample[held]), axis=1, kind="stable"), axis=1)
    places = router.part(sample)[nearest(sample, min(k, len(sample) - 1), held)]
    needed = np.sort(ranks[np.arange(len(held))[:, None], places].ravel())
    router.probes = int(min(parts, needed[int(np.ceil(target * len(needed))) - 1] + 1))
    return router


def _log_shares(scores: np.ndarray) -> np.ndarray:
    top = scores - scores.max(axis=1, keepdims=True)
    return top - np.log(np.exp(top).sum(axis=1, keepdims=True))


class Routers:
    """The router of the table and those of its large parts; places count all parts through."""

    def __init__(self, top: Router, inner: dict[int, Router]) -> None:
        self.top, self.inner = top, inner
        widths = [len(inner[p].b2) if p in inner else 1 for p in range(len(top.b2))]
        self.first = np.concatenate([[0], np.cumsum(widths)])

    def part(self, x: np.ndarray) -> np.ndarray:
        """The most probable place of each row."""
        out = self.top.part(x)
        place = self.first[out]
        for p, router in self.inner.items():
            mine = np.flatnonzero(out == p)
            if len(mine):
                place[mine] += router.part(x[mine])
        return place

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and turn (likeliest first) of every place that the rows visit as queries."""
        shares = _log_shares(self.top.scores(x))
        seen = np.argsort(-shares, axis=1, kind="stable")[:, : self.top.probes]
        row, part = np.repeat(np.arange(len(x)), seen.shape[1]), seen.ravel()
        plain = ~np.isin(part, list(self.inner))
        rows, places, likely = [row[plain]], [self.first[part[plain]]], [shares[row[plain], part[plain]]]
        for p, router in self.inner.items():
            mine = row[part == p]
            if not len(mine):
                continue
            inside = _log_shares(router.scores(x[mine]))
            best = np.argsort(-inside, axis=1, kind="stable")[:, : router.probes]
            rows.append(np.repeat(mine, best.shape[1]))
            places.append(self.first[p] + best.ravel())
            likely.append((shares[mine, p][:, None] + np.take_along_axis(inside, best, axis=1)).ravel())
        rows, places, likely = np.concatenate(rows), np.concatenate(places), np.concatenate(likely)
        order = np.lexsort((places, -likely, rows))
        rows, places = rows[order], places[order]
        return rows, places, np.arange(len(rows)) - np.searchsorted(rows, rows)

    @property
    def most(self) -> int:
        """Places that a query visits at most."""
        probes = sorted((self.inner[p].probes if p in self.inner else 1 for p in range(len(self.top.b2))), reverse=True)
        return sum(probes[: self.top.probes])


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the rows that take part, with vectors of doubles."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.filter(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _stacked(values: pa.Array, dim: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _routed(rows: DataFrame, routers: Routers, dim: int, queries: bool) -> DataFrame:
    """vec_id, v, part, turn: each row with its place, or each query with all places that it visits, likeliest first."""
    sent = rows.sparkSession.sparkContext.broadcast(routers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                some = batch.slice(start, 2048)
                x = _stacked(some.column(1), dim)
                row, place, turn = sent.value.parts(x) if queries else (np.arange(len(x)), sent.value.part(x), np.zeros(len(x)))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(turn.astype(np.int32))], names=["vec_id", "v", "part", "turn"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, part int, turn int")


def _turn() -> Column:
    return F.md5(F.col("vec_id").cast("string").cast("binary"))


def inner_routers(rows: DataFrame, top: Router, dim: int, k: int = K) -> dict[int, Router]:
    """Routers of the parts that hold more than twice PART_ROWS rows, each fitted in a task on a sample of the part's rows."""
    placed = materialise(_routed(rows, Routers(top, {}), dim, False).select("vec_id", "v", "part"), "parts")
    sizes = materialise(placed.groupBy("part").agg(F.count("*").alias("size")).filter(F.col("size") > 2 * PART_ROWS), "part-sizes")
    share = (F.lit(1.5 * SAMPLE + 100)) / F.col("size")
    drawn = placed.join(F.broadcast(sizes), "part").withColumn("turn", _turn()).filter(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") < share * 16**8)  # MOST_PARTS rows at most

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.sort_values(["turn", "vec_id"]).head(SAMPLE)
        made = fit(np.stack(first["v"].to_numpy()), int(group["size"].iloc[0]), INNER_TARGET, k)
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "router": [pickle.dumps(made)]})

    fitted = drawn.groupBy("part").applyInPandas(run, "part int, router binary")
    return {r["part"]: pickle.loads(r["router"]) for r in fitted.toLocalIterator()}  # MOST_PARTS of them at most


FOUND = "query_id long, vec_id long, score double"


def compare(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query, of those that its bound doesn't rule out."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    q, x = np.stack(queries["v"].to_numpy()), np.stack(rows["v"].to_numpy())
    qid, xid, bound = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy(), queries["bound"].to_numpy()
    scale = np.abs(x).max() * np.abs(q).max() * x.shape[1]
    out = []
    for i in range(0, len(q), TILE):
        s = q[i : i + TILE] @ x.T
        s[qid[i : i + TILE, None] == xid[None, :]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if len(xid) > k else np.full(len(s), -np.inf)
        least = np.maximum(least, bound[i : i + TILE])
        a, b = np.nonzero((s >= least[:, None] - 1e-12 * scale) & (s > -np.inf))
        exact = (q[i + a] * x[b]).sum(axis=1)
        order = np.lexsort((xid[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < k
        out.append((qid[i + a[keep]], xid[b[keep]], exact[keep]))
    return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def search(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows that were found.

    is_query is a condition on vec_id.
    """
    ship_package(table.sparkSession)
    rows = usable(table, id_col, vector_col)
    first = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = first["dim"] if first else 1
    rows = rows.filter(F.size("v") == dim)
    alike = Window.partitionBy("v").orderBy("vec_id")
    kept = materialise(rows.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1).select("vec_id", "v"), "vectors")
    count = kept.count()
    turn = _turn()
    sample = kept.select("v", turn.alias("turn"), "vec_id").filter(likely_first(turn, count, SAMPLE)).orderBy("turn", "vec_id").limit(SAMPLE).select("v").toPandas()
    top = fit(np.stack(sample["v"].to_numpy()) if len(sample) else np.zeros((0, dim)), count, target, k)
    routers = Routers(top, inner_routers(kept, top, dim, k))

    index = materialise(_routed(kept, routers, dim, False), "index")
    asked = materialise(_routed(rows.filter(is_query), routers, dim, True), "asked")
    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # queries of a part come in groups too, so that none grows with the table
    groups = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    parts = F.broadcast(materialise(blocks.join(groups, "part"), "part-plan"))  # MOST_PARTS squared rows at most
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    near = asked.join(parts, "part").withColumn("block", each).withColumn("g", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("groups")).cast("int")).select("part", "block", "g", "vec_id", "v", "turn")
    placed = index.join(parts, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    far = placed.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("part", "block", "g", "vec_id", "v")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(asking: DataFrame) -> DataFrame:
        return asking.groupBy("part", "block", "g").cogroup(far.groupBy("part", "block", "g")).applyInPandas(lambda q, r: compare(q, r, k), FOUND)

    # the likeliest parts give each query a score that its k-th nearest can't be under; the others return only what reaches it
    lead = -(-routers.most // LEAD_SHARE)
    first_found = materialise(met(near.filter(F.col("turn") < lead).withColumn("bound", F.lit(float("-inf"))).drop("turn")), "likeliest")
    top_found = first_found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    bounds = top_found.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count("*") == k, F.min("score")).alias("b"))
    later = near.filter(F.col("turn") >= lead).join(bounds, F.col("vec_id") == F.col("q"), "left").select("part", "block", "g", "vec_id", "v", F.coalesce("b", F.lit(float("-inf"))).alias("bound"))
    found = first_found.unionByName(met(later))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
