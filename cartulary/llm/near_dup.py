"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Words are what white space separates; a text's n-grams are its runs of ``NGRAM``
words (a shorter text is one n-gram; a text without words has none). Texts with
the same set of n-grams form one *set*; of a set one text takes part, with the
number of different texts as its weight.

1. Every whole text gets a MinHash signature, cut into bands. Number of bands and
   rows follow from the threshold and the target recall (``banding``).
2. Band hashes shuffle; sets that share one point to the least of them, a row for
   each set and band. The connected groups of these pointers hold every pair
   that shares a band.
3. Pairs are verified on their full n-grams, all of a group at once or bucket by
   bucket, whichever copies fewer n-grams: copies of one text are cheapest as one
   group, while a long chain of chance candidates only meets within its buckets. A
   pair that shares several buckets counts in the one of its least shared band.
   Common n-grams are compared by matrix products, rare ones by their short lists
   of owners. Pairs never become rows: a set gets the weight of the sets it links
   to, and a root. Groups and buckets are cut into blocks by n-grams and sets, each
   pair of blocks is verified by itself, so memory is bounded and no pair left out.
4. Roots of blocks are joined; the least document id of a class names it.

Result: a row per document with class_id (its class's least document id, classes
being chains of links), class_size (documents) and n_links (different texts with
a similarity of at least the threshold; texts that differ in white space only are
the same text).

Defined cases: null counts as empty; texts without words are equal to each
other; null ids come after all ids, and a class of only null ids has a null
class_id; rows that share an id are separate documents; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.components import components
from cartulary.llm.exact_dedup import possibly_among
from cartulary.llm.shared import distinct_sorted, give_back_memory, join_groups, materialise, ship_package, text_or_empty

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: A block of a group holds about so many n-grams, and so many sets.
BLOCK_NGRAMS = 250_000
BLOCK_SETS = 512
TILE = 1024
#: N-grams with more owners than this go into the matrix product.
COMMON = 24
WORDS_KEPT = 250_000
#: Where a set is verified: a group (band -1) or a bucket of a band, cut into so many blocks.
PLACE = "struct<part:long,band:int,blocks:int,block:int>"


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands reach the recall at the threshold within so many hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


class Shingler:
    """Hashed n-grams of texts, with a memory of words."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def words(self, data: bytes) -> np.ndarray:
        """64-bit hashes of the words."""
        parts, known = data.split(), self.known
        try:
            return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in set(parts).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))

    def ngrams(self, data: bytes) -> np.ndarray:
        """Sorted distinct hashes of the n-grams."""
        w = self.words(data)
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return distinct_sorted(h)


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        seeds = np.random.default_rng(20240229)
        self.a = seeds.integers(1 << 31, dtype=np.uint32, size=bands * rows) * np.uint32(2) + np.uint32(1)
        self.b = seeds.integers(1 << 32, dtype=np.uint32, size=bands * rows, endpoint=False)

    def bands_of(self, grams: np.ndarray) -> list[int]:
        """One 64-bit hash for each band; none for an empty set."""
        if not len(grams):
            return []
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        h = (grams >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(h), 512):
            low = np.minimum(low, (h[i : i + 512, None] * self.a ^ self.b).min(axis=0))
        return [xxhash.xxh3_64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(low.reshape(self.bands, self.rows))]


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row (unique), set_key, text_key, fetch (hash of the raw text), grams (number), bands."""
    ship_package(docs.sparkSession)
    t = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(t).alias("fetch"), t.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(n), Signer(bands, rows)
        for batch in batches:
            sets, texts, sizes, hashed = [], [], [], []
            for v in batch.column(3):
                data = v.as_py()
                grams = shingler.ngrams(data)
                sets.append(xxhash.xxh3_128_digest(grams.tobytes()))
                texts.append(xxhash.xxh3_64_intdigest(b" ".join(data.split())) - (1 << 63))
                sizes.append(len(grams))
                hashed.append(signer.bands_of(grams))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary()), pa.array(texts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashed, pa.list_(pa.int64()))], names=["doc_id", "row", "fetch", "set_key", "text_key", "grams", "bands"])
        del shingler, signer
        give_back_memory()

    return base.mapInArrow(run, "doc_id long, row long, fetch long, set_key binary, text_key long, grams int, bands array<long>")


def linked(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: a matrix of sets by others (by sets themselves, if None)."""
    same = others is None
    all_sets = sets if same else [*sets, *others]
    m, first = len(all_sets), len(sets)
    sizes = np.array([len(s) for s in all_sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, column, owners = np.unique(np.concatenate(all_sets), return_inverse=True, return_counts=True)
    kept = owners[column] > 1
    owner, column = owner[kept], column[kept]
    many = owners > COMMON
    number = np.cumsum(many) - 1
    dense = many[column]
    d_owner, d_column = owner[dense], number[column[dense]]
    r_owner, r_column = owner[~dense], column[~dense]
    order = np.lexsort((r_owner, r_column))
    r_owner, r_column = r_owner[order], r_column[order]
    # pairs of owners of each rare n-gram: place k with every place up to COMMON - 1 further on
    left, right = [], []
    for gap in range(1, COMMON):
        at = np.flatnonzero(r_column[gap:] == r_column[:-gap]) if gap < len(r_column) else []
        if not len(at):
            break
        left.append(r_owner[at])
        right.append(r_owner[at + gap])
    lo = np.concatenate(left) if left else np.zeros(0, np.int64)
    hi = np.concatenate(right) if right else np.zeros(0, np.int64)
    if not same:
        across = (lo < first) & (hi >= first)
        lo, hi = lo[across], hi[across] - first
    rows, cols = first, (first if same else m - first)
    out = np.zeros((rows, cols), bool)
    total = int(many.sum())
    d_order = np.argsort(d_owner, kind="stable")
    d_owner, d_column = d_owner[d_order], d_column[d_order]
    r_order = np.argsort(lo, kind="stable")
    lo, hi = lo[r_order], hi[r_order]
    base = 0 if same else first

    def tile(start: int, end: int, c0: int, c1: int) -> np.ndarray:
        x = np.zeros((end - start, c1 - c0), np.float32)
        a, b = np.searchsorted(d_owner, [start, end])
        inside = (d_column[a:b] >= c0) & (d_column[a:b] < c1)
        x[d_owner[a:b][inside] - start, d_column[a:b][inside] - c0] = 1
        return x

    num, den = (threshold / (1 + threshold)), 1e-9
    for i in range(0, rows, TILE):
        ie = min(i + TILE, rows)
        a, b = np.searchsorted(lo, [i, ie])
        for j in range(i if same else 0, cols, TILE):
            je = min(j + TILE, cols)
            shared = np.zeros((ie - i, je - j), np.float32)
            for c in range(0, total, 4096):
                c1 = min(c + 4096, total)
                shared += tile(i, ie, c, c1) @ tile(base + j, base + je, c, c1).T
            here = (hi[a:b] >= j) & (hi[a:b] < je)
            np.add.at(shared, (lo[a:b][here] - i, hi[a:b][here] - j), 1)
            need = num * (sizes[i:ie, None] + sizes[base + j : base + je][None, :])
            hit = shared >= need - den * np.maximum(need, 1)
            if same and i == j:
                hit = np.triu(hit, 1)
                hit |= hit.T
                out[i:ie, j:je] = hit
            else:
                out[i:ie, j:je] = hit
                if same:
                    out[j:je, i:ie] = hit.T
    return out


def _roots(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Component numbers of the rows (and of the columns, unless they are the same nodes)."""
    rows, cols = link.shape
    mine, theirs = np.full(rows, -1), (np.full(rows, -1) if same else np.full(cols, -1))
    if same:
        theirs = mine
    for start in range(rows):
        if mine[start] >= 0:
            continue
        mine[start] = start
        front = np.array([start])
        while len(front):
            reached = np.flatnonzero(link[front].any(axis=0) & (theirs < 0))
            theirs[reached] = start
            if same:
                front = reached
            else:
                front = np.flatnonzero(link[:, reached].any(axis=1) & (mine < 0)) if len(reached) else reached
                mine[front] = start
    return mine, (None if same else theirs)


def _fresh(link: np.ndarray, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """The links of pairs that share no band before this one."""
    rows, cols = np.nonzero(link)
    kept = np.ones(len(rows), bool)
    for k in range(band):
        kept &= a[rows, k] != b[cols, k]
    out = np.zeros_like(link)
    out[rows[kept], cols[kept]] = True
    return out


def verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Roots and link weights of the sets in a block, or across a pair of blocks.

    ``band`` is that of the bucket, or -1 for a group in which every pair meets once.
    """
    group = group.drop_duplicates("node").sort_values("node")
    band, i, j = int(group["band"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
    left = group[group["block"] == i]
    right = left if i == j else group[group["block"] == j]
    if left.empty or right.empty:
        return pd.DataFrame({k: pd.Series(dtype="int64") for k in ("node", "root", "links")})
    a = [np.frombuffer(x, np.uint64) for x in left["set"]]
    link = linked(a, None if i == j else [np.frombuffer(x, np.uint64) for x in right["set"]], threshold)
    mine, theirs = _roots(link, i == j)
    if band > 0:
        link = _fresh(link, np.stack(left["bands"].to_list()), np.stack(right["bands"].to_list()), band)
    w, v = left["weight"].to_numpy(np.int64), right["weight"].to_numpy(np.int64)
    nodes = left["node"].to_numpy()
    out = pd.DataFrame({"node": nodes, "root": nodes[mine], "links": link @ v})
    if i == j:
        return out
    others = right["node"].to_numpy()
    return pd.concat([out, pd.DataFrame({"node": others, "root": np.where(theirs >= 0, nodes[theirs], others), "links": link.T @ w})])


def _sets_of(rows: DataFrame, n: int) -> DataFrame:
    """rows with the binary column set, the sorted n-gram hashes of text, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            made = [shingler.ngrams(v.as_py()).tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], names=["set", *batch.schema.names[1:]])
        del shingler
        give_back_memory()

    return rows.mapInArrow(run, f"set binary, node long, weight long, bands array<long>, places array<{PLACE}>")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, class_size, n_links for every document."""
    bands, band_rows = banding(threshold, recall)
    signed = materialise(signatures(docs, id_col, text_col, n, bands, band_rows), "signatures")
    count = signed.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row", "fetch"))
    # two levels: a hot set's texts are first counted within each task
    by_text = signed.groupBy("set_key", "text_key").agg(first.alias("f"), F.count("*").alias("docs"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    sets = materialise(by_text.groupBy("set_key").agg(F.min("f").alias("f"), F.sum("docs").alias("docs"), F.count("*").alias("weight"), F.first("grams").alias("grams"), F.first("bands").alias("bands")).select("set_key", F.col("f.row").alias("node"), F.col("f.doc_id").alias("first_id"), F.col("f.fetch").alias("fetch"), "docs", "weight", "grams", "bands"), "sets")

    hashed = F.posexplode("bands").alias("band", "h")
    keyed = sets.select("node", "grams", hashed).select("node", "grams", F.xxhash64("band", "h").alias("k"))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_NGRAMS), F.ceil(F.col("size") / BLOCK_SETS)).cast("int").alias("blocks")
    hubs = keyed.groupBy("k").agg(F.min("node").alias("hub"), F.count("*").alias("size"), F.sum("grams").alias("total")).filter("size > 1")
    hubs = materialise(hubs.select("*", blocks), "hubs")
    pointers = join_groups(keyed.select("node", "k"), hubs.select("k", "hub", "size"), "k", "size", count * bands)
    found = materialise(components(pointers.filter("hub <> node").select(F.col("node").alias("u"), F.col("hub").alias("v"))), "candidate-groups")

    # a group as a whole, or its buckets one by one: what copies fewer n-grams
    members = sets.join(found, "node").select("node", F.col("root").alias("comp"), "first_id", "fetch", "weight", "grams", "bands")
    by_bucket = hubs.join(found, F.col("hub") == F.col("node")).groupBy("root").agg(F.sum(F.col("total") * F.col("blocks")).alias("copied"))
    whole = (F.col("total") * F.col("blocks") <= F.col("copied")).alias("whole")
    groups = members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("grams").alias("total")).select("*", blocks).join(by_bucket, F.col("comp") == F.col("root"))
    groups = materialise(groups.select("comp", "size", "blocks", whole), "groups")
    placed = materialise(join_groups(members.drop("grams"), groups, "comp", "size", count), "placed")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    at_once = placed.filter("whole").withColumn("places", F.array(F.struct(F.col("comp").alias("part"), F.lit(-1).alias("band"), "blocks", block)))
    apart = placed.filter("not whole")
    keys = apart.select("node", hashed).select("node", "band", F.xxhash64("band", "h").alias("k"))
    met = join_groups(keys, hubs.select("k", "size", "blocks"), "k", "size", count * bands).filter("blocks is not null")
    lists = met.groupBy("node").agg(F.collect_list(F.struct(F.col("k").alias("part"), "band", "blocks", block)).alias("places"))
    columns = ["node", "first_id", "fetch", "weight", "bands", "places"]
    wanted = materialise(at_once.select(*columns).unionByName(apart.join(lists, "node").select(*columns)), "wanted")

    t = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(t).alias("x"), t.cast("binary").alias("text"))
    # a Bloom filter of the wanted texts lets the others go before the shuffle
    few = texts.filter(possibly_among(texts, F.col("x"), wanted.select("fetch")))
    fetched = few.join(wanted.hint("merge"), F.col("d").eqNullSafe(F.col("first_id")) & (F.col("x") == F.col("fetch"))).select("text", "node", "weight", "bands", "places")
    each = _sets_of(fetched, n).select("set", "node", "weight", "bands", F.inline("places"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = each.withColumn("other", other).select("set", "node", "weight", "bands", "part", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    out = spread.groupBy("part", "band", "i", "j").applyInPandas(lambda g: verify(g, threshold), "node long, root long, links long")
    verified = materialise(out, "verified")

    roots = materialise(components(verified.select(F.col("node").alias("u"), F.col("root").alias("v"))), "classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = materialise(sets.select("set_key", "node", "first_id", "docs", "weight").join(links, "node", "left").join(roots, "node", "left").select("set_key", "first_id", "docs", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted")
    classes = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("docs").alias("class_size"), F.count("*").alias("members")), "class-table")
    per_set = materialise(join_groups(rooted, classes, "root", "members", count).select("set_key", "docs", "n_links", "class_id", "class_size", "root"), "set-classes")
    return join_groups(signed.select("doc_id", "row", "fetch", "set_key"), per_set, "set_key", "docs", count).select("doc_id", "class_id", "class_size", "n_links", "row", "fetch", "root")


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, class_size, n_links for every document."""
    return join(docs, **how).select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("n_links").cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of docs with all their columns: of each class the one with the least id stays.

    Only rows that may be dropped are shuffled: those with an id and text that is
    dropped or occurs more than once, found by a Bloom filter. The rest pass through.
    """
    made = materialise(join(docs, id_col, text_col, **how).select("doc_id", "row", "fetch", "root"), "joined")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row"))
    leads = made.groupBy("root").agg(lead.alias("f")).select(F.col("f.row").alias("lead"))
    marked = made.join(leads, made["row"] == leads["lead"], "left")
    keys = marked.groupBy("doc_id", "fetch").agg(F.count("*").alias("copies"), F.max(F.col("lead").isNotNull()).alias("stays"))
    touched = materialise(keys.filter("not stays or copies > 1").select(F.col("doc_id").alias("k"), F.col("fetch").alias("x"), "stays"), "touched")
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("own"), F.xxhash64(text_or_empty(text_col)).alias("fx"))
    maybe = possibly_among(keyed, F.xxhash64("own", "fx"), touched.select(F.xxhash64("k", "x").alias("h")))
    split = keyed.withColumn("maybe", maybe)
    both = split.filter("maybe").join(touched.hint("merge"), F.col("own").eqNullSafe(F.col("k")) & (F.col("fx") == F.col("x")), "left")
    # rows equal in id and text are copies: one of them stays
    turn = Window.partitionBy("own", "fx").orderBy(F.lit(1))
    copies = both.filter("stays").withColumn("n", F.row_number().over(turn)).filter("n = 1")
    return split.filter("not maybe").select("row").unionByName(both.filter("stays is null").select("row")).unionByName(copies.select("row")).select("row.*")
