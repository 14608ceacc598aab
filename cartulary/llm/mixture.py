"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Every source s gets a target number of words: weights share the wanted total,
a target stops at ``max_repeats`` times the source's size and the excess is
shared again by weight, until none is above (``targets``).

Document rates are the exponential tilt rate = exp(sum of lambdas) that is closest
in relative entropy (weighted by words) to taking every document once, subject to
sum(size * rate) = target for every group of every grouping: sources, and if wanted
others such as languages (``balanced``). A rate stops at max_repeats, in the dual too.
The convex dual is solved by Newton iterations: each takes one grouped aggregation
for the words that every group takes at present (the gradient is that minus the
target) and for those of them whose rate isn't stopped (the curvature: within a
grouping documents are in one group each, so its block of the Hessian is diagonal).
With several groupings their blocks take turns. Documents of the same groups share
their rate, so sums run over one row for each combination of groups that occurs.

Rates become whole copies: floor(rate) for all, and one more for the documents
that come first by the MD5 of their id until the source's target is reached.
Their running sum needs no global sort: totals by the first hex digits, in two
levels of at most 256 each, show the bucket in which a source's target falls; buckets
before it take the extra copy, those after don't, and only that one bucket is summed
row by row. Documents meet their source's plan by broadcast up to SMALL sources,
beyond that by ``join_groups``.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; a null id hashes as the empty string; sources without words get target
0; equal rows are told apart by nothing and may take different numbers of copies,
the same numbers in every run; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.shared import WORD, join_groups, materialise, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
NEWTON_STEPS = 60
#: Groups take their target to this share of it.
CLOSE = 1e-12
#: Hex digits of a bucket: 65,536 buckets, so that a bucket of the largest source stays small at any size.
BUCKET_DIGITS = 4
#: So many sources are broadcast.
SMALL = 10_000


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources (source, source_size) with the column target.

    Sorted by cap per weight, the capped sources come first, so running sums of
    whole numbers give the level that the others share. The windows run over the
    table of sources, which holds one row for each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    caps = sources.withColumn("w", w.cast("long")).withColumn("cap", (F.col("source_size") * max_repeats).cast("long"))
    totals = Window.partitionBy()
    sums = caps.select("source", "source_size", "w", "cap", F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"), F.sum("w").over(totals).alias("w_all"), F.sum("source_size").over(totals).alias("size_all"))
    level = (F.col("size_all") * share - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    levels = sums.withColumn("level", level).withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    shared = F.min(F.when(~F.col("capped"), F.struct("cap_before", "w_before", "level"))).over(totals)
    return levels.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared["level"] * F.col("w")).alias("target"))


def balanced(cells: DataFrame, groupings: Sequence[tuple[str, DataFrame]], cap: float = MAX_REPEATS, steps: int = NEWTON_STEPS) -> DataFrame:
    """cells (a column for each grouping, and size) with rate: entropy balancing under all groupings' targets.

    groupings name the columns, each with its table (group, target). Groups without
    words or with target 0 get rate 0. Iterations end when every group that has words to take is CLOSE to its
    target, or after so many steps, as when targets contradict each other.
    """
    lambdas = [t.select(F.col("group").alias(f"g{k}"), F.col("target").cast("double").alias(f"t{k}"), F.lit(0.0).alias(f"l{k}")) for k, (_, t) in enumerate(groupings)]
    # the first grouping starts where it alone would be solved; with no other one, the first step finds nothing left to do
    name = groupings[0][0]
    held = cells.groupBy(F.col(name).alias("in_cells")).agg(F.sum("size").cast("double").alias("held"))
    alone = F.when((F.col("t0") > 0) & (F.col("held") > 0), F.ln(F.col("t0") / F.col("held"))).otherwise(0.0)
    lambdas[0] = lambdas[0].join(held, F.col("g0").eqNullSafe(F.col("in_cells")), "left").select("g0", "t0", alone.alias("l0"))
    lambdas = [materialise(t, "lambdas") for t in lambdas]

    def rated() -> DataFrame:
        out = cells
        for k, (name, _) in enumerate(groupings):
            out = _met(out, lambdas[k], F.col(name).eqNullSafe(F.col(f"g{k}")))
        tilt = F.exp(sum((F.col(f"l{k}") for k in range(len(groupings))), F.lit(0.0)))
        wanted = F.lit(True)
        for k in range(len(groupings)):
            wanted = wanted & (F.col(f"t{k}") > 0)
        rate = F.when(wanted & (F.col("size") > 0), F.least(tilt, F.lit(float(cap)))).otherwise(0.0)
        return out.withColumn("rate", rate).withColumn("stopped", tilt >= cap)

    settled = 0
    for step in range(steps * len(groupings)):
        k = step % len(groupings)
        taken = F.col("size") * F.col("rate")
        sums = rated().groupBy(f"g{k}", f"t{k}", f"l{k}").agg(F.sum(taken).alias("taken"), F.sum(F.when(~F.col("stopped"), taken)).alias("free"))
        off = F.col(f"t{k}") - F.col("taken")
        # at most 1 either way, so that far starts stay stable; a wholly stopped group that takes too much comes down too
        curve = F.coalesce(F.nullif(F.col("free"), F.lit(0.0)), F.col("taken"))
        move = F.when((F.col("taken") > 0) & (off != 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(off, curve)))).otherwise(0.0)
        up = materialise(sums.select(f"g{k}", f"t{k}", (F.col(f"l{k}") + move).alias(f"l{k}"), F.when(F.col("taken") > 0, F.try_divide(F.abs(off), F.col(f"t{k}"))).alias("off")), "lambdas")
        far = up.agg(F.max(F.when(F.col(f"t{k}") > 0, F.col("off")))).first()[0]
        lambdas[k] = up.drop("off")
        settled = settled + 1 if far is None or far < CLOSE else 0
        if settled == len(groupings):
            break
    drop = [f"{c}{k}" for k in range(len(groupings)) for c in "gtl"]
    return rated().drop("stopped", *drop)


def _met(rows: DataFrame, groups: DataFrame, on: Column) -> DataFrame:
    """rows joined with groups, which are broadcast if they are few."""
    return rows.join(F.broadcast(groups) if groups.count() <= SMALL else groups, on)


def tilted(sources: DataFrame, cap: float = MAX_REPEATS) -> DataFrame:
    """sources (source, source_size, target) with rate."""
    cells = sources.select(F.col("source").alias("cell"), F.col("source_size").cast("double").alias("size"))
    rates = balanced(cells, [("cell", sources.select(F.col("source").alias("group"), "target"))], cap)
    return sources.join(rates.select("cell", "rate"), F.col("source").eqNullSafe(F.col("cell"))).drop("cell")


def _measured(id_col: str, text_col: str, source_col: str) -> list[Column]:
    turn = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), turn.alias("turn"), F.substring(turn, 1, BUCKET_DIGITS).alias("bucket")]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, the order of documents (turn) and its bucket, without the texts."""
    return docs.select(*_measured(id_col, text_col, source_col))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan, however large a source is."""
    keyed = plan.withColumn("key", _key("source")).drop("source")
    mine = rows.withColumn("key", _key("source"))
    if plan.count() <= SMALL:
        return mine.join(F.broadcast(keyed), "key").drop("key", "documents")
    total = plan.agg(F.sum("documents")).first()[0]
    return join_groups(mine, materialise(keyed, "keyed-plan"), "key", "documents", total).drop("key", "documents")


def planned(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """For sized rows: the plan of each source, and the documents of the buckets in which targets fall.

    The plan has source_size, target, rate, whole (copies for all), edge (the bucket
    before which documents take one more). The second table has a source, turn,
    doc_id, size and extra for each document in its source's edge bucket.
    """
    buckets = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("documents")), "buckets")
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"), F.sum("documents").alias("documents"))
    sources = materialise(targets(sizes.drop("documents"), weights, share, max_repeats).join(sizes.select(F.col("source").alias("s"), "documents"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    sources = materialise(tilted(sources, max_repeats), "rates")
    whole = F.floor(F.col("rate") + 1e-9)
    plan = sources.withColumn("whole", whole.cast("int")).withColumn("budget", F.round(F.col("source_size") * (F.col("rate") - whole), 3))

    def falling(parts: DataFrame, at: str) -> DataFrame:
        """source, at, before: of a source's parts (part_size, start) the one in which its budget falls, and the words before it; there are 256 at most."""
        inside = Window.partitionBy("s").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        upto = parts.withColumn("before", F.col("start") + F.coalesce(F.sum("part_size").over(inside), F.lit(0)))
        met = upto.join(plan.select("source", "budget"), F.col("s").eqNullSafe(F.col("source")))
        return met.filter("before < budget and before + part_size >= budget").select("s", at, "before")

    coarse = F.substring("bucket", 1, BUCKET_DIGITS // 2)
    first = falling(buckets.groupBy(F.col("source").alias("s"), coarse.alias("coarse")).agg(F.sum("bucket_size").alias("part_size")).withColumn("start", F.lit(0)), "coarse")
    first = materialise(first.select(F.col("s").alias("fs"), F.col("coarse").alias("fc"), F.col("before").alias("start")), "coarse-edges")
    inner = buckets.join(first, F.col("source").eqNullSafe(F.col("fs")) & (coarse == F.col("fc"))).select(F.col("source").alias("s"), "bucket", F.col("bucket_size").alias("part_size"), "start")
    edge = falling(inner, "bucket").select(F.col("s").alias("s2"), F.col("bucket").alias("edge"), "before")
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").withColumn("edge", F.coalesce("edge", F.when(F.col("budget") > 0, F.lit("~")).otherwise(F.lit("")))).withColumn("before", F.coalesce("before", F.lit(0)))
    plan = materialise(plan, "mix-plan")
    running = Window.partitionBy("source", "bucket").orderBy("turn", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    on_edge = _with_source(rows, plan).filter("bucket = edge").withColumn("extra", (reached + F.col("size") / 2 <= F.col("budget")).cast("int"))
    return plan, on_edge


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    rows = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    plan, on_edge = planned(rows, **how)
    off_edge = _with_source(rows, plan).filter("bucket <> edge").withColumn("extra", (F.col("bucket") < F.col("edge")).cast("int"))
    copies = F.col("whole") + F.col("extra")
    out = off_edge.unionByName(on_edge)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of docs with all their columns, as often as the mix takes them.

    Documents meet the small plan of their source and the few rows of its edge
    bucket; whole texts aren't counted twice or joined with each other. Rows that
    share an id, source and size share their number of copies: that of the first one.
    """
    rows = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    plan, on_edge = planned(rows, **how)
    edges = materialise(on_edge.groupBy(F.col("source").alias("e_source"), F.col("turn").alias("e_turn"), F.col("size").alias("e_size")).agg(F.min("extra").alias("e_extra")), "edges")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text"))
    mine = keyed.select("row", *_measured("__id", "__text", "__source")[1:])
    met = _with_source(mine, plan.select("source", "documents", "whole", "edge")).withColumn("on_edge", F.col("bucket") == F.col("edge"))
    exact = met.join(edges, F.col("on_edge") & F.col("source").eqNullSafe(F.col("e_source")) & (F.col("turn") == F.col("e_turn")) & (F.col("size") == F.col("e_size")), "left")
    copies = F.col("whole") + F.when(F.col("on_edge"), F.coalesce("e_extra", F.lit(0))).otherwise((F.col("bucket") < F.col("edge")).cast("int"))
    return exact.withColumn("copies", copies.cast("int")).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
