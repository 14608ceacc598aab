"""Quality classifier with hierarchical empirical Bayes over sites.

Document evidence: a sparse logistic classifier on hashed words and word pairs of
the whole text (``BINS`` bins, each present one counts once), beside surface
measures (shares of character classes, repetition of words and lines, word
lengths). It is fitted on a bounded, documented sample of labelled documents: of
those whose documents are there the first SAMPLE_ROWS by the MD5 of their id, up
to SAMPLE_GRAMS present bins in all.

Site evidence: grouped aggregation over *all* documents gives, for every host and
every path of a host, how many documents there are and the sum of their
classifier probabilities; a label, where there is one, takes the probability's
place. A host's rate is a Beta posterior whose prior is the global rate, a
path's one whose prior is its host's posterior. Prior strengths come from the
data by the method of moments: the less sites differ beyond what their sizes
explain, the stronger the pull; a site with few documents stays near its prior.

A document's score adds to its own log odds the log odds by which its path's
posterior differs from the global rate. The document itself takes no part in the
posteriors that it is scored with: its evidence is taken out of its path and host
first, so a label never vouches for its own document. A document is kept at 0.5 or
more. Documents meet their path by ``join_groups``: hot paths are broadcast, all
others are shuffled, nothing is copied.

Defined cases: null or empty text has its own measure and is scored like any
other; null hosts and paths form groups of their own; without both kinds of labels
every document has probability 0.5 and is kept; labels of unknown documents are
ignored, and of several labels of a document the mean counts; rows with equal ids
share their label; a path's only document has its host's posterior, a host's only
one the global rate; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import distinct_sorted, give_back_memory, join_groups, likely_first, materialise, ship_package

SAMPLE_ROWS = 20_000
SAMPLE_GRAMS = 2_000_000
FEATURES = 14
BINS = 1 << 18
WORDS_KEPT = 250_000
STRONGEST, WEAKEST = 10_000.0, 2.0
KEEP_AT = 0.5
SITE_WEIGHT = 1.0

#: Classes of bytes: other, lower, upper, digit, white space, sentence marks, other marks, not ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[33, 34, *range(35, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6
_CLASS[[39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def measures(text: str | None) -> np.ndarray:
    """FEATURES numbers that describe the whole text."""
    out = np.zeros(FEATURES)
    words = (text or "").split()
    if not words:
        out[0] = 1
        return out
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(_CLASS[data], minlength=8) / len(data)
    lines = text.split("\n")
    ends = sum(w[-1] in "#$%&*!|" for w in words) / len(words)
    out[1:8] = counts[1:8]
    out[8] = len(set(words)) / len(words) * np.log1p(len(words)) / 5
    out[9] = sum(map(str.__eq__, words, words[1:])) / len(words)
    out[10] = 1 - len(set(lines)) / len(lines)
    out[11] = ends
    out[12] = np.log1p(len(words)) / 10
    out[13] = sum(map(len, words)) / len(words) / 10
    return out


class Bins:
    """Bins of the words and word pairs of texts, with a memory of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct bins of a text."""
        words, known = (text or "").lower().split(), self.known
        if not words:
            return np.zeros(0, np.int32)
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        return distinct_sorted((np.concatenate([h, pairs]) >> np.uint64(46)).astype(np.int32))


def expand(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised measures and their squares."""
    z = np.clip((x - middle) / scale, -8, 8)
    return np.hstack([z, z * z])


def logistic(x: np.ndarray, y: np.ndarray, grams: list[np.ndarray], penalty: float = 1.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the measures (intercept first) and of the bins: ridge logistic regression by accelerated gradients.

    A text's bins weigh 1 / sqrt(their number) each, and the measures are scaled to
    length 1 or so, so that one step width fits all.
    """
    dense = np.hstack([np.ones((len(x), 1)), x / np.sqrt(x.shape[1])])
    size = np.array([len(g) for g in grams])
    at = np.concatenate([np.zeros(0, np.int32), *grams])
    row = np.repeat(np.arange(len(grams)), size)
    weight = (1 / np.sqrt(np.maximum(size, 1)))[row]
    # the curvature of a row is at most a quarter of its squared length
    step = 1 / (0.25 * ((dense**2).sum(axis=1).max() + 1) * len(x) + penalty)
    step = max(step, 1 / (0.25 * np.linalg.norm(dense.T @ dense, 2) + 0.25 * len(x) + penalty))
    w, v = np.zeros(dense.shape[1]), np.zeros(BINS)
    ahead_w, ahead_v, last = w, v, 1.0
    for _ in range(steps):
        odds = dense @ ahead_w + np.bincount(row, weight * ahead_v[at], len(x))
        rest = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y
        ridge = penalty * ahead_w
        ridge[0] = 0
        new_w = ahead_w - step * (dense.T @ rest + ridge)
        new_v = ahead_v - step * (np.bincount(at, weight * rest[row], BINS) + penalty * ahead_v)
        now = (1 + np.sqrt(1 + 4 * last * last)) / 2
        ahead_w, ahead_v = new_w + (last - 1) / now * (new_w - w), new_v + (last - 1) / now * (new_v - v)
        w, v, last = new_w, new_v, now
    w = w.copy()
    w[1:] /= np.sqrt(x.shape[1])
    return w, v


class Model:
    """What a fit found: middles and scales of the measures, weights of measures and bins."""

    def __init__(self, middle: np.ndarray, scale: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        self.middle, self.scale, self.w, self.v = middle, scale, w, v.astype(np.float32)

    def odds(self, x: np.ndarray, grams: np.ndarray) -> float:
        """Log odds of good quality, between -12 and 12."""
        z = expand(x[None, :], self.middle, self.scale)[0]
        sparse = float(self.v[grams].sum(dtype=np.float64)) / np.sqrt(len(grams)) if len(grams) else 0.0
        return float(np.clip(self.w[0] + z @ self.w[1:] + sparse, -12, 12))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Measures, labels (0 or 1) and bins of the labelled documents that rank first."""
    ship_package(docs.sparkSession)
    turn = F.md5(F.col("label_id").cast("string").cast("binary"))
    # only labels of documents that are there count as candidates
    ids = docs.select(F.col(id_col).alias("doc_id"))
    present = materialise(labels.join(ids, F.col("label_id") == F.col("doc_id"), "left_semi"), "labels")
    drawn = present.withColumn("turn", turn).filter(likely_first(turn, present.count(), 2 * SAMPLE_ROWS))
    # ids are ranked first, so only the texts of the sample are turned into bins
    best = materialise(drawn.orderBy("turn", "label_id").limit(SAMPLE_ROWS), "sample-ids")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(best), F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins()
        for batch in batches:
            found = [v.as_py() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([measures(t).tobytes() for t in found], pa.binary()), pa.array([bins(t).tobytes() for t in found], pa.binary()), *batch.columns[1:]], names=["x", "grams", "good", "turn"])

    featured = texts.select("text", "good", "turn").mapInArrow(run, "x binary, grams binary, good double, turn string")
    # rows that share an id count once
    made = materialise(featured.groupBy("turn").agg(F.min(F.struct("x", "grams", "good")).alias("m")).select("turn", "m.*"), "sample")
    sizes = made.select("turn", (F.length("grams") / 4).cast("long").alias("n")).orderBy("turn").collect()  # SAMPLE_ROWS at most
    upto = np.cumsum([r["n"] for r in sizes])
    kept = made.filter(F.col("turn") <= sizes[int(min(np.searchsorted(upto, SAMPLE_GRAMS), len(sizes) - 1))]["turn"]) if sizes else made
    rows = sorted((r["turn"], bytes(r["x"]), r["good"], bytes(r["grams"])) for r in kept.toLocalIterator())
    x, y, grams = [np.frombuffer(r[1]) for r in rows], [round(r[2]) for r in rows], [np.frombuffer(r[3], np.int32) for r in rows]
    return np.array(x).reshape(-1, FEATURES), np.array(y, float), grams


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from labels (label_id, good) and their documents; None without both kinds of labels."""
    x, y, grams = sample(docs, labels, id_col, text_col)
    if len(np.unique(y)) < 2:
        return None
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(middle, scale, *logistic(expand(x, middle, scale), y, grams))


def scored(docs: DataFrame, model: Model | None, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the classifier's log odds of every document's whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", "host", "path", F.lit(0.0).alias("odds"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def odds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bins, of = Bins(), sent.value.odds
        for texts in batches:
            yield pa.array([of(measures(t), bins(t)) for t in (v.as_py() for v in texts)], pa.float64())
        give_back_memory()

    return rows.select("doc_id", "host", "path", odds("text").alias("odds"))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _strength(groups: DataFrame, n: str, rate: str, around: Column) -> float:
    """The prior strength, by moments of group rates around their priors: one number for all groups."""
    excess = F.sum(F.col(n) * F.pow(F.col(rate) - around, 2)) - F.sum("within")
    row = groups.agg((excess / F.greatest(F.sum(n), F.lit(1.0))).alias("between"), F.avg(around * (1 - around)).alias("spread")).first()
    if row["between"] is None or row["between"] <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, row["spread"] / row["between"] - 1))


def _site() -> Column:
    """One text for a host and a path; nulls differ from all texts."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.regexp_replace(c, "\x1f", "\x1f\x1f")), F.lit("-"))
    return F.concat(part("host"), F.lit("\x1f/"), part("path"))


def posteriors(evidence: DataFrame) -> DataFrame:
    """site, host, path, n, good, host_n, host_good, global_rate, host_strength, path_strength: a row for each path, with all that its posterior needs."""
    paths = materialise(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("evidence").alias("good"), F.sum(F.pow("evidence", 2)).alias("sq")), "paths")
    within = (F.col("sq") - F.col("good") * F.col("good") / F.col("n")) / F.col("n")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum("sq").alias("host_sq"))
    global_rate = F.lit(float(paths.agg(((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2))).first()[0]))
    host_within = (F.col("host_sq") - F.col("host_good") * F.col("host_good") / F.col("host_n")) / F.col("host_n")
    hosts = materialise(hosts.withColumn("raw", F.col("host_good") / F.col("host_n")).withColumn("within", host_within), "hosts")
    host_strength = _strength(hosts, "host_n", "raw", global_rate)
    prior = ((F.col("host_good") + host_strength * global_rate) / (F.col("host_n") + host_strength)).alias("host_rate")
    joined = materialise(paths.join(hosts.select(F.col("host").alias("h"), "host_n", "host_good", prior), F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("raw", F.col("good") / F.col("n")).withColumn("within", within), "paths-hosts")
    path_strength = _strength(joined, "n", "raw", F.col("host_rate"))
    return joined.select(_site().alias("site"), "host", "path", "n", "good", "host_n", "host_good", global_rate.alias("global_rate"), F.lit(host_strength).alias("host_strength"), F.lit(path_strength).alias("path_strength"))


def _rates(own: Column | float) -> tuple[Column, Column]:
    """Posterior rates of the host and the path of a row of posteriors, without the evidence ``own`` of one document (none, if 0.0)."""
    one = 0.0 if isinstance(own, float) else 1.0
    left = lambda total, rest: F.greatest(F.lit(0.0), F.least(total - own, rest))
    host_n, n = F.col("host_n") - one, F.col("n") - one
    host = (left(F.col("host_good"), host_n) + F.col("host_strength") * F.col("global_rate")) / (host_n + F.col("host_strength"))
    return host, (left(F.col("good"), n) + F.col("path_strength") * host) / (n + F.col("path_strength"))


def sites(evidence: DataFrame) -> DataFrame:
    """host, path, documents, path_rate, host_rate, global_rate: posteriors of every path, from all its documents."""
    host, path = _rates(0.0)
    return posteriors(evidence).select("host", "path", F.col("n").cast("long").alias("documents"), path.alias("path_rate"), host.alias("host_rate"), "global_rate")


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, doc_score, path_rate, host_rate, global_rate, quality_score, kept for every document."""
    good = labels.select(F.col(label_id).alias("label_id"), F.col(label).cast("double").alias("y")).dropna().groupBy("label_id").agg(F.avg("y").alias("good"))
    rows = scored(docs, fit(docs, good, id_col, text_col), id_col, text_col, host, path).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    rows = materialise(rows, "scores").join(good, F.col("doc_id") == F.col("label_id"), "left")
    evidence = materialise(rows.select("doc_id", "host", "path", _site().alias("site"), "odds", "p", F.coalesce("good", "p").alias("evidence")), "evidence")
    paths = materialise(posteriors(evidence).drop("host", "path"), "posteriors")
    both = join_groups(evidence.select("doc_id", "site", "odds", "p", "evidence"), paths, "site", "n", evidence.count())
    host_rate, path_rate = _rates(F.col("evidence"))
    out = both.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    score = 1 / (1 + F.exp(-(F.col("odds") + SITE_WEIGHT * (_logit(F.col("path_rate")) - _logit(F.col("global_rate"))))))
    return out.select("doc_id", F.col("p").alias("doc_score"), "path_rate", "host_rate", "global_rate", score.alias("quality_score")).withColumn("kept", F.col("quality_score") >= KEEP_AT)


def held_out(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", folds: int = 4) -> DataFrame:
    """terms, documents, accuracy, log_loss: of labelled documents of one fold, by a model and sites that never saw their labels.

    terms is ``document`` (the classifier alone) or ``document and site``; the fold
    holds the ids whose CRC-32 as text leaves 2 when divided by ``folds``.
    """
    mine = F.crc32(F.col(label_id).cast("string").cast("binary")) % folds == 2
    made = classify(docs, labels.filter(~mine), host, path, id_col, text_col, label_id, label)
    truth = labels.filter(mine).select(F.col(label_id).alias("k"), F.round(label).cast("double").alias("y")).dropna()
    pairs = F.explode(F.array(F.struct(F.lit("document").alias("terms"), F.col("doc_score").alias("s")), F.struct(F.lit("document and site").alias("terms"), F.col("quality_score").alias("s")))).alias("p")
    rows = made.join(truth, F.col("doc_id") == F.col("k")).select("y", pairs).select("y", "p.terms", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p.s"))).alias("s"))
    loss = -(F.col("y") * F.ln("s") + (1 - F.col("y")) * F.ln(1 - F.col("s")))
    return rows.groupBy("terms").agg(F.count("*").alias("documents"), F.avg(((F.col("s") >= KEEP_AT) == (F.col("y") > 0.5)).cast("double")).alias("accuracy"), F.avg(loss).alias("log_loss"))
