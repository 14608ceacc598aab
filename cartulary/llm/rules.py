"""Quality rules: learned decision lists over statistics of a text.

The statistics of every whole text come from one pass (``measured``). Sequential
covering learns an ordered list of conjunctions of thresholds from labelled
rows: a rule grows by the condition of the largest FOIL gain until it takes in no
row of the other class, is pruned from its end on rows that it hasn't seen, and
stays if it is right there more often than wrong; the rows that it takes in leave
the pool, and the next rule grows. Rules cover the class that is rarer among the
labels, the list ends with the other. ``condition`` turns a list into one Spark
CASE expression, so judging is a projection in the JVM, and the list can be read:
``text_of`` writes it down.

Rules are fitted on a bounded sample, at most SAMPLE_ROWS labelled documents: those
whose documents are there, the first by the MD5 of their id. Statistics and
verdicts cover every document.

Defined cases: a null or empty text has no words and all counts 0; labels of
unknown documents or without a quality are ignored, and of several labels of a document the
mean counts, from a half on as good; without both kinds of labels the list is
empty and its verdict the only kind there is (keep, if there is none); rows with
equal ids share their label; a null id has no label; other columns are passed on.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import likely_first, materialise, ship_package
from cartulary.llm.wording import covered, numbered, repeated_grams, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 20_000
#: Thresholds that a condition may have, for each measure: quantiles of the rows at hand.
CUTS = 64
MOST_RULES, MOST_CONDITIONS = 16, 4

#: Counts that ``measured`` returns, all whole numbers.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_long_words")


def share(part: str, of: str) -> Column:
    """One count by another; 0 where that is 0."""
    return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(F.lit(0.0))


#: Measures that rules put thresholds on.
MEASURES = ("words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "repeated_lines", "repeated_words", "distinct_words", "long_words", "words_a_line")


def measure(name: str) -> Column:
    """A measure as an expression over COUNTS."""
    return {
        "words": lambda: F.col("n_words").cast("double"),
        "word_length": lambda: share("word_chars", "n_words"),
        "symbol_share": lambda: share("n_symbols", "word_chars"),
        "upper_share": lambda: share("n_upper", "word_chars"),
        "digit_share": lambda: share("n_digits", "word_chars"),
        "mark_share": lambda: share("n_marks", "word_chars"),
        "repeated_lines": lambda: share("n_dup_lines", "n_lines"),
        "repeated_words": lambda: share("n_repeat_words", "n_words"),
        "distinct_words": lambda: share("n_distinct", "n_words"),
        "long_words": lambda: share("n_long_words", "n_words"),
        "words_a_line": lambda: share("n_words", "n_lines"),
    }[name]()


_WHITE = b" \t\n\r\x0b\x0c"
_IS = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)), "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "mark": np.isin(np.arange(256), np.frombuffer(b"!?.,;:", np.uint8)), "symbol": np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8)),
    "start": ~np.isin(np.arange(256), np.concatenate([np.arange(128, 192), np.frombuffer(_WHITE, np.uint8)])),
}


def counts_of(texts: list[str | None]) -> np.ndarray:
    """COUNTS of several whole texts, a row each."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    words = [words_of(t) for t in texts]
    ids, bounds = numbered(words)
    repeated = covered(repeated_grams(ids, bounds, WINDOW), WINDOW, len(ids))
    up_to = np.append(0, np.cumsum(repeated))
    out[:, 0] = np.diff(bounds)
    out[:, 4] = up_to[bounds[1:]] - up_to[bounds[:-1]]
    for row, text, own in zip(out, texts, words, strict=True):
        if not own:
            continue
        data = text.encode()
        seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        lines = [x for x in data.split(b"\n") if x.strip(_WHITE)]
        row[1:4] = seen[_IS["start"]].sum(), seen[_IS["symbol"]].sum(), len(lines) - len(set(lines))
        row[5:] = len(lines), len(set(own)), seen[_IS["upper"]].sum(), seen[_IS["digit"]].sum(), seen[_IS["mark"]].sum(), sum(len(w) > 16 for w in own)
    return out


def measured(docs: DataFrame, text_col: str = "text", to: str = "counts") -> DataFrame:
    """docs with a struct of COUNTS of the whole text."""
    ship_package(docs.sparkSession)

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        found = counts_of(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in range(len(COUNTS))], names=list(COUNTS))

    return docs.withColumn(to, count(F.col(f"`{text_col}`").cast("string")))


class Condition(NamedTuple):
    """A measure at least, or below, a threshold."""

    measure: str
    least: bool
    bound: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return (x[self.measure] >= self.bound) == self.least

    def column(self) -> Column:
        c = measure(self.measure)
        return c >= F.lit(self.bound) if self.least else c < F.lit(self.bound)


class Rules(NamedTuple):
    """Conjunctions in order, the verdict of each, and that of rows which none takes in."""

    rules: tuple[tuple[Condition, ...], ...]
    verdict: bool
    otherwise: bool


def holds(rule: tuple[Condition, ...], x: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Those of the rows that a conjunction takes in."""
    for c in rule:
        rows = rows[c.holds({c.measure: x[c.measure][rows]})]
    return rows


def best_condition(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of the largest FOIL gain on the rows; ties go to the first measure and the least threshold."""
    best: tuple[float, Condition | None] = (0.0, None)
    total, wanted = len(rows), int(y[rows].sum())
    if not wanted:
        return best
    before = np.log2(wanted / total)
    for name in x:
        v = x[name][rows]
        cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1), method="higher"))
        mids = (cuts[:-1] + cuts[1:]) / 2
        order = np.argsort(v, kind="stable")
        at = np.searchsorted(v[order], mids)
        below_wanted = np.append(0, np.cumsum(y[rows][order]))[at]
        for least, p, n in ((True, wanted - below_wanted, total - at), (False, below_wanted, at)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - before), 0.0)
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = (float(gain.max()), Condition(name, least, float(mids[int(gain.argmax())])))
    return best


def grown(x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray) -> tuple[Condition, ...]:
    """A conjunction that takes in rows of the wanted class, and as few others as possible."""
    rule: tuple[Condition, ...] = ()
    while len(rule) < MOST_CONDITIONS and len(rows) and not y[rows].all():
        _, condition = best_condition(x, y, rows)
        if condition is None:
            break
        rule, rows = (*rule, condition), holds((condition,), x, rows)
    return rule


def pruned(rule: tuple[Condition, ...], x: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray) -> tuple[tuple[Condition, ...], float]:
    """The beginning of a conjunction with the largest (right - wrong) / (right + wrong) on the rows, the shortest of equals."""
    best: tuple[tuple[Condition, ...], float] = ((), -1.0)
    for n in range(1, len(rule) + 1):
        taken = y[holds(rule[:n], x, rows)]
        worth = (2 * int(taken.sum()) - len(taken)) / len(taken) if len(taken) else -1.0
        if worth > best[1]:
            best = rule[:n], worth
    return best


def learned(x: dict[str, np.ndarray], good: np.ndarray) -> Rules:
    """A decision list from measures and labels by sequential covering.

    Every third row is kept for pruning; with under three rows of the rarer class all rows serve both.
    """
    verdict = bool(len(good) and 2 * good.sum() <= len(good))
    y = good == verdict
    if not y.any() or y.all():
        return Rules((), verdict, bool(good.all()) if len(good) else True)
    turn = np.arange(len(y))
    for kind in (True, False):
        turn[y == kind] = np.arange((y == kind).sum())
    few = y.sum() < 3
    growing = np.flatnonzero((turn % 3 != 2) | few)
    pruning = np.flatnonzero((turn % 3 == 2) | few)
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MOST_RULES and y[growing].any():
        rule, worth = pruned(grown(x, y, growing), x, y, pruning)
        if not rule or worth <= 0:
            break
        rules.append(rule)
        growing = np.setdiff1d(growing, holds(rule, x, growing))
        pruning = np.setdiff1d(pruning, holds(rule, x, pruning))
    return Rules(tuple(rules), verdict, not verdict)


def condition(made: Rules) -> Column:
    """The list as one conditional expression over COUNTS; true means keep."""
    out = None
    for rule in made.rules:
        every = rule[0].column()
        for c in rule[1:]:
            every &= c.column()
        out = F.when(every, made.verdict) if out is None else out.when(every, made.verdict)
    return F.lit(made.otherwise) if out is None else out.otherwise(made.otherwise)


def text_of(made: Rules) -> str:
    """The list in words, a rule a line."""
    say = {True: "keep", False: "drop"}
    lines = [f"{say[made.verdict]} if " + " and ".join(f"{c.measure} {'>=' if c.least else '<'} {c.bound:.6g}" for c in rule) for rule in made.rules]
    return "\n".join([*lines, f"else {say[made.otherwise]}"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """turn, good and MEASURES of at most so many labelled rows, in order of the MD5 of their id.

    Labels meet ids first, so those of unknown documents count for nothing; what is then
    broadcast to the texts is bounded by ``rows``.
    """
    means = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__l")).agg((F.avg("quality") >= 0.5).alias("good"))
    ids = docs.select(F.col(f"`{id_col}`").alias("__id")).distinct()
    known = materialise(means.join(ids, F.col("__l") == F.col("__id"), "left_semi").withColumn("turn", F.md5(F.col("__l").cast("string").cast("binary"))), "labelled")
    drawn = known.filter(likely_first(F.col("turn"), known.count(), rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    counted = measured(texts.join(F.broadcast(drawn), F.col("__id") == F.col("__l")), "__text").select("turn", "good", "counts.*")
    numbers = counted.select("turn", "good", *[measure(name).alias(name) for name in MEASURES])
    return numbers.orderBy("turn", *MEASURES).limit(rows)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Rules:
    """A decision list from the labelled documents; the driver gets a row of numbers for each in the sample."""
    sample = labelled(docs, labels, id_col, text_col, rows).toPandas()
    return learned({name: sample[name].to_numpy(float) for name in MEASURES}, sample["good"].to_numpy(bool))


def base_failed() -> Column:
    """Rows that the rules aren't asked about: under ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, made: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed and kept for every document."""
    counted = measured(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    return counted.select("doc_id", "counts.*").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & condition(made))
