"""Quality scores from a sparse ensemble of rules over text statistics.

Boosted trees are grown on a bounded sample of labelled rows; every path from a root to a node becomes a
rule, a conjunction of bounds on statistics. An L1-penalised logistic regression keeps few of them, and the
kept ones are compiled into one Spark column expression. Statistics are column expressions as well, so
scoring a corpus is a projection without Python or a shuffle.

Defined cases: null and empty texts have the statistics of an empty text and get a score; null ids are never
held out and never learned from; a document with several labels counts with their mean, rounded, halves up;
repeated rows are scored one by one; without labels of both classes the score is the smoothed share of label
1 for every row (0.5 without labels); an empty table gives no rows; more columns of the input are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows that are learned from, at most: the lowest by a hash of their id.
SAMPLE_ROWS = 8_000
HELD_OUT = 2


# ---------------------------------------------------------------- statistics


def statistics(text: Column) -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    """(parts, statistics): named arrays of the text, and named numbers over those and ``__text``."""
    parts = [("__text", text), ("__words", F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")), ("__lines", F.split(text, "\n"))]
    t, words, lines = F.col("__text"), F.col("__words"), F.col("__lines")
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    only = lambda kept: F.length(F.regexp_replace(t, f"[^{kept}]+", "")) / n
    stats = [
        ("log_chars", F.log1p(F.length(t).cast("double"))),
        ("word_length", n / n_words),
        ("upper_share", only("A-Z")),
        ("digit_share", only("0-9")),
        ("symbol_share", only(r"#$%&*!^~=<>@\\")),
        ("bar_share", only("|")),
        ("stop_share", only(".,;:?")),
        ("word_variety", F.size(F.array_distinct(words)) / n_words),
        ("line_variety", F.size(F.array_distinct(lines)) / F.size(lines)),
        ("log_line_length", F.log1p(n / F.size(lines))),
    ]
    return parts, stats


#: The statistics, in the order in which rules number them.
STATISTICS = [
    "log_chars", "word_length", "upper_share", "digit_share", "symbol_share", "bar_share", "stop_share", "word_variety", "line_variety", "log_line_length",
]


def with_statistics(docs: DataFrame, *kept: Column, text: str = "text") -> DataFrame:
    parts, stats = statistics(text_of(text))
    staged = docs.select(*kept, *[c.alias(k) for k, c in parts])
    names = [c for c in staged.columns if not c.startswith("__")]
    return staged.select(*names, *[c.alias(k) for k, c in stats])


# ---------------------------------------------------------------- learning


@dataclass(frozen=True)
class Rule:
    """All bounds hold: (statistic's number, True for "at most", bound)."""

    bounds: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, at_most, bound in self.bounds:
            out &= (x[:, k] <= bound) if at_most else (x[:, k] > bound)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, at_most, bound in self.bounds:
            c = F.col(STATISTICS[k])
            out = out & ((c <= bound) if at_most else (c > bound))
        return out


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> list[tuple[Rule, np.ndarray, float]]:
    """Grow one tree on gradients; (path, rows, step) of every node but the root, leaves marked by a step."""
    out = []

    def split(rows: np.ndarray, bounds: tuple, left: int) -> None:
        best = None
        if left and len(rows) >= 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for k, edges in enumerate(cuts):
                at = np.searchsorted(edges, x[rows, k])
                gs = np.cumsum(np.bincount(at, g[rows], len(edges) + 1))[:-1]
                hs = np.cumsum(np.bincount(at, h[rows], len(edges) + 1))[:-1]
                gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - whole
                if len(gain) and (best is None or gain.max() > best[0]):
                    best = (float(gain.max()), k, float(edges[int(gain.argmax())]))
        if best is None or best[0] < 1e-6:
            if bounds:
                out.append((Rule(bounds), rows, float(-g[rows].sum() / (h[rows].sum() + 1.0))))
            return
        _, k, bound = best
        if bounds:
            out.append((Rule(bounds), rows, np.nan))
        low = x[rows, k] <= bound
        split(rows[low], (*bounds, (k, True, bound)), left - 1)
        split(rows[~low], (*bounds, (k, False, bound)), left - 1)

    split(np.arange(len(x)), (), depth)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Paths of boosted trees, without repeats."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64), method="nearest")) for k in range(x.shape[1])]
    z, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = _sigmoid(z)
        for rule, rows, step in _tree(x, cuts, p - y, p * (1 - p), depth):
            found.setdefault(rule)
            if not np.isnan(step):
                z[rows] += rate * step
    return list(found)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1 logistic regression by accelerated proximal steps; the intercept is free."""
    n = len(y)
    step = 4.0 * n / (np.linalg.norm(np.column_stack([np.ones(n), a]), 2) ** 2)
    b, w = 0.0, np.zeros(a.shape[1])
    bz, wz, t = b, w, 1.0
    for _ in range(rounds):
        r = _sigmoid(bz + a @ wz) - y
        nb, nw = bz - step * r.mean(), wz - step * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0.0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        bz, wz = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * rule.holds(x)
        return _sigmoid(z)

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = (3e-2, 1e-2, 3e-3, 1e-3, 3e-4)) -> RuleEnsemble:
    """Grow rules on all rows, choose the penalty by the loss on every fifth row, refit on all."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    test = np.arange(len(y)) % 5 == 4
    rules = grow_rules(x[~test], y[~test]) if test.any() and y[~test].min() < y[~test].max() else grow_rules(x, y)
    if not rules:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    a = np.column_stack([r.holds(x) for r in rules]).astype(np.float64)

    def loss(penalty: float) -> float:
        b, w = lasso(a[~test], y[~test], penalty, 150)
        p = np.clip(_sigmoid(b + a[test] @ w), 1e-9, 1 - 1e-9)
        return float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())

    best = min(penalties, key=loss) if test.any() and y[~test].min() < y[~test].max() else 3e-3
    b, w = lasso(a, y, best)
    kept = [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-3]
    return RuleEnsemble(b, tuple(kept))


# ---------------------------------------------------------------- Spark


def _bucket(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> RuleEnsemble:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (_bucket(F.col(doc_id)) != HELD_OUT))
    each = usable.groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.floor(F.avg(label) + 0.5).alias("__y"))
    sample = each.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("t"))
    joined = texts.join(F.broadcast(sample), F.col("id") == F.col("__id"))  # sample_rows bounds it
    stats = with_statistics(joined, F.col("id"), F.col("__y").alias("y"), text="t")
    one = stats.groupBy("id").agg(F.min(F.struct("y", *STATISTICS)).alias("s"))  # one row for an id that repeats
    rows = one.orderBy("id").select("s.*").collect()
    x = np.array([[r[k] for k in STATISTICS] for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["y"] for r in rows], dtype=np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = learn(docs, labels, sample_rows, doc_id=doc_id, text=text, label=label)
    held = F.coalesce(_bucket(F.col(doc_id)) == HELD_OUT, F.lit(False))
    scored = with_statistics(docs, F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), text=text).withColumn("score", model.column())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns as they are."""
    model = learn(docs, labels, doc_id=doc_id, text=text)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    return with_statistics(docs, row, text=text).where(model.column() >= threshold).select("row.*")
