"""Quality classifier (operator 8): tree paths as rules, lasso logistic weights, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm import textstats as S

#: Labelled rows that the model is fitted on, at most: those with the least hash of their id.
TRAIN_ROWS = 20_000
TREES, DEPTH, MIN_LEAF, RATE = 24, 3, 20, 0.3
PENALTY = 2e-3
THRESHOLD = 0.3
FOLDS = 5


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a double; a text without words has zeros."""
    w, lines = S.words(text), S.lines(text)
    n, chars = F.greatest(F.size(w), F.lit(1)), F.greatest(S.word_chars(text), F.lit(1))
    low = F.transform(w, lambda x: F.length(x))
    out = {
        "words": F.log1p(F.size(w)),
        "word_length": S.word_chars(text) / n,
        "longest_word": F.log1p(F.coalesce(F.array_max(low), F.lit(0))),
        "symbols": S.count_of(text, S.SYMBOLS) / n,
        "exclamations": S.count_of(text, "!?") / n,
        "stops": S.count_of(text, ".,;:") / n,
        "digits": S.count_of(text, "0123456789") / chars,
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "distinct_words": F.size(F.array_distinct(w)) / n,
        "duplicate_lines": S.repeats(lines) / F.greatest(F.size(lines), F.lit(1)),
        "words_a_line": F.log1p(F.size(w) / F.greatest(F.size(lines), F.lit(1))),
    }
    return {k: c.cast("double") for k, c in out.items()}


def held_out(id_: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is 0 modulo FOLDS; null ids, too."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.value if self.above else x <= self.value

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    """Score: the logistic function of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        terms = [F.when(reduce(and_, (c.column() for c in rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1.0 / (1.0 + F.exp(-reduce(add, terms, F.lit(self.intercept))))

    def predict(self, features: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(features.values())))
        z = np.full(n, self.intercept)
        for rule, w in self.rules:
            z += w * holds(rule, features, n)
        return 1 / (1 + np.exp(-z))


def holds(rule: Rule, features: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(and_, (c.holds(features[c.feature]) for c in rule), np.ones(n, dtype=bool))


def _split(x: np.ndarray, r: np.ndarray) -> tuple[float, float]:
    """Gain and threshold of the best split of residuals r by x, halfway between two values."""
    order = np.argsort(x, kind="stable")
    xs, sums = x[order], np.cumsum(r[order])
    k = np.arange(1, len(x))
    can = (xs[1:] > xs[:-1]) & (k >= MIN_LEAF) & (len(x) - k >= MIN_LEAF)
    if not can.any():
        return 0.0, 0.0
    left, total = sums[:-1], sums[-1]
    gain = np.where(can, left**2 / k + (total - left) ** 2 / (len(x) - k) - total**2 / len(x), 0)
    i = int(gain.argmax())
    return float(gain[i]), float((xs[i] + xs[i + 1]) / 2)


def _grow(features: dict[str, np.ndarray], r: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: list[Rule], fit: np.ndarray, scale: np.ndarray) -> None:
    """A regression tree on residuals; every node but the root is a rule, leaves move ``fit`` by a Newton step."""
    names = list(features)
    best = max(((*_split(features[f][rows], r[rows]), f) for f in names), key=lambda g: g[0]) if depth else (0.0, 0.0, "")
    if best[0] <= 1e-9:
        fit[rows] += RATE * r[rows].sum() / (scale[rows].sum() + 1.0)
        return
    _, value, name = best
    for above in (False, True):
        condition = Condition(name, above, value)
        own = rows[condition.holds(features[name][rows])]
        out.append((*path, condition))
        _grow(features, r, own, out[-1], depth - 1, out, fit, scale)


def grow_rules(features: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, without repeats."""
    fit, out = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-fit))
        _grow(features, y - p, np.arange(len(y)), (), DEPTH, out, fit, p * (1 - p))
    return list(dict.fromkeys(out))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * |weights|, by accelerated proximal gradient steps."""
    n, m = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    rate = 4 * n / (np.linalg.norm(a, 2) ** 2)
    w = np.zeros(m + 1)
    w[0] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    v, t = w.copy(), 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - rate * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(features: dict[str, np.ndarray], y: np.ndarray) -> RuleModel:
    """The rule ensemble of labelled rows. One label only gives a constant, no rows one half."""
    y = y.astype(float)
    if not len(y):
        return RuleModel(0.0, ())
    if y.min() == y.max():
        return RuleModel(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), ())
    rules = grow_rules(features, y)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    x = np.stack([holds(r, features, len(y)) for r in rules], axis=1).astype(float)
    _, first = np.unique(x, axis=1, return_index=True)  # rules with the same rows: the first
    kept = sorted(first)
    b, w = lasso_logistic(x[:, kept], y, PENALTY)
    return RuleModel(b, tuple((rules[i], float(v)) for i, v in zip(kept, w, strict=True) if abs(v) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> RuleModel:
    """Fit on labelled documents outside the held-out fold: at most ``rows`` labels, those with the least hash of their id (null
    labels don't count; a repeated id counts with its greatest label). Only their statistics reach the driver.

    Where there are more labels, a bound on the hash, a tenth above the wanted share, keeps all others out of the sort. Null
    texts count as empty; documents without label and other columns don't matter; no labels give a constant model.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(id_column))).groupBy(id_column).agg(F.max(label).alias("label"))
    known = known.withColumn("at", F.xxhash64(id_column))
    share = (1.1 * rows + 1000) / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.col("at") < F.lit(int((share - 0.5) * 2.0**64)))
    known = known.orderBy("at", id_column).limit(rows).select(F.col(id_column).alias("known"), "label")
    texts = docs.select(F.col(id_column).alias("id"), S.text_of(text_column).alias("text"))
    joined = texts.join(F.broadcast(known), F.col("id") == F.col("known"))  # at most ``rows`` rows
    stats = statistics(F.col("text"))
    found = joined.select("id", "label", *(c.alias(k) for k, c in stats.items())).toPandas()
    found = found.sort_values(["id", *stats], kind="stable")
    return fit_rules({k: found[k].to_numpy(float) for k in stats}, found["label"].to_numpy())


def _scored(docs: DataFrame, model: RuleModel, names: dict[str, str], text_column: str) -> DataFrame:
    """Columns by new names, then score and predicted. The statistics pass through a generator of one row: an optimizer that moves
    a later filter down stops there, so no statistic is evaluated again for each condition that uses it. Only statistics that a rule uses are there."""
    used = {c.feature for rule, _ in model.rules for c in rule} or {"words"}
    stats = {k: c for k, c in statistics(F.col("text__")).items() if k in used}
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()), S.text_of(f"`{text_column}`").alias("text__"))
    rows = rows.select(*names.values(), *(c.alias(f"{k}__") for k, c in stats.items()))
    rows = rows.select(*names.values(), F.inline(F.array(F.struct(*(F.col(f"{k}__").alias(k) for k in stats)))))
    return rows.withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_quality(docs: DataFrame, model: RuleModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, held_out, score and predicted of every document. One pass without shuffle or Python; null texts count as empty, null
    and repeated ids stay, other columns never enter a score, an empty table gives no row."""
    rows = _scored(docs, model, {id_column: "id__"}, text_column)
    return rows.select(F.col("id__").alias(id_column), held_out(F.col("id__")).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, model: RuleModel, *, text_column: str = "text") -> DataFrame:
    """The documents predicted 1, with their own columns, whatever their names. Null texts count as empty for the score and stay null;
    repeated rows stay or go together; an empty table gives no row."""
    names = {c: f"own__{i}" for i, c in enumerate(docs.columns)}
    return _scored(docs, model, names, text_column).filter("predicted = 1").select(*(F.col(a).alias(c) for c, a in names.items()))
