"""Experiments over any model: cross-validation, search, transfer, leave-one-out, ablation, learning curve, importance.

A model is a function (train, test) -> test with a column ``prediction``; whatever it learns, features and fences included, it
learns from ``train`` alone. Models are fitted one after the other, each on the cluster; only errors come together. Those that are
``Foldwise`` learn all folds of a comparison from the same few passes over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from random import Random

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.operators import cleaning, modeling
from terravane.operators.shared import bucket_ends, cut, placed, quantiles_of_sets, same

Model = Callable[[DataFrame, DataFrame], DataFrame]
#: The shares of the training rows that a learning curve takes.
FRACTIONS = (0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0)
METRICS = ("rmse", "mae", "mdape", "r2")
#: Rows that settle where buckets of values end; all rows are then counted.
SETTLING = 200_000


@dataclass(frozen=True)
class Folds:
    """Rows with a number ``_bits`` whose bit k tells whether the model of fold k learns from the row; some of the rows, to settle buckets;
    and the distinct (fold, columns) of the rows, for which models are asked."""

    rows: DataFrame
    some: DataFrame
    cells: DataFrame
    fold: str
    folds: int


@dataclass(frozen=True)
class Foldwise:
    """A model that can also learn all folds at once. ``learn`` gives what the folds' models say of each cell, in columns that begin with a
    tag, and from these and a row whether the row is asked and its prediction. ``by``: the columns that make cells."""

    model: Model
    by: tuple[str, ...]
    learn: Callable[[Folds, str], tuple[DataFrame, Column, Column]]

    def __call__(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return self.model(train, test)


def backoff(groups: Sequence[str], price: str, area: str) -> Model:
    """Median unit price times area, from narrow groups to wide ones."""

    def learn(f: Folds, tag: str) -> tuple[DataFrame, Column, Column]:
        unit, tops = F.col(price) / F.col(area), range(len(groups), -1, -1)
        levels = quantiles_of_sets(f.rows, [groups[:k] for k in tops], unit, [0.5], bucket_ends(f.some, unit), F.col("_bits"), f.folds)
        out = f.cells
        for k, level in zip(tops, levels, strict=True):
            level = level.select(F.col("set").alias("_set"), *(F.col(g).alias(f"_of_{g}") for g in groups[:k]), F.col("q0").alias(f"_u{k}"))
            out = out.join(level, [F.col(f.fold) == F.col("_set"), *(F.col(g) == F.col(f"_of_{g}") for g in groups[:k])], "left").drop("_set", *(f"_of_{g}" for g in groups[:k]))
        out = out.withColumn(f"{tag}_unit", F.coalesce(*(F.col(f"_u{k}") for k in tops)))
        return out.select(*f.cells.columns, f"{tag}_unit"), F.lit(True), F.col(f"{tag}_unit") * F.col(area)

    return Foldwise(lambda train, test: modeling.predict_backoff(test, modeling.fit_backoff(train, groups, price, area), groups, area), tuple(groups), learn)


def estimator(features: Pipeline, regressor: object, label: str) -> Model:
    """Features and a Spark ML regressor of the label's logarithm, both fitted on the training rows."""

    def model(train: DataFrame, test: DataFrame) -> DataFrame:
        fitted = Pipeline(stages=[features, regressor]).fit(train.withColumn("log_label", F.log(label)))
        scored = fitted.transform(test).withColumn("prediction", F.exp("log_prediction"))
        return scored.select(*test.columns, "prediction")

    return model


def linear(numeric: Sequence[str], categorical: Sequence[str], regressor: LinearRegression, label: str) -> Model:
    """The estimator of a linear regressor over the plain features. All folds learn from the moments of the rows by category: a linear fit
    by squared error takes no more from its rows than counts, means and covariances."""
    features, names = modeling.feature_pipeline(numeric, categorical), [*numeric, "log_label"]

    def learn(f: Folds, tag: str) -> tuple[DataFrame, Column, Column]:
        points = cut(_points(f.rows, numeric, categorical, label).coalesce(1))
        reach = points.agg(*(F.max(F.abs(c)).alias(c) for c in numeric)).first()
        steps = [[0.0] * len(numeric), *([reach[c] or 1.0 if c == x else 0.0 for x in numeric] for c in numeric)]  # a row for the start, one for each number
        grid = F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), *(F.lit(v).alias(c) for c, v in zip(numeric, step, strict=True))) for i, step in enumerate(steps))))
        own, scores = cut(f.cells.select(f.fold, *categorical).distinct().select("*", grid.alias("_x")).select(f.fold, *categorical, "_x.*")), None
        for k in range(f.folds):
            fitted = Pipeline(stages=[features, regressor.copy({regressor.weightCol: "weight"})]).fit(points.filter(F.getbit("_bits", F.lit(k)) == 1))
            found = fitted.transform(own.filter(F.col(f.fold) == k)).select(f.fold, *categorical, "_i", "log_prediction")
            scores = found if scores is None else scores.unionByName(found)
        start = F.max(F.when(F.col("_i") == 0, F.col("log_prediction")))
        slopes = [((F.max(F.when(F.col("_i") == i, F.col("log_prediction"))) - start) / steps[i][i - 1]).alias(f"{tag}_{c}") for i, c in enumerate(numeric, 1)]
        by = [f.fold, *categorical]
        lines = cut(scores.groupBy(*(F.col(c).alias(f"_of_{c}") for c in by)).agg(start.alias(f"{tag}_start"), *slopes))
        out = f.cells.join(lines, same([(F.col(c), F.col(f"_of_{c}")) for c in by])).drop(*(f"_of_{c}" for c in by))
        total = F.col(f"{tag}_start")
        for c in numeric:
            total = total + F.col(f"{tag}_{c}") * F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
        return out, F.lit(True), F.exp(total)

    def _points(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str) -> DataFrame:
        """(_bits, categorical, numeric, log_label, weight): for rows of equal bits and categories few points of equal count, means and
        covariances. A null label stays one, for the regressor to refuse."""
        known = rows.select("_bits", *categorical, *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in numeric), F.log(label).alias("log_label"))
        pairs = [F.covar_pop(a, b) for a in names for b in names]
        sums = known.groupBy("_bits", *categorical).agg(F.count("*").alias("_n"), F.count("log_label").alias("_known"), F.array(*(F.avg(c) for c in names)).alias("_mean"), F.array(*pairs).alias("_cov"))
        ends = sums.mapInPandas(_spread_out(len(names)), f"{sums.select('_bits', *categorical).schema.simpleString()[7:-1]}, _at array<double>, weight double")
        return ends.select("_bits", *categorical, *(F.col("_at")[i].alias(c) for i, c in enumerate(names)), "weight")

    return Foldwise(estimator(features, regressor, label), tuple(categorical), learn)


def _spread_out(d: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each row's count, means and covariances 2 d points around the means, along the covariances' axes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keep, out = p.drop(columns=["_n", "_known", "_mean", "_cov"]), []
            for n, known, mean, cov in zip(p["_n"], p["_known"], p["_mean"], p["_cov"], strict=True):
                if known < n:
                    out.append([([*mean[:-1], None], float(n))])
                    continue
                cov = np.array(cov, float).reshape(d, d)
                size, axes = np.linalg.eigh(cov) if np.isfinite(cov).all() else (np.full(d, np.nan), np.eye(d))
                way = axes * np.sqrt(np.maximum(size, 0) * d)
                out.append([(list(np.array(mean, float) + sign * way[:, i]), n / (2 * d)) for i in range(d) for sign in (-1, 1)])
            keep = keep.assign(_one=pd.Series(out, index=p.index, dtype=object)).explode("_one", ignore_index=True)
            yield keep.assign(_at=keep["_one"].map(lambda o: o[0]), weight=keep["_one"].map(lambda o: o[1])).drop(columns="_one")

    return run


def fenced(model: Model, group: str, value: Column) -> Model:
    """The model inside Tukey fences that are learnt on the training rows and applied to both sides."""

    def inside(train: DataFrame, test: DataFrame) -> DataFrame:
        fences = cut(cleaning.fit_fences(train, group, value))
        return model(cleaning.within_fences(train, fences, group, value), cleaning.within_fences(test, fences, group, value))

    def learn(f: Folds, tag: str) -> tuple[DataFrame, Column, Column]:
        own, every = quantiles_of_sets(f.rows, [[group], []], value, [0.25, 0.75], bucket_ends(f.some, value), F.col("_bits"), f.folds)
        low, high = cleaning.tukey(F.col("q0"), F.col("q1"))
        own = own.filter(F.col("n") >= cleaning.IQR_MIN_ROWS).select(F.col("set").alias("_set"), F.col(group).alias("_grp"), low.alias("_lo"), high.alias("_hi"))
        every = every.select(F.col("set").alias("_all"), low.alias("_all_lo"), high.alias("_all_hi"))
        sets = f.rows.sparkSession.range(f.folds).select(F.col("id").cast("int").alias("_k")).join(every, F.col("_k") == F.col("_all"), "left")
        groups = f.cells.select(group).unionByName(f.rows.select(group)).distinct()
        fences = groups.join(sets).join(own, (F.col(group) == F.col("_grp")) & (F.col("_k") == F.col("_set")), "left")
        fences = cut(fences.select(F.col(group).alias("_of"), "_k", F.coalesce("_lo", "_all_lo").alias(f"{tag}_lo"), F.coalesce("_hi", "_all_hi").alias(f"{tag}_hi")))
        ends = [F.max(F.when(F.col("_k") == k, F.col(f"{tag}_{end}"))).alias(f"_{end}{k}") for k in range(f.folds) for end in ("lo", "hi")]
        wide = cut(fences.groupBy("_of").agg(*ends))

        def within(table: DataFrame) -> DataFrame:
            bits = F.lit(0)
            for k in range(f.folds):
                bits = bits + F.when((F.getbit("_bits", F.lit(k)) == 1) & F.col("_fenced").between(F.col(f"_lo{k}"), F.col(f"_hi{k}")), 1 << k).otherwise(0)
            return table.withColumn("_fenced", value).join(wide, same([(F.col(group), F.col("_of"))])).withColumn("_bits", bits).select(*table.columns)

        cells, asked, prediction = model.learn(Folds(within(f.rows), within(f.some), f.cells, f.fold, f.folds), tag)
        cells = cells.join(fences, same([(F.col(group), F.col("_of"))]) & (F.col(f.fold) == F.col("_k"))).drop("_of", "_k")
        return cells, asked & F.coalesce(value.between(F.col(f"{tag}_lo"), F.col(f"{tag}_hi")), F.lit(False)), prediction

    return Foldwise(inside, tuple(dict.fromkeys([group, *model.by])), learn) if isinstance(model, Foldwise) else inside


def errors(parts: Mapping[object, DataFrame], label: str, name: str, scale: float = 1.0) -> DataFrame:
    """A row of metrics for each named table of predictions."""
    out = None
    for key, df in parts.items():
        own = df.select(F.lit(key).alias(name), F.col(label).alias("true"), F.col("prediction").alias("predicted"))
        out = own if out is None else out.unionByName(own)
    return modeling.measure(cut(out), "true", "predicted", scale, [name])


def cross_validate(model: Model, rows: DataFrame, label: str, fold: str = "fold", folds: int = modeling.FOLDS) -> DataFrame:
    """Metrics by fold; each fold is predicted from the others. Rows without a fold are in no part."""
    parts = {k: model(rows.filter((F.col(fold) != k)), rows.filter(F.col(fold) == k)) for k in range(folds)}
    return errors(parts, label, "fold")


def spread(by_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of the metrics over folds."""
    both = [x for m in METRICS for x in (F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_std"))]
    return by_fold.groupBy(*by).agg(F.count("*").alias("folds"), *both)


def search(make: Callable[..., Model], grid: Mapping[str, Sequence], rows: DataFrame, label: str, budget: int, fold: str = "fold", folds: int = 3, seed: int = modeling.SEED) -> tuple[dict, list[dict]]:
    """The point of the grid with the least mean MAE over folds, and all points tried: at most ``budget``, drawn without replacement."""
    points = [dict(zip(grid, p, strict=True)) for p in product(*grid.values())]
    tried = []
    for p in Random(seed).sample(points, min(budget, len(points))):
        tried.append({**p, "mae": spread(cross_validate(make(**p), rows, label, fold, folds)).first()["mae"]})
    best = min(tried, key=lambda t: float("inf") if t["mae"] is None else t["mae"])
    return {k: best[k] for k in grid}, tried


def _foldwise(models: Mapping[str, Foldwise], rows: DataFrame, label: str, fold: str, folds: int) -> DataFrame:
    """(model, fold, metrics): what ``cross_validate`` finds of each model, whose folds learn at once. Every row meets the few numbers of
    its cell, and all errors are measured together."""
    bits = F.lit(0)
    for k in range(folds):
        bits = bits + F.when(F.col(fold) != k, 1 << k).otherwise(0)
    share, by = min(1.0, SETTLING / max(rows.count(), 1)), list(dict.fromkeys(c for m in models.values() for c in m.by))
    asked = rows.filter(F.col(fold).isin(list(range(folds))))
    known = rows.filter(F.col(fold).isNotNull()).withColumn("_bits", bits)
    f = Folds(known, cut(known.sample(share, modeling.SEED)), cut(asked.select(fold, *by).distinct()), fold, folds)
    learnt, said = f.cells, []
    for i, (name, model) in enumerate(models.items()):
        own, inside, prediction = model.learn(f, f"_m{i}")
        new = [c for c in own.columns if c not in f.cells.columns]
        own = cut(own).select(*(F.col(c).alias(f"_of_{c}") for c in f.cells.columns), *new)
        learnt = learnt.join(own, same([(F.col(c), F.col(f"_of_{c}")) for c in f.cells.columns])).select(*learnt.columns, *new)
        said.append(F.when(inside, F.struct(F.lit(name).alias("model"), prediction.alias("predicted"))))
    learnt = cut(learnt)
    learnt = learnt.select(*(F.col(c).alias(f"_of_{c}") for c in f.cells.columns), *(c for c in learnt.columns if c not in f.cells.columns))

    def predicted(table: DataFrame) -> DataFrame:
        joined = table.join(learnt, same([(F.col(c), F.col(f"_of_{c}")) for c in f.cells.columns]))
        long = joined.select(fold, F.col(label).alias("true"), F.explode(F.array(*said)).alias("_p")).filter("_p IS NOT NULL")
        return long.select("_p.model", F.col(fold).alias("fold"), "true", "_p.predicted")

    def middle(table: DataFrame, groups: Sequence[str], value: Column, shares: Sequence[float]) -> DataFrame:
        return quantiles_of_sets(table, [groups], value, shares, ends)[0]

    error = F.when(F.col("true") > 0, F.abs(F.col("predicted") - F.col("true")) / F.col("true"))
    ends = bucket_ends(predicted(f.some.filter(F.col(fold).isin(list(range(folds))))), error)
    return cut(modeling.measure(predicted(asked), "true", "predicted", 1.0, ["model", "fold"], middle))


def catalogue(models: Mapping[str, Model], rows: DataFrame, label: str, fold: str = "fold", folds: int = modeling.FOLDS) -> DataFrame:
    """Mean and deviation of the metrics for each model (or configuration, for an ablation) on the same folds."""
    rows, out = cut(rows), None  # read by every fit
    together = {name: model for name, model in models.items() if isinstance(model, Foldwise)}
    by_fold = _foldwise(together, rows, label, fold, folds) if together else None
    for name, model in models.items():
        found = by_fold.filter(F.col("model") == name) if name in together else cross_validate(model, rows, label, fold, folds)
        own = spread(found).withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def leave_one_out(model: Model, rows: DataFrame, key: str, label: str, top: int = 5, min_test: int = 20, min_train: int = 200) -> DataFrame:
    """Metrics for each of the ``top`` most frequent keys, predicted from all other rows; keys with too few rows on a side are left out."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(top).collect()
    total = rows.count()
    kept = [r[key] for r in counts if r["n"] >= min_test and total - r["n"] >= min_train]
    if not kept:
        return errors({None: rows.limit(0).withColumn("prediction", F.lit(None).cast("double"))}, label, key)
    return errors({k: model(rows.filter(~F.col(key).eqNullSafe(k)), rows.filter(F.col(key) == k)) for k in kept}, label, key)


def learning_curve(model: Model, train: DataFrame, test: DataFrame, id_: str, label: str, fractions: Sequence[float] = FRACTIONS, seed: int = modeling.SEED) -> DataFrame:
    """Metrics of one test set by the share of training rows; shares are nested, by a hash of the id. Column change is the step
    of the MdAPE to the share before."""
    at = modeling.hash_part(modeling.seeded(F.col(id_), seed)).cast("double") / 2.0**60
    found = errors({f: model(train.filter(at < f), test) for f in fractions}, label, "fraction")
    return found.withColumn("change", F.col("mdape") - F.lag("mdape").over(Window.orderBy("fraction")))  # one row per share


def _dealt(df: DataFrame, columns: Sequence[str], id_: str, seed: int) -> DataFrame:
    """(_at, columns): values in a hash order of the ids."""
    order = [F.md5(modeling.seeded(F.col(id_), seed)).asc(), F.col(id_).asc()]
    return placed(df.select(F.col(id_), *(F.col(c).alias(f"_new_{c}") for c in columns if c != id_)), [], order, "_at", "_all").drop(id_, "_all")


def shuffled(df: DataFrame, column: str, id_: str, seed: int) -> DataFrame:
    """The table with one column dealt anew: the row at a place in the ids' order takes the value of the row at that place in a hash
    order. Both places come from range partitionings, so rows never meet in one task."""
    rows = placed(df, [], [F.col(id_).asc()], "_place", "_all")
    joined = rows.join(_dealt(df, [column], id_, seed), F.col("_place") == F.col("_at"))
    return joined.withColumn(column, F.col(f"_new_{column}")).select(*df.columns)


def permutation_importance(predict: Callable[[DataFrame], DataFrame], test: DataFrame, columns: Sequence[str], id_: str, label: str, repeats: int = 5, seed: int = modeling.SEED) -> DataFrame:
    """How much the MdAPE of a fitted model rises when a column is dealt anew: mean and deviation over the repeats, largest first. Rows
    are placed once, and once for each repeat in a hash order that all columns share."""
    plain = errors({"": predict(test)}, label, "column").select(F.col("mdape").alias("plain"))
    rows, out = cut(placed(test, [], [F.col(id_).asc()], "_place", "_all")), None
    for k in range(repeats):
        both = cut(rows.join(_dealt(test, columns, id_, seed + k), F.col("_place") == F.col("_at")))
        for c in columns:
            own = errors({c: predict(both.withColumn(c, F.col(f"_new_{c}")).select(*test.columns))}, label, "column").select("column", "mdape")
            out = own if out is None else out.unionByName(own)
    rise = out.join(F.broadcast(plain)).withColumn("rise", F.col("mdape") - F.col("plain"))  # one row
    return rise.groupBy("column").agg(F.avg("rise").alias("importance"), F.stddev_samp("rise").alias("std")).orderBy(F.desc("importance"), "column")
