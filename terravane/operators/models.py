"""The catalogue of models: their tiers, search grids and budgets, and those that Spark ML has not: nearest neighbours, a network.

Every entry makes a model (see terravane.operators.experiments) from the values of a point of its grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators import experiments, modeling
from terravane.operators.experiments import Model
from terravane.operators.shared import cut, quantiles

TIERS = ("0 · mốc", "1 · tuyến tính", "2 · chủ lực", "3 · mở rộng")
#: Test rows that the nearest-neighbour model answers at once: they are sent to all tasks.
QUERIES = 20_000


@dataclass(frozen=True)
class ModelSpec:
    name: str
    tier: str
    make: Callable[..., Model]
    grid: Mapping[str, Sequence] = field(default_factory=dict)
    raw: bool = False
    notes: str = ""

    @property
    def grid_size(self) -> int:
        """Points of the grid; 0 without a grid."""
        return prod(map(len, self.grid.values())) if self.grid else 0

    def search_budget(self, requested: int) -> int:
        """Points that a search draws: no more than there are."""
        return min(requested, self.grid_size)


def constant_median(label: str) -> Model:
    """The training rows' median for every row."""
    return lambda train, test: test.join(F.broadcast(quantiles(train, [], F.col(label), [0.5]).withColumnRenamed("q0", "prediction")))  # one row


def _fitted(features: Pipeline, train: DataFrame, test: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Features learnt on the training rows: (x, y = log of the label) of these, and the test rows with x and a number."""
    fitted = features.fit(train)
    rows = fitted.transform(train).select(vector_to_array("features").alias("x"), F.log(label).alias("y")).filter("y IS NOT NULL")
    asked = fitted.transform(test).withColumn("x", vector_to_array("features")).select(*test.columns, "x", F.monotonically_increasing_id().alias("_query"))
    return cut(rows), cut(asked)


def nearest(features: Pipeline, label: str, neighbours: int = 5, weights: str = "uniform") -> Model:
    """The mean logarithm of the label over the nearest training rows (``distance``: weighted by its inverse).

    Test rows go out in blocks of at most QUERIES to all tasks, each of which finds the nearest among its own training
    rows; only ``neighbours`` candidates per test row and task meet. So training rows never move.
    """

    def model(train: DataFrame, test: DataFrame) -> DataFrame:
        rows, asked = _fitted(features, train, test, label)
        places = asked.select("_query", "x")
        bounds = [r["_query"] for r in places.select("_query").orderBy("_query").toLocalIterator()][::QUERIES] + [1 << 62]
        out = None
        for low, high in zip(bounds, bounds[1:], strict=False):
            block = places.filter(F.col("_query").between(low, high - 1)).toPandas()
            own, q = block["_query"].to_numpy(), np.stack(block["x"].to_numpy())
            squares = (q * q).sum(axis=1)

            def run(parts: Iterator[pd.DataFrame], own=own, q=q, squares=squares) -> Iterator[pd.DataFrame]:
                best_d, best_y = np.full((len(q), neighbours), np.inf), np.zeros((len(q), neighbours))
                for p in parts:
                    a, y = np.stack(p["x"].to_numpy()), p["y"].to_numpy()
                    for at in range(0, len(q), 1024):
                        part = slice(at, at + 1024)
                        d = np.maximum(squares[part, None] - 2 * q[part] @ a.T + (a * a).sum(axis=1)[None, :], 0)
                        d, y2 = np.hstack([best_d[part], d]), np.hstack([best_y[part], np.broadcast_to(y, d.shape)])
                        keep = np.argsort(d, axis=1, kind="stable")[:, :neighbours]
                        best_d[part], best_y[part] = np.take_along_axis(d, keep, 1), np.take_along_axis(y2, keep, 1)
                i, k = np.nonzero(np.isfinite(best_d))
                yield pd.DataFrame({"_of": own[i], "d": best_d[i, k], "y": best_y[i, k]})

            near = rows.mapInPandas(run, "_of long, d double, y double")
            out = near if out is None else out.unionByName(near)
        if out is None:
            return test.withColumn("prediction", F.lit(None).cast("double"))
        nearest_ = F.slice(F.sort_array(F.collect_list(F.struct("d", "y"))), 1, neighbours)  # neighbours of each task
        weight = (lambda x: 1 / F.greatest(F.sqrt(x["d"]), F.lit(1e-9))) if weights == "distance" else (lambda x: F.lit(1.0))
        total = lambda f: F.aggregate("near", F.lit(0.0), lambda a, x: a + f(x))
        means = out.groupBy("_of").agg(nearest_.alias("near")).select("_of", F.exp(total(lambda x: weight(x) * x["y"]) / total(weight)).alias("prediction"))
        return asked.join(means, F.col("_query") == F.col("_of"), "left").select(*test.columns, "prediction")

    return model


def network(features: Pipeline, label: str, hidden: Sequence[int] = (128,), penalty: float = 1e-4, epochs: int = 60, rate: float = 0.01, seed: int = modeling.SEED) -> Model:
    """A network of rectified layers for the logarithm of the label, by full gradients: each task sums the gradient over its rows and
    the driver, which holds the weights alone, takes Adam's step. So an epoch is one pass over the training rows."""

    def forward(w: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        layers = [x]
        for i in range(0, len(w), 2):
            z = layers[-1] @ w[i] + w[i + 1]
            layers.append(np.maximum(z, 0) if i + 2 < len(w) else z)
        return layers

    def gradients(rows: DataFrame, w: list[np.ndarray], centre: float) -> tuple[np.ndarray, int]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, n = [np.zeros_like(x) for x in w], 0
            for p in parts:
                layers = forward(w, np.stack(p["x"].to_numpy()))
                error = layers[-1] - (p["y"].to_numpy()[:, None] - centre)
                n += len(p)
                for i in range(len(w) - 2, -1, -2):
                    below = layers[i // 2]
                    sums[i] += below.T @ error
                    sums[i + 1] += error.sum(axis=0)
                    error = (error @ w[i].T) * (below > 0)
            yield pd.DataFrame({"n": [n], "g": [np.concatenate([s.ravel() for s in sums])]})

        found = rows.mapInPandas(run, "n long, g array<double>").toLocalIterator()  # one row a task, each of the weights' size
        total, count = np.zeros(sum(x.size for x in w)), 0
        for r in found:
            total, count = total + np.array(r["g"]), count + r["n"]
        return total, count

    def model(train: DataFrame, test: DataFrame) -> DataFrame:
        rows, asked = _fitted(features, train, test, label)
        one = rows.agg(F.avg("y").alias("y"), F.max(F.size("x")).alias("width")).first()
        if one["width"] is None:
            return test.withColumn("prediction", F.lit(None).cast("double"))
        rng, sizes, w = np.random.default_rng(seed), [one["width"], *hidden, 1], []
        for a, b in zip(sizes, sizes[1:], strict=False):
            w += [rng.normal(scale=(2 / a) ** 0.5, size=(a, b)), np.zeros(b)]
        m = v = np.zeros(sum(x.size for x in w))
        for step in range(1, epochs + 1):
            g, n = gradients(rows, w, one["y"])
            flat = np.concatenate([x.ravel() for x in w])
            g = g / max(n, 1) + penalty * flat
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            at, new = 0, []
            for x in w:
                new.append(flat[at : at + x.size].reshape(x.shape))
                at += x.size
            w = new

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(np.exp(forward(w, np.stack(x.to_numpy()))[-1][:, 0] + one["y"])) if len(x) else pd.Series([], dtype=float)

        return asked.select(*test.columns, predict("x").alias("prediction"))

    return model


def catalogue(features: Callable[[], Pipeline], groups: Sequence[str], label: str, area: str, fast: bool = False) -> list[ModelSpec]:
    """All models. ``fast`` leaves those for a smoke test, not for a report."""
    common = {"featuresCol": "features", "labelCol": "log_label", "predictionCol": "log_prediction"}
    ml = lambda kind, **fixed: lambda **point: experiments.estimator(features(), kind(**{**common, **fixed, **point}), label)
    powers = lambda low, high, n: [float(x) for x in np.logspace(low, high, n)]
    specs = [
        ModelSpec("Dummy (trung vị)", TIERS[0], lambda: constant_median(label), notes="R² = 0"),
        ModelSpec("Trung vị giá/m² theo nhóm", TIERS[0], lambda: experiments.backoff(groups, label, area), raw=True),
        ModelSpec("Hồi quy tuyến tính", TIERS[1], ml(LinearRegression, solver="normal", regParam=0.0)),
        ModelSpec("Ridge", TIERS[1], ml(LinearRegression, elasticNetParam=0.0), {"regParam": powers(-3, 3, 25)}),
        ModelSpec("Lasso", TIERS[1], ml(LinearRegression, elasticNetParam=1.0, maxIter=200), {"regParam": powers(-4, 1, 25)}),
        ModelSpec(
            "Random Forest",
            TIERS[2],
            ml(RandomForestRegressor, seed=modeling.SEED),
            {"numTrees": [20, 50, 100], "maxDepth": [8, 12, 15], "minInstancesPerNode": [1, 2, 4, 8], "featureSubsetStrategy": ["sqrt", "0.3", "0.5"]},
        ),
        ModelSpec(
            "Gradient boosting",
            TIERS[2],
            ml(GBTRegressor, seed=modeling.SEED),
            {"maxIter": [20, 50, 100], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [4, 6, 8], "subsamplingRate": [0.7, 0.85, 1.0]},
        ),
        ModelSpec("K láng giềng", TIERS[3], lambda **p: nearest(features(), label, **p), {"neighbours": [3, 5, 8, 12, 20], "weights": ["uniform", "distance"]}),
        ModelSpec("Cây quyết định", TIERS[3], ml(DecisionTreeRegressor, seed=modeling.SEED), {"maxDepth": [4, 6, 8, 12, 15], "minInstancesPerNode": [1, 5, 20, 50]}),
        ModelSpec("MLP", TIERS[3], lambda **p: network(features(), label, **p), {"hidden": [(128,), (256, 64), (128, 64, 32)], "penalty": [1e-4, 1e-3, 1e-2]}),
    ]
    keep = {"Dummy (trung vị)", "Trung vị giá/m² theo nhóm", "Ridge", "Random Forest", "Gradient boosting"}
    return [s for s in specs if not fast or s.name in keep]
