"""Truncated singular value decomposition of sparse feature vectors (TF-IDF), as a Spark ML estimator.

Subspace iteration: the driver holds a matrix of as many rows as there are features and as many columns as components are asked
for; each step multiplies it by the Gram matrix of the rows, which tasks do for their own rows, and sums come back by feature. So
the work of a step is linear in the rows' non-zeros and nothing at the driver grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components asked for; steps; extra columns that are iterated and then dropped.
COMPONENTS, STEPS, EXTRA = 120, 6, 10


def feasible(components: int, features: int) -> int:
    """Fewer components where there are too few features for the number asked for."""
    return max(1, min(components, features - 1))


def _gram_times(rows: DataFrame, column: str, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis, for the matrix A whose rows are the column's vectors (arrays of doubles)."""
    width = basis.shape[1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(basis)
        for p in parts:
            a = np.stack(p[column].to_numpy()) if len(p) else np.zeros((0, len(basis)))
            total += a.T @ (a @ basis)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"feature": used, "sums": pd.Series(list(total[used]), dtype=object)})

    sums = rows.select(column).mapInPandas(run, "feature long, sums array<double>")
    added = sums.groupBy("feature").agg(F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums"))
    out = np.zeros_like(basis)
    for r in added.toLocalIterator():
        out[r["feature"]] = r["sums"]
    return out


def components_of(df: DataFrame, column: str, components: int = COMPONENTS, seed: int = 42) -> np.ndarray:
    """Right singular vectors (features x components) of the largest singular values, each with a positive largest entry."""
    rows = df.select(vector_to_array(column).alias("x")).persist()
    try:
        first = rows.first()
        if first is None:
            return np.zeros((1, 1))
        features = len(first["x"])
        k = feasible(components, features)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, min(k + EXTRA, features))))[0]
        for _ in range(STEPS):
            basis = np.linalg.qr(_gram_times(rows, "x", basis))[0]
        small = basis.T @ _gram_times(rows, "x", basis)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        out = basis @ vectors[:, np.argsort(-values)[:k]]
        return out * np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    finally:
        rows.unpersist()


class _Params(HasInputCol, HasOutputCol):
    components = Param(Params._dummy(), "components", "singular vectors", typeConverter=TypeConverters.toInt)


class TruncatedSVD(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol: str = "tfidf", outputCol: str = "svd", components: int = COMPONENTS) -> None:
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="tfidf", outputCol="svd", components=COMPONENTS)

    def _fit(self, dataset: DataFrame) -> TruncatedSVDModel:
        found = components_of(dataset, self.getInputCol(), self.getOrDefault("components"))
        return TruncatedSVDModel(found)._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class TruncatedSVDModel(Model, _Params):
    def __init__(self, basis: np.ndarray) -> None:
        super().__init__()
        self.basis = basis

    def _transform(self, dataset: DataFrame) -> DataFrame:
        basis = self.basis

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(x.to_numpy()) @ basis) if len(x) else [], dtype=object)

        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))
