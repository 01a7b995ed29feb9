"""Mapping by majority, back-off medians, splits, metrics, features and Spark ML models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer, CountVectorizer, IDF, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions.text import UNKNOWN
from terravane.operators.shared import cut, placed, quantiles

WEAK_SHARE, FOLDS, TEST_SHARE, SEED = 0.60, 5, 0.20, 42
#: Columns that hold the label.
LABEL_COLUMNS = ("total_price_vnd", "price_per_m2", "price_kind", "price_mismatch")


def majority_mapping(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """For each key the most frequent targets (ties by name), support (all rows), majority_share (3 digits) and alternatives by rank."""
    counts = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in (key, *targets))).groupBy(key, *targets).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), *targets)
    ranked = counts.withColumns({"place": F.row_number().over(order), "total": F.sum("n").over(Window.partitionBy(key))})
    rest = F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", *targets, "n"))))
    return ranked.groupBy(key).agg(
        *(F.max(F.when(F.col("place") == 1, F.col(t))).alias(t) for t in targets),
        F.max("total").alias("support"),
        F.round(F.max("n") / F.max("total"), 3).alias("majority_share"),
        rest.alias("alternatives"),
    )


def resolve_wards(df: DataFrame, mapping: DataFrame, old: str, new: str, district: str, weak: float = WEAK_SHARE) -> DataFrame:
    """Columns ward, district_resolved, ward_frame: a known old ward; else the mapped one (weak below the share), where the own
    district goes before the mapped one; else unknown."""
    m = mapping.select(F.col("new_ward").alias("m_new"), F.col("old_ward").alias("m_old"), F.col("old_district").alias("m_district"), F.col("majority_share").alias("m_share"))
    joined = df.join(m, F.col(new) == F.col("m_new"), "left")
    known = F.coalesce(F.col(old), F.lit(UNKNOWN)) != UNKNOWN
    own = F.when(F.coalesce(F.col(district), F.lit(UNKNOWN)) != UNKNOWN, F.col(district))
    frame = F.when(known, "old").when(F.col("m_old").isNotNull(), F.when(F.col("m_share") < weak, "mapped_weak").otherwise("mapped")).otherwise("unmapped")
    out = joined.withColumns(
        {
            "ward": F.when(known, F.col(old)).otherwise(F.coalesce("m_old", F.lit(UNKNOWN))),
            "district_resolved": F.when(known, F.coalesce(own, F.lit(UNKNOWN))).otherwise(F.coalesce(own, F.col("m_district"), F.lit(UNKNOWN))),
            "ward_frame": frame,
        }
    )
    return out.drop("m_new", "m_old", "m_district", "m_share")


def fit_backoff(train: DataFrame, groups: Sequence[str], price: str, area: str) -> list[DataFrame]:
    """Medians of the unit price by all groups, then by fewer and fewer, then of all rows (u<k> with k groups)."""
    rows, levels = cut(train.select(*groups, (F.col(price) / F.col(area)).alias("_unit"))), []
    for k in range(len(groups), -1, -1):
        found = quantiles(rows, groups[:k], F.col("_unit"), [0.5])
        levels.append(found.select(*(F.col(g).alias(f"l{k}_{g}") for g in groups[:k]), F.col("q0").alias(f"u{k}")))
    return levels


def predict_backoff(df: DataFrame, levels: list[DataFrame], groups: Sequence[str], area: str) -> DataFrame:
    """Column prediction: the narrowest known median times the area. Levels join on their groups (Spark broadcasts small ones)."""
    out, top = df, len(groups)
    for k, level in zip(range(top, -1, -1), levels, strict=True):
        out = out.join(level, [F.col(g) == F.col(f"l{k}_{g}") for g in groups[:k]], "left") if k else out.join(F.broadcast(level))  # one row
    return out.withColumn("prediction", F.coalesce(*(F.col(f"u{k}") for k in range(top, -1, -1))) * F.col(area)).select(*df.columns, "prediction")


def measure(df: DataFrame, true: str, predicted: str, scale: float = 1e9, by: Sequence[str] = (), find: Callable[..., DataFrame] = quantiles) -> DataFrame:
    """By group, or of all rows: n, n_non_finite, rmse, mae (both over ``scale``), mdape (percent, true above 0) and r2 over finite pairs.
    ``find`` finds exact quantiles, as ``quantiles`` does."""
    t, p = F.col(true).cast("double"), F.col(predicted).cast("double")
    ok = t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p) & (F.abs(t) < float("inf")) & (F.abs(p) < float("inf"))
    rows = df.select(*by, F.when(ok, t).alias("_t"), F.when(ok, p - t).alias("_e"))
    n = F.count("_e")
    sums = rows.groupBy(*by).agg(
        n.alias("n"),
        (F.count("*") - n).alias("n_non_finite"),
        (F.sqrt(F.avg(F.col("_e") * F.col("_e"))) / scale).alias("rmse"),
        (F.avg(F.abs("_e")) / scale).alias("mae"),
        F.when(n > 1, 1 - F.try_divide(F.sum(F.col("_e") * F.col("_e")), F.var_pop("_t") * n)).alias("r2"),
    )
    middle = find(rows, by, F.when(F.col("_t") > 0, F.abs("_e") / F.col("_t")), [0.5]).select(*(F.col(g).alias(f"{g}_of") for g in by), (F.col("q0") * 100).alias("mdape"))
    joined = sums.join(middle, [F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in by], "left") if by else sums.join(F.broadcast(middle))  # one row
    return joined.select(*by, "n", "n_non_finite", "rmse", "mae", "mdape", "r2")


def price_bin(price: Column, edges: Sequence[float] = (0, 2e9, 5e9, 1e10)) -> Column:
    """Index of the bin (a, b]; the last has no end; null at or below the first edge."""
    out = F.when(price <= edges[0], None)
    for i, high in enumerate(edges[1:]):
        out = out.when(price <= high, F.lit(i))
    return out.when(price.isNotNull(), F.lit(len(edges) - 1))


def with_strata(df: DataFrame, place: str, price: str, min_rows: int = 10) -> DataFrame:
    """Column stratum: place and price quartile (a, b]; strata below ``min_rows`` are pooled."""
    rows = df.join(F.broadcast(quantiles(df, [], F.col(price), [0.25, 0.5, 0.75])))  # one row
    q = F.when(F.col(price) <= F.col("q0"), 0).when(F.col(price) <= F.col("q1"), 1).when(F.col(price) <= F.col("q2"), 2).otherwise(3)
    rows = rows.withColumn("own", F.concat_ws("|", F.col(place), q.cast("string"))).drop("q0", "q1", "q2")
    sizes = rows.groupBy("own").agg(F.count("*").alias("own_rows"))
    return rows.join(sizes, "own").withColumn("stratum", F.when(F.col("own_rows") >= min_rows, F.col("own")).otherwise("other")).drop("own", "own_rows")


def split_groups(df: DataFrame, group: str, id_: str, folds: int = FOLDS, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """(group, stratum, role, fold): groups are ranked by md5 in the stratum of their first row; the first fifth is the test set, the
    rest is dealt to folds. A group never straddles."""
    first = df.groupBy(F.col(group).alias("grp")).agg(F.min_by("stratum", id_).alias("stratum"))
    ranked = placed(first, ["stratum"], [F.md5(seeded(F.col("grp"), seed)), F.col("grp").asc()], "place", "groups")
    tests = F.bround(F.col("groups") * test_share, 0)
    test = F.col("place") <= tests
    return ranked.select("grp", "stratum", F.when(test, "test").otherwise("train").alias("role"), F.when(~test, F.pmod((F.col("place") - tests - 1).cast("int"), F.lit(folds))).alias("fold"))


def capped_sample(df: DataFrame, place: str, id_: str, max_rows: int, seed: int = SEED) -> DataFrame:
    """About ``max_rows`` rows, in proportion to each place and at least one of it, by md5 order."""
    order = [F.md5(seeded(F.col(id_), seed)), F.col(id_).asc()]
    every = df.agg(F.count("*").alias("_all"))
    ranked = placed(df, [place], order, "_place", "_rows").join(F.broadcast(every))  # one row
    take = F.greatest(F.lit(1), F.bround(F.col("_rows") * max_rows / F.col("_all"), 0))
    return ranked.filter((F.col("_all") <= max_rows) | (F.col("_place") <= take)).select(*df.columns)


def seeded(id_: Column, seed: int) -> Column:
    """The text whose md5 orders or draws rows at random."""
    return F.concat(F.lit(f"{seed}|"), id_.cast("string"))


def hash_part(c: Column, part: int = 0) -> Column:
    """60 bits of the md5 of a value as text, a decimal number; ``part`` 0 or 1."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1 + 15 * part, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, id_: str) -> DataFrame:
    """Sixteen hex digits that depend on the ids alone, not on their order: sums of hashes, which tasks add up, and the count."""
    sums = df.agg(*(F.coalesce(F.sum(hash_part(F.col(id_), k)), F.lit(0)).cast("string").alias(f"s{k}") for k in (0, 1)), F.count(id_).cast("string").alias("n"))
    return sums.select(F.substring(F.sha2(F.concat_ws("|", "s0", "s1", "n"), 256), 1, 16).alias("fingerprint"))


def assert_no_leakage(df: DataFrame, banned: Sequence[str] = LABEL_COLUMNS) -> DataFrame:
    found = sorted(set(df.columns) & set(banned))
    if found:
        raise ValueError(f"label columns among features: {found}")
    return df


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], flags: Sequence[str] = (), tokens: str | None = None, vocabulary: int = 8000, min_df: float = 5.0) -> Pipeline:
    """Scaled numbers, one-hot categories (unseen levels in a bucket of their own), flags as they are, TF-IDF of tokens."""
    stages: list = [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep")] if categorical else []
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep"))
    stages += [VectorAssembler(inputCols=list(numeric), outputCol="numbers", handleInvalid="keep"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    parts = ["scaled", *(f"{c}_hot" for c in categorical), *flags]
    if tokens:
        stages += [CountVectorizer(inputCol=tokens, outputCol="tf", vocabSize=vocabulary, minDF=min_df), IDF(inputCol="tf", outputCol="tfidf")]
        parts.append("tfidf")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def registry(fast: bool = False) -> dict[str, object]:
    """Estimators of the label's logarithm by name. Boosters other than Spark's and a neural regressor are not part of Spark."""
    common = {"featuresCol": "features", "labelCol": "log_label", "predictionCol": "log_prediction"}
    models = {
        "ols": LinearRegression(regParam=0.0, solver="normal", **common),
        "ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0, **common),
        "lasso": LinearRegression(regParam=0.001, elasticNetParam=1.0, **common),
        "tree": DecisionTreeRegressor(maxDepth=8, seed=SEED, **common),
    }
    if not fast:
        models |= {"forest": RandomForestRegressor(numTrees=30, maxDepth=8, seed=SEED, **common), "boosting": GBTRegressor(maxIter=20, maxDepth=5, seed=SEED, **common)}
    return models


def evaluate(model: object, train: DataFrame, test: DataFrame, label: str, name: str) -> DataFrame:
    """Fit on the logarithm of the label; errors of the test rows on its own scale."""
    return evaluate_all({name: model}, train, test, label)


def moments(train: DataFrame, label: str) -> DataFrame:
    """(features, log_label, weight): two rows for all rows of equal features, a deviation of the label below and above its mean. They
    keep the number of rows and the sums of the label and of its square, all that fits by squared error take from rows."""
    rows = train.select(vector_to_array("features").alias("x"), F.log(label).alias("y"))
    known = F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.count("y").alias("known")
    sums = rows.groupBy("x").agg(*known)
    ends = F.explode(F.when(F.col("known") < F.col("n"), F.array(F.lit(None).cast("double"))).otherwise(F.array(F.col("mean") - F.col("sd"), F.col("mean") + F.col("sd"))))
    return sums.select(array_to_vector("x").alias("features"), ends.alias("log_label"), (F.col("n") / 2).alias("weight"))


def evaluate_all(models: Mapping[str, object], train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """The same of several models, a row each. Those that draw no rows are fitted on the moments of the training rows; each distinct
    vector of features is scored once, and all errors are measured together."""
    few, every, fitted = cut(moments(train, label)), train.withColumn("log_label", F.log(label)), {}
    for name, model in models.items():
        draws = isinstance(model, RandomForestRegressor) or (isinstance(model, GBTRegressor) and model.getSubsamplingRate() < 1)
        fitted[name] = model.fit(every) if draws else model.copy({model.weightCol: "weight"}).fit(few)
    asked = cut(test.select(vector_to_array("features").alias("x")).distinct()).withColumn("features", array_to_vector("x"))
    scores = None
    for name, model in fitted.items():
        own = model.transform(asked).select("x", F.lit(name).alias("model"), F.exp("log_prediction").alias("predicted"))
        scores = own if scores is None else scores.unionByName(own)
    rows = test.select(vector_to_array("features").alias("_x"), F.col(label).alias("true"))
    scored = rows.join(scores, F.col("_x") == F.col("x")).select("model", "true", "predicted")
    found = measure(cut(scored), "true", "predicted", 1.0, ["model"])
    return found.select(*(c for c in found.columns if c != "model"), "model")


def right_closed(splits: Sequence[float], column: str, out: str) -> Bucketizer:
    """Spark's bucketizer is left-closed; negated edges make it right-closed over the negated column."""
    return Bucketizer(splits=sorted(-s for s in splits), inputCol=column, outputCol=out)
