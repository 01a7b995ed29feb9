"""Experiment operators on a small table with known errors."""

import pytest
from pyspark.sql import functions as F

from terravane.operators import experiments as e
from terravane.operators import modeling, shared
from terravane.plans import queries


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "ab"[i % 2] if i % 7 else None, float(10 + i % 5), (2.0 if i % 2 else 3.0) * (10 + i % 5), i % 3) for i in range(300)]
    return spark.createDataFrame(data, "id int, place string, area double, price double, fold int")


def mean(spark_rows, column):
    return {r[0]: r[column] for r in spark_rows.collect()}


def test_folds_are_predicted_from_the_others(rows):
    got = e.cross_validate(e.backoff(["place"], "price", "area"), rows.filter("place IS NOT NULL"), "price", folds=3).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2] and all(r["mae"] == 0 and r["r2"] == 1 for r in got)
    assert sum(r["n"] for r in got) == rows.filter("place IS NOT NULL").count()


def test_search_finds_the_groups_that_fit(rows):
    make = lambda groups: e.backoff(list(groups), "price", "area")
    best, tried = e.search(make, {"groups": [(), ("place",)]}, rows.filter("place IS NOT NULL"), "price", 10)
    assert best == {"groups": ("place",)} and len(tried) == 2


def test_leave_one_out_needs_rows_on_both_sides(rows):
    model = e.backoff([], "price", "area")
    assert sorted(r["place"] for r in e.leave_one_out(model, rows, "place", "price", min_test=20, min_train=100).collect()) == ["a", "b"]
    assert e.leave_one_out(model, rows, "place", "price", min_test=1000).count() == 0


def test_learning_curve_has_nested_shares(rows):
    got = e.learning_curve(e.backoff(["place"], "price", "area"), rows.filter("fold > 0"), rows.filter("fold = 0"), "id", "price", (0.3, 1.0)).orderBy("fraction").collect()
    assert [r["fraction"] for r in got] == [0.3, 1.0] and got[0]["n"] == got[1]["n"] == 100 and got[0]["change"] is None


def test_shuffled_column_keeps_its_values_and_matters(rows):
    out = e.shuffled(rows, "area", "id", 1)
    key = lambda d, c: sorted((r[c] for r in d.collect()), key=repr)
    assert out.columns == rows.columns and key(out, "area") == key(rows, "area") and key(out, "id") == key(rows, "id")
    assert out.join(rows.withColumnRenamed("area", "was").select("id", "was"), "id").filter(F.col("area") != F.col("was")).count() > 100
    placed = rows.filter("place IS NOT NULL")
    model = lambda t: e.backoff(["place"], "price", "area")(placed.filter("fold > 0"), t)
    got = e.permutation_importance(model, placed.filter("fold = 0"), ["area", "fold"], "id", "price", repeats=2).collect()
    assert [r["column"] for r in got] == ["area", "fold"] and got[0]["importance"] > 1 and got[1]["importance"] == 0


def test_fences_are_learnt_on_training_rows(rows):
    train = rows.filter("fold > 0")
    test = rows.filter("fold = 0").withColumn("price", F.when(F.col("id") == 0, 1e9).otherwise(F.col("price")))
    out = e.fenced(e.backoff([], "price", "area"), "place", F.log(F.col("price") / F.col("area")))(train, test)
    assert out.filter("price = 1e9").count() == 0 and out.count() >= 90


def test_all_models_are_compared(spark):
    got = queries.QUERIES["model_errors"](spark, "/root/testdata/sf0.001").collect()
    assert {r["model"] for r in got} == set(modeling.registry()) and len(got) == 6


def test_importance_rests_on_the_operators_repeats(spark, monkeypatch):
    own, seen = e.permutation_importance, []
    monkeypatch.setattr(e, "permutation_importance", lambda *a, repeats=5, **k: (seen.append(repeats), own(*a, repeats=1, **k))[1])
    queries.QUERIES["permutation_importance"](spark, "/root/testdata/sf0.001")
    assert seen == [5]


def test_moments_of_equal_features_fit_as_their_rows_do(spark):
    rows = spark.createDataFrame([(float(k % 7), "ab"[k % 2], float(1 + (k * 37) % 101), k) for k in range(700)], "a double, c string, price double, k int")
    prep = modeling.feature_pipeline(["a"], ["c"]).fit(rows).transform(rows).select("features", "price")
    few, every = modeling.moments(prep, "price"), prep.withColumn("log_label", F.log("price"))
    assert few.count() == 28 and few.agg(F.sum("weight")).first()[0] == 700
    for name in ("ols", "ridge", "lasso"):
        model = modeling.registry()[name]
        x, y = model.fit(every), model.copy({model.weightCol: "weight"}).fit(few)
        assert all(abs(a - b) < 1e-9 for a, b in zip([*x.coefficients, x.intercept], [*y.coefficients, y.intercept], strict=True))


def test_folds_learn_at_once_what_each_learns_alone(spark, rows, monkeypatch):
    odd = spark.createDataFrame([(900, "c", 9.0, 50.0, 0), (901, "a", 8.0, 9.0, -1), (902, "b", 7.0, 900.0, None), (903, None, 6.0, 70.0, 1)], rows.schema)
    d = rows.withColumn("price", F.col("price") * (1 + F.col("id") * 37 % 101 / 50)).unionByName(odd)
    broker, ridge = e.backoff(["place"], "price", "area"), modeling.registry()["ridge"]
    models = {"linear": e.linear(["area"], ["place"], ridge, "price"), "number": e.linear(["area"], [], ridge, "price"), "broker": broker, "fenced": e.fenced(broker, "place", F.log(F.col("price") / F.col("area")))}
    alone = {r["model"]: r for r in e.catalogue({name: m.model for name, m in models.items()}, d, "price", folds=3).collect()}
    for owner, name in ((modeling, "fit_backoff"), (e.cleaning, "fit_fences"), (e, "cross_validate")):  # fits of one fold
        monkeypatch.setattr(owner, name, lambda *a, name=name, **k: pytest.fail(f"{name} was called"))
    together = e.catalogue(models, d, "price", folds=3).collect()
    assert [r["model"] for r in together] == [*models] and together[0].asDict().keys() == alone["linear"].asDict().keys()
    for r in together:
        assert all(v == (want if c == "model" else pytest.approx(want, rel=1e-9)) for (c, v), want in zip(r.asDict().items(), alone[r["model"]], strict=True))


def test_quantiles_of_sets_are_those_of_each_set(spark):
    data = [("ab"[k % 2] if k % 11 else None, "xyz"[k % 3], None if k % 13 == 0 else float(k * 37 % 101) if k % 5 else float("nan") if k % 25 == 0 else 7.0, k % 8) for k in range(1500)]
    d = spark.createDataFrame(data, "g string, h string, v double, bits int")
    levels, shares = [["g", "h"], ["g"], []], [0.25, 0.5]
    for ends in (shared.bucket_ends(d, F.col("v")), [7.0]):
        for level, found in zip(levels, shared.quantiles_of_sets(d, levels, F.col("v"), shares, ends, F.col("bits"), 2), strict=True):
            for k in range(2):
                want = shared.quantiles(d.filter(F.getbit("bits", F.lit(k)) == 1), level, F.col("v"), shares)
                assert sorted(map(str, found.filter(F.col("set") == k).select(*want.columns).collect())) == sorted(map(str, want.collect()))
