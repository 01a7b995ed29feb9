"""Experiments over prepared listings: tuned models on shared folds, transfer, leave-one-out, ablation, saved results, the champion.

Results are JSON texts in a folder that Spark can write; tables of them are rendered by terravane.plans.tables.
"""

from __future__ import annotations

import ast
import json
import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import money
from terravane.operators import cleaning, experiments, modeling
from terravane.operators.experiments import Model
from terravane.operators.models import TIERS, ModelSpec, catalogue
from terravane.operators.shared import cut, remove
from terravane.operators.svd import TruncatedSVD

#: The columns that a model sees; groups of the broker's baseline; least rows of an experiment.
LABEL, AREA, GROUPS = "total_price_vnd", "area_m2", ("district", "ward", "property_type")
MISSING = ("bedrooms", "bathrooms", "floors", "frontage_m", "alley_width_m")
NUMERIC = ("area_m2", *MISSING, *(f"{c}_missing" for c in MISSING), "description_length", "listing_year", "listing_month", "listing_quarter_index")
CATEGORICAL = ("district", "ward", "property_type", "legal_status", "direction", "position")
LEAST_ROWS, LEAST_TRANSFER, SEARCH, SEARCH_FOLDS, E1_ROWS = 500, 200, 40, 3, 6000
SCALE = 1e9

log = logging.getLogger(__name__)


def load_frame(spark: SparkSession, path: str, sample: int | None = None, id_: str = "listing_id", seed: int = modeling.SEED) -> DataFrame:
    """Prepared listings; ``sample``: that many, those with the least md5 of seed and id."""
    frame = spark.read.parquet(path)
    return frame if sample is None else frame.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string"))), id_).limit(sample)


def feature_frame(df: DataFrame) -> DataFrame:
    """Columns derived without learning: calendar, lengths, flags, tokens; absent ones are null or empty."""
    at, clean = F.col("published_at"), F.coalesce(F.col("description_clean"), F.lit(""))
    out = df.withColumns(
        {
            "listing_year": F.year(at),
            "listing_month": F.month(at),
            "listing_quarter_index": (F.year(at) - 2025) * 4 + F.quarter(at) - 1,
            "description_length": F.length(F.coalesce(F.col("description"), F.lit(""))),
            "words": money.analyzer(F.col("description_tokens")),
        }
    ).withColumns(money.flags(clean))
    return out.withColumns({c: (F.col(c) if c in out.columns else F.lit(None)).cast("double") for c in NUMERIC})


def features(use_text: bool = True, use_flags: bool = True, components: int = 120) -> Pipeline:
    """Numbers, categories and, as asked for, flags and the singular vectors of TF-IDF."""
    own = modeling.feature_pipeline(list(NUMERIC), list(CATEGORICAL), list(money.FLAGS) if use_flags else [], "words" if use_text else None)
    if not use_text:
        return own
    *stages, assembler = own.getStages()
    return Pipeline(stages=[*stages, TruncatedSVD(inputCol="tfidf", outputCol="svd", components=components), assembler.setInputCols([c if c != "tfidf" else "svd" for c in assembler.getInputCols()])])


def imputed(model: Model, columns: Sequence[str] = MISSING, groups: Sequence[str] = ("property_type", "district")) -> Model:
    """The model on rows whose nulls are medians of the training rows' groups, then of all training rows."""

    def inside(train: DataFrame, test: DataFrame) -> DataFrame:
        fitted = tuple(cut(d) for d in cleaning.fit_medians(train, list(columns), list(groups)))
        fill = lambda d: cleaning.impute(d, fitted, list(columns), list(groups))
        return model(fill(train), fill(test))

    return inside


def unit_price() -> Any:
    return F.log(F.col(LABEL) / F.col(AREA))


def build_model(spec: ModelSpec, params: Mapping[str, Any] | None = None) -> Model:
    """A model of the catalogue with the parameters given, imputed and inside fences, all learnt on the training rows."""
    own = spec.make(**{k: coerce(v) for k, v in (params or {}).items()})
    return experiments.fenced(own if spec.raw else imputed(own), "district", unit_price())


def default_specs(fast: bool = False, use_text: bool = True, use_flags: bool = True) -> list[ModelSpec]:
    return catalogue(lambda: features(use_text, use_flags), GROUPS, LABEL, AREA, fast)


@dataclass
class ModelResult:
    name: str
    tier: str
    cv_mean: dict[str, float] = field(default_factory=dict)
    cv_std: dict[str, float] = field(default_factory=dict)
    holdout: dict[str, float] = field(default_factory=dict)
    best_params: dict[str, Any] = field(default_factory=dict)
    fit_seconds: float = 0.0
    notes: str = ""
    search_budget: int = 0


def coerce(value: Any) -> Any:
    """A parameter as it was before it was saved as text."""
    if not isinstance(value, str):
        return value
    try:
        return ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return value


def leakage_checklist(frame: DataFrame) -> dict[str, Any]:
    """Columns, rows and rows with money in their tokens; label columns among the features and money in texts are errors."""
    used = [*NUMERIC, *CATEGORICAL, *money.FLAGS, "words"]
    modeling.assert_no_leakage(frame.select(*used))
    one = frame.agg(F.count("*").alias("rows"), F.count_if(money.money_left(F.array_join("words", " ")) > 0).alias("money")).first()
    if one["money"]:
        raise ValueError(f"{one['money']} rows have money in their tokens")
    return {"columns": len(used), "rows": one["rows"], "rows_with_money": 0}


def metrics_of(predicted: DataFrame) -> dict[str, float]:
    return modeling.measure(predicted, LABEL, "prediction", SCALE).first().asDict()


def with_splits(frame: DataFrame, id_: str = "listing_id", group: str = "duplicate_group") -> DataFrame:
    """Columns role and fold: groups of duplicates never straddle, strata are districts and price quartiles."""
    rows = modeling.with_strata(frame, "district", LABEL)
    split = modeling.split_groups(rows, group, id_).select(F.col("grp").alias("_grp"), "role", "fold")
    return cut(rows.join(split, F.col(group).eqNullSafe(F.col("_grp"))).drop("_grp", "stratum"))


def tuned(spec: ModelSpec, train: DataFrame, budget: int, id_: str = "listing_id") -> dict[str, Any]:
    """The best parameters of the grid by the mean MAE over three folds of the training rows; none without a grid."""
    if not spec.grid or spec.raw:
        return {}
    rows = train.withColumn("_fold", F.pmod(F.xxhash64(F.lit(modeling.SEED), id_), F.lit(SEARCH_FOLDS)))
    return experiments.search(lambda **p: build_model(spec, p), spec.grid, cut(rows), LABEL, spec.search_budget(budget), "_fold", SEARCH_FOLDS)[0]


def evaluate_model(spec: ModelSpec, split: DataFrame, search_iterations: int = SEARCH, params: Mapping[str, Any] | None = None) -> ModelResult:
    """Tune once on the training rows, then measure on their folds and once on the rows held out."""
    began = time.time()
    train, test = split.filter("role = 'train'"), split.filter("role = 'test'")
    best = tuned(spec, train, search_iterations) if params is None else dict(params)
    model = build_model(spec, best)
    own = experiments.spread(experiments.cross_validate(model, train, LABEL)).first().asDict()
    result = ModelResult(
        spec.name,
        spec.tier,
        {m: own[m] for m in experiments.METRICS},
        {m: own[f"{m}_std"] for m in experiments.METRICS},
        metrics_of(model(train, test)),
        {k: str(v) for k, v in best.items()},
        round(time.time() - began, 1),
        spec.notes,
        spec.search_budget(search_iterations),
    )
    log.info("%s: MdAPE %s, %.0f s", spec.name, result.cv_mean["mdape"], result.fit_seconds)
    return result


# --- results ----------------------------------------------------------------------------------------------------------


def save_results(spark: SparkSession, root: str, name: str, payload: Mapping[str, Any]) -> None:
    text = json.dumps(payload, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}")


def read_results(spark: SparkSession, root: str, name: str) -> dict[str, Any] | None:
    """A saved payload; None if there is none."""
    try:
        return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/{name}").collect()))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def results_to_payload(results: Sequence[ModelResult], **extra: Any) -> dict[str, Any]:
    return {"models": [asdict(r) for r in results], **extra}


def best_params(spark: SparkSession, root: str, name: str) -> dict[str, dict]:
    """Parameters of each model in a saved comparison."""
    payload = read_results(spark, root, name)
    return {m["name"]: m.get("best_params") or {} for m in payload["models"]} if payload else {}


def pick_champion(payload: Mapping[str, Any]) -> dict[str, Any]:
    """The model with the least mean MdAPE that is no baseline."""
    return min((m for m in payload["models"] if m["tier"] != TIERS[0]), key=lambda m: m["cv_mean"]["mdape"])


def champion_of(spark: SparkSession, root: str, name: str, specs: Sequence[ModelSpec]) -> tuple[ModelSpec | None, dict]:
    """The champion of a saved comparison and its parameters; without one the forest."""
    payload = read_results(spark, root, name)
    wanted, params = ("Random Forest", {}) if payload is None else (lambda c: (c["name"], c.get("best_params") or {}))(pick_champion(payload))
    return next((s for s in specs if s.name == wanted), None), params


# --- experiments ------------------------------------------------------------------------------------------------------


def run_e1(spark: SparkSession, frame: DataFrame, specs: Sequence[ModelSpec], root: str, sources: Mapping[str, str], iterations: int = SEARCH, max_rows: int | None = E1_ROWS, force: bool = False) -> None:
    """Compare all models on each source alone. A saved comparison with all of the models is not run again unless forced."""
    for source, label in sources.items():
        own = frame.filter(F.col("source") == source)
        own = modeling.capped_sample(own, "district", "listing_id", max_rows) if max_rows else own
        saved = read_results(spark, root, f"e1_{source}")
        if saved and not force and {s.name for s in specs} <= {m["name"] for m in saved["models"]}:
            log.info("e1_%s is there", source)
            continue
        ready = cut(feature_frame(own))
        n = ready.count()
        if n < LEAST_ROWS:
            log.warning("%s has %d rows only", source, n)
            continue
        checklist, split = leakage_checklist(ready), with_splits(ready)
        results = [evaluate_model(s, split, iterations) for s in specs]
        extra = {"experiment": "E1", "source": source, "label": label, "n_rows": n, "leakage_checklist": checklist, "search_iterations": iterations, "seed": modeling.SEED}
        save_results(spark, root, f"e1_{source}", results_to_payload(results, **extra, cv_folds=modeling.FOLDS, holdout_test_size=modeling.TEST_SHARE))


def run_e2(spark: SparkSession, frame: DataFrame, specs: Sequence[ModelSpec], root: str, old: str, new: str, cutoff: str, iterations: int = SEARCH) -> None:
    """Train on the old source, test on the new one, with the parameters that the old source's comparison found."""
    train, test = (cut(feature_frame(frame.filter(F.col("source") == s))) for s in (old, new))
    n, m = train.count(), test.count()
    if n < LEAST_ROWS or m < LEAST_TRANSFER:
        log.warning("too few rows for E2: %d, %d", n, m)
        return
    for d in (train, test):
        leakage_checklist(d)
    known, rows = best_params(spark, root, f"e1_{old}"), []
    for s in specs:
        params = known.get(s.name) or tuned(s, train, iterations)
        own = s.make(**{k: coerce(v) for k, v in params.items()})
        rows.append({"name": s.name, "tier": s.tier, "transfer": metrics_of((own if s.raw else imputed(own))(train, test))})
    extra = {"params_source": f"e1_{old}" if known else "tuned here", "test_source": new, "cutoff": cutoff}
    save_results(spark, root, "e2", {"experiment": "E2", "train_rows": n, "test_rows": m, "models": rows, **extra})


#: Names of the ablation's configurations, and whether each has texts and flags.
CONFIGURATIONS = [("Chỉ đặc trưng bảng", False, False), ("Bảng + cờ văn bản thủ công", False, True), ("Bảng + TF-IDF/SVD", True, False), ("Bảng + TF-IDF/SVD + cờ", True, True)]


def run_ablation(spark: SparkSession, frame: DataFrame, root: str, source: str, iterations: int = SEARCH, specs: Callable[[bool, bool], Sequence[ModelSpec]] = lambda t, f: default_specs(False, t, f)) -> None:
    """The champion with and without each branch of the text, on the same folds and with the same budget."""
    ready = cut(feature_frame(frame.filter(F.col("source") == source)))
    if ready.count() < LEAST_ROWS:
        return
    split, rows, name = with_splits(ready), [], None
    for label, use_text, use_flags in CONFIGURATIONS:
        spec, _ = champion_of(spark, root, f"e1_{source}", specs(use_text, use_flags))
        if spec is None:
            return
        own, name = evaluate_model(spec, split, max(8, iterations // 3)), spec.name
        rows.append({"configuration": label, "cv_mean": own.cv_mean, "cv_std": own.cv_std})
    save_results(spark, root, "ablation", {"experiment": "Ablation", "model": name, "rows": rows})


def run_e3(spark: SparkSession, frame: DataFrame, specs: Sequence[ModelSpec], root: str, source: str) -> None:
    """The champion on wards that it has not seen."""
    ready = cut(feature_frame(frame.filter(F.col("source") == source)))
    spec, params = champion_of(spark, root, f"e1_{source}", specs)
    if spec is None or ready.count() < LEAST_ROWS:
        return
    own = spec.make(**{k: coerce(v) for k, v in params.items()})
    found = experiments.leave_one_out(own if spec.raw else imputed(own), ready, "ward", LABEL).collect()  # a row a ward, five at most
    rows = [{"ward": r["ward"], "n_test": r["n"], "metrics": {m: r[m] for m in experiments.METRICS}} for r in found]
    save_results(spark, root, "e3", {"experiment": "E3", "model": spec.name, "params_source": f"e1_{source}" if params else "defaults", "rows": rows})


#: Names of the price bins.
BINS = ("< 2 tỷ", "2–5 tỷ", "5–10 tỷ", "> 10 tỷ")


def error_analysis(predicted: DataFrame) -> dict[str, Any]:
    """MdAPE of predictions by district (20 rows at least) and by price, and all metrics."""
    rows = predicted.withColumn("bin", modeling.price_bin(F.col(LABEL)))
    by_place = modeling.measure(rows, LABEL, "prediction", SCALE, ["district"]).filter("n >= 20").select("district", "n", "mdape").orderBy(F.desc("mdape"), "district").collect()
    by_bin = modeling.measure(rows.filter("bin IS NOT NULL"), LABEL, "prediction", SCALE, ["bin"]).select("bin", "n", "mdape").orderBy("bin").collect()
    return {"by_district": [r.asDict() for r in by_place], "by_price_bin": [r.asDict() | {"bin": BINS[r["bin"]]} for r in by_bin], "overall": metrics_of(predicted)}


def analyse(spark: SparkSession, frame: DataFrame, specs: Sequence[ModelSpec], root: str, source: str, fractions: Sequence[float] = experiments.FRACTIONS) -> None:
    """Errors and learning curve of the champion on the rows held out."""
    spec, params = champion_of(spark, root, f"e1_{source}", specs)
    if spec is None:
        return
    split, model = with_splits(cut(feature_frame(frame.filter(F.col("source") == source)))), build_model(spec, params)
    train, test = split.filter("role = 'train'"), split.filter("role = 'test'")
    save_results(spark, root, "error_analysis", error_analysis(cut(model(train, test))))
    points, n = experiments.learning_curve(model, train, test, "listing_id", LABEL, fractions).orderBy("fraction").collect(), train.count()
    rows = [{"fraction": p["fraction"], "n_train": round(n * p["fraction"]), **{m: p[m] for m in experiments.METRICS}} for p in points]
    save_results(spark, root, "learning_curve", {"model": spec.name, "points": rows})


# --- the champion -----------------------------------------------------------------------------------------------------


def export_champion(spark: SparkSession, frame: DataFrame, root: str, source: str, specs: Sequence[ModelSpec]) -> str:
    """Write the champion as its training rows inside fences, its name and its parameters: a model here is a function of training
    rows, so that is all that predicts again. Returns a model card in markdown."""
    spec, params = champion_of(spark, root, f"e1_{source}", specs)
    if spec is None:
        raise ValueError("no champion")
    rows = feature_frame(frame.filter(F.col("source") == source))
    inside = cleaning.within_fences(rows, cut(cleaning.fit_fences(rows, "district", unit_price())), "district", unit_price())
    remove(spark, f"{root}/champion-rows")
    inside.write.parquet(f"{root}/champion-rows")
    one = spark.read.parquet(f"{root}/champion-rows").agg(F.count("*").alias("n"), F.date_format(F.min("published_at"), "MM/yyyy").alias("a"), F.date_format(F.max("published_at"), "MM/yyyy").alias("b")).first()
    saved = read_results(spark, root, f"e1_{source}")
    shown = pick_champion(saved)["cv_mean"] if saved else {}
    save_results(spark, root, "champion", {"model_name": spec.name, "best_params": params, "trained_rows": one["n"], "seed": modeling.SEED})
    lines = [f"# Model card: {spec.name}", "", f"- Số dòng: {one['n']}", f"- Nguồn: {source}", f"- Khoảng thời gian: {one['a']} – {one['b']}", "", "| Chỉ số | Giá trị |", "|---|---:|"]
    return "\n".join([*lines, *(f"| {k} | {v:.3f} |".replace(".", ",") for k, v in shown.items() if v is not None), "", f"Seed: {modeling.SEED}. Tham số: `{params or 'mặc định'}`."]) + "\n"


def load_artifacts(spark: SparkSession, root: str) -> tuple[dict[str, Any], DataFrame, dict[str, Any]]:
    """The champion, its training rows and its error analysis (empty if there is none)."""
    bundle = read_results(spark, root, "champion")
    if bundle is None:
        raise ValueError(f"no champion in {root}: run the experiments and export it")
    return bundle, spark.read.parquet(f"{root}/champion-rows"), read_results(spark, root, "error_analysis") or {}


def reference_values(frame: DataFrame, columns: Sequence[str] = CATEGORICAL) -> dict[str, list[str]]:
    """The values of each category, which a form offers."""
    one = frame.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in columns)).first()
    return {c: one[c] for c in columns}


def input_row(spark: SparkSession, values: Mapping[str, Any], frame: DataFrame) -> DataFrame:
    """A listing as a row in the shape of the training rows; its text loses all money first."""
    known = {f.name: f.dataType for f in frame.schema}
    row = spark.createDataFrame([(values.get("description") or "",)], "description string")
    given = {c: F.lit(values.get(c)).cast(known[c]) for c in (AREA, *MISSING, *CATEGORICAL) if c in known}
    row = row.withColumns({**given, **{f"{c}_missing": F.lit(0) for c in MISSING}, "published_at": F.current_timestamp(), "description_clean": money.strip_money(F.col("description"))})
    row = row.withColumn("description_tokens", money.strip_money(money.pretokenize(F.col("description_clean"))))
    own = feature_frame(row)
    return own.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in own.columns}).select(*known)


def price_of(spark: SparkSession, values: Mapping[str, Any], root: str, specs: Sequence[ModelSpec]) -> dict[str, float]:
    """The champion's price of a listing, a range as wide as its median error, and the unit price."""
    bundle, rows, errors = load_artifacts(spark, root)
    spec = next(s for s in specs if s.name == bundle["model_name"])
    own = spec.make(**{k: coerce(v) for k, v in bundle["best_params"].items()})
    price = (own if spec.raw else imputed(own))(rows, input_row(spark, values, rows)).first()["prediction"]
    share = (errors.get("overall", {}).get("mdape") or 20.0) / 100
    return {"price": price, "low": price * (1 - share), "high": price * (1 + share), "unit": price / values[AREA]}


def explanation(spark: SparkSession, values: Mapping[str, Any], root: str, specs: Sequence[ModelSpec], columns: Sequence[str] = (AREA, *MISSING, *CATEGORICAL)) -> list[tuple[str, float]]:
    """How much each stated value moves the price: the change of its logarithm when the value is left out, largest first."""
    bundle, rows, _ = load_artifacts(spark, root)
    spec = next(s for s in specs if s.name == bundle["model_name"])
    own = spec.make(**{k: coerce(v) for k, v in bundle["best_params"].items()})
    model, stated = own if spec.raw else imputed(own), [c for c in columns if values.get(c) is not None]
    numbers = [c for c in stated if c not in CATEGORICAL]
    typical = cleaning.fit_medians(rows, numbers, [])[1].first().asDict() if numbers else {}
    typical = {c: typical.get(f"all_{c}") for c in numbers} | {c: r[c] for c in stated if c in CATEGORICAL for r in [rows.groupBy(c).count().orderBy(F.desc("count"), c).first()]}
    asked = input_row(spark, values, rows).withColumn("_left_out", F.lit(""))
    for c in stated:
        asked = asked.unionByName(input_row(spark, {**values, c: typical[c]}, rows).withColumn("_left_out", F.lit(c)))
    found = {r["_left_out"]: r["p"] for r in model(rows.withColumn("_left_out", F.lit("")), asked).select("_left_out", F.log("prediction").alias("p")).collect()}
    return sorted(((c, found[""] - found[c]) for c in stated), key=lambda x: -abs(x[1]))
