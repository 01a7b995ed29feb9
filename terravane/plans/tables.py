"""Saved results as markdown tables, and the figures' numbers as small tables. A conclusion follows the sign of what was measured."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from statistics import median, stdev
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.operators.models import TIERS
from terravane.operators.shared import quantiles
from terravane.plans.pipeline import formatted_number
from terravane.plans.runner import CONFIGURATIONS, read_results

#: Metrics in order, their names, decimals and whether less is better.
METRICS = {"rmse": ("RMSE (tỷ)", 3, True), "mae": ("MAE (tỷ)", 3, True), "mdape": ("MdAPE (%)", 1, True), "r2": ("R²", 3, False)}
BASELINE = "Trung vị giá/m² theo nhóm"
SLIDE = ("Dummy (trung vị)", BASELINE, "Ridge", "Random Forest", "Gradient boosting")
#: A learning curve's last step below this, in percentage points, is flat.
FLAT = 0.3

Payload = Mapping[str, Any]


def label(text: str) -> str:
    """A label without long dashes."""
    return text.replace(" — ", " · ").replace("—", "·")


def number(value: float | None, digits: int = 3) -> str:
    return formatted_number(value, digits)


def signed(value: float, digits: int) -> str:
    return ("+" if value > 0 else "") + number(value, digits)


def cell(mean: float, std: float | None, digits: int, bold: bool = False) -> str:
    text = f"{number(mean, digits)} ± {number(std, digits)}"
    return f"**{text}**" if bold else text


def best_place(values: Sequence[float | None], less: bool) -> int:
    """The place of the best value; missing ones are worst."""
    worst = float("inf") if less else float("-inf")
    known = [worst if v is None else v for v in values]
    return known.index(min(known) if less else max(known))


def table(header: Sequence[str], rows: Sequence[Sequence[object]], left: int = 1) -> list[str]:
    """Lines of a markdown table; the first ``left`` columns are words."""
    return [f"| {' | '.join(header)} |", "|" + "---|" * left + "---:|" * (len(header) - left), *(f"| {' | '.join(map(str, r))} |" for r in rows)]


def leaders(payload: Payload) -> list[dict]:
    """Models that the folds can't tell from the best one: within one deviation of it, baselines left out."""
    own = [m for m in payload["models"] if m["tier"] != TIERS[0]]
    best = min(own, key=lambda m: m["cv_mean"]["mdape"])
    near = [m for m in own if m["cv_mean"]["mdape"] <= best["cv_mean"]["mdape"] + (best["cv_std"]["mdape"] or 0)]
    return sorted(near, key=lambda m: m["cv_mean"]["mdape"])


def budget_note(payload: Payload) -> str:
    """Models whose grid is smaller than the budget."""
    short = sorted((m["search_budget"], m["name"]) for m in payload["models"] if 0 < m.get("search_budget", 0) < payload["search_iterations"])
    return " Lượt rút thật thấp hơn ngân sách ở: " + ", ".join(f"{name} {n}" for n, name in short) + "." if short else ""


def render_e1(payload: Payload) -> str:
    order = {t: i for i, t in enumerate(TIERS)}
    models = sorted(payload["models"], key=lambda m: (order.get(label(m["tier"]), 99), m["name"]))
    share = payload["holdout_test_size"]
    lines = [
        f"# E1: {label(payload['label'])}",
        "",
        f"{number(payload['n_rows'], 0)} dòng, hold-out {100 - round(share * 100)}/{round(share * 100)}, {payload['cv_folds']}-fold, seed {payload['seed']}. Ngân sách tinh chỉnh {payload['search_iterations']}."
        + budget_note(payload),
        "",
    ]
    best = {k: best_place([m["cv_mean"][k] for m in models], less) for k, (_, _, less) in METRICS.items()}
    rows = [[label(m["tier"]), m["name"], *(cell(m["cv_mean"][k], m["cv_std"][k], d, best[k] == i) for k, (_, d, _) in METRICS.items())] for i, m in enumerate(models)]
    lines += table(["Tầng", "Mô hình", *(t for t, _, _ in METRICS.values())], rows, 2)
    lines += ["", "## Hold-out", "", *table(["Mô hình", *(t for t, _, _ in METRICS.values())], [[m["name"], *(number(m["holdout"][k], d) for k, (_, d, _) in METRICS.items())] for m in models])]
    baseline = next((m for m in models if m["name"] == BASELINE), None)
    if baseline and any(m["tier"] != TIERS[0] for m in models):
        own = leaders(payload)
        gaps = [baseline["cv_mean"]["mdape"] - m["cv_mean"]["mdape"] for m in own]
        range_ = number(gaps[0], 2) if len(gaps) == 1 else f"{number(min(gaps), 2)}–{number(max(gaps), 2)}"
        lines += ["", f"Nhóm dẫn đầu ({', '.join(m['name'] for m in own)}) hơn baseline môi giới **{range_} điểm phần trăm MdAPE**."]
    unstable = [m["name"] for m in models if m["cv_mean"]["rmse"] is not None and (m["cv_std"]["rmse"] or 0) > 0.6 * m["cv_mean"]["rmse"]]
    lines += ["", f"**Chú ý**: {', '.join(unstable)} có độ lệch chuẩn RMSE lớn so với trung bình."] if unstable else []
    overflow = [(m["name"], m["holdout"]["n_non_finite"]) for m in models if m["holdout"].get("n_non_finite")]
    lines += ["", "**Dự báo tràn số**: " + ", ".join(f"{n} ({k})" for n, k in overflow) + "."] if overflow else []
    return "\n".join(lines) + "\n"


def render_e2(payload: Payload, reference: Payload | None = None) -> str:
    """Transfer, with the difference to the comparison on the new source, where that was run."""
    known = {m["name"]: m["cv_mean"]["mdape"] for m in reference["models"]} if reference else {}
    rows, deltas = [], []
    for m in payload["models"]:
        now, was = m["transfer"]["mdape"], known.get(m["name"])
        change = "(không có mốc)" if was is None else "không tính được" if now is None else signed(now - was, 1)
        deltas += [now - was] if was is not None and now is not None and m["name"] != SLIDE[0] else []
        rows.append([m["name"], *(number(m["transfer"][k], d) for k, (_, d, _) in METRICS.items()), change])
    lines = ["# E2: chuyển giao theo thời gian", "", f"Huấn luyện trên {number(payload['train_rows'], 0)} tin tới {payload['cutoff']}, kiểm trên {number(payload['test_rows'], 0)} tin.", ""]
    lines += table(["Mô hình", *(t for t, _, _ in METRICS.values()), "Δ MdAPE"], rows)
    overflow = [(m["name"], m["transfer"]["n_non_finite"]) for m in payload["models"] if m["transfer"].get("n_non_finite")]
    lines += ["", "**Dự báo tràn số**: " + ", ".join(f"{n} ({k} dòng)" for n, k in overflow) + "."] if overflow else []
    if deltas:
        middle, worse = median(deltas), sum(d > 0 for d in deltas)
        lines += ["", f"Trung vị mức {'xấu đi' if middle > 0 else 'tốt lên'}: **{number(abs(middle), 1)} điểm phần trăm MdAPE** ({worse}/{len(deltas)} mô hình xấu đi)."]
    return "\n".join(lines) + "\n"


def render_ablation(payload: Payload) -> str:
    rows = payload["rows"]
    first = rows[0]["cv_mean"]["mdape"]
    shown = [[r["configuration"], cell(r["cv_mean"]["mdape"], r["cv_std"]["mdape"], 2), signed(r["cv_mean"]["mdape"] - first, 2), number(r["cv_mean"]["rmse"]), number(r["cv_mean"]["r2"])] for r in rows]
    lines = ["# Ablation: đặc trưng văn bản đáng bao nhiêu?", "", f"Mô hình: {payload['model']}, cùng bộ fold và ngân sách.", ""]
    lines += table(["Cấu hình đặc trưng", "MdAPE (%)", "Δ so với chỉ bảng", "RMSE (tỷ)", "R²"], shown)
    by = {r["configuration"]: r["cv_mean"]["mdape"] for r in rows}
    flags, text = by.get(CONFIGURATIONS[1][0]), by.get(CONFIGURATIONS[2][0])
    if flags is not None and text is not None:
        verdicts = {(True, False): "Cờ thủ công giúp được, TF-IDF/SVD làm tệ đi.", (True, True): "Cả hai nhánh văn bản đều giúp được.", (False, True): "Chỉ TF-IDF/SVD giúp được.", (False, False): "Không nhánh văn bản nào làm giảm sai số."}
        lines += ["", verdicts[flags < first, text < first]]
    return "\n".join(lines) + "\n"


def render_e3(payload: Payload) -> str:
    rows = [[r["ward"], r["n_test"], number(r["metrics"]["mdape"], 1), number(r["metrics"]["rmse"]), number(r["metrics"]["r2"])] for r in payload["rows"]]
    lines = ["# E3: giữ lại từng phường làm tập kiểm", "", f"Mô hình: {payload['model']}.", "", *table(["Phường giữ lại", "Số tin kiểm", "MdAPE (%)", "RMSE (tỷ)", "R²"], rows)]
    values = [r["metrics"]["mdape"] for r in payload["rows"] if r["metrics"]["mdape"] is not None]
    lines += ["", f"Trung bình MdAPE: {number(sum(values) / len(values), 1)}% ± {number(stdev(values) if len(values) > 1 else 0.0, 1)}."] if values else []
    return "\n".join(lines) + "\n"


def render_error_analysis(payload: Payload) -> str:
    places = [[r["district"], r["n"], number(r["mdape"], 1)] for r in payload["by_district"]]
    bins = [[r["bin"], r["n"], number(r["mdape"], 1)] for r in payload["by_price_bin"]]
    lines = ["# Phân tích lỗi theo lát cắt", "", *table(["Quận", "Số tin kiểm", "MdAPE (%)"], places), "", *table(["Khoảng giá", "Số tin kiểm", "MdAPE (%)"], bins)]
    if len(bins) >= 3:
        low, high = (f(payload["by_price_bin"], key=lambda r: r["mdape"]) for f in (min, max))
        lines += ["", f"Thấp nhất ở {low['bin']} ({number(low['mdape'], 1)}%), cao nhất ở {high['bin']} ({number(high['mdape'], 1)}%)."]
    return "\n".join(lines) + "\n"


def render_learning_curve(payload: Payload) -> str:
    points = payload["points"]
    rows = [[f"{round(p['fraction'] * 100)}%", p["n_train"], number(p["rmse"]), number(p["mdape"], 1)] for p in points]
    lines = ["# Đường cong học", "", f"Mô hình: {payload['model']}.", "", *table(["Tỷ lệ", "Số tin", "RMSE (tỷ)", "MdAPE (%)"], rows, 0)]
    if len(points) > 1:
        gain = points[-2]["mdape"] - points[-1]["mdape"]
        verdict = f"vẫn còn giảm {number(gain, 1)} điểm" if gain > FLAT else f"xấu đi {number(-gain, 1)} điểm" if gain < -FLAT else "gần như không giảm nữa"
        lines += ["", f"Từ {points[0]['n_train']} lên {points[-1]['n_train']} tin: {number(points[0]['mdape'], 1)}% → {number(points[-1]['mdape'], 1)}%. **Bước cuối {verdict}**."]
    return "\n".join(lines) + "\n"


def render_e1_slide(payload: Payload) -> str:
    """Few models and columns; all leaders are bold, as the folds can't rank them."""
    models, own = {m["name"]: m for m in payload["models"]}, {m["name"] for m in leaders(payload)}
    rows = [[f"**{n}**" if n in own else n, *(number(models[n]["cv_mean"][k], METRICS[k][1]) for k in ("mdape", "rmse", "r2"))] for n in SLIDE if n in models]
    lines = ["# Kết quả chính (E1)", "", f"{number(payload['n_rows'], 0)} tin · {payload['cv_folds']}-fold", "", *table(["Mô hình", "MdAPE (%)", "RMSE (tỷ)", "R²"], rows)]
    return "\n".join(lines) + "\n"


def render_ablation_slide(payload: Payload) -> str:
    first = payload["rows"][0]["cv_mean"]["mdape"]
    rows = [[r["configuration"], number(r["cv_mean"]["mdape"], 2), signed(r["cv_mean"]["mdape"] - first, 2)] for r in payload["rows"]]
    return "\n".join(["# Ablation: văn bản đáng bao nhiêu?", "", *table(["Đặc trưng dùng", "MdAPE (%)", "Δ"], rows)]) + "\n"


def render_all(spark: SparkSession, root: str, sources: Sequence[str], newest: str) -> dict[str, str]:
    """Every table that saved results allow, by file name."""
    plain: dict[str, tuple[str, Callable[[Payload], str]]] = {
        **{f"e1-results-{s}.md": (f"e1_{s}", render_e1) for s in sources},
        "slide-e1.md": (f"e1_{newest}", render_e1_slide),
        "e2-results.md": ("e2", lambda p: render_e2(p, read_results(spark, root, f"e1_{newest}"))),
        "e3-results.md": ("e3", render_e3),
        "ablation.md": ("ablation", render_ablation),
        "slide-ablation.md": ("ablation", render_ablation_slide),
        "error-analysis.md": ("error_analysis", render_error_analysis),
        "learning-curve.md": ("learning_curve", render_learning_curve),
    }
    found = {file: (read_results(spark, root, name), render) for file, (name, render) in plain.items()}
    return {file: render(payload) for file, (payload, render) in found.items() if payload is not None}


def render_funnel(steps: DataFrame, sources: Sequence[str]) -> str:
    """Rows of a funnel's totals (step, name, total, change, a column per source)."""
    rows = [[r["name"], formatted_number(r["total"]), "" if r["change"] is None else formatted_number(r["change"]), *(formatted_number(r[s]) for s in sources)] for r in steps.orderBy("step").collect()]
    return "\n".join(table(["Bước", "Còn lại", "Thay đổi", *sources], rows)) + "\n"


# --- numbers of figures -----------------------------------------------------------------------------------------------


def histogram(df: DataFrame, value: Column, bins: int = 60, by: Column | None = None) -> DataFrame:
    """(by, bin, low, n): equal bins from the least to the greatest value, one range for all groups; nulls are left out."""
    rows = df.select((F.lit("") if by is None else by).alias("by"), value.cast("double").alias("v")).filter("v IS NOT NULL")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = rows.join(F.broadcast(ends))  # one row
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)), F.lit(0))
    return wide.groupBy("by", at.cast("long").alias("bin")).agg((F.first("lo") + F.col("bin") * (F.first("hi") - F.first("lo")) / bins).alias("low"), F.count("*").alias("n"))


def counts_by(df: DataFrame, row: str, column: Column, names: Sequence[str], rest: str = "others") -> DataFrame:
    """Rows by a category and, as columns, by the named values of another; all others are one column."""
    named = df.select(row, F.when(column.isin(*names), column).otherwise(rest).alias("_name"))
    return named.groupBy(row).pivot("_name", [*names, rest]).count().na.fill(0)


def medians_by_month(df: DataFrame, at: str, value: Column, by: str, least: int = 15) -> DataFrame:
    """(month, by, median, n, after_gap) of groups with enough rows; after_gap: the month before has no such row."""
    rows = df.select(F.trunc(at, "month").alias("m"), F.col(by).alias("by"), value.alias("v"))
    middle = quantiles(rows, ["m", "by"], F.col("v"), [0.5]).select(F.col("m").alias("_m"), F.col("by").alias("_by"), F.col("q0").alias("median"))
    m = rows.groupBy("m", "by").agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(middle, F.col("m").eqNullSafe(F.col("_m")) & F.col("by").eqNullSafe(F.col("_by")), "left").drop("_m", "_by")
    before = F.lag("m").over(Window.partitionBy("by").orderBy("m"))  # one row a month
    return m.select(F.date_format("m", "yyyy-MM").alias("month"), "by", "median", "n", F.coalesce(F.months_between("m", before) > 1, F.lit(False)).alias("after_gap"))


def figures(listings: DataFrame, label: str = "total_price_vnd", area: str = "area_m2") -> dict[str, DataFrame]:
    """The numbers of the figures that describe listings, a small table each: distributions of the price's logarithm and of the area
    by source, rows by district and source, monthly medians of the unit price by source."""
    sources = sorted(r["source"] for r in listings.select("source").distinct().collect())  # a handful
    return {
        "price_distribution": histogram(listings, F.log10(label), by=F.col("source")),
        "area_distribution": histogram(listings, F.col(area), by=F.col("source")),
        "count_by_district": counts_by(listings, "district", F.col("source"), sources),
        "unit_price_by_month": medians_by_month(listings, "published_at", F.col(label) / F.col(area), "source"),
    }


def save_figures(listings: DataFrame, root: str) -> None:
    """Each figure's numbers as one CSV folder."""
    for name, table_ in figures(listings).items():
        table_.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")


def changes(results: DataFrame, value: str, order: str, digits: int = 6) -> DataFrame:
    """Columns to_first and to_previous: a result's difference to the first and to the one before, in order."""
    w = Window.orderBy(order)  # one row per result
    return results.withColumns({"to_first": F.round(F.col(value) - F.first(value).over(w), digits), "to_previous": F.round(F.col(value) - F.lag(value).over(w), digits)})
