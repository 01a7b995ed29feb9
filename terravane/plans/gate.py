"""The quality gate of raw records: views of each source, counts in one scan, checks against thresholds, a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import address, phones, price
from terravane.plans.pipeline import GATE, formatted_number, gate

LONG_TEXT = 200
#: The districts that the corpus is about.
TARGETS = ("Tân Bình", "Tân Phú", "Quận 12")
#: Metrics: the name in a report and whether it is a share.
TITLES = {
    "rows": ("Tổng số tin thô", False),
    "long_share": ("Tỷ lệ tin có mô tả ≥ 200 ký tự", True),
    "price_share": ("Tỷ lệ tin có giá dạng số", True),
    "place_share": ("Tỷ lệ tin có phường hoặc toạ độ", True),
    "target_rows": ("Tin ở các quận mục tiêu", False),
    "phones": ("Tin còn dấu vết SĐT (bộ dò của bước xoá)", False),
    "phones_independent": ("Tin còn dấu vết SĐT (bộ dò độc lập)", False),
}


def _view(records: DataFrame, source: str, text, own_price, ward, district) -> DataFrame:
    coordinates = F.coalesce(F.col("latitude") * F.col("longitude"), F.lit(0.0)) != 0
    return records.select(
        F.lit(source).alias("source"),
        F.coalesce(text, F.lit("")).alias("description"),
        own_price.alias("price"),
        (ward | coordinates).alias("placed"),
        district.alias("district"),
        F.to_json(F.struct(*records.columns)).alias("record"),
    )


def gateway_view(records: DataFrame, source: str) -> DataFrame:
    """What the gate asks of gateway records: description, price, whether there is a ward or a place, district, and the whole record."""
    named = F.coalesce(F.nullif(F.col("ward_name"), F.lit("")), F.nullif(F.col("ward_name_v3"), F.lit(""))).isNotNull()
    return _view(records, source, F.col("body"), price.numeric_price(F.col("price")), named, address.district(F.col("area_name")))


def page_view(records: DataFrame, source: str) -> DataFrame:
    """The same of records of detail pages, whose price may be words and whose ward stands in the address."""
    own = F.coalesce(price.numeric_price(F.col("price_vnd_ld")), price.parse_price(F.col("price_text"), F.lit(None).cast("double"))["total"])
    place = F.coalesce(F.col("address"), F.lit(""))
    return _view(records, source, F.col("description"), own, F.contains(place, F.lit("Phường")), address.district(place))


def collect(views: Sequence[DataFrame], targets: Sequence[str] = TARGETS, shape: str = "vn") -> tuple[DataFrame, DataFrame]:
    """One row of the gate's metrics over all views, and rows by source. Strings of a record are searched by the detector of the
    redaction and by the independent one, wherever they stand."""
    rows = views[0]
    for v in views[1:]:
        rows = rows.unionByName(v)
    rows = rows.withColumns({"found": F.size(phones.spans(F.col("record"), shape)) > 0, "found_plainly": phones.plain_hit(F.col("record"))})
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0))
    metrics = {
        "rows": F.count("*"),
        "long_share": share(F.length("description") >= LONG_TEXT),
        "price_share": share(F.col("price").isNotNull()),
        "place_share": share(F.col("placed")),
        "target_rows": F.count_if(F.col("district").isin(*targets)),
        "phones": F.count_if("found"),
        "phones_independent": F.count_if("found_plainly"),
    }
    return rows.agg(*(c.alias(k) for k, c in metrics.items())), rows.groupBy("source").agg(F.count("*").alias("n"))


def render(checks: DataFrame, by_source: DataFrame, titles: Mapping[str, tuple[str, bool]] = TITLES, spec: Sequence[tuple[str, float, bool]] = GATE) -> str:
    """The gate's checks (a row each) as markdown, and the decision."""
    own = {r["metric"]: r for r in checks.collect()}
    counts = ", ".join(f"{r['source']} {formatted_number(r['n'])}" for r in by_source.orderBy("source").collect())
    lines = ["# Cổng kiểm chất lượng dữ liệu thô", "", f"Nguồn thô: {counts}.", "", "| Kiểm tra | Đạt được | Ngưỡng | Kết quả |", "|---|---:|---:|:---:|"]
    failed = []
    for metric, _, ceiling in spec:
        if metric not in own:
            continue
        r, (title, is_share) = own[metric], titles[metric]
        show = lambda v: f"{v * 100:.1f}%".replace(".", ",") if is_share else formatted_number(v)  # noqa: E731, B023
        lines.append(f"| {title} | {show(r['value'])} | {'≤' if ceiling else '≥'} {show(r['threshold'])} | {'ĐẠT' if r['passed'] else 'CHƯA ĐẠT'} |")
        failed += [] if r["passed"] else [title.lower()]
    lines += ["", f"**{len(own) - len(failed)}/{len(own)} ngưỡng đạt.**", "", "Chưa đạt: " + "; ".join(failed) + "." if failed else "Toàn bộ ngưỡng đạt."]
    return "\n".join(lines) + "\n"


def run(views: Sequence[DataFrame], targets: Sequence[str] = TARGETS, shape: str = "vn") -> tuple[DataFrame, str]:
    """The checks and their report."""
    stats, by_source = collect(views, targets, shape)
    checks = gate(stats)
    return checks, render(checks, by_source)
