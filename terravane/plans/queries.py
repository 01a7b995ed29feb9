"""Queries over the star-schema tables, which stand in for listings, and the same rows in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import address, extract, money, phones, price
from terravane.functions.text import flat
from terravane.operators import cleaning, dedup, experiments, gold, modeling, shared
from terravane.plans import gate, pipeline, tables
from terravane.sources import html, store, wards
from terravane.sources import listings as sources
from terravane.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def listings(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey"))


GROUPS = ["p_brand", "p_type"]
_BACKOFF = """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, p_brand, p_type, l_extendedprice / l_quantity AS u
  FROM lineitem JOIN part ON l_partkey = p_partkey),
u2 AS (SELECT p_brand, p_type, median(u) AS m2 FROM d GROUP BY ALL), u1 AS (SELECT p_brand, median(u) AS m1 FROM d GROUP BY ALL),
u0 AS (SELECT median(u) AS m0 FROM d),
p AS (SELECT d.*, coalesce(m2, m1, m0) * l_quantity AS prediction FROM d LEFT JOIN u2 USING (p_brand, p_type) LEFT JOIN u1 USING (p_brand), u0)
"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = listings(spark, sf)
    return modeling.predict_backoff(d, modeling.fit_backoff(d, GROUPS, "l_extendedprice", "l_quantity"), GROUPS, "l_quantity")


@query(_BACKOFF + "SELECT l_orderkey, l_linenumber, round(prediction + 0.0000003, 6) AS prediction FROM p")
def broker_baseline(spark, sf):
    return predictions(spark, sf).select("l_orderkey", "l_linenumber", F.round(F.col("prediction") + 0.0000003, 6).alias("prediction"))


@query(
    _BACKOFF
    + """SELECT count(*) AS n, 0 AS n_non_finite, round(sqrt(avg((prediction - l_extendedprice) ** 2)), 4) AS rmse,
  round(avg(abs(prediction - l_extendedprice)), 4) AS mae, round(median(abs(prediction - l_extendedprice) / l_extendedprice) * 100, 6) AS mdape,
  round(1 - sum((prediction - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM p"""
)
def broker_metrics(spark, sf):
    m = modeling.measure(shared.cut(predictions(spark, sf).select("l_extendedprice", "prediction")), "l_extendedprice", "prediction", 1.0)
    return m.select("n", F.col("n_non_finite").cast("int").alias("n_non_finite"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mdape", 6).alias("mdape"), F.round("r2", 6).alias("r2"))


@query(
    _BACKOFF
    + """SELECT CAST(CASE WHEN l_extendedprice <= 20000 THEN 0 WHEN l_extendedprice <= 50000 THEN 1 ELSE 2 END AS INTEGER) AS price_bin, count(*) AS n,
  round(median(abs(prediction - l_extendedprice) / l_extendedprice) * 100, 6) AS mdape FROM p GROUP BY ALL HAVING count(*) >= 20"""
)
def error_slices(spark, sf):
    p = predictions(spark, sf).withColumn("price_bin", modeling.price_bin(F.col("l_extendedprice"), (0, 20000, 50000)))
    out = modeling.measure(shared.cut(p.select("price_bin", "l_extendedprice", "prediction")), "l_extendedprice", "prediction", 1.0, ["price_bin"])
    return out.filter("n >= 20").select("price_bin", "n", F.round("mdape", 6).alias("mdape"))


def _customer_orders(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))


_FENCES = """
WITH d AS (SELECT o_orderkey, c_nationkey, ln(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM d),
g AS (SELECT c_nationkey, count(*) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM d GROUP BY ALL),
f AS (SELECT c_nationkey, g.n, CASE WHEN g.n >= 60 THEN g.a - 1.5 * (g.b - g.a) ELSE w.a - 1.5 * (w.b - w.a) END AS lo,
  CASE WHEN g.n >= 60 THEN g.b + 1.5 * (g.b - g.a) ELSE w.b + 1.5 * (w.b - w.a) END AS hi, CASE WHEN g.n >= 60 THEN 'group' ELSE 'all' END AS basis FROM g, w)
"""


@query(
    _FENCES
    + """SELECT f.c_nationkey, f.n, round(lo, 6) AS lo, round(hi, 6) AS hi, basis, round(avg(CAST(v BETWEEN lo AND hi AS INTEGER)), 6) AS keep_share
  FROM f JOIN d USING (c_nationkey) GROUP BY ALL
  UNION ALL SELECT NULL, n, round(a - 1.5 * (b - a), 6), round(b + 1.5 * (b - a), 6), 'whole', NULL FROM w"""
)
def iqr_fences(spark, sf):
    f = cleaning.fit_fences(_customer_orders(spark, sf), "c_nationkey", F.log("o_totalprice"))
    return f.select("c_nationkey", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "basis", F.round("keep_share", 6).alias("keep_share"))


@query(_FENCES + "SELECT o_orderkey, c_nationkey FROM d JOIN f USING (c_nationkey) WHERE v BETWEEN lo AND hi")
def iqr_filter(spark, sf):
    d = _customer_orders(spark, sf)
    v = F.log("o_totalprice")
    return cleaning.within_fences(d, cleaning.fit_fences(d, "c_nationkey", v), "c_nationkey", v).select("o_orderkey", "c_nationkey")


@query(
    """SELECT coalesce(CASE WHEN l_quantity NOT BETWEEN 5 AND 45 THEN 'area' WHEN l_extendedprice NOT BETWEEN 3000 AND 60000 THEN 'price'
  WHEN l_returnflag = 'R' THEN 'rental' END, 'kept') AS reason, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def hard_rules_funnel(spark, sf):
    rules = [("area", ~F.col("l_quantity").between(5, 45)), ("price", ~F.col("l_extendedprice").between(3000, 60000)), ("rental", F.col("l_returnflag") == "R")]
    rows = read(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    return cleaning.apply_rules(rows, rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT 0 AS step, 'read' AS name, o_orderstatus AS source, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 1, 'priced', o_orderstatus, count(*) FROM orders WHERE o_totalprice > 50000 GROUP BY ALL
  UNION ALL SELECT 2, 'urgent', o_orderstatus, count(*) FROM orders WHERE o_totalprice > 50000 AND o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT CAST(step AS INTEGER) AS step, name, source, n, n - lag(n) OVER (PARTITION BY source ORDER BY step) AS change FROM s"""
)
def funnel_steps(spark, sf):
    o = read(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    a = o.filter("o_totalprice > 50000")
    return pipeline.funnel([("read", o), ("priced", a), ("urgent", a.filter("o_orderpriority = '1-URGENT'"))], "o_orderstatus")


@query(
    """SELECT p_partkey, p_size, CAST(p_size IS NULL AS INTEGER) AS p_size_missing, coalesce(nullif(p_brand, ''), 'không rõ') AS p_brand
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS p_size, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 <> 0 THEN p_brand END AS p_brand FROM part)"""
)
def missing_indicators(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 <> 0 THEN p_size END").alias("p_size"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 <> 0 THEN p_brand END").alias("p_brand"))
    return cleaning.mark_missing(p, ["p_size"], ["p_brand"])


@query(
    """WITH d AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS s FROM part),
g AS (SELECT p_brand, p_type, median(s) AS m FROM d GROUP BY ALL)
SELECT p_partkey, p_brand, p_type, coalesce(s, m, (SELECT median(s) FROM d)) AS s FROM d LEFT JOIN g USING (p_brand, p_type)"""
)
def group_median_impute(spark, sf):
    d = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.expr("CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END").alias("s"))
    return cleaning.impute(d, cleaning.fit_medians(d, ["s"], GROUPS), ["s"], GROUPS)


_MAPPING = """
WITH c AS (SELECT c_nationkey AS new_ward, c_mktsegment AS old_ward, c_mktsegment || '-d' AS old_district, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY new_ward ORDER BY n DESC, old_ward) AS place, sum(n) OVER (PARTITION BY new_ward) AS total FROM c),
m AS (SELECT new_ward, old_ward, old_district, CAST(total AS BIGINT) AS support, round(n / total, 3) AS majority_share FROM r WHERE place = 1)
"""


def _mapping(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("new_ward"), F.col("c_mktsegment").alias("old_ward"), F.concat("c_mktsegment", F.lit("-d")).alias("old_district"))
    return modeling.majority_mapping(c, "new_ward", ["old_ward", "old_district"])


@query(_MAPPING + "SELECT new_ward, old_ward, old_district, support, majority_share, (SELECT count(*) FROM c WHERE c.new_ward = m.new_ward) - 1 AS others FROM m")
def ward_mapping(spark, sf):
    return _mapping(spark, sf).withColumn("others", F.size("alternatives").cast("long")).drop("alternatives")


@query(
    _MAPPING
    + """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE coalesce(m.old_ward, 'không rõ') END AS ward,
  CASE WHEN s_suppkey % 2 = 0 THEN 'here' WHEN s_suppkey % 3 = 0 THEN 'không rõ' ELSE coalesce(m.old_district, 'không rõ') END AS district_resolved,
  CASE WHEN s_suppkey % 3 = 0 THEN 'old' WHEN m.old_ward IS NULL THEN 'unmapped' WHEN majority_share < 0.6 THEN 'mapped_weak' ELSE 'mapped' END AS ward_frame
  FROM supplier LEFT JOIN m ON s_nationkey = new_ward AND new_ward % 4 <> 0"""
)
def ward_resolution(spark, sf):
    return _resolved(spark, sf).select("s_suppkey", "ward", "district_resolved", "ward_frame")


def _resolved(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'own' END").alias("old"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'here' END").alias("dist"))
    return modeling.resolve_wards(s, _mapping(spark, sf).filter("new_ward % 4 <> 0"), "old", "s_nationkey", "dist")


@query(
    _MAPPING
    + """, f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'old' WHEN m.old_ward IS NULL THEN 'unmapped' WHEN majority_share < 0.6 THEN 'mapped_weak' ELSE 'mapped' END AS f
  FROM supplier LEFT JOIN m ON s_nationkey = new_ward AND new_ward % 4 <> 0)
SELECT count(*) AS "rows", round(avg(CAST(f = 'unmapped' AS INTEGER)), 4) AS unmapped_rate, count(*) FILTER (f = 'old') AS old, count(*) FILTER (f = 'mapped') AS mapped,
  count(*) FILTER (f = 'mapped_weak') AS mapped_weak, count(*) FILTER (f = 'unmapped') AS unmapped FROM f"""
)
def ward_quality(spark, sf):
    return wards.quality(_resolved(spark, sf))


@query(
    """SELECT 'c' || c_custkey AS id, 'customer' AS source, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS phone FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_acctbal, 'không rõ', NULL FROM supplier"""
)
def unify_sources(spark, sf):
    c = read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.col("s_acctbal").alias("balance"))
    return cleaning.unify([c, s], ["id", "source", "balance", "segment", "phone"], ["segment"]).withColumn("phone", F.col("phone").cast("string"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 <> 0 AND l_quantity BETWEEN 1 AND 45 THEN l_quantity END AS a,
  CASE WHEN l_suppkey % 2 = 0 AND l_suppkey BETWEEN 1 AND 45 THEN CAST(l_suppkey AS DOUBLE) END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(a, b) AS v, a IS NULL AND b IS NOT NULL AS from_text FROM p"""
)
def provenance_pick(spark, sf):
    v, t = cleaning.pick(F.expr("CASE WHEN l_partkey % 4 <> 0 THEN l_quantity END"), F.expr("CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS STRING) ELSE 'none' END"), 1, 45)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), t.alias("from_text"))


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(abs(l_extendedprice - p_retailprice * l_quantity) / (p_retailprice * l_quantity) <= 0.1, true) AS agrees
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
)
def price_cross_check(spark, sf):
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    joined = line.join(read(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", price.cross_checks(F.col("l_extendedprice"), F.col("p_retailprice"), F.col("l_quantity")).alias("agrees"))


_N, _M = "(o_orderkey % 90 + 1)", "(o_orderkey % 899 + 100)"


@query(
    f"""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN {_N} * 1000000000 + {_M} * 1000000 WHEN 1 THEN {_N} * 1000000000 + {_M} * 1000000
  WHEN 2 THEN {_M} * 1000000 WHEN 3 THEN {_M} * 1000000 * 50 ELSE {_N} * 1000000000 + {_M} * 1000000 END AS DOUBLE) AS total,
  CASE o_orderkey % 5 WHEN 3 THEN 'unit' ELSE 'total' END AS kind FROM orders"""
)
def price_roundtrip(spark, sf):
    text = F.expr(
        f"""CASE o_orderkey % 5 WHEN 0 THEN concat('giá ', {_N}, ' tỷ ', {_M}, ' triệu') WHEN 1 THEN concat({_N}, ' ty ', {_M})
        WHEN 2 THEN concat({_M}, ' Triệu') WHEN 3 THEN concat({_M}, ' triệu/m²') ELSE concat({_N}, ',', {_M}, ' tỉ') END"""
    )
    o = read(spark, sf, "orders").select("o_orderkey", text.alias("t"))
    return o.select("o_orderkey", price.parse_price(F.col("t"), F.lit(50)).alias("p")).select("o_orderkey", "p.total", "p.kind")


@query(
    """SELECT p_partkey, CAST(CASE WHEN p_size % 9 = 0 THEN 1 ELSE p_size % 9 + 1 END AS INTEGER) AS floors, CASE WHEN p_partkey % 6 IN (0, 4) THEN CAST(p_size % 10 + 3 AS DOUBLE) WHEN p_partkey % 6 = 5 THEN p_size % 20 + 2.5 END AS frontage_m,
  CASE p_partkey % 6 WHEN 0 THEN CAST((p_size % 10 + 3) * (p_size % 20 + 10) AS DOUBLE) WHEN 2 THEN p_size + 20.5 ELSE CAST(p_size + 20 AS DOUBLE) END AS area_m2,
  CAST(p_size % 5 + 1 AS INTEGER) AS bedrooms, CAST(p_size % 3 + 1 AS INTEGER) AS bathrooms, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size % 6 + 2 AS DOUBLE) END AS alley_width_m,
  CASE WHEN p_partkey % 6 = 5 THEN 'mặt tiền' WHEN p_partkey % 4 = 0 THEN 'hẻm' ELSE 'không rõ' END AS position,
  CASE p_size % 3 WHEN 0 THEN 'Đông Nam' WHEN 1 THEN 'Tây' ELSE 'không rõ' END AS direction, CASE p_size % 2 WHEN 0 THEN 'sổ hồng' ELSE 'giấy tay' END AS legal_status FROM part"""
)
def attributes_roundtrip(spark, sf):
    """Areas as width by length, labelled, certified beside others, after a rejected token, bare, and with a frontage."""
    body = F.expr(
        """concat('Nhà ', CASE WHEN p_size % 9 = 0 THEN 'cấp 4' ELSE concat('1 trệt ', p_size % 9, ' lầu') END, CASE p_partkey % 6
        WHEN 0 THEN concat(', ', p_size % 10 + 3, 'm x ', p_size % 20 + 10, 'm, ') WHEN 1 THEN concat(' ', p_size + 20, 'mat, diện tích ', p_size + 20, 'm giá tốt, ')
        WHEN 2 THEN concat(', xây ', p_size + 90, 'm2 rộng rãi thoáng mát sạch sẽ, công nhận ', p_size + 20, ',5 m2, ') WHEN 3 THEN concat(' ', p_size + 20, 'mx dt ', p_size + 20, 'm, ')
        WHEN 4 THEN concat(', ', p_size + 20, 'm2 gồm ', p_size % 10 + 3, 'x', p_size % 20 + 10, ', ') ELSE concat(', mặt tiền ', p_size % 20 + 2, ',5m, DT: ', p_size + 20, ' mv, ') END,
        p_size % 5 + 1, ' phòng ngủ, ', p_size % 3 + 1, ' WC', CASE WHEN p_partkey % 4 = 0 THEN concat(', hẻm ', p_size % 6 + 2, 'm') ELSE '' END,
        CASE p_size % 3 WHEN 0 THEN ', hướng Đông Nam' WHEN 1 THEN ', hướng Tây' ELSE '' END, CASE p_size % 2 WHEN 0 THEN ', sổ hồng' ELSE ', giấy tay' END)"""
    )
    own = extract.extract_all(F.lit("Bán"), F.col("body"))
    names = ["floors", "frontage_m", "area_m2", "bedrooms", "bathrooms", "alley_width_m", "position", "direction", "legal_status"]
    return read(spark, sf, "part").select("p_partkey", body.alias("body")).select("p_partkey", *(own[n].alias(n) for n in names))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey IN (2, 9) THEN 'Thủ Đức' WHEN c_nationkey BETWEEN 1 AND 12 THEN 'Quận ' || c_nationkey ELSE 'Gò Vấp' END AS district,
  'Phường ' || (c_custkey % 30 + 1) AS ward, 'Lê Lợi' AS street FROM customer"""
)
def address_roundtrip(spark, sf):
    text = F.expr(
        """concat(CASE c_custkey % 2 WHEN 0 THEN 'Lê Lợi, P.' ELSE 'Lê Lợi, Phường ' END, c_custkey % 30 + 1, ', ',
        CASE WHEN c_nationkey BETWEEN 1 AND 12 THEN concat(CASE c_custkey % 3 WHEN 0 THEN 'Q.' WHEN 1 THEN 'quan ' ELSE 'Quận ' END, c_nationkey) ELSE 'GO VAP' END, ', TPHCM')"""
    )
    c = read(spark, sf, "customer").select("c_custkey", text.alias("t"))
    return c.select("c_custkey", address.parse_address(F.col("t")).alias("a")).select("c_custkey", "a.street", "a.ward", "a.district")


def _after_plus():
    """How many of the spans in a text stand after a plus sign."""
    return F.size(F.filter("spans", lambda x: (x["start"] > 0) & (F.substring("text", x["start"], F.lit(1)) == "+")))


@query(r"""SELECT doc_id, regexp_replace(text, '1 \(\d{3}\) \d{3}-\d{4}', '[SDT_DA_XOA]', 'g') AS text, CAST(len(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS INTEGER) AS hits FROM documents WHERE regexp_matches(text, '\+1 \(\d{3}\)')""")
def phone_scrub(spark, sf):
    d = read(spark, sf, "documents").filter(F.col("text").rlike(r"\+1 \(\d{3}\)"))
    d = d.select("doc_id", "text", phones.scrubbed(F.col("text"), "plus1").alias("s"), phones.spans(F.col("text"), "plus1").alias("spans"))
    return d.select("doc_id", "s", _after_plus().alias("hits")).select("doc_id", "s.text", "hits")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS INTEGER) AS hits FROM documents WHERE regexp_matches(text, '\+1 \(\d{3}\) \d{3}-\d{4}')""")
def phone_counts(spark, sf):
    """Numbers that the detector finds after a plus sign."""
    d = read(spark, sf, "documents").select("doc_id", "text", phones.spans(F.col("text"), "plus1").alias("spans"))
    return d.select("doc_id", _after_plus().alias("hits")).filter("hits > 0")


_TEN, _MARK = "concat('09', lpad(cast(o_orderkey % 100000000 as string), 8, '0'))", phones.MARKER
#: A text with a number in it, and the same with the number cut, by kind: plain, spaced, with country code, letters for digits, another
#: script, words, beside a size, a price that stays, two numbers, invisible characters, after a contact word.
_HIDDEN = [
    ("concat('Liên hệ ', {n}, ' xem nhà')", "'Liên hệ {m} xem nhà'", 1),
    ("concat('sđt ', substr({n}, 1, 4), '.', substr({n}, 5, 3), ' ', substr({n}, 8, 3))", "'sđt {m}'", 1),
    ("concat('Zalo +84 ', substr({n}, 2, 3), '-', substr({n}, 5, 3), '*', substr({n}, 8, 3))", "'Zalo +{m}'", 1),
    ("concat('LH ', replace(replace({n}, '0', 'O'), '1', 'l'), ' nhé')", "'LH {m} nhé'", 1),
    ("concat('gọi ', translate({n}, '0123456789', '٠١٢٣٤٥٦٧٨٩'))", "'gọi {m}'", 1),
    ("concat('liên hệ không chín', replace(replace({d}, '1', ' một'), '2', ' hai'))", "'liên hệ {m}'", 1),
    ("concat('Bán đất 5x20 ', {n})", "'Bán đất 5x20 {m}'", 1),
    ("concat('Giá ', o_orderkey % 900 + 100, '.000.000 đồng, ', o_orderkey % 9 + 1, ' tầng')", None, 0),
    ("concat({n}, ' - ', {n}, ', chính chủ')", "'{m} - {m}, chính chủ'", 2),
    ("concat('sdt ', substr({n}, 1, 3), '​', substr({n}, 4, 7))", "'sdt {m}'", 1),
    ("concat('Mã tin ', o_orderkey % 900000000 + 100000000)", None, 0),
    ("concat('hotline 1900 ', lpad(cast(o_orderkey % 10000 as string), 4, '0'))", "'hotline {m}'", 1),
]


def _hidden(part: str) -> str:
    n, d = _TEN, "concat('1212121', o_orderkey % 2 + 1)"
    return "CASE " + " ".join(f"WHEN o_orderkey % {len(_HIDDEN)} = {i} THEN {part_}" for i, (a, b, h) in enumerate(_HIDDEN) for part_ in [{"text": a, "clean": b or a, "hits": str(h)}[part].format(n=n, d=d, m=_MARK)]) + " END"


@query(f"""SELECT o_orderkey, {_hidden("clean")} AS text, CAST({_hidden("hits")} AS INTEGER) AS hits FROM orders""")
def phone_roundtrip(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", phones.scrubbed(F.expr(_hidden("text"))).alias("s"))
    return o.select("o_orderkey", "s.text", "s.hits")


@query("SELECT o_orderkey, trim('house on sale GIÁTIỀN ' || CASE WHEN o_orderkey % 2 = 0 THEN 'call me' ELSE '' END) AS text, 0 AS money_left FROM orders")
def money_scrub(spark, sf):
    text = F.expr("concat('house on sale ', CASE o_orderkey % 3 WHEN 0 THEN concat(o_orderkey % 90 + 1, ' tỷ 200 triệu') WHEN 1 THEN concat(o_orderkey % 90 + 1, '_triệu/m2') ELSE concat(o_orderkey + 100000000, ' vnd') END, CASE WHEN o_orderkey % 2 = 0 THEN ' call me' ELSE '' END)")
    d = read(spark, sf, "orders").select("o_orderkey", money.strip_money(text).alias("text"))
    return d.select("o_orderkey", "text", money.money_left(F.col("text")).alias("money_left"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '\s+')) AS w FROM documents)
SELECT w AS token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, trim(regexp_replace(w, '[^\p{L}\p{N}\p{M}_]', '', 'g'), '_') AS w FROM t)
WHERE length(w) > 1 AND w NOT IN ('the', 'of', 'and') GROUP BY ALL ORDER BY n DESC, token LIMIT 50"""
)
def top_tokens(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.explode(money.tokenize(F.col("text"), ["the", "of", "and"])).alias("token"))
    per_doc = d.groupBy("token", "doc_id").agg(F.count("*").alias("c"))  # no distinct: one more partial sum
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "token").limit(50)


@query("SELECT p_partkey, CAST(p_partkey % 2 = 0 AS INTEGER) AS co_mat_tien, CAST(p_partkey % 3 = 0 AS INTEGER) AS ban_gap, CAST(p_partkey % 5 = 0 AS INTEGER) AS thang_may FROM part")
def text_flags(spark, sf):
    text = F.expr("concat('Nhà ', CASE WHEN p_partkey % 2 = 0 THEN 'mặt tiền ' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'cần bán gấp ' ELSE 'hẹn gặp ' END, CASE WHEN p_partkey % 5 = 0 THEN 'có thang máy' ELSE '' END)")
    own = money.flags(F.col("t"))
    return read(spark, sf, "part").select("p_partkey", text.alias("t")).select("p_partkey", *(own[k].alias(k) for k in ("co_mat_tien", "ban_gap", "thang_may")))


def _documents(spark, sf):
    """Documents, and how near-duplicates compare them: text, block and price."""
    d = read(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    return d, ("doc_id", F.col("text"), [F.col("lang"), dedup.area_bucket(F.col("n_chars"), 200)], F.col("n_chars"))


_NEAR = r"""
WITH RECURSIVE o AS (SELECT doc_id, text, lower(text) AS t, coalesce(lang, '') AS lang, n_chars, n_chars // 200 AS bucket FROM documents),
able AS (SELECT lang, bucket FROM o GROUP BY ALL HAVING count(*) > 1 AND bool_or(regexp_matches(text, '(?s)\S.{29,}\S'))),
d AS (SELECT o.* FROM o JOIN able USING (lang, bucket)),
w AS (SELECT doc_id, lang, bucket, ' ' || unnest(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) || ' ' AS w FROM d),
g AS (SELECT doc_id, lang, bucket, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) || list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4))
    || list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5))) AS g FROM w),
c AS (SELECT doc_id, lang, bucket, g, count(*) AS n FROM g GROUP BY ALL), q AS (SELECT doc_id, sqrt(sum(n * n)) AS q FROM c GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.lang = y.lang AND x.bucket = y.bucket AND x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, round(dot / (u.q * v.q), 5) AS cosine FROM p JOIN q u ON u.doc_id = a JOIN q v ON v.doc_id = b JOIN d da ON da.doc_id = a JOIN d db ON db.doc_id = b
  WHERE dot / (u.q * v.q) >= 0.85 AND abs(da.n_chars - db.n_chars) / greatest(da.n_chars, db.n_chars) <= 0.03)"""


@query(_NEAR + " SELECT a, b, cosine FROM pairs")
def near_dup_pairs(spark, sf):
    d, how = _documents(spark, sf)
    return dedup.duplicate_pairs(d, *how).select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(
    _NEAR
    + """, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r(node, reached) AS (SELECT DISTINCT a, a FROM e UNION SELECT node, e.b FROM r JOIN e ON e.a = reached),
k AS (SELECT node, min(reached) AS grp FROM r GROUP BY ALL), s AS (SELECT doc_id, n_chars, coalesce(grp, doc_id) AS grp FROM o LEFT JOIN k ON node = doc_id)
SELECT doc_id, grp AS duplicate_group FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n_chars DESC, doc_id) = 1"""
)
def near_dup_survivors(spark, sf):
    d, how = _documents(spark, sf)
    return dedup.survivors(d, dedup.groups_of(dedup.duplicate_links(d, *how)), "doc_id", F.lit(None).cast("timestamp"), F.col("n_chars")).select("doc_id", "duplicate_group")


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<a\s')) AS INTEGER) AS links FROM pages""")
def html_fields(spark, sf):
    return read(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.links(F.col("html")).alias("links"))


@query(
    """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, 'Nhà ' || p_name AS title, 'Lê Lợi, ' || p_brand AS address, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) || '000000' ELSE p_size || ' tỷ' END AS price,
  CASE WHEN p_partkey % 2 = 0 THEN 'House' END AS property_type, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'a much longer text than that of the page' ELSE 'short text' END AS description,
  p_size || ' m2' AS area, CASE WHEN p_partkey % 5 = 0 THEN CAST(10.5 + p_size AS DOUBLE) END AS latitude, CASE WHEN p_partkey % 5 = 0 THEN 106.25::DOUBLE END AS longitude FROM part"""
)
def page_details(spark, sf):
    """Detail pages with and without linked data and a map; a description stands in either place."""
    page = F.expr(
        """concat('<html><head><script type="application/ld+json">', CASE WHEN p_partkey % 2 = 0 THEN concat('[{"@type":"Person","name":"x","makesOffer":{"price":', p_partkey + 1, '000000,"itemOffered":{"@type":"House"}',
        CASE WHEN p_partkey % 3 = 0 THEN ',"description":"a much longer text than that of the page"' ELSE '' END, '}}]') ELSE '{"@type":"Thing"}' END, '</script></head><body><h1> Nhà  ', p_name, '</h1>',
        '<div class="address">Lê Lợi, ', p_brand, '</div>', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('<div class="price big">', p_size, ' tỷ</div>') END,
        '<div class="info-attr"><span>Diện tích</span><span>', p_size, ' m2</span></div><div class="info-content-body">short<br>text</div>',
        CASE WHEN p_partkey % 5 = 0 THEN concat('<iframe src="https://maps.example.org/?q=', 10.5 + p_size, ',106.25&amp;z=3"></iframe>') ELSE '' END, '</body></html>')"""
    )
    d = read(spark, sf, "part").select("p_partkey", html.detail_record(page, F.concat(F.lit("https://site.example.org/nha-id"), F.col("p_partkey").cast("string"))).alias("r"))
    return d.select("p_partkey", "r.id", "r.title", "r.address", "r.price", "r.property_type", "r.description", F.col("r.attributes")["diện tích"].alias("area"), "r.latitude", "r.longitude")


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS id, 'Nhà ' || p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_size || ' tỷ' END AS price, p_brand AS address FROM part WHERE p_partkey % 4 <> 0"""
)
def page_lists(spark, sf):
    """List pages of ten blocks; blocks without an id are passed over."""
    block = F.expr(
        """concat('<div class="prop-info"><a href="/ban-nha', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('-id', p_partkey) END, '"><h2 class="prop-title">Nhà ', p_name, '</h2></a><div class="prop-addr">', p_brand, '</div>',
        CASE WHEN p_partkey % 3 = 0 THEN concat('<div class="price">', p_size, ' tỷ</div>') ELSE '' END, '</div>')"""
    )
    pages = read(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("page")).agg(F.concat_ws("", F.collect_list(block)).alias("html"))
    rows = pages.select(F.explode(html.listing_blocks(F.col("html"))).alias("b"))
    return rows.select(store.listing_id(F.col("b.url")).alias("id"), "b.title", "b.price", "b.address")


@query(
    """SELECT CAST(first_day AS VARCHAR) AS day, count(*) AS new_users FROM (SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY ALL) GROUP BY ALL"""
)
def incremental_ids(spark, sf):
    first = store.first_seen(read(spark, sf, "events").select("user_id", "ts"), "user_id", F.to_date("ts"))
    return first.groupBy(F.col("first").cast("string").alias("day")).agg(F.count("*").alias("new_users"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 12:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 12:00:00') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def new_ids_only(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts")
    seen, later = e.filter("ts < TIMESTAMP '2024-01-01 12:00:00'"), e.filter("ts >= TIMESTAMP '2024-01-01 12:00:00'")
    first = later.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    fresh = store.new_records(first, seen, "user_id")
    return fresh.select("event_id", F.col("user_id").cast("long").alias("user_id"))


_GATE_ROWS = """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 250 ELSE 50 END AS chars, c_custkey % 4 <> 0 AS priced, c_custkey % 5 < 3 AS placed, c_custkey % 6 IN (0, 1) AS target,
  c_custkey % 50 = 7 AS called, c_custkey % 50 IN (7, 8) AS plain FROM customer)"""


@query(
    _GATE_ROWS
    + """, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(chars >= 200 AS INTEGER)) AS long, avg(CAST(priced AS INTEGER)) AS priced, avg(CAST(placed AS INTEGER)) AS placed,
  CAST(count(*) FILTER (target) AS DOUBLE) AS target, CAST(count(*) FILTER (called) AS DOUBLE) AS called, CAST(count(*) FILTER (plain) AS DOUBLE) AS plain FROM r),
c AS (SELECT 'rows' AS metric, n AS value, 8000.0::DOUBLE AS threshold, false AS ceiling FROM s UNION ALL SELECT 'long_share', long, 0.9::DOUBLE, false FROM s UNION ALL SELECT 'price_share', priced, 0.8::DOUBLE, false FROM s
  UNION ALL SELECT 'place_share', placed, 0.7::DOUBLE, false FROM s UNION ALL SELECT 'target_rows', target, 3000.0::DOUBLE, false FROM s UNION ALL SELECT 'phones', called, 0.0::DOUBLE, true FROM s
  UNION ALL SELECT 'phones_independent', plain, 0.0::DOUBLE, true FROM s)
SELECT metric, round(value, 6) AS value, threshold, CASE WHEN ceiling THEN value <= threshold ELSE value >= threshold END AS passed FROM c"""
)
def qa_gate(spark, sf):
    """Gateway records and pages through their views: a called number is one that both detectors see, thirteen digits in a row
    only the plain one."""
    c = read(spark, sf, "customer").selectExpr(
        "c_custkey AS k",
        "concat(repeat('a ', CASE WHEN c_custkey % 3 = 0 THEN 125 ELSE 25 END)) AS words",
        "CASE WHEN c_custkey % 50 = 7 THEN 'LH 0901234567' WHEN c_custkey % 50 = 8 THEN '8490123456789' ELSE 'x' END AS note",
        "CASE c_custkey % 6 WHEN 0 THEN 'Tân Bình' WHEN 1 THEN 'Quận 12' WHEN 2 THEN 'Quận 1' ELSE NULL END AS place",
    )
    gateway = c.filter("k % 2 = 0").selectExpr(
        "words AS body", "note AS subject", "CASE WHEN k % 4 <> 0 THEN 5e9 END AS price", "CASE WHEN k % 5 = 0 THEN 'P.1' END AS ward_name", "CASE WHEN k % 5 = 1 THEN 'P.2' END AS ward_name_v3",
        "CASE WHEN k % 5 = 2 THEN 10.5 END AS latitude", "CASE WHEN k % 5 = 2 THEN 106.5 ELSE 0.0 END AS longitude", "place AS area_name",
    )
    pages = c.filter("k % 2 = 1").selectExpr(
        "words AS description", "note AS title", "CASE WHEN k % 3 = 0 THEN 5e9 END AS price_vnd_ld", "CASE WHEN k % 3 = 0 THEN '' ELSE '5 tỷ' END AS price_text",
        "concat(CASE WHEN k % 5 < 2 THEN 'Phường 1, ' ELSE '' END, coalesce(place, 'Gò Vấp')) AS address", "CASE WHEN k % 5 = 2 THEN 10.5 ELSE 0.0 END AS latitude", "106.5 AS longitude",
    )
    stats, _ = gate.collect([gate.gateway_view(gateway, "gateway"), gate.page_view(pages, "pages")])
    return pipeline.gate(stats).withColumn("value", F.round("value", 6))


def _gold(spark, sf):
    """Listings with labels, some of which the text does not state, states otherwise or states in words that are not read."""
    p = read(spark, sf, "part").selectExpr(
        "p_partkey AS list_id", "'Bán' AS subject",
        """concat('Nhà ', p_size % 5 + 2, CASE WHEN p_partkey % 7 = 0 THEN ' phòng khách' ELSE ' phòng ngủ' END, '. Hẻm thông thoáng, yên tĩnh, an ninh, sạch sẽ. Nhà ', p_size % 5 + 7, ' tầng. Gần chợ, gần trường, gần công viên xanh. DT ',
        p_size + 20, 'm2') AS body""",
        "CAST(p_size + 20 + CASE WHEN p_partkey % 3 = 0 THEN 0.25 ELSE 0 END AS DOUBLE) AS size", "p_size % 5 + 2 + CASE WHEN p_partkey % 5 = 0 THEN 60 ELSE 0 END AS rooms",
        "CASE WHEN p_partkey % 2 = 0 THEN p_size % 5 + 7 ELSE 0 END AS floors", "CAST(NULL AS INT) AS toilets",
    )
    return gold.judged(gold.build(p, "list_id", size=1 << 30))


_GOLD = """WITH g AS (SELECT 'area_m2' AS field, p_partkey % 3 <> 0 AS stated, true AS said, true AS ok FROM part
  UNION ALL SELECT 'bedrooms', p_partkey % 5 <> 0, p_partkey % 7 <> 0, p_partkey % 5 <> 0 FROM part UNION ALL SELECT 'floors', true, true, true FROM part WHERE p_partkey % 2 = 0)"""


@query(
    _GOLD
    + """, n AS (SELECT field, count(*) FILTER (stated AND said AND ok) AS tp, count(*) FILTER (stated AND said) AS said, count(*) FILTER (stated) AS gold, count(*) AS n FROM g GROUP BY ALL)
SELECT field, round(tp / said, 6) AS precision_, round(tp / gold, 6) AS recall_, round(2 * tp / (said + gold), 6) AS f1, gold AS n_gold_verbatim, n AS n_gold_total FROM n"""
)
def gold_scores(spark, sf):
    m = gold.measure(_gold(spark, sf))
    return m.select("field", F.round("precision", 6).alias("precision_"), F.round("recall", 6).alias("recall_"), F.round("f1", 6).alias("f1"), "n_gold_verbatim", "n_gold_total")


@query(_GOLD + " SELECT field, count(*) FILTER (stated AND said AND ok) AS correct, count(*) FILTER (stated AND NOT said) AS missed, 0::BIGINT AS off_by_one, 0::BIGINT AS off_by_more FROM g GROUP BY ALL")
def gold_errors(spark, sf):
    return gold.error_breakdown(_gold(spark, sf))


_STRATA = """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders),
s AS (SELECT o_orderkey, o_custkey, o_orderstatus || '|' || CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 ELSE 3 END AS own FROM orders, q),
t AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY own) >= 10 THEN own ELSE 'other' END AS stratum FROM s),
f AS (SELECT o_custkey AS grp, arg_min(stratum, o_orderkey) AS stratum FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || grp), grp) AS place, round_even(count(*) OVER (PARTITION BY stratum) * 0.2, 0) AS tests FROM f)
"""


def _strata(spark, sf):
    return modeling.with_strata(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice")


@query(_STRATA + "SELECT grp, stratum, CASE WHEN place <= tests THEN 'test' ELSE 'train' END AS role, CAST(CASE WHEN place > tests THEN (place - tests - 1) % 5 END AS INTEGER) AS fold FROM r")
def group_splits(spark, sf):
    return modeling.split_groups(_strata(spark, sf), "o_custkey", "o_orderkey").withColumn("fold", F.col("fold").cast("int"))


@query(
    """SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS place,
  count(*) OVER (PARTITION BY o_orderstatus) AS of_, (SELECT count(*) FROM orders) AS n FROM orders) WHERE place <= greatest(1, round_even(of_ * 600 / n, 0))"""
)
def capped_sample(spark, sf):
    return modeling.capped_sample(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 600)


@query(
    """WITH s AS (SELECT CAST(sum(CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS a,
  CAST(sum(CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS b, CAST(count(*) AS VARCHAR) AS n FROM orders)
SELECT substr(sha256(a || '|' || b || '|' || n), 1, 16) AS fingerprint FROM s"""
)
def split_fingerprint(spark, sf):
    return modeling.fingerprint(read(spark, sf, "orders"), "o_orderkey")


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderstatus AS s, median(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 15)
SELECT strftime(m, '%Y-%m') AS month, s AS status, round(v, 4) AS median_price, n, coalesce(date_diff('month', lag(m) OVER (PARTITION BY s ORDER BY m), m) > 1, false) AS after_gap FROM m"""
)
def monthly_median(spark, sf):
    m = tables.medians_by_month(read(spark, sf, "orders"), "o_orderdate", F.col("o_totalprice"), "o_orderstatus")
    return m.select("month", F.col("by").alias("status"), F.round("median", 4).alias("median_price"), "n", "after_gap")


@query(
    """SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source NOT IN ('src0', 'src1')) AS others FROM documents GROUP BY ALL"""
)
def pivot_by_source(spark, sf):
    return tables.counts_by(read(spark, sf, "documents"), "lang", F.col("source"), ["src0", "src1"])


@query(
    """WITH b AS (SELECT ln(o_totalprice) AS v FROM orders), r AS (SELECT min(v) AS lo, max(v) AS hi FROM b)
SELECT CAST(least(floor((v - lo) / (hi - lo) * 60), 59) AS BIGINT) AS bin, count(*) AS n FROM b, r GROUP BY ALL"""
)
def price_histogram(spark, sf):
    return tables.histogram(read(spark, sf, "orders"), F.log("o_totalprice")).select("bin", "n")


_RESULTS = "(SELECT p_brand AS model, round(avg(p_retailprice), 6) AS mae, round(stddev_samp(p_retailprice), 6) AS std FROM part GROUP BY ALL)"


def _results(spark, sf):
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_retailprice"), 6).alias("mae"), F.round(F.stddev_samp("p_retailprice"), 6).alias("std"))


@query(f"WITH r AS {_RESULTS}, b AS (SELECT mae + std AS top FROM r ORDER BY mae LIMIT 1) SELECT model, mae, std FROM r, b WHERE mae <= top")
def leading_models(spark, sf):
    return pipeline.leaders(_results(spark, sf), "mae", "std")


@query(f"WITH r AS {_RESULTS} SELECT model, mae, round(mae - first_value(mae) OVER (ORDER BY model), 6) AS to_first, round(mae - lag(mae) OVER (ORDER BY model), 6) AS to_previous FROM r")
def delta_table(spark, sf):
    return tables.changes(_results(spark, sf), "mae", "model").select("model", "mae", "to_first", "to_previous")


@query(
    """SELECT 'c_custkey' AS "column", 'bigint' AS type, CAST(1 AS DOUBLE) AS non_null_share, substr(min(CAST(c_custkey AS VARCHAR)), 1, 40) AS example FROM customer
  UNION ALL SELECT 'c_name', 'string', 1, substr(min(c_name), 1, 40) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', 1, substr(min(c_mktsegment), 1, 40) FROM customer"""
)
def schema_profile(spark, sf):
    return store.profile(read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf):
    at = f"{shared.shared_root(spark)}/stream-{uuid.uuid4().hex}"
    shared.remove_at_exit(spark, at)
    one = read(spark, sf, "events").select("event_id", "user_id")
    one.unionByName(one).write.parquet(f"{at}/raw")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.stream_table(spark, f"{at}/raw"), f"{at}/store", f"{at}/state", "event_id").awaitTermination()
    return spark.read.parquet(f"{at}/store").select("event_id")


@query()
def model_errors(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", F.when(F.pmod(F.xxhash64("l_orderkey"), F.lit(5)) == 0, "test").otherwise("train").alias("role"))
    prep = modeling.feature_pipeline(["l_quantity", "l_discount"], ["l_returnflag"]).fit(d.filter("role = 'train'")).transform(d)
    prep = shared.cut(prep.select("l_extendedprice", "features", "role"))  # six models read it, some of them many times
    train, test = prep.filter("role = 'train'"), prep.filter("role = 'test'")
    return modeling.evaluate_all(modeling.registry(), train, test, "l_extendedprice")


def _dated_listings(spark, sf):
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("fold", (F.col("l_orderkey") % 5).cast("int"))


_ERRORS = """count(*) AS n, round(sqrt(avg((p - l_extendedprice) ** 2)), 4) AS rmse, round(avg(abs(p - l_extendedprice)), 4) AS mae,
  round(median(abs(p - l_extendedprice) / l_extendedprice) * 100, 6) AS mdape"""
#: Training rows by case k, as table t; test rows as table e; predictions by the back-off median as table x.
_CASES = """, d AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate, p_brand, p_type, l_extendedprice / l_quantity AS u FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT k.*, d.* FROM d JOIN k ON {train}), e AS (SELECT k.*, d.* FROM d JOIN k ON {test}),
m2 AS (SELECT k, p_brand, p_type, median(u) AS m2 FROM t GROUP BY ALL), m1 AS (SELECT k, p_brand, median(u) AS m1 FROM t GROUP BY ALL), m0 AS (SELECT k, median(u) AS m0 FROM t GROUP BY ALL),
x AS (SELECT e.*, coalesce(m2, m1, m0) * l_quantity AS p FROM e LEFT JOIN m2 USING (k, p_brand, p_type) LEFT JOIN m1 USING (k, p_brand) LEFT JOIN m0 USING (k))
"""
_BROKER = experiments.backoff(GROUPS, "l_extendedprice", "l_quantity")


def _rounded(df, *by):
    return df.select(*by, "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mdape", 6).alias("mdape"))


@query("WITH k AS (SELECT CAST(range AS INTEGER) AS k FROM range(5))" + _CASES.format(train="l_orderkey % 5 <> k", test="l_orderkey % 5 = k") + f"SELECT k AS fold, {_ERRORS} FROM x GROUP BY ALL")
def broker_cross_validation(spark, sf):
    return _rounded(experiments.cross_validate(_BROKER, _dated_listings(spark, sf), "l_extendedprice"), "fold")


@query(
    "WITH k AS (SELECT 'later' AS k)" + _CASES.format(train="l_shipdate < TIMESTAMP '1996-01-01'", test="l_shipdate >= TIMESTAMP '1996-01-01'") + f"SELECT k AS period, {_ERRORS} FROM x GROUP BY ALL"
)
def temporal_transfer(spark, sf):
    d = _dated_listings(spark, sf)
    later = _BROKER(d.filter("l_shipdate < TIMESTAMP '1996-01-01'"), d.filter("l_shipdate >= TIMESTAMP '1996-01-01'"))
    return _rounded(experiments.errors({"later": later}, "l_extendedprice", "period"), "period")


@query(
    "WITH k AS (SELECT p_brand AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL ORDER BY count(*) DESC, p_brand LIMIT 5)"
    + _CASES.format(train="p_brand <> k", test="p_brand = k")
    + f"SELECT k AS p_brand, {_ERRORS} FROM x GROUP BY ALL"
)
def broker_leave_one_out(spark, sf):
    return _rounded(experiments.leave_one_out(_BROKER, _dated_listings(spark, sf), "p_brand", "l_extendedprice"), "p_brand")


def _ridge(categorical):
    return experiments.linear(["l_quantity"], categorical, modeling.registry(fast=True)["ridge"], "l_extendedprice")


@query()
def feature_ablation(spark, sf):
    models = {"quantity": _ridge([]), "quantity, brand": _ridge(["p_brand"]), "broker": _BROKER, "broker in fences": experiments.fenced(_BROKER, "p_brand", F.log(F.col("l_extendedprice") / F.col("l_quantity")))}
    return experiments.catalogue(models, _dated_listings(spark, sf).select("fold", "l_extendedprice", "l_quantity", *GROUPS), "l_extendedprice")


@query(
    f"WITH k AS (SELECT unnest({list(experiments.FRACTIONS)}) AS k)"
    + _CASES.format(train="l_orderkey % 5 > 0 AND CAST(CAST('0x' || substr(md5('42|' || l_orderkey), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0 < k", test="l_orderkey % 5 = 0")
    + f", z AS (SELECT CAST(k AS DOUBLE) AS fraction, {_ERRORS}, median(abs(p - l_extendedprice) / l_extendedprice) * 100 AS m FROM x GROUP BY ALL) SELECT * EXCLUDE m, round(m - lag(m) OVER (ORDER BY fraction), 5) AS change FROM z"
)
def learning_curve(spark, sf):
    d = _dated_listings(spark, sf)
    c = experiments.learning_curve(_BROKER, d.filter("fold > 0"), d.filter("fold = 0"), "l_orderkey", "l_extendedprice")
    return _rounded(c.withColumn("change", F.round("change", 5)), "fraction", "change")


def _importance_sql() -> str:
    """The back-off median's error with one column of the test rows dealt anew, by md5 order of seed and id, five times."""
    parts = []
    for seed in range(42, 47):
        for c in ("l_quantity", "p_brand", "p_type"):
            own = ", ".join(f"v.{x}" if x == c else f"e.{x}" for x in ("l_quantity", "p_brand", "p_type"))
            parts.append(f"SELECT '{c}' AS c, {seed} AS seed, e.l_extendedprice, {own} FROM e JOIN (SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || id), id) AS at FROM e) v ON e.place = v.at")
    return (
        """WITH d AS (SELECT l_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_extendedprice, l_quantity, p_brand, p_type, l_extendedprice / l_quantity AS u FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT * FROM d WHERE l_orderkey % 5 > 0), e AS (SELECT *, row_number() OVER (ORDER BY id) AS place FROM d WHERE l_orderkey % 5 = 0),
m2 AS (SELECT p_brand, p_type, median(u) AS m2 FROM t GROUP BY ALL), m1 AS (SELECT p_brand, median(u) AS m1 FROM t GROUP BY ALL), m0 AS (SELECT median(u) AS m0 FROM t),
s AS (SELECT '' AS c, 0 AS seed, l_extendedprice, l_quantity, p_brand, p_type FROM e UNION ALL """
        + " UNION ALL ".join(parts)
        + """), r AS (SELECT c, seed, median(abs(coalesce(m2, m1, m0) * l_quantity - l_extendedprice) / l_extendedprice) * 100 AS mdape
  FROM s LEFT JOIN m2 USING (p_brand, p_type) LEFT JOIN m1 USING (p_brand), m0 GROUP BY ALL)
SELECT c AS "column", round(avg(mdape - (SELECT mdape FROM r WHERE c = '')), 5) AS importance, round(stddev_samp(mdape), 5) AS std FROM r WHERE c <> '' GROUP BY ALL"""
    )


@query(_importance_sql())
def permutation_importance(spark, sf):
    d = _dated_listings(spark, sf).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    test = d.filter("fold = 0")
    levels = [shared.cut(level) for level in modeling.fit_backoff(d.filter("fold > 0"), GROUPS, "l_extendedprice", "l_quantity")]
    found = experiments.permutation_importance(lambda t: modeling.predict_backoff(t, levels, GROUPS, "l_quantity"), test, ["l_quantity", "p_brand", "p_type"], "id", "l_extendedprice")
    return found.select("column", F.round("importance", 5).alias("importance"), F.round("std", 5).alias("std"))


@query()
def prepared_listings(spark, sf):
    d = listings(spark, sf).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("listing_id"),
        F.concat(F.lit("Nhà "), "p_type").alias("title"),
        F.concat(F.lit("Bán nhà mặt tiền giá "), F.round("l_extendedprice", 0).cast("long"), F.lit(" triệu, sổ hồng "), "p_brand").alias("description"),
        (F.col("l_extendedprice") * 1e6).alias("total_price_vnd"),
        F.col("l_quantity").alias("area_m2"),
        F.col("p_brand").alias("district"),
        F.col("p_type").alias("ward"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.lit(False).alias("is_rental"),
        F.lit("a").alias("source"),
        *(F.lit(None).cast("double").alias(c) for c in ("bedrooms", "bathrooms", "floors", "frontage_m", "alley_width_m")),
        *(F.lit(None).cast("string").alias(c) for c in ("legal_status", "direction", "position")),
    )
    return pipeline.prepare(d)[0].select("listing_id", "duplicate_group", "description_clean", "description_tokens", F.round("price_per_m2", 4).alias("price_per_m2"))


@query("SELECT c_custkey, lower(c_name) AS key FROM customer")
def accent_free(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", flat(F.translate(F.col("c_name"), "aeu", "áếữ")).alias("key"))


@query(
    """SELECT 'g-' || p_partkey AS listing_id, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)), '%Y-%m-%d') AS day,
  CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice * 1000000 ELSE 5000000000 END AS total, CASE WHEN p_partkey % 3 <> 0 THEN 'structured' ELSE 'total' END AS price_kind,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(20 + p_size AS DOUBLE) END AS area_m2, CAST(p_size % 5 + 1 AS DOUBLE) AS bedrooms, true AS bedrooms_from_text,
  ['mặt tiền', 'hẻm', 'không rõ', 'không rõ'][p_partkey % 4 + 1] AS position, ['không rõ', 'sổ hồng', 'hợp đồng mua bán', 'giấy tay'][p_size % 4 + 1] AS legal_status,
  ['không rõ', 'Đông', 'Tây', 'Nam', 'Bắc', 'Đông Bắc', 'Đông Nam', 'Tây Bắc', 'Tây Nam'][p_size % 9 + 1] AS direction, CASE p_partkey % 4 WHEN 3 THEN 'Biệt thự' ELSE 'Nhà phố' END AS property_type,
  'Phường ' || p_size AS ward, 'Quận ' || (p_size % 5 + 3) AS district, 'old' AS ward_frame FROM part"""
)
def gateway_listings(spark, sf):
    records = read(spark, sf, "part").selectExpr(
        "p_partkey AS list_id", "1704067200000 + p_partkey % 365 * 86400000 AS list_time", "'Bán nhà' AS subject", "concat(p_size % 5 + 1, ' phòng ngủ') AS body",
        "CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice * 1000000 END AS price", "'5 tỷ' AS price_string", "CAST(NULL AS DOUBLE) AS price_million_per_m2", "CASE WHEN p_partkey % 2 = 0 THEN 20 + p_size END AS size",
        "CAST(NULL AS INT) AS rooms", "CAST(NULL AS INT) AS floors", "CAST(NULL AS INT) AS toilets", "CAST(NULL AS DOUBLE) AS width", "p_partkey % 4 + 1 AS house_type", "p_size % 4 AS property_legal_document",
        "p_size % 9 AS direction", "'Nhà' AS category_name", "'' AS street_name", "concat('P.', p_size) AS ward_name", "CAST(NULL AS STRING) AS ward_name_v3", "concat('Q.', p_size % 5 + 3) AS area_name",
        "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude", "CAST(NULL AS TIMESTAMP) AS _collected_at",
    )
    mapping = _mapping(spark, sf).withColumn("new_ward", F.col("new_ward").cast("string"))
    out = sources.unified([sources.from_gateway(records, mapping, "g")]).withColumns({"day": F.date_format("published_at", "yyyy-MM-dd"), "total": F.col("total_price_vnd")})
    return out.select("listing_id", "day", "total", "price_kind", "area_m2", "bedrooms", "bedrooms_from_text", "position", "legal_status", "direction", "property_type", "ward", "district", "ward_frame")


@query(
    """SELECT 'p-' || p_partkey AS listing_id, '2024-12-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS day, CASE WHEN p_partkey % 2 = 0 THEN 5000000000.0::DOUBLE ELSE p_size * 1e9::DOUBLE END AS total,
  CASE WHEN p_partkey % 2 = 0 THEN 'structured' ELSE 'total' END AS price_kind, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size + 20 AS DOUBLE) ELSE CAST(p_size + 30 AS DOUBLE) END AS area_m2, p_partkey % 3 <> 0 AS area_from_text,
  CASE WHEN p_partkey % 5 = 0 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS bedrooms, 3.0::DOUBLE AS floors, true AS floors_from_text, CASE WHEN p_partkey % 2 = 0 THEN 'sổ đỏ' ELSE 'sổ hồng' END AS legal_status, 'Lê Lợi' AS street,
  'Phường ' || (p_size % 9 + 1) AS ward, 'Quận ' || (p_size % 5 + 3) AS district, 'old' AS ward_frame FROM part"""
)
def page_listings(spark, sf):
    records = read(spark, sf, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS listing_id", "'Nhà 1 trệt 2 lầu' AS title", "concat('Sổ hồng, 2 phòng ngủ, dt ', p_size + 30, 'm2') AS description", "CASE WHEN p_partkey % 2 = 0 THEN '5000000000' END AS price_vnd_ld",
        "concat(p_size, ' tỷ') AS price_text", "CASE WHEN p_partkey % 3 = 0 THEN concat(p_size + 20, ' m2') ELSE '' END AS usable_area_text", "CAST(NULL AS STRING) AS land_area_text", "CAST(NULL AS STRING) AS area_text",
        "CASE WHEN p_partkey % 5 = 0 THEN '3' END AS bedrooms_text", "CAST(NULL AS STRING) AS floors_text", "CAST(NULL AS STRING) AS bathrooms_text", "CAST(NULL AS STRING) AS frontage_text",
        "CASE WHEN p_partkey % 2 = 0 THEN 'sổ đỏ' ELSE ' ' END AS legal_status", "'Đông' AS direction", "'House' AS property_type_ld", "concat('Lê Lợi, Phường ', p_size % 9 + 1, ', Quận ', p_size % 5 + 3, ', TPHCM') AS address",
        "concat(lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0'), '/12/2024') AS posted_at_text", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude", "CAST(NULL AS TIMESTAMP) AS _collected_at",
    )
    mapping = _mapping(spark, sf).withColumn("new_ward", F.col("new_ward").cast("string"))
    out = sources.unified([sources.from_pages(records, mapping, "p")]).withColumns({"day": F.date_format("published_at", "yyyy-MM-dd"), "total": F.col("total_price_vnd")})
    return out.select("listing_id", "day", "total", "price_kind", "area_m2", "area_from_text", "bedrooms", "floors", "floors_from_text", "legal_status", "street", "ward", "district", "ward_frame")


@query(
    """SELECT 'h-' || p_partkey AS listing_id, p_retailprice * 1000000 AS total, CAST(p_size AS DOUBLE) AS area_m2, CASE WHEN p_partkey % 2 = 0 THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END AS floors, p_partkey % 2 = 1 AS floors_from_text,
  CASE WHEN p_partkey % 3 = 0 THEN 'Đông' ELSE 'không rõ' END AS direction, 'Biệt thự' AS property_type, 'Phường ' || (p_size % 9 + 1) AS ward, 'Quận ' || (p_size % 5 + 3) AS district, 'không rõ' AS street FROM part"""
)
def history_listings(spark, sf):
    table = read(spark, sf, "part").selectExpr(
        "p_partkey AS k", "'Nhà 3 tầng' AS name", "CAST(NULL AS STRING) AS description", "p_retailprice * 1000000 AS price", "CAST(NULL AS TIMESTAMP) AS published_at", "CAST(p_size AS DOUBLE) AS area", "2 AS bedroom_count", "1 AS bathroom_count",
        "CASE WHEN p_partkey % 2 = 0 THEN 5 END AS floor_count", "CAST(NULL AS DOUBLE) AS frontage_width", "CAST(NULL AS DOUBLE) AS road_width", "CASE WHEN p_partkey % 3 = 0 THEN 'Đông' END AS house_direction", "'Biệt thự' AS property_type_name",
        "CAST(NULL AS STRING) AS street_name", "concat('P.', p_size % 9 + 1) AS ward_name", "concat('Q.', p_size % 5 + 3) AS district_name",
    )
    out = sources.unified([sources.from_history(table, "h", "k")]).withColumn("total", F.col("total_price_vnd"))
    return out.select("listing_id", "total", "area_m2", "floors", "floors_from_text", "direction", "property_type", "ward", "district", "street")
