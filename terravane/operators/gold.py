"""Gold labels of listings and the quality of what is read from their texts: whether a text states a label, scores, kinds of errors."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import extract
from terravane.functions.text import contexts, flat

SEED, SIZE = 42, 200
#: Characters beside a number in which a word must tell what it is.
REACH = 26
F1_TARGET, REQUIRED = 0.9, ("area_m2", "bedrooms", "floors")


@dataclass(frozen=True)
class Measured:
    """A field: the column of its label, how far a value may be off (a share; 0: equal as whole numbers), its name in reports and the
    words beside a number that state it."""

    label: str
    tolerance: float
    title: str
    words: str


#: The measured fields.
FIELDS = {
    "area_m2": Measured("size", 0.02, "Diện tích (m²)", r"(?:m2|m²|mv|dt|dien\s*tich|cong\s*nhan|dtcn|dtsd)"),
    "bedrooms": Measured("rooms", 0.0, "Số phòng ngủ", r"(?:pn|phong\s*ngu|phong|ngu|bedroom|\bp\b)"),
    "bathrooms": Measured("toilets", 0.0, "Số nhà tắm", r"(?:wc|toilet|nha\s*tam|phong\s*tam|\bvs\b)"),
    "floors": Measured("floors", 0.0, "Số tầng", r"(?:tang|lau\b(?!\s*(?:dai|nam))|(?<!phong )(?<!nha )tam\b|me\b(?!\s*con)|tret|lung|cap\s*4|ket\s*cau)"),
}
ERRORS = ("correct", "missed", "off by one", "off by more")


def spellings(number: Column) -> Column:
    """A pattern of the ways to write a number: whole numbers without decimals, others with a dot or a comma."""
    plain = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    return F.concat(F.lit(r"(?<![\d.,])"), F.replace(plain, F.lit("."), F.lit("[.,]")), F.lit(r"(?!\d)"))


def stated(number: Column, text: Column, words: str) -> Column:
    """Whether the text (flat) has the number with one of the words within REACH characters on a side. Null numbers are not stated."""
    around = contexts(text, F.coalesce(spellings(number), F.lit("(?!)")), REACH)
    return F.exists(around, lambda c: c["left"].rlike(words) | c["right"].rlike(words))


def agrees(predicted: Column, gold: Column, tolerance: Column) -> Column:
    whole = F.bround(predicted, 0) == F.bround(gold, 0)
    return F.when(tolerance == 0, whole).otherwise(F.abs(predicted - gold) <= tolerance * F.greatest(F.abs(gold), F.lit(1e-9)))


def build(records: DataFrame, id_: str, title: str = "subject", body: str = "body", size: int = SIZE, fields: Mapping[str, Measured] = FIELDS, seed: int = SEED) -> DataFrame:
    """Gold labels (id, text, field, gold, stated): one row for each field that a structured column of a record fills (not 0).

    ``size`` records with an area label and a body are drawn, those with the least md5 of seed and id: the draw does not
    depend on the order of rows, and only that many rows leave a task.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0
    pool = records.filter(filled(fields["area_m2"].label) & (F.coalesce(F.col(body), F.lit("")) != ""))
    drawn = pool.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string"))), id_).limit(size)
    text = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.col(body))
    drawn = drawn.select(F.col(id_).alias("id"), text.alias("text"), flat(text).alias("flat"), *(F.col(m.label).cast("double").alias(f"label_{f}") for f, m in fields.items()))
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"label_{f}").alias("gold"), stated(F.col(f"label_{f}"), F.col("flat"), m.words).alias("stated")) for f, m in fields.items()]
    return drawn.select("id", "text", F.explode(F.array(*rows)).alias("r")).select("id", "text", "r.*").filter("gold <> 0")


def judged(gold: DataFrame, fields: Mapping[str, Measured] = FIELDS) -> DataFrame:
    """Gold labels with ``predicted`` (what the extraction reads from the text alone) and ``outcome``, one of ERRORS."""
    own = extract.extract_all(F.col("text"), F.lit(None).cast("string"))
    pick = lambda values: F.coalesce(*(F.when(F.col("field") == f, v) for f, v in values.items()))
    rows = gold.withColumn("predicted", pick({f: own[f].cast("double") for f in fields}))
    right = agrees(F.col("predicted"), F.col("gold"), pick({f: F.lit(m.tolerance) for f, m in fields.items()}))
    near = F.abs(F.col("predicted") - F.col("gold")) <= 1
    outcome = F.when(F.col("predicted").isNull(), ERRORS[1]).when(right, ERRORS[0]).when(near, ERRORS[2]).otherwise(ERRORS[3])
    return rows.withColumn("outcome", outcome)


def measure(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 by field of judged labels that the text states, and how many labels there are of both kinds."""
    said = F.col("stated")
    n = rows.groupBy("field").agg(
        F.count_if(said & (F.col("outcome") == ERRORS[0])).alias("true_positive"),
        F.count_if(said & F.col("predicted").isNotNull()).alias("n_predicted"),
        F.count_if(said).alias("n_gold_verbatim"),
        F.count("*").alias("n_gold_total"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    n = n.withColumns({"precision": ratio("true_positive", "n_predicted"), "recall": ratio("true_positive", "n_gold_verbatim")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return n.select("field", "precision", "recall", f1.alias("f1"), "n_gold_verbatim", "n_gold_total")


def error_breakdown(rows: DataFrame) -> DataFrame:
    """How many stated labels had each outcome, by field; a column per outcome."""
    return rows.filter("stated").groupBy("field").agg(*(F.count_if(F.col("outcome") == e).alias(e.replace(" ", "_")) for e in ERRORS))


def report(scores: DataFrame, errors: DataFrame, fields: Mapping[str, Measured] = FIELDS) -> str:
    """Both tables as markdown, a row for each field; fields that reach the target are marked."""
    own, wrong = ({r["field"]: r for r in d.collect()} for d in (scores, errors))  # one row per field
    text = lambda v: f"{v:.3f}".replace(".", ",")
    lines = ["# Chất lượng trích xuất", "", "| Trường | Nhãn được nêu | Precision | Recall | F1 |", "|---|---:|---:|---:|---:|"]
    for f, m in fields.items():
        if f in own:
            r = own[f]
            mark = " ✓" if f in REQUIRED and r["f1"] >= F1_TARGET else ""
            lines.append(f"| {m.title} | {r['n_gold_verbatim']}/{r['n_gold_total']} | {text(r['precision'])} | {text(r['recall'])} | **{text(r['f1'])}**{mark} |")
    lines += ["", "| Trường | Đúng | Bỏ sót | Lệch 1 đơn vị | Lệch khác |", "|---|---:|---:|---:|---:|"]
    for f, m in fields.items():
        if f in wrong:
            lines.append(f"| {m.title} | " + " | ".join(str(wrong[f][e.replace(" ", "_")]) for e in ERRORS) + " |")
    return "\n".join(lines) + "\n"
