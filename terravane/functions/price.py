"""Prices in text, as column expressions: an ordered cascade of readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions.text import deaccent, flat, group, let

BILLION, MILLION = 1e9, 1e6

#: Number, units and words, on accent-free lower-case text.
NUMBER = r"(\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
BILLIONS = r"\s*(?:ty|ti\b|billion|b\b)"
MILLIONS = r"\s*(?:trieu|tr\b|cu\b|million|m\b)"
PER_M2 = r"\s*(?:/|tren|moi|per)?\s*m\s*2"
NEGOTIABLE = r"thoa\s*thuan|lien\s*he|thuong\s*luong|khong\s*ro|dang\s*cap\s*nhat|gia\s*thoa|call|contact"
RENTAL = r"cho\s*thue|can\s*thue|gia\s*thue|thue\s*nha|thue\s*phong|/\s*thang|mot\s*thang|1\s*thang|month"

#: Least price of a sale.
LEAST_SALE = 3e8


def number(token: Column, billions: bool = False) -> Column:
    """A number under either locale. With both separators the last is the decimal one; a separator before exactly three digits
    groups thousands, but a single one before a unit of billions is decimal."""
    return let(token, lambda x: _read_number(x, billions))


def _read_number(token: Column, billions: bool) -> Column:
    comma_last = F.instr(F.reverse(token), ",") < F.instr(F.reverse(token), ".")
    grouped = token.rlike(r"^\d{1,3}([.,]\d{3})+$")
    if billions:
        grouped = grouped & token.rlike(r"[.,].*[.,]")
    both = token.contains(",") & token.contains(".")
    plain = (
        F.when(both & comma_last, F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(token, F.lit(","), F.lit("")))
        .when(grouped, F.regexp_replace(token, "[.,]", ""))
        .otherwise(F.replace(token, F.lit(","), F.lit(".")))
    )
    return let(plain, lambda p: F.when(p.rlike(r"^\d+(\.\d+)?$"), p.try_cast("double")))


def round_vnd(c: Column) -> Column:
    """To 1,000, halves to even."""
    return F.bround(c / 1000, 0) * 1000


def parse_price(text: Column, area: Column | None = None) -> Column:
    """Struct (total, unit, kind). Kinds: missing, negotiable, unit, total. A unit price gives a total only with an area."""
    area = F.lit(None).cast("double") if area is None else area.cast("double")
    return let(flat(text), lambda t: _read_price(t, area))


def _read_price(t: Column, area: Column) -> Column:
    none = F.lit(None).cast("double")

    def reading(kind: str, total: Column, unit: Column = none) -> Column:
        return F.struct(round_vnd(total).alias("total"), round_vnd(unit).alias("unit"), F.lit(kind).alias("kind"))

    def amount(pattern: str, i: int = 1, billions: bool = False) -> Column:
        return number(group(t, pattern, i), billions)

    per_million = amount(NUMBER + MILLIONS + PER_M2) * MILLION
    per_billion = amount(NUMBER + BILLIONS + PER_M2, billions=True) * BILLION
    pair, tail = NUMBER + BILLIONS + r"\s*" + NUMBER + MILLIONS, NUMBER + BILLIONS + r"\s*(\d{1,3})(?!\s*\d)(?!\s*m)"
    both = amount(pair, 1, True) * BILLION + amount(pair, 2) * MILLION
    head, rest = amount(tail, 1, True), group(t, tail, 2)
    tailed = F.when(head == F.floor(head), (head + rest.try_cast("double") / F.pow(F.lit(10.0), F.length(rest))) * BILLION)
    bare = F.replace(F.replace(group(t, r"(\d[\d.,]*\d)"), F.lit(","), F.lit("")), F.lit("."), F.lit("")).try_cast("double")
    billions, millions = amount(NUMBER + BILLIONS, billions=True) * BILLION, amount(NUMBER + MILLIONS) * MILLION
    words = t.rlike(NEGOTIABLE)
    return (
        F.when(t == "", reading("missing", none))
        .when(words & ~t.rlike(r"\d"), reading("negotiable", none))
        .when(per_million.isNotNull(), reading("unit", per_million * area, per_million))
        .when(per_billion.isNotNull(), reading("unit", per_billion * area, per_billion))
        .when(both.isNotNull(), reading("total", both))
        .when(tailed.isNotNull(), reading("total", tailed))
        .when(billions.isNotNull(), reading("total", billions))
        .when(millions.isNotNull(), reading("total", millions))
        .when(bare >= 1e8, reading("total", bare))
        .when(words, reading("negotiable", none))
        .otherwise(reading("missing", none))
    )


def has_total(parsed: Column) -> Column:
    """Whether a parsed price has a total."""
    return parsed["total"].isNotNull()


def numeric_price(c: Column) -> Column:
    """A price given as a number; 0 and 1 stand for undisclosed, infinite ones are none."""
    value = F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    return F.when((value > 1) & ~F.isnan(value) & (value < float("inf")), value)


def deviation(total: Column, unit: Column, area: Column) -> Column:
    """Relative gap between a total and unit price times area; null if one is missing."""
    return F.try_divide(F.abs(total - unit * area), unit * area)


def cross_checks(total: Column, unit: Column, area: Column, tolerance: float = 0.10) -> Column:
    """Whether they agree; what can't be compared does."""
    return F.coalesce(deviation(total, unit, area) <= tolerance, F.lit(True))


def looks_like_rental(title: Column, total: Column) -> Column:
    """A positive price below any sale, or a rental phrase in the title."""
    return F.coalesce((total > 0) & (total < LEAST_SALE), F.lit(False)) | F.coalesce(deaccent(title).rlike(RENTAL), F.lit(False))
