"""Nulls, domain rules, fences, medians, provenance and unification of listing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.text import UNKNOWN
from terravane.operators.shared import cut, quantiles

#: Fixed values.
VALID_AREA, VALID_PRICE = (10.0, 1000.0), (3e8, 1e11)
IQR_FACTOR, IQR_MIN_ROWS, IQR_MIN_SHARE = 1.5, 60, 0.80


def drop_missing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(required))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls by column, which may overlap."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns))


def mark_missing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), unknown: str = UNKNOWN) -> DataFrame:
    """0/1 columns ``<c>_missing``; null or empty categories become unknown."""
    out = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in numeric})
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(unknown)) for c in categorical}) if categorical else out


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that fails; null if none does. A null condition is no failure."""
    return F.coalesce(*(F.when(failed, F.lit(name)) for name, failed in rules))


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, Column]], reason: str = "reason") -> DataFrame:
    return df.withColumn(reason, first_reason(rules))


def hard_rules(area: str = "area_m2", price: str = "total_price_vnd", rental: str = "is_rental") -> list[tuple[str, Column]]:
    return [
        ("area", ~F.col(area).between(*VALID_AREA)),
        ("price", ~F.col(price).between(*VALID_PRICE)),
        ("rental", F.coalesce(F.col(rental), F.lit(False))),
    ]


def tukey(q1: Column, q3: Column, factor: float = IQR_FACTOR) -> tuple[Column, Column]:
    """The bounds of the fence around two quartiles."""
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def fit_fences(df: DataFrame, group: str, value: Column, min_rows: int = IQR_MIN_ROWS, factor: float = IQR_FACTOR) -> DataFrame:
    """Tukey fences of a value by group: (group, n, lo, hi, basis, keep_share), with a row of null group for all rows. Groups below
    ``min_rows`` get the fence of all rows."""
    rows = cut(df.select(F.col(group).alias("grp"), value.alias("v")).filter(F.col("v").isNotNull()))
    lo, hi = tukey(F.col("q0"), F.col("q1"), factor)
    every = rows.agg(F.count("*").alias("all_n")).join(F.broadcast(quantiles(rows, [], F.col("v"), [0.25, 0.75]))).select("all_n", lo.alias("all_lo"), hi.alias("all_hi"))  # one row
    own = quantiles(rows, ["grp"], F.col("v"), [0.25, 0.75]).select(F.col("grp").alias("of"), lo.alias("lo"), hi.alias("hi"))
    own = rows.groupBy("grp").agg(F.count("*").alias("n")).join(own, F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    enough = F.col("n") >= min_rows
    fences = own.join(F.broadcast(every)).select(  # one row
        "grp",
        "n",
        F.when(enough, F.col("lo")).otherwise(F.col("all_lo")).alias("lo"),
        F.when(enough, F.col("hi")).otherwise(F.col("all_hi")).alias("hi"),
        F.when(enough, F.lit("group")).otherwise(F.lit("all")).alias("basis"),
    )
    fences = cut(fences)
    shares = rows.join(fences.select(F.col("grp").alias("g"), "lo", "hi"), F.col("grp").eqNullSafe(F.col("g")))
    shares = shares.groupBy("grp").agg(F.avg(F.col("v").between(F.col("lo"), F.col("hi")).cast("int")).alias("keep_share"))
    joined = fences.join(shares.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    whole = every.select(F.lit(None).cast(df.schema[group].dataType).alias("grp"), F.col("all_n").alias("n"), F.col("all_lo").alias("lo"), F.col("all_hi").alias("hi"), F.lit("whole").alias("basis"), F.lit(None).cast("double").alias("keep_share"))
    return joined.unionByName(whole).withColumnRenamed("grp", group)


def within_fences(df: DataFrame, fences: DataFrame, group: str, value: Column) -> DataFrame:
    """Rows inside their group's fence, bounds included; groups that were not fitted use the fence of all rows. Fences have one row
    per group; Spark broadcasts them if they are small."""
    own = fences.filter("basis <> 'whole'").select(F.col(group).alias("grp"), "lo", "hi")
    whole = fences.filter("basis = 'whole'").select(F.col("lo").alias("all_lo"), F.col("hi").alias("all_hi"))
    joined = df.join(own, F.col(group) == F.col("grp"), "left").join(F.broadcast(whole))  # one row
    return joined.filter(value.between(F.coalesce("lo", "all_lo"), F.coalesce("hi", "all_hi"))).select(*df.columns)


def fit_medians(df: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Medians by group and of all rows, of all columns at once."""
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns)))
    rows = cut(df.select(*groups, long.alias("_c")).select(*groups, F.col("_c.name").alias("_name"), F.col("_c.value").alias("_value")))
    wide = lambda prefix: [F.max(F.when(F.col("_name") == c, F.col("q0"))).alias(f"{prefix}_{c}") for c in columns]
    by_group = quantiles(rows, [*groups, "_name"], F.col("_value"), [0.5]).groupBy(*groups).agg(*wide("median"))
    return by_group, quantiles(rows, ["_name"], F.col("_value"), [0.5]).agg(*wide("all"))


def impute(df: DataFrame, fitted: tuple[DataFrame, DataFrame], columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Nulls become the median of their group, else of all rows."""
    by_group, whole = fitted
    named = by_group.select(*(F.col(g).alias(f"g_{g}") for g in groups), *(f"median_{c}" for c in columns))
    on = [F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in groups]
    joined = df.join(named, on, "left").join(F.broadcast(whole))  # one row
    return joined.withColumns({c: F.coalesce(c, f"median_{c}", f"all_{c}") for c in columns}).select(*df.columns)


def pick(structured: Column, from_text: Column, low: float | None = None, high: float | None = None) -> tuple[Column, Column]:
    """The first usable of two values, and whether it came from text. Null, empty, 0, non-numeric and out of range are not usable."""

    def usable(c: Column) -> Column:
        v = c.cast("string").try_cast("double")
        ok = (v != 0) & (v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True))
        return F.when(ok, v)

    a, b = usable(structured), usable(from_text)
    return F.coalesce(a, b), a.isNull() & b.isNotNull()


def unify(sources: Sequence[DataFrame], columns: Sequence[str], categorical: Sequence[str] = (), unknown: str = UNKNOWN) -> DataFrame:
    """Union by name in a fixed column order; absent columns are null, missing categories unknown."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    out = out.withColumns({c: F.lit(None) for c in columns if c not in out.columns})
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(unknown)) for c in categorical}).select(*columns)
