"""Statistics of whole texts as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of other characters than these (ASCII white space).
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_chars(text: Column) -> Column:
    return F.length(without(text, SPACE)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return (F.length(text) - F.length(without(text, characters))).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACE)) > 0)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, also where the body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeats(items: Column) -> Column:
    """How many items of an array equal an earlier one."""
    return (F.size(items) - F.size(F.array_distinct(items))).cast("long")


def window_hashes(word_list: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    starts = F.when(F.size(word_list) >= n, F.sequence(F.lit(1), F.size(word_list) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return let(F.transform(word_list, lambda w: F.xxhash64(w)), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, n))))


def repeated_words(windows: Column, n: int) -> Column:
    """Words covered by runs of n words that occur twice or more, given the hashes of all runs. Runs are sorted with their
    places, so equal ones are neighbours; texts without repeats skip that."""
    zero = F.lit(0).cast("long")

    def places(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        same = lambda j, k: F.get(sorted_, j)["h"] == F.get(sorted_, k)["h"]
        twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j, j - 1)) | ((j < last) & same(j, j + 1)))
        return F.sort_array(F.transform(twice, lambda j: F.get(sorted_, j)["i"]))

    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-n).alias("last"), zero.alias("total"))
    covered = F.aggregate(
        let(tagged, places),
        start,
        lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(n), p - a["last"])).alias("total")),
        lambda a: a["total"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(zero)
