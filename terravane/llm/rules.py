"""Quality rules (operator 6): a short-circuit cascade ordered by rejection per cost. DataFrame functions only."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm import textstats as S
from terravane.llm.storage import remove, written

#: Rows of the sample on which rules are timed and counted. It settles their order only, never a verdict.
SAMPLE_ROWS = 2000
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Rule:
    """A document is rejected if the condition, over the text and the base columns, is true."""

    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules that are no base test: symbols, repeated lines, shouting, word length, vocabulary."""
    t, n, upper = F.col(text), F.col("n_words"), F.regexp_count(F.col(text), F.lit(r"\p{Lu}"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("duplicate_lines", F.col("n_dup_lines") * 10 > F.size(S.lines(t)) * 3),
        Rule("shouting", upper * 10 > F.col("word_chars") * 4),
        Rule("word_length", (F.col("word_chars") * 2 < n * 5) | (F.col("word_chars") > n * 15)),
        Rule("vocabulary", F.size(F.array_distinct(S.words(t))) * 5 < n),
    ]


@dataclass(frozen=True)
class Estimate:
    """A rule, its seconds for the sample, the share of rows that it rejects among those that reach it in the order, and that per
    second."""

    rule: Rule
    seconds: float
    rejected: float
    worth: float


#: Times that a rule is evaluated for each row when it is timed, so that it stands out of a job's own time; rounds of all rules.
EVALUATIONS, ROUNDS = 4, 2


def estimate(sample: DataFrame, rules: Sequence[Rule]) -> list[Estimate]:
    """The rules in the order of the cascade, by rejection per cost, on a sample of base columns.

    Only rows that pass the base tests count, as others reach no rule. Which rules reject a row is counted for all rules at
    once (a row per combination that occurs), so a rule's rejections are those among rows that the rules before it leave.
    A rule's cost is the least time of ROUNDS jobs that evaluate it EVALUATIONS times a row, less that of an empty rule; to
    keep noise out of the order, a cost below a tenth of the empty job's counts as that, and costs are compared in powers of
    two. Equal worth leaves rules as given.
    """
    passed = sample.filter(~F.col("base_failed"))
    flags = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    combinations = [(list(row)[:-1], row["n"]) for row in passed.select(*flags).groupBy(*(f"r{i}" for i in range(len(rules)))).agg(F.count("*").alias("n")).collect()]
    times = F.sequence(F.lit(1), F.lit(EVALUATIONS))

    def timed(condition: Column) -> float:
        again = F.aggregate(times, F.lit(0), lambda a, _: a + F.coalesce(condition, F.lit(False)).cast("int"))
        began = time.perf_counter()
        passed.agg(F.sum(again)).collect()
        return time.perf_counter() - began

    jobs = [F.length("text") < 0, *(r.rejects for r in rules)]
    idle, *seconds = (min(x) for x in zip(*([timed(j) for j in jobs] for _ in range(ROUNDS)), strict=True))
    costs = [2.0 ** round(math.log2(max(s - idle, idle / 10))) for s in seconds]
    left, out = list(range(len(rules))), []
    while left:
        rows = sum(n for _, n in combinations)
        shares = {i: sum(n for flags_, n in combinations if flags_[i]) / rows if rows else 0.0 for i in left}
        best = max(left, key=lambda i: (shares[i] / costs[i], -i))
        out.append(Estimate(rules[best], seconds[best], shares[best], shares[best] / costs[best]))
        left.remove(best)
        combinations = [(flags_, n) for flags_, n in combinations if not flags_[best]]
    return out


def sample_of(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows from all of the table (a Bernoulli sample sized by the table's count, so its size does not grow), in one
    partition. A column that no rule needs is not read."""
    count = docs.count()
    drawn = docs.sample(fraction=min(1.0, rows / count), seed=17) if count > rows else docs
    return drawn.repartition(1)


def base_columns(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text (null: empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(F.col(id_column).alias("doc_id"), S.text_of(text_column).alias("text"))
    rows = rows.select("*", S.words(F.col("text")).alias("words"), S.lines(F.col("text")).alias("lines"))
    rows = rows.select("*", S.window_hashes(F.col("words"), WINDOW).alias("windows"))
    rows = rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        S.word_chars(F.col("text")).alias("word_chars"),
        S.count_of(F.col("text"), S.SYMBOLS).alias("n_symbols"),
        S.repeats(F.col("lines")).alias("n_dup_lines"),
        S.repeated_words(F.col("windows"), WINDOW).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed)


def cascade(rules: Sequence[Rule]) -> Column:
    """False at the first rule that rejects; later rules of that row are not evaluated."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for r in rules:
        out = out.when(r.rejects, F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(
    docs: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Base columns and ``kept`` of every document.

    A sample of about ``sample_rows`` rows is measured and puts the rules in order: texts are drawn first, and only those
    drawn get base columns. Then one pass without shuffle judges all rows. Null texts count as empty (base_failed), null and repeated ids stay, other columns are
    ignored, an empty table gives no row. A rule that is null for a row doesn't reject it.
    """
    rules = list(default_rules() if rules is None else rules)
    base = base_columns(docs, id_column=id_column, text_column=text_column)
    if len(rules) > 1:
        texts, drawn = written(sample_of(docs.select(id_column, text_column), sample_rows), "rule-texts")
        sample, path = written(base_columns(texts, id_column=id_column, text_column=text_column), "rule-sample")
        rules = [e.rule for e in estimate(sample, rules)]
        remove(docs.sparkSession, drawn)
        remove(docs.sparkSession, path)
    return base.withColumn("kept", cascade(rules)).drop("text")


#: The same rows in DuckDB's SQL.
ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT r, unnest(range(0, len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT r, i, array_to_string(words[i + 1 : i + 8], ' ') AS g FROM p),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, range(0, 8) AS x(k) GROUP BY r),
b AS (SELECT doc_id, text, lines, words, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > len(lines) * 3
    OR (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) * 10 > word_chars * 4
    OR word_chars * 2 < n_words * 5 OR word_chars > n_words * 15 OR len(list_distinct(words)) * 5 < n_words) AS kept
FROM f
"""
