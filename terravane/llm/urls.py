"""URL filters (operator 10): pattern rules indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over host and path (``example.com/a/b``) and the tokens that each match contains whole."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False


def host_rule(verdict: str, rule: str) -> PatternRule:
    """``host/path``: fits the host and its subdomains where the url's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = re.findall(TOKEN, host) + re.findall(TOKEN, re.sub(f"{TOKEN}$", "", path))  # a last token may go on in the url
    return PatternRule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), True)


#: The listed rules.
LISTED = [
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
]


def _label(*parts: str) -> str:
    """A host label made of the parts with hyphens or nothing between; each part is a token if it stands alone."""
    return rf"^(?:[^/]*[.-])?{'-'.join(parts)}(?:[.-][^/]*)?(?:/|$)"


#: Rules for urls that no listed rule fits; what none of these fits is allowed.
PATTERNS = [
    PatternRule("spam-farm", "block", _label("spam", "farm"), ("spam", "farm")),
    PatternRule("cheap-pills", "block", _label("cheap", "pills"), ("cheap", "pills")),
    PatternRule("casino", "block", _label("casino"), ("casino",)),
    PatternRule("adserver", "block", r"^ads?[0-9]*\.[^/]*/(?:.*/)?banner(?:/|$)", ("banner",)),
    PatternRule("login", "block", r"/(?:account/)?login(?:\.php)?$", ("login",)),
    PatternRule("tracker", "block", r"^[^/]*/(?:.*/)?pixel\.gif$", ("pixel", "gif")),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the
    end. Both are empty for null and where there is no ``://``."""
    some = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(some, "://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(some, "://[^/?#]*([^?#]*)", 1)


def url_tokens(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(f"({TOKEN})"), 1))


def rarest_tokens(lines: DataFrame, rules: Sequence[PatternRule]) -> dict[str, str | None]:
    """For each rule the token of it that the fewest urls (column ``line``) have; None for a rule without tokens, which every url has
    to try. Only counts of the rules' own tokens leave a task."""
    known = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if known:
        seen = lines.select(F.explode(F.array_intersect(url_tokens(F.col("line")), F.array(*map(F.lit, known)))).alias("token"))
        counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def judge_urls(
    pages: DataFrame,
    rules: Sequence[PatternRule] = (*LISTED, *PATTERNS),
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Per page: the id, host, path, rule (the longest listed rule that fits, else null), verdict and pattern (the first other
    rule that fits, if no listed one does).

    The index from rarest token to rules is a literal map, one entry per token of the rules: a url's tokens fetch its rules
    inside the row, and only these run their expression, in order, until one fits. Listed rules go before others, longer
    before shorter, block before allow. So pages are judged in one pass without shuffle, after a pass over the urls alone
    that counts the rules' tokens. Null urls have empty host and path and the default verdict; null and repeated ids stay;
    other columns are ignored; an empty table gives no row, and without rules all urls have the default verdict.
    """
    host, path = host_and_path(F.col(url_column))
    index = rarest_tokens(pages.select(F.concat(host, path).alias("line")), rules)
    ranked = sorted(rules, key=lambda r: (not r.listed, -len(r.name) if r.listed else 0, r.verdict != "block"))
    by_token: dict[str, list[int]] = {}
    for i, r in enumerate(ranked, 1):
        by_token.setdefault(index[r.name] or "", []).append(i)  # '' fetches rules without tokens
    urls = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path")).withColumn("line", F.concat("host", "path"))
    first = F.lit(None).cast("int")
    if ranked:
        fetches = F.create_map(*(x for t, own in by_token.items() for x in (F.lit(t), F.array(*map(F.lit, own)))))
        patterns = F.array(*(F.lit(r.pattern) for r in ranked))
        tokens = F.array_append(F.array_intersect(url_tokens(F.col("line")), F.array(*map(F.lit, by_token))), F.lit(""))
        fetched = F.sort_array(F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(fetches, t), F.array().cast("array<int>")))))
        first = F.aggregate(fetched, first, lambda found, i: F.coalesce(found, F.when(F.rlike(F.col("line"), F.element_at(patterns, i)), i)))
    judged = urls.select("id", "host", "path", first.alias("first"))
    of = lambda values: F.try_element_at(F.array(*(F.lit(v) for v in values)), F.col("first")) if ranked else F.lit(None).cast("string")
    listed = F.col("first") <= sum(r.listed for r in ranked)
    return judged.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        F.when(listed, of(r.name for r in ranked)).alias("rule"),
        F.coalesce(of(r.verdict for r in ranked), F.lit(default)).alias("verdict"),
        F.when(~listed, of(r.name for r in ranked)).alias("pattern"),
    )


#: The same rows in DuckDB's SQL.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, host || path AS s FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(s, '^(?:[^/]*\.)?www\.example\.com/en/') THEN 'www.example.com/en/'
    WHEN regexp_matches(s, '^(?:[^/]*\.)?example\.com/en/') THEN 'example.com/en/'
    WHEN regexp_matches(s, '^(?:[^/]*\.)?net/es/') THEN 'net/es/'
    WHEN regexp_matches(s, '^(?:[^/]*\.)?net/fr/') THEN 'net/fr/'
    WHEN regexp_matches(s, '^(?:[^/]*\.)?com/') THEN 'com/' END AS rule FROM c),
e AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(s, '^(?:[^/]*[.-])?spam-farm(?:[.-][^/]*)?(?:/|$)') THEN 'spam-farm'
    WHEN regexp_matches(s, '^(?:[^/]*[.-])?cheap-pills(?:[.-][^/]*)?(?:/|$)') THEN 'cheap-pills'
    WHEN regexp_matches(s, '^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)') THEN 'casino'
    WHEN regexp_matches(s, '^ads?[0-9]*\.[^/]*/(?:.*/)?banner(?:/|$)') THEN 'adserver'
    WHEN regexp_matches(s, '/(?:account/)?login(?:\.php)?$') THEN 'login'
    WHEN regexp_matches(s, '^[^/]*/(?:.*/)?pixel\.gif$') THEN 'tracker' END AS pattern FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM e
"""
