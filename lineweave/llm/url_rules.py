"""URL filters: pattern rules fetched by their rarest literal token.

Every rule is a regular expression over host + path. Its literal tokens are runs of letters and digits that
any match must hold as whole tokens. Token counts over all urls pick each rule's rarest one, and the rule is
indexed there; a url's own tokens then fetch the few rules whose expressions are run. A rule without a literal
token is run on every url.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import table
from lineweave.llm.line_dedup import ascii_lower

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """name: as reported. verdict: allow or block. rank: of the rules that fit, the largest rank wins, then
    the first name. tokens: lower-cased tokens that any url the pattern fits must hold."""

    name: str
    verdict: str
    pattern: str
    rank: int
    tokens: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains where the url's path starts with path; longer rules outrank shorter ones."""
    whole = TOKEN.findall(f"{host}{path}".lower())
    if whole and re.search("[A-Za-z0-9]$", host + path):
        whole.pop()  # the url's token may go on
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?{re.escape(host + path)}", 1000 + len(host + path), tuple(whole))


def junk_rule(label: str) -> Rule:
    """Blocks hosts with label as a whole part between dots."""
    return Rule(f"junk:{label}", "block", rf"\A(?:[^/]*\.)?{re.escape(label)}\.", len(label), tuple(TOKEN.findall(label)))


SITE_RULES = (site_rule("block", "net", "/"), site_rule("allow", "example.net", "/en/"), site_rule("block", "example.com", "/de/"), site_rule("allow", "org", "/fr/"))
#: Host parts of link farms, betting, adult and pharmacy spam.
JUNK = ("spam-farm", "free-bets", "casino", "best-casino", "online-casino", "porn", "xxx", "adult-videos", "cheap-pills", "viagra", "payday-loans", "click-farm", "link-farm", "ads")
JUNK_RULES = tuple(junk_rule(x) for x in JUNK)


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(sites: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many rows of sites (host, path) each of the rules' tokens occurs."""
    words = sites.select(F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))).alias("t"))
    own = sites.sparkSession.createDataFrame([(t,) for t in tokens], "t string")
    rows = words.join(F.broadcast(own), "t", "left_semi").groupBy("t").count().collect()  # a row for each rule token at most
    return {r.t: r["count"] for r in rows}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token, and those without any."""
    by_token, rest = defaultdict(list), []
    for rule in rules:
        if rule.tokens:
            by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
        else:
            rest.append(rule)
    return dict(by_token), rest


@lru_cache(maxsize=1 << 16)
def compiled(pattern: str) -> re.Pattern:
    """A rule's expression, compiled when a url first fetches it."""
    return re.compile(pattern, re.DOTALL)


def judge(site: str, by_token: dict, rest: list) -> Rule | None:
    """The rule of highest rank that fits site = host + path."""
    best = None
    for rules in (*(by_token.get(t, ()) for t in set(TOKEN.findall(site.lower()))), rest):
        for rule in rules:
            if (best is None or (rule.rank, best.name) > (best.rank, rule.name)) and compiled(rule.pattern).search(site):
                best = rule
    return best


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + JUNK_RULES, url_col: str = "url") -> DataFrame:
    """pages and __host, __path, __rule (name of the rule that fits, or null), __verdict.

    A url that no rule fits is allowed. Null urls and urls without :// have empty host and path. Columns of pages with
    the names of the added ones are replaced. Rules are settings that every executor holds once: their number does
    not grow with the data.
    """
    pages = pages.drop("__host", "__path", "__rule", "__verdict", "__judged")
    sites = pages.withColumn("__host", host_of(F.col(url_col))).withColumn("__path", path_of(F.col(url_col)))
    tokens = sorted({t for r in rules for t in r.tokens})
    counts = token_counts(sites.select(F.col("__host").alias("host"), F.col("__path").alias("path")), tokens) if tokens else {}
    index = pages.sparkSession.sparkContext.broadcast(rule_index(rules, counts))

    @F.arrow_udf("struct<rule string, verdict string>")
    def verdicts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_token, rest = index.value
        for sites_ in parts:
            found = [judge(s, by_token, rest) for s in sites_.to_pylist()]
            names = pa.array([r.name if r else None for r in found], pa.string())
            yield pa.StructArray.from_arrays([names, pa.array([r.verdict if r else "allow" for r in found], pa.string())], ["rule", "verdict"])

    judged = sites.withColumn("__judged", verdicts(F.concat("__host", "__path")))
    return judged.withColumn("__rule", F.col("__judged.rule")).withColumn("__verdict", F.col("__judged.verdict")).drop("__judged")


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    done = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
    named = F.when(F.col("__rule").isin([r.name for r in SITE_RULES]), F.col("__rule"))
    return done.select(
        "page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), named.alias("rule"), F.col("__verdict").alias("verdict")
    )


ORACLE = rf"""
WITH s AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|\.)({"|".join(JUNK)})\.') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
