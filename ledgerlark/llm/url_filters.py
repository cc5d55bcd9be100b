"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host and path with the literal tokens that every
match must contain. Tokens are counted over all urls, each rule is filed under its rarest
one, and only the rules that a url's own tokens fetch are run on that url.

The index has one row per rule. Urls and rules meet in a join on the token, and the
longest rule that fits wins by a map-side combined maximum per page, so neither a hot
host nor a common token gathers rows in one task.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no
rule and is allowed; hosts of rules count in lower case, their paths as they are; rules without a literal token run on every url; repeated rows are
judged alike, each as a row of its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, small, stored

BLOCK, ALLOW = "block", "allow"
_TOKEN_GAP = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` must match all of host and path; ``tokens`` are whole literal tokens of it."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    priority: int


def _lower(text: str) -> str:
    """A-Z in lower case, as in the tokens of urls."""
    return re.sub("[A-Z]+", lambda found: found[0].lower(), text)


def host_rule(verdict: str, name: str) -> Rule:
    """Rule ``host/path``: fits the host, its subdomains, and paths starting alike."""
    host, slash, path = name.partition("/")
    host = _lower(host)
    pattern = rf"(?s)(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}.*"
    # The last token of the path may go on in a url, so it counts only before a delimiter.
    literal = _lower(f"{host}/" + (path if path.endswith("/") else path.rpartition("/")[0]))
    return Rule(name, verdict, pattern, tuple(t for t in re.split(_TOKEN_GAP, literal) if t), 1_000_000 + len(name))


def word_rule(name: str) -> Rule:
    """Blocking rule of the method: the words, joined by any one delimiter, in the host."""
    words = name.split("-")
    pattern = r"(?s)(?:[^/]*[^a-z0-9/])?" + r"[^a-z0-9/]".join(map(re.escape, words)) + r"(?:[^a-z0-9/][^/]*)?(?:/.*)?"
    return Rule(name, BLOCK, pattern, tuple(words), len(name))


# The rules given, and host names that sell or pad.
HOST_RULES = (
    host_rule(BLOCK, "net/"),
    host_rule(ALLOW, "example.net/en/"),
    host_rule(BLOCK, "example.com/de/"),
    host_rule(ALLOW, "org/fr/"),
)
WORD_RULES = tuple(map(word_rule, ("casino", "cheap-pills", "free-bets", "porn", "spam-farm", "xxx")))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return lower_ascii(F.coalesce(F.regexp_extract(rest, "^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(lower_ascii(F.concat_ws("/", host, path)), _TOKEN_GAP), ""))


RULES = "rule_id long, name string, verdict string, pattern string, tokens array<string>, priority int"


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Rules with a number each. A table of rules has the fields of ``Rule`` as columns, and
    its tokens in lower case; it never goes through the driver."""
    if isinstance(rules, DataFrame):
        tokens = F.transform("tokens", lower_ascii).alias("tokens")
        return stored(rules.select(F.monotonically_increasing_id().alias("rule_id"), "name", "verdict", "pattern", tokens, "priority"), "rule-table")
    return spark.createDataFrame([(i, r.name, r.verdict, r.pattern, list(r.tokens), r.priority) for i, r in enumerate(rules)], RULES)


def rule_index(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the ``token`` each is filed under: its rarest among ``tokens``.

    ``tokens`` has one row per url and token. A rule with a token that no url has is
    filed under that one, so it is never fetched. Only tokens of rules are counted.
    """
    of_rules = rules.select("rule_id", F.explode("tokens").alias("token"))
    counts = tokens.join(small(of_rules.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = of_rules.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("_key")
    )
    return rules.join(rarest, "rule_id", "left").select("rule_id", "name", "verdict", "pattern", "priority", F.col("_key.token").alias("token"))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[Rule] | DataFrame = HOST_RULES + WORD_RULES) -> DataFrame:
    """All rows and columns of ``pages`` and a struct ``(host, path, rule, verdict,
    matched)``, named ``filter`` with underscores in front if that is taken.

    ``rule`` names the given rule that decides, ``matched`` any rule; a rule of the
    method decides only where no given one fits.
    """
    spark, out = pages.sparkSession, free_name(pages.columns, "filter")
    table = rule_table(spark, rules)
    urls = pages.select(F.col(f"`{url}`").alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    tokens = urls.select(F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("token"))
    index = stored(rule_index(tokens, table), "rules")
    everywhere = index.where(F.col("token").isNull()).withColumn("token", F.lit(""))
    index = small(index.where(F.col("token").isNotNull()).unionByName(everywhere))
    found = urls.select("_url", "_host", "_path", F.explode(F.array_append(_tokens(F.col("_host"), F.col("_path")), F.lit(""))).alias("token"))
    fits = F.expr("concat(_host, _path) RLIKE concat('^(?:', pattern, ')$')")
    best = (
        found.join(index, "token")
        .where(fits)
        .groupBy("_url")
        .agg(F.max(F.struct("priority", "name", "verdict")).alias("_best"))
    )
    joined = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), F.col(f"`{url}`").alias("_own"))
    joined = joined.join(best, F.col("_own") == F.col("_url"), "left")
    given = F.col("_best.priority") >= 1_000_000
    judgement = F.struct(
        host_of(F.col("_own")).alias("host"),
        path_of(F.col("_own")).alias("path"),
        F.when(given, F.col("_best.name")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(ALLOW)).alias("verdict"),
        F.col("_best.name").alias("matched"),
    )
    return joined.select("_row.*", judgement.alias(out))
