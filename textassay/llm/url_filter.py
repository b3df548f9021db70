"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression; its literal tokens, which any match contains, are
taken from the pattern.  It is filed under the token of it that the fewest URLs have; a URL's tokens fetch
its candidate rules, and only those run.  Host rules (a host with a path) decide
before the patterns do.

All is native columns: the rule index is a literal map inside the projection as
long as there are at most ``INLINE_RULES`` rules, so that a judgement moves no
row; beyond, distinct URLs are joined to the index by token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rule_tokens import literal_tokens

INLINE_RULES = 500


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is looked for in URLs in lower case; ``tokens`` are those of the pattern where none are given."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...] = ()

    def literals(self) -> tuple[str, ...]:
        return self.tokens or literal_tokens(self.pattern)


HOST_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)

PATTERN_RULES = (
    PatternRule("casino", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*[.-])?casino[.-]"),
    PatternRule("free-bets", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*[.-])?free-bets[.]"),
    PatternRule("online-poker", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*[.-])?online-poker[.]"),
    PatternRule("cheap-pills", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*[.-])?cheap-pills[.]"),
    PatternRule("adult-host", "block", r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?xxx[.-]"),
    PatternRule("login-page", "block", r"://[^/?#]+/(?:[^?#]*/)?login(?:[/?#.]|$)"),
)

#: Rules that one filter takes: they travel with the plan or as a small table.
MOST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """The longest host rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("verdict"))).otherwise(found)
    return found


def check_rules(rules: tuple[PatternRule, ...]) -> None:
    """Refuse rules that can't be filed: each needs a pattern that compiles, an action and tokens that its pattern surely holds."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    for r in rules:
        re.compile(r.pattern)
        own = literal_tokens(r.pattern)
        if not own or not set(r.tokens) <= set(own):
            raise ValueError(f"rule {r.name}: {'no token is sure to stand in a match' if not own else f'its pattern only has the tokens {own}'}")
        if r.action not in ("allow", "block"):
            raise ValueError(f"rule {r.name}: its action is allow or block")


def read_rules(spark: SparkSession, path: str) -> tuple[tuple[HostRule, ...], tuple[PatternRule, ...]]:
    """Rules of a JSON-lines file or folder, in the order of ``place``.

    A row has ``action`` and either ``host`` and ``path`` or ``name`` and
    ``pattern``; the tokens of a pattern are taken from it and checked.
    """
    rows = spark.read.schema("place int, action string, host string, path string, name string, pattern string").option("mode", "FAILFAST").json(path).orderBy("place", "name", "host", "path").limit(MOST_RULES + 1).collect()
    hosts = tuple(HostRule(r.action, r.host.lower(), r.path or "") for r in rows if r.host)
    patterns = tuple(PatternRule(r.name, r.action, r.pattern) for r in rows if r.pattern)
    check_rules(patterns)
    if bad := [r for r in hosts if r.action not in ("allow", "block")]:
        raise ValueError(f"rule {bad[0].name}: its action is allow or block")
    return hosts, patterns


def rarest_tokens(pages: DataFrame, url_col: str, rules: tuple[PatternRule, ...]) -> dict[str, list[int]]:
    """Token to the rules filed under it: of each rule's tokens the one that the fewest URLs have.

    One pass counts the rules' own tokens only; as many numbers as these come back.
    """
    tokens = [r.literals() for r in rules]
    wanted = sorted({t for own in tokens for t in own})
    spark = pages.sparkSession
    own = spark.createDataFrame([(t,) for t in wanted], "token string")
    counts = pages.select(F.explode(url_tokens(F.col(url_col))).alias("token")).join(own, "token").groupBy("token").count()
    urls = dict(counts.toLocalIterator())
    index: dict[str, list[int]] = {}
    for k, own in enumerate(tokens):
        index.setdefault(min(own, key=lambda t: (urls.get(t, 0), t)), []).append(k)
    return index


def _candidates_inline(url: Column, rules: tuple[PatternRule, ...], index: dict[str, list[int]]) -> Column:
    entry = lambda k: F.struct(F.lit(k).alias("k"), F.lit(rules[k].name).alias("rule"), F.lit(rules[k].action).alias("verdict"), F.lit(rules[k].pattern).alias("pattern"))
    filed = F.create_map(*[x for t, ks in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, ks)))])
    fetched = F.flatten(F.filter(F.transform(url_tokens(url), lambda t: F.try_element_at(filed, t)), lambda x: x.isNotNull()))
    return F.filter(fetched, lambda r: F.regexp_like(F.translate(url, UPPER, LOWER), r["pattern"]))


def judged_inline(pages: DataFrame, url_col: str, rules: tuple[PatternRule, ...], index: dict[str, list[int]]) -> Column:
    """The first rule (in their order) whose pattern fits, as a struct; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fitting = F.array_min(_candidates_inline(F.col(url_col), rules, index))
    return F.when(fitting.isNotNull(), F.struct(fitting["rule"].alias("rule"), fitting["verdict"].alias("verdict")))


def judged_by_join(pages: DataFrame, url_col: str, rules: tuple[PatternRule, ...], index: dict[str, list[int]]) -> DataFrame:
    """``__url, __pattern`` for the distinct URLs that some pattern fits, by a join on tokens."""
    spark: SparkSession = pages.sparkSession
    filed = spark.createDataFrame([(t, k, rules[k].name, rules[k].action, rules[k].pattern) for t, ks in index.items() for k in ks], "token string, k int, rule string, verdict string, pattern string")
    urls = pages.select(F.col(url_col).alias("__url")).filter("__url IS NOT NULL").distinct()
    candidates = urls.withColumn("token", F.explode(url_tokens(F.col("__url")))).join(filed, "token")
    fits = candidates.filter(F.regexp_like(F.translate("__url", UPPER, LOWER), F.col("pattern")))
    return fits.groupBy("__url").agg(F.min(F.struct("k", "rule", "verdict")).alias("x")).select("__url", F.struct("x.rule", "x.verdict").alias("__pattern"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, inline_rules: int = INLINE_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for each row of ``pages``.

    ``rule`` is the longest host rule that fits; its action is the verdict.  Else
    the first pattern rule that fits decides (its name is in ``pattern``); else the
    verdict is allow.  A URL that is null or without ``://`` has an empty host and
    path and no host rule.  Ids may be null or repeated; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    check_rules(pattern_rules)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    index = rarest_tokens(rows, "__url", pattern_rules) if pattern_rules else {}
    if len(pattern_rules) <= inline_rules:
        rows = rows.withColumn("__pattern", judged_inline(rows, "__url", pattern_rules, index))
    else:
        rows = rows.join(judged_by_join(rows, "__url", pattern_rules, index), "__url", "left")
    rows = rows.withColumns({"host": url_host(F.col("__url")), "path": url_path(F.col("__url"))})
    rows = rows.withColumn("__host", host_rule(F.col("host"), F.col("path"), host_rules))
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("__host.rule").alias("rule"),
        F.coalesce("__host.verdict", "__pattern.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("__host").isNull(), F.col("__pattern.rule")).alias("pattern"),
    )
