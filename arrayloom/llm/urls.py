"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host, with all of its subdomains, and a path prefix. Its literal tokens are those of its host and path. How
often each token stands in the urls is counted over all urls, and the rule is filed under the rarest of its tokens that
any matching url must contain as a whole. A url's tokens fetch candidate rules; only those run their regular
expression, and the longest match decides.

All of it is DataFrame work: hosts and paths are cut by column functions, the rule index is a small table (RULES_MOST bounds
it for a broadcast; a larger one is joined by token), and matching runs once for each distinct host and path. Verdicts go back to
the urls by weight: hosts and paths of many urls are broadcast.

Defined cases: a null url or one without ``://`` has an empty host and path, matches no rule and gets the default verdict;
of rules of equal length the first in order wins; repeated urls are judged alike; other columns play no part. At most FREE_MOST
rules may have no literal token, since those are tried on every host and path; more are an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import join_by_weight, write_table

#: Rules up to this number are broadcast.
RULES_MOST = 100_000
#: Rules without a literal token.
FREE_MOST = 100
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def pattern(self) -> str:
        """A regular expression for host, a line feed and path; an empty host stands for all."""
        quote = lambda s: re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", s)
        return ("^(?:[^\n]*\\.)?" + quote(self.host) if self.host else "^[^\n]*") + "\n" + quote(self.path)

    def tokens(self) -> list[str]:
        """Tokens that every matching url has: the host's labels, and the path's parts that end before its end."""
        parts = self.path.split("/")[:-1]
        return [f"h:{t}" for t in self.host.split(".") if t] + [f"p:{t}" for t in parts if t]


def parse_rule(verdict: str, rule: str) -> Rule:
    """``host/path`` as a rule."""
    host, slash, path = rule.partition("/")
    return Rule(verdict, host.translate(_LOW), slash + path)


_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = [parse_rule("block", "net/"), parse_rule("allow", "example.net/en/"), parse_rule("block", "example.com/de/"), parse_rule("allow", "org/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_url`")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens() -> Column:
    labels = F.transform(F.split("host", r"\."), lambda t: F.concat(F.lit("h:"), t))
    parts = F.transform(F.split("path", "/"), lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.concat(labels, parts))


def judge(pages: DataFrame, rules: list[Rule] | None = None, *, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null) and verdict for every page."""
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    cut = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    cut = cut.select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return cut.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    free = [r for r in rules if not r.tokens()]
    if len(free) > FREE_MOST:
        raise ValueError(f"more than {FREE_MOST} rules have no literal token")
    places = write_table(cut.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "url-places")
    total = places.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = spark.createDataFrame(
        [(i, r.verdict, r.name, len(r.name), r.pattern(), r.tokens()) for i, r in enumerate(rules)],
        "number int, verdict string, rule string, length int, pattern string, tokens array<string>",
    )
    every = table.select("number", "verdict", "rule", "length", "pattern", F.explode_outer("tokens").alias("token"))
    names = every.select("token").where("token IS NOT NULL").distinct()
    small = len(rules) <= RULES_MOST
    bound = F.broadcast if small else (lambda df: df)
    seen = places.select("n", F.explode(_tokens()).alias("token")).join(bound(names), "token").groupBy("token").agg(F.sum("n").alias("seen"))
    counted = every.join(seen, "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    rarest = counted.groupBy("number", "verdict", "rule", "length", "pattern").agg(F.min_by("token", F.struct("seen", "token")).alias("token"))
    rarest = write_table(rarest, "url-rules")
    keyed = bound(rarest.where("token IS NOT NULL"))
    candidates = places.select("host", "path", F.explode(_tokens()).alias("token")).join(keyed, "token")
    if free:
        tried = F.broadcast(rarest.where("token IS NULL").drop("token"))
        candidates = candidates.unionByName(places.select("host", "path", F.lit(None).cast("string").alias("token")).crossJoin(tried).select(candidates.columns))
    fits = candidates.where(F.expr("concat(host, '\n', path) RLIKE pattern"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("length", (-F.col("number")).alias("o"))).alias("best"))
    told = places.join(best, ["host", "path"], "left").select("host", "path", "n", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return join_by_weight(cut, write_table(told, "url-verdicts"), ["host", "path"], "n", total).select("page_id", "host", "path", "rule", "verdict")
