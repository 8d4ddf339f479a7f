"""URL filter: explicit host/path rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are summed per host; each level's good rate is shrunk through a
beta-binomial prior whose mean is the level above (host, registered domain, suffix, all pages) and whose
strength comes from the spread of that level (method of moments). A page is allowed if the lower posterior
bound of its host's rate reaches ``floor``.

Only DataFrame expressions. The labelled rows are summed by host before their one shuffle, and the sums are written, so they are read
once; all spreads come from one job. Rows of a frequent host are dealt over several tasks when they get its bound.

Null urls and urls
without ``://`` have an empty host and path. Null outcomes are ignored; no labelled row at all gives the
prior rate 0.5. Rule ties cannot arise: the longest rule string wins, equal strings are one rule (the last given). Repeated rows
and ids are judged row by row, an empty table gives no rows, other columns are not read, and a long url is a value like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm import runtime

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which domains are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: So many rules are compiled into one expression; longer lists are joined, with the same result.
MOST_COMPILED_RULES = 200


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class Reputation:
    """floor: least lower bound that is allowed; z: width of the bound in standard deviations."""

    floor: float = 0.5
    z: float = 1.64
    least_rho: float = 0.001
    most_rho: float = 0.5


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, found).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, found).otherwise(F.lit(""))


def registered_domain(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(n <= 1, host).when(deep, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(F.concat_ws(".", F.slice(labels, -2, 2)))


def public_suffix(host: Column) -> Column:
    return F.regexp_extract(registered_domain(host), r"[^.]*$", 0)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(text, verdict), else null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def rule_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """For rule lists of any length: joins distinct (host, path) pairs with ``rules`` (text, verdict) on each suffix
    of the host, as many as it has labels; returns host, path, rule, verdict of the longest fitting rule."""
    keyed = rules.select("text", "verdict", F.regexp_extract("text", "^[^/]*", 0).alias("rule_host"), F.regexp_extract("text", "/.*$", 0).alias("rule_path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    asked = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    hit = asked.join(keyed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max_by(F.struct("text", "verdict"), F.struct(F.length("text"), "text"))
    return hit.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.text").alias("rule"), F.col("best.verdict").alias("verdict"))


def host_posteriors(outcomes: DataFrame, hosts: DataFrame, params: Reputation = Reputation()) -> DataFrame:
    """Lower posterior bound per host. outcomes: host, good (0/1); hosts: every host asked for, with columns that are kept.

    Five sums for each of the three levels come to the driver, whatever the size of the data.
    """
    scratch = runtime.Scratch(outcomes.sparkSession)
    sums = F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k")
    by_host = outcomes.where("good is not null and host is not null").groupBy("host").agg(*sums)
    by_host = scratch.write(by_host.withColumns({"domain": registered_domain(F.col("host")), "suffix": public_suffix(F.col("host"))}), "hosts")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    level = lambda i, x: x.agg(F.lit(i).alias("level"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.count("*").alias("groups"))
    levels = {r["level"]: r for r in level(0, by_host).union(level(1, by_domain)).union(level(2, by_suffix)).collect()}
    n, k = levels[0]["n"], levels[0]["k"]
    rate = min(max(k / n if n else 0.5, 0.01), 0.99)

    def strength(r) -> float:
        """Of a level's prior: from the spread of its rates, the sum of n (k / n - rate)**2."""
        more = (r["n"] or 0) - r["groups"]
        spread = r["kk"] - 2 * rate * r["k"] + rate * rate * r["n"] if r["n"] else 0.0
        rho = (spread / (rate * (1 - rate)) - r["groups"]) / more if more else params.most_rho
        rho = min(max(rho, params.least_rho), params.most_rho)
        return (1 - rho) / rho

    at_host, at_domain, at_suffix = (strength(levels[i]) for i in range(3))

    def shrunk(above: Column, weight: float) -> Column:
        return (F.coalesce("k", F.lit(0.0)) + weight * above) / (F.coalesce("n", F.lit(0.0)) + weight)

    asked = hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": public_suffix(F.col("host"))})
    out = asked.join(by_suffix, "suffix", "left").withColumn("at_suffix", shrunk(F.lit(rate), at_suffix)).drop("n", "k")
    out = out.join(by_domain.drop("suffix"), "domain", "left").withColumn("at_domain", shrunk(F.col("at_suffix"), at_domain)).drop("n", "k")
    out = out.join(by_host.drop("domain", "suffix"), "host", "left").withColumn("rate", shrunk(F.col("at_domain"), at_host))
    weight = F.coalesce("n", F.lit(0.0)) + at_host + 1
    bound = F.col("rate") - params.z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / weight)
    return out.select(*hosts.columns, "rate", bound.alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], params: Reputation = Reputation(), url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule (or null), verdict, rate and bound of every row. outcomes: url, good."""
    spark = pages.sparkSession
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = outcomes.select(host_of(F.col("url")).alias("host"), "good")
    hosts = runtime.Scratch(spark).write(parts.groupBy("host").agg(F.count("*").alias("rows")), "asked")
    total = hosts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if len(rules) <= MOST_COMPILED_RULES:
        found = parts.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    else:
        given = spark.createDataFrame([(r.text, r.verdict) for r in {r.text: r for r in rules}.values()], "text string, verdict string")
        fitting = rule_table(parts, given).select("host", "path", F.struct(F.col("rule").alias("text"), "verdict").alias("found"))
        found = parts.join(fitting, ["host", "path"], "left")
    scored = runtime.join_hot(found, host_posteriors(known, hosts, params), ["host"], "rows", total, F.xxhash64("key", "path"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("bound") >= params.floor, "allow").otherwise("block"))
    return scored.select(F.col("key").alias(key), "host", "path", F.col("found.text").alias("rule"), verdict.alias("verdict"), "rate", "bound")
