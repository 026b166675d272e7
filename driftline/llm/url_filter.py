"""URL filter: rules first, else the host's empirical-Bayes reputation.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix. From the top down each
group's rate is shrunk towards its parent's by a beta-binomial prior whose strength is fitted by moments over all
groups of the level; a host that has no outcomes gets its parent's prior. A page is blocked if the upper bound of its
host's posterior is below the least rate, so that doubt allows.

Null urls and those without :// have an empty host and path, which form a group of their own and fit no rule; empty
tables give empty results; outcomes that are null count as absent; repeated rows are judged each.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_grouped, stored

#: Suffixes of two labels, under which a registered domain has three. Fixed values.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Bounds of a prior's strength, in outcomes.
STRENGTH = (1.0, 1000.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule (text, allow or block) that fits, else null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        one = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def site_levels(host: Column, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix; suffixes have one label, but for the given ones of two."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    double = two.isin(*double_suffixes)
    return F.when(double, three).otherwise(two), F.when(double, two).otherwise(F.element_at(labels, -1))


def shrunk(groups: DataFrame) -> DataFrame:
    """groups (n, k, parent) with alpha and beta of each posterior; the prior's strength is fitted over all groups."""
    v, p = F.col("parent") * (1 - F.col("parent")), F.col("k") / F.col("n")
    fit = groups.filter("n > 0").agg(
        F.sum(F.col("n") * (p - F.col("parent")) ** 2).alias("seen"), F.sum(v).alias("least"), F.sum(v * (F.col("n") - 1)).alias("room")
    ).first()
    spread = max(0.0, (fit.seen - fit.least) / fit.room) if fit.room else 0.0
    strength = min(STRENGTH[1], max(STRENGTH[0], 1 / spread - 1)) if spread else STRENGTH[1]
    return groups.withColumn("alpha", strength * F.col("parent") + F.col("k")).withColumn("beta", strength * (1 - F.col("parent")) + F.col("n") - F.col("k"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float, double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> DataFrame:
    """host, pages (its number), n, k, mean, lower, upper for every host of pages (host) given outcomes (host, good)."""
    counted = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(counted, "host", "left").fillna(0, ["n", "k"])
    domain, suffix = site_levels(F.col("host"), double_suffixes)
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    top = ((total.k or 0) + 1) / ((total.n or 0) + 2)
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    suffixes = shrunk(stored(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("size")).withColumn("parent", F.lit(top))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("size"))
    n_hosts = hosts.count()
    below = suffixes.select("suffix", mean.alias("parent"), F.col("size").alias("hosts"))
    domains = shrunk(stored(join_grouped(domains, below, "suffix", "hosts", n_hosts)))
    below = domains.select("domain", mean.alias("parent"), "size")
    judged = shrunk(stored(join_grouped(hosts, below, "domain", "size", n_hosts)))
    a, b = F.col("alpha"), F.col("beta")
    sd = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return judged.select("host", "pages", "n", "k", mean.alias("mean"), F.greatest(F.lit(0.0), mean - z * sd).alias("lower"), F.least(F.lit(1.0), mean + z * sd).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], least_rate: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", double_suffixes: Sequence[str] = DOUBLE_SUFFIXES) -> DataFrame:
    """id, host, path, rule, verdict and reputation (posterior mean of a good page) for each row of pages; outcomes: id, good."""
    host, path = url_parts(F.col(url_col))
    judged = stored(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")))
    labelled = judged.join(outcomes.select("id", "good"), "id").select("host", "good")
    hosts = stored(host_reputation(judged, labelled, z, double_suffixes))
    joined = join_grouped(judged, hosts.select("host", "pages", "mean", "upper"), "host", "pages", judged.count())
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("upper") < least_rate, "block").otherwise("allow"))
    return joined.withColumn("fit", rule).select("id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("mean").alias("reputation"))
