"""URL filter: rules first, then the host's reputation by empirical Bayes (DataFrame functions only).

Labelled outcomes (a page was good or bad) are counted per host, registered domain and suffix. Each level
shrinks its counts towards the mean of the level above it through a beta-binomial prior; how strongly is
estimated from the spread between the groups of the level (method of moments). A host without outcomes
takes the prior of its domain, then of its suffix, then of the whole. A page is allowed when the lower
posterior bound of its host's good rate reaches the threshold.

Edge cases: a null url or one without ``://`` has an empty host and path, and the empty host is judged as
any other host. Repeated pages are repeated in the result. Outcomes whose label is null don't count. With no
outcomes at all the prior mean is 0.5 and its strength ``LOOSE``, so the bound decides for all hosts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.llm.base import lower_ascii

#: Public suffixes of two labels; all others are the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
#: Strength of a prior (in outcomes) when groups differ as much, or as little, as can be told.
LOOSE, TIGHT = 1.0, 1000.0
#: Standard normal quantile of the one-sided bound, and the good rate that it must reach.
Z, LEAST_GOOD = 1.6449, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    host, path = host_and_path(F.col("_url"))
    return pages.withColumn("_url", F.col(url)).withColumns({"host": host, "path": path}).drop("_url")


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and action; null when none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, action = F.when(fits, host + path).otherwise(name), F.when(fits, verdict).otherwise(action)
    return name, action


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    parts = F.split(host, r"\.")
    last = F.element_at(parts, -1)
    two = F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, F.greatest(-F.size(parts), F.lit(-2))), last)).otherwise(last)
    three = F.when(F.size(parts) > 2, F.concat_ws(".", F.element_at(parts, F.greatest(-F.size(parts), F.lit(-3))), two)).otherwise(two)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(last)


def strength(groups: DataFrame, mu: Column) -> DataFrame:
    """One row: the prior's strength for groups (n, k), from the spread of k / n between them."""
    spread = groups.select("n", "k", mu.alias("mu")).agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mu"), 2)).alias("v"),
        F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("groups"), F.max("mu").alias("m"))
    noise = F.col("m") * (1 - F.col("m")) * F.col("groups") / F.col("all_n")
    between = F.col("v") / F.col("all_n") - noise
    kappa = F.when(between > 1e-9, F.col("m") * (1 - F.col("m")) / between - 1).otherwise(TIGHT)
    return spread.select(F.coalesce(F.greatest(F.lit(LOOSE), F.least(F.lit(TIGHT), kappa)), F.lit(LOOSE)))


def reputations(outcomes: DataFrame) -> tuple[list[DataFrame], list[Column]]:
    """Counts by host, domain and suffix of ``outcomes`` (host, good boolean or null); the mean and each level's strength.

    Counts are combined before each shuffle, so a host with a third of all outcomes is one row per task.
    """
    known = outcomes.filter(F.col("good").isNotNull() & F.col("host").isNotNull())
    hosts = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mu = suffixes.agg(F.coalesce(F.sum("k") / F.sum("n"), F.lit(0.5))).scalar()
    levels = [hosts, domains, suffixes]
    return levels, [mu, *[strength(level, mu).scalar() for level in levels]]


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], keep: list[str]) -> DataFrame:
    """keep, host, path, rule, verdict of each page (url); outcomes: (host, good)."""
    own = with_host(pages.select(*keep, "url"))
    name, action = rule_columns(rules)
    domain, suffix = domain_and_suffix(F.col("host"))
    own = own.select(*keep, "host", "path", name.alias("rule"), action.alias("action"))
    (by_host, by_domain, by_suffix), (mu, kh, kd, ks) = reputations(outcomes)
    # Every host of the pages once, whatever its number of pages; then its posterior, level by level.
    hosts = own.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
    hosts = (hosts.join(by_suffix.select("suffix", F.col("n").alias("ns"), F.col("k").alias("gs")), "suffix", "left")
             .join(by_domain.select("domain", F.col("n").alias("nd"), F.col("k").alias("gd")), "domain", "left")
             .join(by_host.select("host", F.col("n").alias("nh"), F.col("k").alias("gh")), "host", "left")
             .na.fill(0, ["ns", "gs", "nd", "gd", "nh", "gh"])
             .withColumns({"mu": mu, "ks": ks, "kd": kd, "kh": kh}))
    hosts = hosts.withColumn("ms", (F.col("ks") * F.col("mu") + F.col("gs")) / (F.col("ks") + F.col("ns")))
    hosts = hosts.withColumn("md", (F.col("kd") * F.col("ms") + F.col("gd")) / (F.col("kd") + F.col("nd")))
    hosts = hosts.withColumn("mh", (F.col("kh") * F.col("md") + F.col("gh")) / (F.col("kh") + F.col("nh")))
    low = F.col("mh") - Z * F.sqrt(F.col("mh") * (1 - F.col("mh")) / (F.col("kh") + F.col("nh") + 1))
    return own.join(hosts.select("host", low.alias("low")), "host", "left").select(
        *keep, "host", "path", "rule",
        F.coalesce("action", F.when(F.col("low") >= LEAST_GOOD, "allow").otherwise("block")).alias("verdict"))
