"""URL filters: fixed rules first, then the reputation of a host by empirical Bayes.

Labelled pages give each host a count of bad outcomes. A host's rate is shrunk towards that of its registered
domain, the domain's towards its suffix and the suffix's towards all pages, by beta-binomial priors whose
weights are estimated from the spread of the counts. A page goes if the lower bound of its host's posterior
bad rate is above the limit. A host without labelled pages has the prior that its domain, else its suffix, gives it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, join_stored, stored

#: (verdict, host, start of the path); the longest fitting rule wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels; all others are the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
MAX_BAD = 0.25
SIGMAS = 1.645
LEVELS = ("suffix", "domain", "host")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffixes_of(table: DataFrame, name: str = "suffix", limit: int = 50_000) -> tuple[str, ...]:
    """Suffixes of two labels from a table (a published list has some thousands; more than ``limit`` are refused)."""
    rows = table.select(F.lower(F.trim(F.col(name))).alias("s")).filter(F.size(F.split("s", r"\.")) == 2).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} suffixes")
    return tuple(sorted(r["s"] for r in rows))


def bare_host(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def with_names(df: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``host``, its bare name, registered domain and public suffix; a host that is a suffix is its own domain."""
    df = df.withColumn("bare", bare_host(F.col("host")))
    last = F.substring_index("bare", ".", -1)
    two = F.substring_index("bare", ".", -2)
    suffix = F.when(two.isin(list(suffixes)), two).otherwise(last)
    labels = F.when(two.isin(list(suffixes)), F.substring_index("bare", ".", -3)).otherwise(two)
    return df.withColumn("suffix", suffix).withColumn("domain", labels)


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Posterior of every host with labelled pages, and of every domain and suffix above it.

    ``outcomes``: host and bad (0 or 1). Returns (level, name, n, bad, alpha, beta, weight), weight being that of the
    level's prior. One shuffle of the labelled
    pages to their hosts, partial sums first; the levels above add up host counts.
    """
    hosts = stored(
        with_names(outcomes.select(bare_host(F.col("host")).alias("host"), "bad").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad")), suffixes)
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    n, bad = total["n"] or 0, total["bad"] or 0
    out = []
    above = None
    for level, parent in zip(LEVELS, (None, *LEVELS)):
        keys = [level] if parent is None else [level, parent]
        own = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if above is None:
            own = own.withColumn("mean", F.lit((bad + 1.0) / (n + 2.0)))
        else:
            own = join_stored(own, above.select(F.col("name").alias(parent), "mean"), [parent], "inner")
        own = stored(own.select(F.col(level).alias("name"), "n", "bad", "mean"))
        weight = prior_weight(own)
        alpha = F.lit(weight) * F.col("mean") + F.col("bad")
        beta = F.lit(weight) * (1 - F.col("mean")) + F.col("n") - F.col("bad")
        own = own.select("name", "n", "bad", alpha.alias("alpha"), beta.alias("beta"), F.lit(weight).alias("weight"))
        above = stored(own.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))))
        out.append(above.select(F.lit(level).alias("level"), "name", "n", "bad", "alpha", "beta", "weight"))
    return stored(reduce(DataFrame.unionAll, out))


def prior_weight(children: DataFrame) -> float:
    """Weight of the parent's rate in pages, from the spread of the children's rates round it: the
    intra-class correlation r that makes the expected squares of a beta-binomial meet the seen ones, as 1/r - 1
    between 1 and 10,000."""
    p = F.col("bad") / F.col("n") - F.col("mean")
    v = F.col("mean") * (1 - F.col("mean"))
    s = children.agg(F.sum(F.col("n") * p * p).alias("seen"), F.sum(v).alias("chance"), F.sum(v * (F.col("n") - 1)).alias("more")).first()
    if not s["more"]:
        return 10_000.0
    r = min(0.5, max(1 / 10_001, (s["seen"] - s["chance"]) / s["more"]))
    return 1 / r - 1


def host_weight(known: DataFrame) -> float:
    """Weight of the prior of hosts; without labelled pages there is nothing that it would be applied to."""
    return known.filter(F.col("level") == "host").agg(F.max("weight")).first()[0] or 1.0


def judged_urls(
    pages: DataFrame, outcomes: DataFrame, id: str = "page_id", url: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES, suffixes: tuple[str, ...] = SUFFIXES, max_bad: float = MAX_BAD,
    sigmas: float = SIGMAS,
) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict, and the posterior mean and lower bound
    of the bad rate that the method judges by.

    ``outcomes``: url and bad (0 or 1) of labelled pages; rows with a null in either do not count. A host without
    labelled pages is judged by its prior: the posterior mean of its domain, else of its suffix, with the weight that the
    host level has; without either it has no bound and is allowed. User and port of a host belong to no domain. A null
    url, or one without ``://``, has an empty host and path and is judged as the host "". Repeated rows and null ids pass through; other columns are not read; an empty
    table gives an empty result.
    """
    seen = outcomes.filter(F.col("bad").isNotNull() & F.col("url").isNotNull()).select(host_of(F.col("url")).alias("host"), "bad")
    known = reputations(seen, suffixes)
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    spread = F.sqrt(mean * (1 - mean) / (F.col("alpha") + F.col("beta") + 1))
    prior = F.sqrt(mean * (1 - mean) / (F.lit(host_weight(known)) + 1))
    spread = F.when(F.col("level") == "host", spread).otherwise(prior)
    known = stored(known.select("level", "name", mean.alias("mean"), (mean - F.lit(sigmas) * spread).alias("bound")))
    at = pages.select(col(id).alias("page_id"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    rows = with_names(at, suffixes)
    for level in LEVELS[::-1]:
        key = "bare" if level == "host" else level
        side = known.filter(F.col("level") == level).select(
            F.col("name").alias(key), F.col("mean").alias(f"{level}_mean"), F.col("bound").alias(f"{level}_bound")
        )
        rows = join_stored(rows, side, [key])
    mean, bound = (F.coalesce(*(F.col(f"{level}_{what}") for level in LEVELS[::-1])) for what in ("mean", "bound"))
    bad = F.coalesce(bound > max_bad, F.lit(False))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(bad, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, method).alias("verdict"),
        mean.alias("bad_rate"), bound.alias("bad_bound"),
    )


#: The number in a page's path is the id of the document it shows.
DOCUMENT = r"/(\d+)(?:\.html)?/?$"


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages: the quality label of the document a page shows (0 is bad), by the number in its path."""
    shown = pages.select("url", F.regexp_extract(path_of(F.col("url")), DOCUMENT, 1).try_cast("bigint").alias("doc_id"))
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return shown.join(marks.select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").select("url", "bad")
