"""URL filter: hand-written rules first, then the host's reputation by empirical Bayes.

Labelled pages are counted per host. Each level's bad-page rate has a beta prior whose mean is the posterior
mean of the level above (host, registered domain, suffix, everything) and whose strength is the level's
between-group agreement, estimated from all groups. A host is blocked where the lower bound of its posterior
bad-page rate (a quantile of its beta distribution) exceeds the allowed rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, saved

#: Fixed values: (rule, verdict); the part up to the first / is a host with all its subdomains, the rest a path prefix.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Labels below a country's two-letter domain under which names are registered.
SECOND_LABELS = "ac asn asso biz co com ebiz ed edu firm gc gen geek go gob gouv gov gr govt gub gv id ind info int k12 kg lg ltd maori mil mod muni name ne net nhs nic nom or org parliament plc police pro rec res sch school store tm tv web".split()
#: Names below which others register names of their own, so that each of these is a registered domain by itself.
SHARED = "appspot.com azurewebsites.net blogspot.com bitbucket.io cloudfront.net firebaseapp.com fly.dev github.io gitlab.io glitch.me herokuapp.com netlify.app onrender.com pages.dev readthedocs.io repl.co s3.amazonaws.com shopify.com sourceforge.io substack.com surge.sh tumblr.com typepad.com vercel.app web.app weebly.com wixsite.com wordpress.com workers.dev".split()
#: A host is blocked if its bad-page rate is above this with at least this posterior chance.
ALLOWED_RATE, CHANCE = 0.25, 0.95


def judged_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row; both are empty for a null url or one without ://."""
    rest = F.when(F.contains(F.col("url"), F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    lower = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).select("page_id", lower.alias("host"), F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null; equal lengths go to the first in order of text."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bare_host(host: Column) -> Column:
    """A host without the user before an @, the port, and a dot at the end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?\z", "")


def suffix_of(bare: Column, shared: list[str] = SHARED) -> Column:
    """The public suffix: a shared name, a country's second label, or the last label; of a numeric address all of it."""
    two, last = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)
    second = F.substring_index(two, ".", 1)
    out = F.when((F.length(last) == 2) & (two != last) & second.isin(SECOND_LABELS), two).otherwise(last)
    for n in sorted({name.count(".") + 1 for name in shared}):
        tail = F.substring_index(bare, ".", -n)
        out = F.when(tail.isin([s for s in shared if s.count(".") + 1 == n]), tail).otherwise(out)
    return F.when(bare.rlike(r"^[0-9.]+\z|^\[") | (bare == ""), bare).otherwise(out)


def domain_of(bare: Column, suffix: Column) -> Column:
    """The suffix and one label before it (the host itself if it has no more labels)."""
    before = F.left(bare, F.greatest(F.length(bare) - F.length(suffix) - 1, F.lit(0)))
    return F.when(before == "", bare).otherwise(F.concat_ws(".", F.substring_index(before, ".", -1), suffix))


def chance_above(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """The chance of a beta(a, b) variate to exceed x, by the continued fraction of the incomplete beta function."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    turn = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, m, moving = d.copy(), 0, np.ones(len(p), bool)
    # The number of steps grows with the root of the counts.
    while moving.any():
        m += 1
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = np.where(moving, h * c * d, h)
            moving &= np.abs(c * d - 1) > 1e-14
    front = np.array([lgamma(u + v) - lgamma(u) - lgamma(v) for u, v in zip(p, q, strict=True)]) + p * np.log(y) + q * np.log1p(-y)
    below = np.exp(front) * h / p
    return np.where(turn, below, 1 - below)


def _level(groups: DataFrame, above: DataFrame, parent: str) -> DataFrame:
    """groups(parent, n, bad, ...) with alpha and beta of each group's posterior under its parent's mean.

    The strength of the prior is the moment estimate over all groups of at least two pages: with agreement rho
    between the pages of a group, (1 - rho) / rho, held between 1 and 1000.
    """
    children = groups.groupBy(parent).count()
    priors = above.select(parent, F.col("mean").alias("prior_mean")).join(children, parent)
    # A popular domain's hosts are dealt, not sent to one task.
    joined = saved(join_skewed(groups, priors, parent, "count", groups.count()), "level")
    n, bad, m = F.col("n"), F.col("bad"), F.col("prior_mean")
    usable = n > 1
    moments = joined.agg(F.sum(F.when(usable, (bad / n - m) * (bad / n - m) * n)).alias("between"), F.sum(F.when(usable, m * (1 - m))).alias("within"), F.sum(F.when(usable, m * (1 - m) * (n - 1))).alias("extra"))
    rho = F.greatest(F.lit(1e-3), F.least(F.lit(0.5), (F.col("between") - F.col("within")) / F.col("extra")))
    strength = moments.select(F.coalesce(F.when(F.col("extra") > 0, (1 - rho) / rho), F.lit(1000.0)).alias("s")).first()["s"]
    strength = float(min(1000.0, max(1.0, strength)))
    out = joined.withColumn("alpha", bad + m * strength).withColumn("beta", n - bad + (1 - m) * strength)
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))).select(*groups.columns, "alpha", "beta", "mean")


def host_reputation(hosts: DataFrame, labels: DataFrame, allowed_rate: float = ALLOWED_RATE) -> DataFrame:
    """host, pages (rows of hosts), n and bad (labelled pages), mean of the bad-page rate of each host, and above:
    the posterior chance that the rate exceeds allowed_rate, which is 0.95 exactly where the 5 % quantile equals it.

    hosts has page_id and host; labels has doc_id (the page's id) and quality (0 is bad). Hosts without labelled
    pages keep the mean and spread of their domain. Null labels don't count; of repeated labels the worst does.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_page")).agg(F.min("quality").alias("quality"))
    marked = hosts.join(marks, F.col("page_id").cast("long") == F.col("_page"), "left")
    counted = marked.groupBy("host").agg(F.count("*").alias("pages"), F.count("quality").alias("n"), F.coalesce(F.sum(1 - F.col("quality")), F.lit(0)).alias("bad"))
    counted = counted.withColumn("_bare", bare_host(F.col("host")))
    counted = counted.withColumn("suffix", suffix_of(F.col("_bare")))
    counted = counted.withColumn("domain", domain_of(F.col("_bare"), F.col("suffix"))).withColumn("everything", F.lit("")).drop("_bare")
    counted = saved(counted, "hosts")
    domains = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = counted.groupBy("suffix", "everything").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = counted.groupBy("everything").agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean"))
    by_suffix = _level(suffixes, top, "everything")
    by_domain = _level(domains, by_suffix, "suffix")
    by_host = _level(counted, by_domain, "domain")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(chance_above(a.to_numpy(), b.to_numpy(), allowed_rate))

    above = F.pandas_udf(run, "double")
    return by_host.select("host", "pages", "n", "bad", "mean", above("alpha", "beta").alias("above"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, allowed_rate: float = ALLOWED_RATE, chance: float = CHANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, ...).

    A rule's verdict goes before the method's. Rows with a null url, or without ://, have an empty host and
    path and are judged as one host of that name; null page_ids are judged but never labelled; repeated rows
    are judged each; a host without labelled pages is judged by its domain's posterior. Other columns are
    ignored; empty tables give an empty result, empty labels allow all that no rule blocks.
    """
    urls = judged_urls(pages)
    total = pages.count()
    reputation = host_reputation(urls, labels, allowed_rate).select("host", "pages", (F.col("above") >= chance).alias("bad_host"))
    rows = join_skewed(urls, reputation, "host", "pages", total)
    found = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_rule", found)
    own = F.when(F.coalesce("bad_host", F.lit(False)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"))
