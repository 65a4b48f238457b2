"""URL filters: listed rules first, an empirical-Bayes reputation of the host for the rest.

A rule is a host and a path prefix; it fits that host and its subdomains, and the longest fitting rule decides.  Pages
without a rule are judged by their host: outcomes of labelled pages (bad or not) are counted per host, and each level
(suffix, registered domain, host) gets a beta prior whose mean is its parent's and whose strength is estimated from the
spread among the level's members, so that a host with few outcomes is drawn towards its domain, that towards its suffix,
that towards the whole.  A page is blocked where its host's share of bad pages exceeds `limit` with the certainty that
`z` deviations of the posterior give.

All steps are column expressions, aggregations and joins.  Counts per host are combined on the map side before they are
moved, so that a host with a third of all pages is a row from each task; pages meet only the list of hosts that are
blocked, broadcast behind a count or joined by a shuffle that adaptive execution can split.

Cases: a null URL, or one without `://`, has empty host and path, and is judged as a host of that name; an outcome that is
null, or of a page that isn't there, counts for nothing; labels of one page given twice count twice; without outcomes
every page without a rule is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import written

#: (verdict, rule) of the registered query (fixed values)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Public suffixes of two labels; a last label is a suffix by itself
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.in", "co.nz", "com.br", "com.cn")

#: Bytes of blocked hosts up to which they are broadcast
BROADCAST_BYTES = 16 << 20


@dataclass(frozen=True)
class Reputation:
    """Parameters of the posterior bound: share of bad pages not to exceed, deviations, and the prior's least and most strength in pages."""

    limit: float = 0.5
    z: float = 1.645
    least: float = 1.0
    most: float = 1_000.0


def host_of(url: Column) -> Column:
    """Behind the first `://`, up to `/`, `?`, `#` or the end, A-Z in small letters; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.  The rules are a short list: they are in the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        at_host = (host == name) | host.endswith(f".{name}")
        fits = at_host & path.startswith(slash + rest) if slash else at_host
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """Public suffix of a host: its last two labels if they are one, else its last."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1)) if suffixes else F.substring_index(host, ".", -1)


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and the label before it; the host itself where there is none."""
    labels = F.when(suffix.contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host == suffix, host).otherwise(labels)


def _strength(level: DataFrame, of: Reputation) -> Column:
    """Prior strength m of a level, an aggregate of its members (n, bad, mean: the parent's raw share).

    One-way analysis of variance: rho, the correlation of outcomes within a member, is (B - W) / (B + (n0 - 1) W) with B the
    mean square between members around their parents and W that within; m = (1 - rho) / rho.
    """
    k, total = F.count("*"), F.sum("n").cast("double")
    share = F.col("bad") / F.col("n")
    between = F.try_divide(F.sum(F.col("n") * (share - F.col("mean")) * (share - F.col("mean"))), k - 1)
    within = F.try_divide(F.sum(F.col("n") * share * (1 - share)), total - k)
    n0 = F.try_divide(total - F.try_divide(F.sum(F.col("n").cast("double") * F.col("n")), total), k - 1)
    rho = F.try_divide(between - within, between + (n0 - 1) * within)
    # a level with one member, or with one page a member, says nothing about the spread
    return F.when(rho > 0, F.least(F.greatest(F.try_divide(1 - rho, rho), F.lit(of.least)), F.lit(of.most))).otherwise(F.lit(of.most))


def host_reputation(outcomes: DataFrame, of: Reputation = Reputation(), suffixes=SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, bad, prior, posterior, bound) of each host with outcomes (host, bad: 0 or 1).

    bound is the posterior mean of the bad share less z deviations.  Written.
    """
    hosts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    hosts = written(hosts, "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffix = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    every = suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    whole = every["bad"] / every["n"] if every["n"] else 0.0

    def shrunk(level: DataFrame, prior: Column, m: float) -> DataFrame:
        return level.withColumn("prior", prior).withColumn("posterior", (F.col("bad") + m * F.col("prior")) / (F.col("n") + m))

    def strength(level: DataFrame) -> float:
        return level.agg(_strength(level, of).alias("m")).first()["m"]

    s = suffix.withColumn("mean", F.lit(whole))
    s = shrunk(s, F.lit(whole), strength(s)).select("suffix", F.col("posterior").alias("up"), (F.col("bad") / F.col("n")).alias("mean"))
    d = domains.join(s, "suffix")
    d = written(shrunk(d, F.col("up"), strength(d)).select("domain", F.col("posterior").alias("up"), (F.col("bad") / F.col("n")).alias("mean")), "domains")
    h = hosts.join(d, "domain")
    m = strength(h)
    h = shrunk(h, F.col("up"), m)
    mean, weight = F.col("posterior"), F.col("n") + m
    bound = mean - of.z * F.sqrt(mean * (1 - mean) / (weight + 1))
    return written(h.select("host", "domain", "suffix", "n", "bad", "prior", "posterior", bound.alias("bound")), "reputation")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, of: Reputation = Reputation(), suffixes=SUFFIXES, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, method) of each page; outcomes: (page_id, bad), bad 0 or 1.

    method is `rule` or `reputation`.
    """
    u = F.col(url)
    told = outcomes.where(F.col("bad").isNotNull()).select(F.col("page_id").alias("id"), "bad")
    seen = pages.select(F.col(id_col).alias("id"), host_of(u).alias("host")).join(told, "id").select("host", "bad")
    ranks = host_reputation(seen, of, suffixes)
    blocked = ranks.where(F.col("bound") > of.limit).select("host", F.lit(True).alias("bad_host"))
    if (blocked.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        blocked = F.broadcast(blocked)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    judged = judged.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)).join(blocked, "host", "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("bad_host"), "block").otherwise("allow"))
    method = F.when(F.col("found").isNotNull(), "rule").otherwise("reputation")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), method.alias("method"))


def url_digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict of each page; a label of low quality under a page's id is a bad outcome of that page."""
    bad = labels.select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(pages, bad)
