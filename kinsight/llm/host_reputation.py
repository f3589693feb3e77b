"""Operator 3: url filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix. Each level's counts are shrunk through a beta-binomial prior whose mean
is the posterior mean of the level above and whose concentration is estimated,
by the method of moments, from the spread of that level's groups about those
means. A host is blocked when the lower bound of its posterior bad rate exceeds a
threshold, by default the overall bad rate: it is credibly worse than the rest.
Where labels do not differ between hosts more than chance makes them, the priors
are narrow and no host is blocked.
Explicit rules (host and path prefix) come before the method; the longest wins.

Only counts are shuffled, pre-aggregated by host, domain and suffix; large domains
and suffixes are joined by broadcast (a thousand at most), the others spread.
Hosts that hold more than a thousandth of the pages (so a thousand at most) are
joined by broadcast, the others by a shuffled join, so that no host's pages meet
in one task.

Defined results: a null url or one without `://` has empty host and path and is
allowed; urls of any length are read whole; of rules of equal length the later in
order of text wins; repeated rows each give a row and count; null or unlabelled
outcomes don't count; with no label at all every host is judged by the prior
alone; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.llm.common import ascii_lower, join_spread, written

# Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "com.tr")

#: A host is heavy above this share of the pages, which bounds their number by its inverse.
HEAVY_SHARE = 1000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def host_counts(pages: DataFrame, outcomes: DataFrame, url_col: str = "url") -> DataFrame:
    """host, domain, suffix, n_pages, n (labelled), bad. outcomes: url, bad 0/1."""
    seen = pages.select(url_host(F.col(url_col)).alias("host"), F.lit(1).alias("page"), F.lit(0).alias("n"), F.lit(0).alias("bad"))
    told = outcomes.where(F.col("bad").isNotNull()).select(url_host(F.col("url")).alias("host"), F.lit(0).alias("page"), F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad"))
    summed = seen.unionByName(told).groupBy("host").agg(F.sum("page").alias("n_pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return summed.where("host != ''").select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n_pages", "n", "bad")


def concentration(groups: DataFrame, mean: Column, low: float = 1.0, high: float = 1000.0) -> float:
    """The beta prior's concentration about the groups' own prior means, by moments; one row of sums reaches the driver.

    With known means a group's squared deviation over its binomial variance is
    1 + (n - 1) / (concentration + 1) on average.
    """
    squares = F.pow(F.col("bad") - F.col("n") * mean, 2) / (F.col("n") * mean * (1 - mean))
    x = groups.where("n > 0").agg(F.count("*").alias("groups"), F.coalesce(F.sum(squares), F.lit(0.0)).alias("squares"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first()
    excess = x.squares - x.groups
    return min(max(x.n / excess - 1, low), high) if excess > 0 else high


def shrunk(mean: Column, k: float) -> Column:
    return (F.col("bad") + k * mean) / (F.col("n") + k)


def reputations(counts: DataFrame, z: float = 1.645) -> tuple[DataFrame, float]:
    """host, n_pages, bad_rate (posterior mean), bad_low (its lower bound, of the normal approximation), and the overall bad rate."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    rate = (total.bad + 0.5) / (total.n + 1.0)
    domains = counts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("domains"))
    suffixes = suffixes.withColumn("suffix_rate", shrunk(F.lit(rate), concentration(suffixes, F.lit(rate)))).select("suffix", "suffix_rate", "domains")
    domains = written(join_spread(domains, suffixes, "suffix", "suffix_rate", "domains"), "domain-counts")
    parent = F.col("suffix_rate")
    domains = domains.withColumn("domain_rate", shrunk(parent, concentration(domains, parent))).select("domain", "domain_rate", "hosts")
    hosts = written(join_spread(counts, domains, "domain", "domain_rate", "hosts"), "host-priors")
    parent, k = F.col("domain_rate"), concentration(hosts, F.col("domain_rate"))
    deviation = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + k + 1))
    return hosts.withColumn("bad_rate", shrunk(parent, k)).select("host", "n_pages", "bad_rate", (F.col("bad_rate") - z * deviation).alias("bad_low")), rate


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float | None = None, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, host, path, rule and verdict. threshold: of the bad rate; None stands for the overall rate."""
    counts = written(host_counts(pages, outcomes, url_col), "host-counts")
    rated, overall = reputations(counts, z)
    rated = rated.withColumn("blocked", F.col("bad_low") > (overall if threshold is None else threshold))
    n_pages = counts.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    heavy = F.col("n_pages") * HEAVY_SHARE > n_pages
    often = rated.where(heavy).select("host", F.col("blocked").alias("often_blocked"))
    seldom = rated.where(~heavy).select(F.col("host").alias("tail"), F.col("blocked").alias("seldom_blocked"))
    judged = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).join(F.broadcast(often), "host", "left")
    # a heavy host's rows carry a key that no tail host has, spread over tasks
    tail = F.when(F.col("often_blocked").isNull() & (F.col("host") != ""), F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64(id_col)))
    judged = judged.withColumn("tail", tail).join(seldom, "tail", "left")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.coalesce("often_blocked", "seldom_blocked", F.lit(False)), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))
