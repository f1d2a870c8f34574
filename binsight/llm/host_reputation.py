"""URL filter by empirical-Bayes host reputation.

Labelled outcomes (good or not) are counted per host.  A host's share of good
pages is shrunk towards its registered domain, the domain towards its suffix and
the suffix towards the whole, each through a beta prior.  The strength of the
prior at a level comes from the spread of the observed shares below it (method
of moments for the beta-binomial).  A page is blocked if even the upper bound
of its host's posterior stays under the threshold, so hosts with little or no
evidence pass.  Explicit rules (host, path prefix) come first; the longest wins.

Counts are summed map-side and written once per host; the levels above and all
three strengths are read from that table.  Hosts are joined by key, and a page never carries
its text: a host with a third of all pages costs a sum and a join whose skewed
partition can be split.

Defined results: a null url or one without ``://`` has an empty host and path and
gets the verdict of the empty host, as any other.  Outcomes that are null are
not counted.  Without any outcome every page that no rule blocks is allowed.
Repeated rows get equal results; null ids are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from binsight.llm.common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str          # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: rules of the registered query
RULES = (Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix (last label) and one label more."""
    return F.substring_index(host, ".", -2)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def moments(groups: DataFrame, level: str) -> DataFrame:
    """One row: the sums over ``groups`` that ``strength`` needs."""
    return groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
                      F.sum(F.col("good").cast("double") * F.col("good") / F.col("n")).alias("gg")).withColumn("level", F.lit(level))


def strength(r: Row, lowest: float, highest: float) -> float:
    """Prior strength (alpha + beta) from the spread of shares good / n among
    groups: the moment estimate of the beta-binomial's overdispersion."""
    if r.k < 2 or not 0 < r.g < r.n:
        return highest
    mean = r.g / r.n
    spread = r.gg - r.n * mean * mean
    rho = (spread - (r.k - 1) * mean * (1 - mean)) / (mean * (1 - mean) * (r.n - r.nn / r.n - (r.k - 1)))
    return min(max(1 / rho - 1, lowest), highest) if rho > 0 else highest


def host_scores(outcomes: DataFrame, host_col: str, good_col: str, z: float = 1.645, lowest: float = 2.0, highest: float = 1000.0) -> tuple[DataFrame, dict]:
    """(host, n, good, mean, upper) of every host with outcomes, and the prior of
    hosts without: strengths per level, the whole's share, suffix and domain tables."""
    hosts = cut(outcomes.where(F.col(good_col).isNotNull() & F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host"))
                .agg(F.count("*").alias("n"), F.sum(F.col(good_col).cast("long")).alias("good"))
                .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    levels = {r.level: r for r in moments(hosts, "host").unionByName(moments(domains, "domain")).unionByName(moments(suffixes, "suffix")).collect()}
    total = levels["suffix"]
    whole = (total.g + 1) / (total.n + 1) if total.n else 1.0
    k_host, k_domain, k_suffix = (strength(levels[x], lowest, highest) for x in ("host", "domain", "suffix"))
    suffixes = suffixes.select("suffix", ((F.col("good") + k_suffix * whole) / (F.col("n") + k_suffix)).alias("m_suffix"))
    domains = (domains.join(suffixes, "suffix")
               .select("domain", "m_suffix", ((F.col("good") + k_domain * F.col("m_suffix")) / (F.col("n") + k_domain)).alias("m_domain")))
    scored = hosts.join(domains, "domain").select(
        "host", "n", "good", *posterior(F.col("good"), F.col("n"), F.col("m_domain"), k_host, z))
    return scored, {"k_host": k_host, "whole": whole, "suffixes": suffixes, "domains": domains, "z": z}


def posterior(good: Column, n: Column, prior: Column, k: float, z: float) -> tuple[Column, Column]:
    mean = (good + k * prior) / (n + k)
    return mean.alias("mean"), F.least(F.lit(1.0), mean + z * F.sqrt(mean * (1 - mean) / (n + k + 1))).alias("upper")


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", host_col: str = "host", good_col: str = "good",
          rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, and the
    host's posterior (n_labelled, reputation, upper)."""
    scored, prior = host_scores(outcomes, host_col, good_col, z)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # hosts without outcomes: the posterior is the prior of the nearest level with any
    unseen = (rows.select("host").distinct().join(scored, "host", "left_anti")
              .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
              .join(prior["domains"].select("domain", "m_domain"), "domain", "left").join(prior["suffixes"], "suffix", "left")
              .withColumn("p", F.coalesce("m_domain", "m_suffix", F.lit(prior["whole"])))
              .select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("good"),
                      *posterior(F.lit(0.0), F.lit(0.0), F.col("p"), prior["k_host"], z)))
    hosts = scored.unionByName(unseen).select("host", "n", "mean", "upper")
    verdicts = F.create_map(*(x for r in rules for x in (F.lit(r.text), F.lit(r.verdict)))) if rules else F.create_map().cast("map<string,string>")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return (rows.join(hosts, "host", "left").withColumn("rule", rule)
            .select("page_id", "host", "path", "rule", F.coalesce(F.try_element_at(verdicts, F.coalesce("rule", F.lit(""))), own).alias("verdict"),
                    F.coalesce("n", F.lit(0)).alias("n_labelled"), F.col("mean").alias("reputation"), "upper"))
