"""URL filtering by host reputation with empirical-Bayes shrinkage.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix.  Each
level's bad share is a beta-binomial posterior whose prior is centred on the level above:
suffix on the whole, domain on its suffix, host on its domain.  Prior strengths come from the
data by moments, per level.  A host is blocked when even the lower bound of its posterior bad
share exceeds ``MAX_BAD``, so hosts with few or no labels stay.  Explicit rules go first.

All counts are combined before any shuffle; only three numbers (the prior strengths) reach the
driver.  Pages meet their host's verdict in a shuffle join that adaptive execution can split.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged as
the host ``''``; repeated pages are judged one by one; outcomes that are null or of unknown pages are
left out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catamatch.llm.common import LOWER, UPPER
from catamatch.operators.stage import written

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
#: Public suffixes of two labels that are common.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
              "com.br", "co.in", "co.nz", "co.za", "co.kr", "com.cn", "com.mx", "com.tr")
MAX_BAD, Z, MOST_RHO = 0.5, 1.645, 0.333


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host (A-Z lower-cased) and path."""
    part = lambda i: F.coalesce(F.regexp_extract("url", "://([^/?#]*)([^?#]*)", i), F.lit(""))
    return pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """STRUCT<rule, verdict> of the longest fitting rule, else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def levels(hosts: DataFrame) -> DataFrame:
    """Adds suffix and registered domain to hosts."""
    last = lambda n: F.substring_index("host", ".", -n)
    two = last(2).isin(*TWO_LABELS)
    return hosts.withColumns({"suffix": F.when(two, last(2)).otherwise(last(1)),
                              "domain": F.when(two, last(3)).otherwise(last(2))})


def _strength(units: DataFrame) -> float:
    """Prior strength of the units (n, bad) around their mean, by moments of the beta-binomial.

    It is at least that of two observations, so a label or two never decide alone.
    """
    r = units.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
                                 F.sum(F.col("n") * F.col("n")).alias("n2"),
                                 F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2")).first()
    if not r["k"] or r["k"] < 2:
        return 10.0
    p = r["bad"] / r["n"]
    spread = p * (1 - p)
    if spread == 0:
        return 10.0
    between = r["b2"] - r["n"] * p * p
    rho = (between - (r["k"] - 1) * spread) / ((r["n"] - r["n2"] / r["n"] - (r["k"] - 1)) * spread or 1.0)
    return 1 / min(max(rho, 0.001), MOST_RHO) - 1


def reputation(hosts: DataFrame) -> DataFrame:
    """host, score (posterior bad share), low (its lower bound) from host, n, bad counts."""
    hosts = levels(hosts)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    m_suffix, m_domain, m_host = _strength(suffixes), _strength(domains), _strength(hosts)
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = whole["bad"] / whole["n"] if whole["n"] else 0.0

    def shrunk(m, prior):
        return (F.col("bad") + m * prior) / (F.col("n") + m)

    suffixes = suffixes.select("suffix", shrunk(m_suffix, F.lit(mean)).alias("p_suffix"))
    domains = domains.join(suffixes, "suffix").select("suffix", "domain", shrunk(m_domain, F.col("p_suffix")).alias("p_domain"))
    a = F.col("bad") + m_host * F.col("p_domain")
    b = F.col("n") - F.col("bad") + m_host * (1 - F.col("p_domain"))
    score = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, ["suffix", "domain"]).select("host", score.alias("score"), (score - Z * sd).alias("low"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    outcomes: page_id, bad (0 or 1), one row per labelled page.
    """
    urls = parsed(pages)
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(
        F.max("bad").alias("bad")).withColumnRenamed("page_id", "labelled")
    hosts = written(urls.join(known, F.col("page_id") == F.col("labelled"), "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    judged = reputation(hosts)
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("low") > max_bad, "block").otherwise("allow")
    return urls.join(judged, "host").select(
        "page_id", "host", "path", ruled["rule"].alias("rule"), F.coalesce(ruled["verdict"], verdict).alias("verdict"))
