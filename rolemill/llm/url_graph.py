"""URL verdicts from host and path rules, and from trust that spreads over the link graph.

A rule names a host and the start of a path and fits the host and its subdomains; the longest rule
that fits a url decides. All other urls take their host's verdict: personalised PageRank carries
trust from hosts with allowed pages along links, and distrust from hosts with blocked pages against
links (who links to a bad host is suspect). A host is blocked if its distrust reaches the threshold
and is above its trust.

Seeds are a host's share of allowed and of blocked pages. Edges are the different links of each
host to other hosts, with the share of these links that go there; links within a host carry nothing. Ranks and edges
are tables joined by host: a hub is one key of a join that Spark may split, its sums are
pre-aggregated, and one number a round comes to the driver: the mass still on its way. Rounds end when
all that it can still add, over all hosts, is below the tolerance. Each round's mass is written, so a
lost executor costs a round at most.

Defined results: host and path are empty where the url is null or has no `://`; no rule fits an empty
host, and its verdict is allow; null html has no links; hosts without links to them keep their seeds;
repeated pages count as often as they occur; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import read, written

#: The rules, as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rounds whose mass is summed at once.
PARTS = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Spread:
    damping: float = 0.85
    #: The most that ranks may lack, summed over all hosts.
    tolerance: float = 1e-6
    #: Ends the walk early; None: when it has converged.
    rounds: int | None = None
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null where none does."""
    found = None
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, share): where each host's links to other hosts go."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]++)"""), 1)
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("link"))
    absolute = F.col("link").rlike("^(?i)(https?:)?//")
    # relative links stay on the host, other schemes (mail, scripts) lead to none
    dst = host_of(F.concat(F.lit("x:"), F.regexp_replace("link", "^[^/]*//", "//")))
    found = found.where(absolute).select("src", dst.alias("dst"))
    counted = found.where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def _summed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("rank").alias("rank"))


def spread(seeds: DataFrame, edges: DataFrame, settings: Spread, name: str) -> DataFrame:
    """(host, rank) from (host, seed) along (src, dst, share): personalised PageRank over 1 - damping.

    So scaled, a host's rank is its seed and what reaches it: rank = seed + damping * incoming.
    """
    moving = written(seeds.select("host", F.col("seed").alias("rank")), name)
    parts, done = [moving], 0
    while done != settings.rounds:
        mass = moving.agg(F.sum("rank")).first()[0] or 0.0
        # shares of a host sum to 1, so a round passes on damping * mass at most
        if mass * settings.damping / (1 - settings.damping) <= settings.tolerance:
            break
        met = moving.where("rank > 0").join(edges, F.col("host") == F.col("src"))
        got = met.groupBy("dst").agg((F.sum(F.col("rank") * F.col("share")) * settings.damping).alias("rank"))
        moving = written(got.withColumnRenamed("dst", "host"), name)
        parts.append(moving)
        if len(parts) == PARTS:
            parts = [written(_summed(parts), name)]
        done += 1
    return written(_summed(parts), name)


def judge_urls(pages: DataFrame, settings: Spread = Spread()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row per page."""
    url = F.col("url")
    named = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    ruled = named.withColumn("found", rule_of(F.col("host"), F.col("path")))
    shares = ruled.where("host <> ''").groupBy("host").agg(
        *[F.avg(F.when(F.col("found.verdict") == v, 1.0).otherwise(0.0)).alias(v) for v in ("allow", "block")]
    )
    shares = written(shares, "seeds")
    links = written(host_links(named.select("host", "html")), "links")
    trust = spread(shares.select("host", F.col("allow").alias("seed")), links, settings, "trust")
    against = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    total = against.groupBy("src").agg(F.sum("share").alias("total"))
    against = against.join(total, "src").select("src", "dst", (F.col("share") / F.col("total")).alias("share"))
    distrust = spread(shares.select("host", F.col("block").alias("seed")), written(against, "against"), settings, "distrust")
    hosts = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    hosts = written(shares.select("host").join(hosts, "host", "left"), "verdicts")
    bad = (F.col("distrust") >= settings.threshold) & (F.col("distrust") > F.coalesce("trust", F.lit(0.0)))
    own = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    joined = ruled.drop("html").join(hosts, "host", "left")
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "trust", "distrust")


def url_query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
