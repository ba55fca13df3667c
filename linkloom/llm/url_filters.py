"""URL filters: path rules, and link-graph propagation for hosts without one.

A rule names a host, with all its subdomains, and a path prefix; the longest fitting rule decides. For the other pages,
personalised PageRank spreads trust from hosts with allowed pages along links and distrust from hosts with blocked pages
against them (who links to a blocked host is suspect). A host is blocked where its distrust clearly exceeds its trust.

Every link of a page counts: one with a host of its own, also without a scheme (``//host/``), names that host; any other is
resolved against the page's ``<base>``, or its url, and so stays on that host. Hosts of one domain are joined through their
parent domains as well, if ``parents`` is set.

Defined results: host and path of a null url, or one without ``://``, are empty; such pages, and hosts that neither seed nor
link reaches, are allowed. A null html has no links. Rules that fit with the same length are taken in the order of verdict,
host and path. Very long urls and pages are read whole. Repeated rows get equal results; they count as often as they stand in
the shares that seed a host. An empty table gives an empty result. Columns but page_id, url and html are not looked at.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialise

# The rules of the contract (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# A tag's href, from the tag's name on, with the quotes that close it left open to any kind.
LINK = r"""(?is)<a(?:rea)?\s[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
BASE = r"""(?is)<base\s[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
OWN_HOST = r"(?is)^(?:https?:)?//"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null. The rules are a short list of the configuration."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def linked_host(link: Column, base: Column) -> Column:
    """Host of a link on a page whose own links stay on the host base; empty for another scheme, as mailto: or javascript:."""
    own = host_of(F.concat(F.lit("x:"), F.regexp_replace(link, "(?i)^https?:", "")))
    return F.when(link.rlike(OWN_HOST), own).when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit("")).otherwise(base)


def host_edges(pages: DataFrame, parents: bool = True) -> DataFrame:
    """Distinct (src, dst) hosts: links of the pages, and each host with its parent domain, down to the last but one label.

    Rows: host, html. Parent domains are nodes also where they have no page, so that hosts of one domain are joined. Links are
    made distinct inside each page and again by the aggregate before the shuffle.
    """
    base = F.regexp_extract("html", BASE, 1)
    held = pages.where("html is not null").select("host", F.when(base == "", F.col("host")).otherwise(linked_host(base, F.col("host"))).alias("base"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("links"))
    links = held.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform("links", lambda u: linked_host(u, F.col("base"))))).alias("dst"))
    if parents:
        labels = F.split("host", r"\.")
        above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("dst")))
        named = pages.select("host").distinct().where((F.size(labels) > 2) & ~F.col("host").rlike(r"^[0-9.:]+$|^\["))  # no addresses
        parent = named.select(F.explode(F.slice(above, F.lit(1), F.size(labels) - 2)).alias("e")).select("e.src", "e.dst").distinct()
        links = links.union(parent).union(parent.select("dst", "src"))
    return links.where("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-3, at_once: int = 3) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst) and seeds (host, kind, weight) with kind trust or distrust.

    Both vectors move in one join and one aggregate a round: distrust over the reversed edges. Every at_once rounds are written
    to the shared folder. A round shrinks the change of either vector by damping at least, from a whole change of one in the
    first, so the number of rounds that brings it down to tolerance is known before: 43 here. Nothing reaches the driver.
    """
    if rounds is None:
        rounds = math.ceil(math.log(tolerance) / math.log(damping))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    both = materialise(both.join(degree, ["kind", "src"]), "host-edges").withColumnRenamed("src", "host")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = materialise(seeds.groupBy("kind", "host").agg(F.sum("weight").alias("w")).join(F.broadcast(total), "kind").select("kind", "host", (F.col("w") / F.col("total")).alias("p")), "host-seeds")  # total: two rows
    kept, rank = start.withColumn("p", F.lit(1 - damping) * F.col("p")), start
    for k in range(0 if both.isEmpty() else rounds):
        # Not by broadcasts: they would pile up on the driver, round by round.
        sent = rank.join(both.hint("merge"), ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("p") / F.col("degree")).alias("p"))
        rank = sent.union(kept).groupBy("kind", "host").agg(F.sum("p").alias("p"))
        if k % at_once == at_once - 1:
            rank = materialise(rank, "host-rank")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("p"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES, excess: float = 2.0, rounds: int | None = None, parents: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust, of every row.

    excess: a host is blocked if its distrust is over this multiple of its trust, and over an even share, 1 / hosts with pages.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    thin = materialise(seen.select("page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("ruled")), "judged")
    edges = host_edges(seen.select("host", "html"), parents)
    of = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0))
    shares = materialise(thin.where("host <> ''").groupBy("host").agg((of("allow") / F.count("*")).alias("trust"), (of("block") / F.count("*")).alias("distrust")), "host-shares")
    seeds = shares.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, weight)")).where("weight > 0")
    even = 1.0 / max(1, shares.count())
    ranks = materialise(propagate(edges, seeds, rounds), "host-ranks")
    # Mass that reaches a host without links leaves; given back to the seeds it scales a vector, so each is made to sum to one.
    sums = ranks.agg(*[F.greatest(F.coalesce(F.sum(c), F.lit(0.0)), F.lit(1e-300)).alias(f"all_{c}") for c in ("trust", "distrust")])
    ranks = ranks.crossJoin(F.broadcast(sums)).select("host", *[(F.col(c) / F.col(f"all_{c}")).alias(c) for c in ("trust", "distrust")])  # one row
    suspect = materialise(ranks.select("host", "trust", "distrust", ((F.col("distrust") > excess * F.col("trust")) & (F.col("distrust") > even)).alias("suspect")), "host-verdicts")
    out = thin.join(suspect, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("suspect"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
