"""URL filter: rules first, then link-graph propagation for the urls that no rule decides.

Hosts are nodes; an absolute link in a page's html is an edge from the page's host to the link's
host. Personalised PageRank carries trust from hosts with allowed pages along the edges, and
distrust from hosts with blocked pages against them; a seed's mass is the share of its pages. Scores are in units of what a host
whose pages are all decided holds by itself, so they don't shrink with the number of hosts or seeds. A host is blocked if its
distrust reaches a threshold and exceeds its trust. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import ascii_lower, stage

#: (action, host, path), fixed values of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ROUNDS = 12
DAMPING = 0.85
#: Distrust from which a host is blocked: half of what a host with nothing but blocked pages holds by itself.
THRESHOLD = 0.5
_HREF = r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'<>]+)"


def host_of(url):
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. NULL or no ://: empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=None):
    """(rule, action) of the longest rule that fits, or NULL. Among equally long ones the first in alphabetical order."""
    rules = RULES if rules is None else rules
    every = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))
                      for a, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))])
    return F.get(F.filter(every, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])), F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of src that link to dst; links inside a host don't count. pages: (host, html)."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)), lambda u: host_of(F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("http:"), u)).otherwise(u))))).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank. edges: (src, dst, weight); seeds: (host, mass). Returns (host, mass); the
    seeds' masses are scaled to sum 1. A node without out-edges gives its mass up."""
    total = float(seeds.agg(F.sum("mass")).first()[0] or 1.0)
    start = stage(seeds.where("mass > 0").select("host", (F.col("mass") / F.lit(total)).alias("mass")), "seeds")
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    steps = stage(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("p")), "steps")
    rank = start
    for k in range(rounds):
        moved = steps.join(rank, steps.src == rank.host).select(F.col("dst").alias("host"), (F.col("p") * F.col("mass") * damping).alias("mass"))
        rank = moved.union(start.select("host", (F.col("mass") * (1 - damping)).alias("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
        if k % 4 == 3:
            rank = stage(rank, "rank")
    return rank


def judge(pages: DataFrame, rules=None, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    A rule that fits decides. Else the host's scores do; a host without scores, and an empty host, is
    allowed. NULL html has no links. Scores are compared after rounding to 12 places, so the order of
    summation does not matter. Repeated rows stay. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    narrow = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    edges = stage(host_edges(pages.select(host.alias("host"), "html")), "edges")
    share = lambda action: (F.coalesce(F.sum((F.col("r.action") == action).cast("long")), F.lit(0)) / F.count("*")).alias(action)
    hosts = stage(narrow.where("host <> ''").groupBy("host").agg(share("allow"), share("block")), "hosts")
    trust = propagate(edges, hosts.select("host", F.col("allow").alias("mass")), rounds, damping)
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), hosts.select("host", F.col("block").alias("mass")), rounds, damping)
    # propagate() scales the seeds to sum 1; back to shares, and a seed's own part to 1
    mass = hosts.agg(F.sum("allow"), F.sum("block")).first()
    unit = {"trust": float(mass[0] or 0.0) / (1 - damping), "distrust": float(mass[1] or 0.0) / (1 - damping)}
    scores = hosts.select("host").join(trust.withColumnRenamed("mass", "trust"), "host", "left").join(distrust.withColumnRenamed("mass", "distrust"), "host", "left").select(
        "host", *[F.round(F.coalesce(c, F.lit(0.0)) * unit[c], 12).alias(c) for c in ("trust", "distrust")])
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return narrow.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.action"), F.when(bad, "block"), F.lit("allow")).alias("verdict"), "trust", "distrust")
