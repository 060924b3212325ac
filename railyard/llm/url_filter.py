"""URL filters: rules on host and path, and link-graph propagation for the rest.

Rules decide the pages they fit. Every other page gets its host's verdict from
two personalised PageRanks over host edges: trust flows along the links from
hosts that have allowed pages, distrust flows against the links from hosts
that have blocked pages (who links to a blocked host is suspect). A host is
blocked if its distrust exceeds its trust by the threshold.

Host edges are the absolute links of the pages' HTML, summed per pair of
hosts before anything else, and the step from a host to its parent domain and
back (``domains``), as hosts of one domain are run together. Both ranks run in
the same joins (a ``kind`` column). All tables after the first pass have one
row per host or host pair; ranks are written to the shared folder every few
rounds until they have settled (each round leaves at most ``DAMPING`` of the
distance, so they do), and only one number per check comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

# The rules of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
#: Rounds between two looks, and the sum of all changes between them at which ranks have settled.
ROUNDS_PER_WRITE, SETTLED = 5, 1e-6
#: Moves that a task of a round deals with; a graph of fewer is not spread over all shuffle partitions, round by round.
MOVES_A_TASK = 200_000
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, ascii_lower(F.regexp_extract(url.substr(at + 3, F.length(url)), r"^([^/?#]*)", 1))), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", domains: bool = True) -> DataFrame:
    """src, dst, weight: links between different hosts, and steps between a host and its parent domain."""
    found = pages.select(url_host(pages[url_col]).alias("src"), F.explode(F.regexp_extract_all(pages[html_col], F.lit(LINK), F.lit(1))).alias("dst"))
    links = found.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if not domains:
        return links
    # every domain between a host and its last two labels
    hosts = pages.select(url_host(pages[url_col]).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    steps = F.when(F.size(labels) > 2, F.sequence(F.lit(1), F.size(labels) - 2))
    up = hosts.select(labels.alias("l"), F.explode(steps).alias("i")).select(
        F.array_join(F.expr("slice(l, i, size(l))"), ".").alias("src"), F.array_join(F.expr("slice(l, i + 1, size(l))"), ".").alias("dst")).distinct()
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """kind, host, score: personalised PageRank of each kind ('trust' along the
    edges, 'distrust' against them) from ``seeds`` (kind, host, weight), until
    ``ROUNDS_PER_WRITE`` rounds change less than ``settled`` in all. Mass of
    hosts without an edge leaves the walk; repeated edges and seeds add up."""
    directed = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight"))
    total = directed.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    moves = stored(directed.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("total")).alias("share")), "moves")
    tasks = -(-moves.count() // MOVES_A_TASK) or 1
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = stored(seeds.join(F.broadcast(sums), "kind")  # two rows
                   .groupBy("kind", "host").agg((F.sum("weight") / F.first("total")).alias("score")).coalesce(tasks), "seeds")
    base = start.withColumn("score", F.col("score") * (1 - damping))
    ranks = start
    while True:
        before = ranks
        for _ in range(ROUNDS_PER_WRITE):
            flow = ranks.join(moves, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            ranks = flow.unionByName(base).coalesce(tasks).groupBy("kind", "host").agg(F.sum("score").alias("score")).coalesce(tasks)
        ranks = stored(ranks, "ranks")
        moved = ranks.join(before.withColumnRenamed("score", "old"), ["kind", "host"], "full").agg(
            F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        if not moved or moved < settled:
            return ranks


def judge(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = 0.0) -> DataFrame:
    """One row per page: key, host, path, rule (text or null), verdict, trust
    and distrust (of the host; null if no walk reaches it).

    The verdict is the longest fitting rule's action, else block if
    distrust - trust > ``threshold``, else allow (hosts no walk reaches, urls
    without ``://`` and null urls too). A rule fits its host and all
    subdomains if the path starts with the rule's. Null HTML has no links;
    equal rows and null keys keep a row each; an empty table gives none.
    """
    host, path = url_host(pages[url_col]), url_path(pages[url_col])
    rows = pages.select(pages[key_col].alias("key"), host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    seeds = rows.where("action is not null and host <> ''").groupBy(F.when(F.col("action") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(
        F.count("*").cast("double").alias("weight"))
    ranks = propagate(host_edges(pages, url_col, html_col), stored(seeds, "seed_counts"))
    by_host = ranks.groupBy("host").agg(F.max(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"),
                                        F.max(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
    scored = rows.join(by_host, "host", "left")
    suspect = F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold
    return scored.select(F.col("key").alias(key_col), "host", "path", "rule",
                         F.coalesce("action", F.when(suspect, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
