"""URL filters by link-graph propagation.

Rules decide the pages they fit. For the rest the hosts' graph decides: trust
spreads by personalised PageRank from the hosts of allowed pages along the
links, distrust spreads from the hosts of blocked pages against the links (who
links to a blocked host is distrusted). A host whose share of distrust passes a
threshold is blocked.

Host edges: absolute and protocol-relative links in a page's html, one edge for
each pair of hosts weighted by the number of links, and an edge between a host
and its parent domain both ways (a site's pages mostly link relatively, so
subdomains are tied through their parent).

All of it is joins and partial aggregates over (host, host) rows; rank tables
are written to the checkpoint folder every few rounds, until no rank changes any
more. Rules are matched by a join on host suffixes, so the list may be long.

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and is allowed; null html has no links; repeated rows are returned as often as
they stand; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shredline.llm.license_scan import LOWER, UPPER
from shredline.session import ensure_checkpoint_dir

#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

BLOCK = 4      # rounds between two checkpoints
FEW = 100_000  # edges and seeds up to which a round runs in one task

LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url):
    """What stands between the first ``//`` after a scheme and the path, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffixes(host):
    """A host and its parents: a.b.c, b.c, c."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def apply_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of each distinct (host, path): host, path, rule, rule_verdict."""
    fits = (places.select("host", "path", F.explode(suffixes(F.col("host"))).alias("r_host"))
            .join(rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict"), "r_host")
            .where(F.col("path").startswith(F.col("r_path"))))
    name = F.concat("r_host", "r_path")
    return fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("verdict").alias("verdict"))).alias("best")
    ).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight over distinct pairs of hosts; pages have host and html."""
    hosts = pages.where("host <> ''")
    link = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))
    links = (hosts.select(F.col("host").alias("src"), link.alias("link"))
             .select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("link", "^[^/]*:?//", "//"))).alias("dst"))
             .where("dst <> '' and src <> dst"))
    chain = suffixes(F.col("host"))
    up = (hosts.select("host").distinct().select(chain.alias("c"))
          .select(F.explode(F.expr("case when size(c) > 2 then transform(sequence(0, size(c) - 3), "
                                   "i -> struct(c[i] as src, c[i + 1] as dst)) end")).alias("e"))
          .select("e.src", "e.dst").distinct())
    every = links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return every.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85,
              tolerance: float = 1e-9) -> DataFrame:
    """Personalised PageRank of each kind of seed (kind, host, weight): kind, host, rank.

    ``edges`` (kind, src, dst, share) hold the share of src's rank that dst gets. Without
    ``rounds`` it goes on until, over the last ``BLOCK`` rounds, no host was newly reached and
    no host's rank changed by more than ``tolerance`` of itself.
    """
    few = edges.count() + seeds.count() <= FEW
    own = (lambda d: d.coalesce(1)) if few else (lambda d: d)          # few rows: a task and no shuffle for a whole block
    n = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = (own(edges) if few else edges.repartition(n, "kind", "src")).persist()     # lies as ranks are summed, so it moves once
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = (seeds.join(F.broadcast(total), "kind")          # one row for each kind
             .select("kind", "host", (F.col("weight") / F.col("total")).alias("rank")))
    start = own(start).checkpoint()
    back = start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"), F.lit(0.0).alias("old"))
    ranks, done, settled = start, 0, False
    while not settled and done != rounds:
        block = BLOCK if rounds is None else min(BLOCK, rounds - done)
        old = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old"))
        for i in range(block):
            moved = (ranks.select("kind", F.col("host").alias("src"), "rank").join(edges, ["kind", "src"])
                     .select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"),
                             F.lit(0.0).alias("old")))
            parts = moved.unionByName(back)
            if i == block - 1:
                parts = parts.unionByName(old)
            ranks = own(parts).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"))
        ranks, done = ranks.checkpoint(), done + block
        settled = rounds is None and ranks.where(F.abs(F.col("rank") - F.col("old")) > F.col("rank") * tolerance).isEmpty()
    edges.unpersist()
    return ranks.select("kind", "host", "rank")


def judge_urls(pages: DataFrame, rules: DataFrame, threshold: float = 0.5, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    A page without a rule is blocked when distrust / (trust + distrust) of its host
    is over ``threshold``; a host that neither reaches is allowed. ``rounds`` None: until ranks are settled.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    places = pages.groupBy("host", "path").agg(F.count("*").alias("n"))
    ruled = places.join(apply_rules(places, rules), ["host", "path"], "left").checkpoint()
    seeds = (ruled.where("rule is not null").groupBy(F.col("rule_verdict").alias("kind"), "host")
             .agg(F.sum("n").cast("double").alias("weight")))
    edges = host_edges(pages.select("host", "html")).checkpoint()
    both = (edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight")
            .unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"),
                                      "weight")))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    ranks = propagate(shares.checkpoint(), seeds, rounds)
    value = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    hosts = ranks.groupBy("host").agg(value("allow").alias("trust"), value("block").alias("distrust"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    share = F.round(F.try_divide(zero("distrust"), zero("trust") + zero("distrust")), 8)   # ranks shrink with the number of seeds, their share doesn't
    method = F.when(share > threshold, "block").otherwise("allow")
    judged = ruled.join(hosts, "host", "left").select(
        "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"),
        zero("trust").alias("trust"), zero("distrust").alias("distrust"))
    return (pages.select("page_id", "host", "path").join(judged, ["host", "path"])
            .select("page_id", "host", "path", "rule", "verdict", "trust", "distrust"))
