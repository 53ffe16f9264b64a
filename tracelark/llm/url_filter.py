"""URL filters: rules by host and path, and trust and distrust propagated over the link graph of hosts.

Pages that no rule fits are judged by their host. Trust is a personalised PageRank from the hosts of allowed pages along the links;
distrust is one from the hosts of blocked pages against the links (who links to a blocked host is suspect). A host is
blocked if its distrust exceeds both its trust and a floor relative to an even share.

Links are absolute references (``scheme://host`` or ``//host``) in the pages' markup, counted once per pair of hosts, so
a page or host with very many links is summed up before anything is shuffled; ranks and edges stay in Spark. The ranks go on until
they are within CLOSE of the floor, however long the ways from the seeds are.

Cases: a null url, or one without ``://``, has an empty host and path, which no rule fits and no link reaches: allowed; null
html has no links; repeated rows count once per pair of hosts as links and are judged each by itself; without links or seeds
only the seeds' own hosts have ranks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, materialize, table

#: The rules (fixed values): verdict, host, beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: A host needs this share of an even portion of all distrust to be blocked; ranks are exact to CLOSE of that.
FLOOR, CLOSE = 0.5, 0.01
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """verdict, rule of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """src, dst: pairs of different hosts of which one links to the other."""
    urls = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(urls)).alias("to"))
    found = found.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit(":"), "to")).otherwise(F.col("to"))).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").distinct()


def _most_rounds(within: float) -> int:
    """Rounds after which ranks are surely as close as that: each takes DAMPING off the summed difference, which is 2 at most."""
    return max(1, math.ceil(math.log(within / 2) / math.log(DAMPING)))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, within: float = 1e-6) -> DataFrame:
    """host, rank: PageRank over src -> dst that restarts at the seeds (host, weight); the ranks add up to 1, if there are seeds.

    What a host without links out would pass on returns to the seeds. Goes on until all ranks together are ``within`` of
    the limit, or for exactly so many ``rounds``.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    seeds = seeds.groupBy("host").agg((F.sum("weight") / float(total)).alias("seed"))
    state = checkpoint(seeds.select("host", "seed", F.lit(0.0).alias("before"), F.col("seed").alias("rank")))
    edges = checkpoint(edges.join(edges.groupBy("src").agg(F.count("*").alias("out")), "src").select("src", "dst", (1.0 / F.col("out")).alias("part")))
    if edges.limit(1).count() == 0:
        return state.select("host", "rank")
    for _ in range(_most_rounds(within) if rounds is None else rounds):
        passed = edges.join(state.select(F.col("host").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        names = {"seed": "seed", "before": "before", "rank": "old", "got": "got"}
        met = checkpoint(state.join(passed, F.col("host") == F.col("dst"), "full").select(F.coalesce("host", "dst").alias("host"), *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in names.items()]))
        kept, moved = met.agg(F.sum("got"), F.sum(F.abs(F.col("old") - F.col("before")))).first()
        state = met.select("host", "seed", F.col("old").alias("before"), (DAMPING * F.col("got") + (1.0 - DAMPING * kept) * F.col("seed")).alias("rank"))
        if rounds is None and moved * DAMPING / (1.0 - DAMPING) <= within:  # of the round before; this one came closer still
            break
    return state.where("rank > 0").select("host", "rank")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    edges = materialize(links(pages), "hosts")
    seeds = checkpoint(rows.where("ruled is not null").groupBy("host", "ruled").agg(F.count("*").cast("double").alias("weight")))
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct().count()
    within = CLOSE * FLOOR / max(linked, 1)
    trust = personalised_rank(edges, seeds.where("ruled = 'allow'").select("host", "weight"), within=within).withColumnRenamed("rank", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = personalised_rank(back, seeds.where("ruled = 'block'").select("host", "weight"), within=within).withColumnRenamed("rank", "distrust")
    hosts = distrust.join(trust, "host", "full")
    n = hosts.count()
    hosts = hosts.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = hosts.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") > FLOOR / max(n, 1)) & (F.col("host") != "")).select(F.col("host").alias("bad"))
    # rows without a rule are the only ones that need their host's verdict
    out = rows.where("ruled is null").join(bad, F.col("host") == F.col("bad"), "left").select("page_id", "host", "path", "rule", F.when(F.col("bad").isNotNull(), "block").otherwise("allow").alias("verdict"))
    return rows.where("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict")).unionByName(out)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
