"""Verdicts on urls by trust and distrust over the host graph.

Rules name a host and a path; a rule fits its host and every subdomain when the url's
path starts with its path, and the longest fitting rule decides. Urls without a rule go
by their host. Trust is personalised PageRank from the hosts of allowed pages along
links; distrust is the same from the hosts of blocked pages against the links (who
links to a bad host is suspect). Edges are the links between hosts, a relative link
being one to the own host, and one from each host to its parent domain and back, so that
a domain's hosts share their name. A host is blocked where it has distrust and that
exceeds ``margin`` times its trust, however many hosts share a seed's distrust. Both sum to
one over all hosts, and weight is moved until hardly any is under way, over any number of links.

A null url, or one without ``://``, has an empty host and path; an empty host has no
links. Seeds weigh by their pages. Null pages count as pages without links. Everything
is DataFrame work: rules are few and become one expression; ranks are joined to edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import written

DAMPING, WRITE_EVERY = 0.85, 4
REST = 1e-5  # share of all weight that may still be under way at the end
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of ``rule`` (host and path) and ``verdict`` of the longest fitting rule; null
    where none fits. ``rules``: host, path, verdict."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``a, b, n``: links of pages of host ``a`` to host ``b``, and parent domains."""
    links = F.regexp_extract_all(F.coalesce("_h_html", F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]*)"), F.lit(1))
    target = F.when(F.col("link").contains("://"), host_of(F.col("link"))) \
        .when(F.col("link").startswith("//"), host_of(F.concat(F.lit("x:"), "link"))).otherwise(F.col("_h_host"))
    # Relative links need no row of their own: they are counted where they stand.
    is_own = lambda x: ~(x.contains("://") | x.startswith("//"))
    found = pages.where("_h_host <> ''").select("_h_host", links.alias("links"))
    inside = found.groupBy(F.col("_h_host").alias("a")).agg(F.sum(F.size(F.filter("links", is_own))).cast("double").alias("n")) \
        .where("n > 0").select("a", F.col("a").alias("b"), "n")
    outside = found.select("_h_host", F.explode(F.filter("links", lambda x: ~is_own(x))).alias("link")) \
        .select(F.col("_h_host").alias("a"), target.alias("b")).where("b <> ''").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    labels = F.split("_h_host", "[.]")  # a domain and each of its parents, down to two labels
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    hosts = pages.where("_h_host <> ''").select("_h_host").distinct().where(F.size(labels) > 2)
    up = hosts.select(F.explode(F.arrays_zip(
        F.slice(above, 1, F.size(above) - 1).alias("a"), F.slice(above, 2, F.size(above) - 1).alias("b"))).alias("x")) \
        .select("x.a", "x.b", F.lit(1.0).alias("n")).distinct()
    return inside.union(outside).union(up).union(up.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rest: float = REST) -> DataFrame:
    """``host, trust, distrust`` from ``seeds`` (``host, good, bad``: start weights).

    Rounds end when at most ``rest`` of each vector is still to come (what a round adds shrinks by
    ``DAMPING``) and no host has been reached for the first time. Weight that
    hosts without links on would hand out returns to the seeds: the fixed point with that
    return is the one without it, scaled to the sum of the seeds. So both are scaled to
    one sum and can be compared.
    """
    forward = edges.groupBy("a").agg(F.sum("n").alias("all")).join(edges, "a").select(
        F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("all")).alias("good_w"), F.lit(0.0).alias("bad_w"))
    backward = edges.groupBy("b").agg(F.sum("n").alias("all")).join(edges, "b").select(
        F.col("b").alias("host"), F.col("a").alias("to"), F.lit(0.0).alias("good_w"), (F.col("n") / F.col("all")).alias("bad_w"))
    pairs = written(forward.union(backward).groupBy("host", "to").agg(
        F.sum("good_w").alias("good_w"), F.sum("bad_w").alias("bad_w")), "host-pairs")
    # What a host hands to itself round after round is summed up at once, as a geometric series.
    loops = pairs.where("host = to").select("host", (1 - DAMPING * F.col("good_w")).alias("good_on"), (1 - DAMPING * F.col("bad_w")).alias("bad_on"))
    steps = written(pairs.where("host <> to").join(loops, "host", "left").select(
        "host", "to", (F.col("good_w") / F.coalesce("good_on", F.lit(1.0))).alias("good_w"),
        (F.col("bad_w") / F.coalesce("bad_on", F.lit(1.0))).alias("bad_w")), "host-steps")
    base = written(seeds.groupBy("host").agg(F.sum("good").cast("double").alias("trust"), F.sum("bad").cast("double").alias("distrust"))
                   .where("trust > 0 OR distrust > 0"), "host-seeds")
    sums = [F.coalesce(F.sum(c), F.lit(0.0)) for c in ("trust", "distrust")]
    good, bad, reached = base.agg(*sums, F.count("*")).first()
    # Of what some rounds have added, the last one added at most this share; a multiple of it is to
    # come, and the series of a loop can raise that once more.
    coming = DAMPING / (1 - DAMPING) ** 2 / sum(DAMPING**-k for k in range(WRITE_EVERY))
    rank, before = base, (good, bad)
    while True:
        for _ in range(WRITE_EVERY):
            moved = rank.join(steps, "host").select(
                F.col("to").alias("host"), (DAMPING * F.col("trust") * F.col("good_w")).alias("trust"),
                (DAMPING * F.col("distrust") * F.col("bad_w")).alias("distrust"))
            rank = base.union(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")) \
                .where("trust > 0 OR distrust > 0")
        rank = written(rank, "host-ranks")
        trust, distrust, hosts = rank.agg(*sums, F.count("*")).first()
        if hosts == reached and (trust - before[0]) * coming <= rest * trust and (distrust - before[1]) * coming <= rest * distrust:
            break
        before, reached = (trust, distrust), hosts
    whole = written(rank.join(loops, "host", "left").select(
        "host", (F.col("trust") / F.coalesce("good_on", F.lit(1.0))).alias("trust"),
        (F.col("distrust") / F.coalesce("bad_on", F.lit(1.0))).alias("distrust")), "host-ranks")
    trust, distrust = whole.agg(*sums).first()
    return whole.select("host", (F.col("trust") * (good / (trust or 1.0))).alias("trust"),
                        (F.col("distrust") * (bad / (distrust or 1.0))).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",),
          margin: float = 1.0) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``verdict``, and the host's
    ``trust`` and ``distrust``."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(*(F.col(c).alias(f"_h_k_{c}") for c in keep), host.alias("_h_host"), path.alias("_h_path"),
                        rule_of(host, path, rules).alias("_h_rule"))
    counts = rows.where("_h_host <> ''").groupBy(F.col("_h_host").alias("host")).agg(
        F.count(F.when(F.col("_h_rule.verdict") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("_h_rule.verdict") == "block", 1)).alias("bad"))
    counts = written(counts, "host-counts")
    good, bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    seeds = counts.select("host", (F.col("good") / max(1, good)).alias("good"), (F.col("bad") / max(1, bad)).alias("bad"))
    edges = written(host_edges(pages.select(host.alias("_h_host"), F.col(html).alias("_h_html"))), "host-edges")
    ranks = propagate(edges, seeds)
    doubted = (F.col("distrust") > margin * F.col("trust")) & (F.col("distrust") > 0)
    hosts = written(ranks.join(counts.select("host"), "host", "left_semi").select(
        "host", "trust", "distrust", F.when(doubted, "block").otherwise("allow").alias("judged")), "host-verdicts")
    return rows.join(hosts, F.col("_h_host") == F.col("host"), "left").select(
        *(F.col(f"_h_k_{c}").alias(c) for c in keep), F.col("_h_host").alias("host"), F.col("_h_path").alias("path"),
        F.col("_h_rule.rule").alias("rule"), F.coalesce("_h_rule.verdict", "judged", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
