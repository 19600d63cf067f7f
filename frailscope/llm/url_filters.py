"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Pages that a rule allows or blocks are the seeds. Trust starts at the hosts of allowed pages and
flows along links, as a PageRank that always restarts at those hosts. Distrust starts at the hosts
of blocked pages and flows against the links, to those that point there. A host is blocked if its
distrust is above its trust and above a fixed share of what a host of blocked pages starts with on
average, so the size of the graph does not matter; pages that no rule fits get that verdict.

Links are those between different hosts in the pages, counted once per pair of hosts and weighted by
number, and links in both directions between each host and its parent domains, whether they have pages or
not, up to the name below a public suffix. So the hosts of one domain share some of their trust and distrust.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frailscope.functions.joins import fits_broadcast, lookup_join
from frailscope.sources.scratch import store


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
DAMPING = 0.85
MIN_DISTRUST = 0.001
# The ranks are final when a round moves less than this part of all rank.
TOLERANCE = 1e-10
_ROUNDS_AT_ONCE = 8
_EQUAL = 1e-6
_GRAPH = pa.schema([("source", pa.string()), ("target", pa.string()), ("share", pa.float64())])
# Names of two labels under which anybody can have a domain; names of one label are such anyway.
PUBLIC_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp or.jp ne.jp com.br com.cn co.in co.kr co.nz co.za "
    "github.io gitlab.io blogspot.com wordpress.com netlify.app web.app herokuapp.com"
).split()
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HREF = "(?i)href\\s*=\\s*[\"']?([A-Za-z][A-Za-z0-9+.-]*://[^\"'\\s>]+)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty without one."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), *_LETTERS)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits the host, one of its parents, and the path's start."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, links) between different hosts of ``pages`` (host, html)."""
    targets = F.transform(F.regexp_extract_all("html", F.lit(_HREF), 1), url_host)
    pairs = pages.filter("host <> ''").select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    linked = pairs.filter("target <> '' and source <> target").groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("links")
    )
    return linked.union(_parent_links(pages)).groupBy("source", "target").agg(F.sum("links").alias("links"))


def _parent_links(pages: DataFrame) -> DataFrame:
    """Links of weight 1 between each host name and the name without its first label, in both directions.

    Numbers are no names, and public suffixes no parents.
    """
    hosts = pages.filter("host <> '' and not host rlike '^[0-9.]+(:[0-9]*)?$'").select("host").distinct()
    suffixes = ", ".join(f"'{s}'" for s in PUBLIC_SUFFIXES)
    names = F.expr(
        "filter(transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.')),"
        f" x -> contains(x, '.') and x not in ({suffixes}))"
    )
    chains = hosts.select(F.split("host", "[.]").alias("labels")).select(names.alias("names"))
    pairs = F.expr(
        "flatten(transform(sequence(0, size(names) - 2), i -> array("
        "struct(names[i] as source, names[i + 1] as target), struct(names[i + 1] as source, names[i] as target))))"
    )
    return chains.filter("size(names) > 1").select(F.explode(pairs).alias("p")).select(
        "p.source", "p.target", F.lit(1).alias("links")
    ).distinct()


def spread(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, rank) of a PageRank that restarts at the ``seeds`` (host, weight), over links (source, target, links).

    It goes on until a round moves less than ``TOLERANCE`` of the rank, or for just so many ``rounds``.
    The ranks are scaled to a sum of one at the end, which is as if the weight that reaches hosts
    without outgoing links went back to the seeds; without seeds there are none. A graph of more links than
    may be broadcast is worked on in rounds of joins, a small one in one task.
    """
    total = seeds.agg(F.sum("weight")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    start = store(seeds.groupBy("host").agg((F.sum("weight") / F.lit(float(total))).alias("start")), "start")
    out = links.groupBy("source").agg(F.sum("links").alias("all"))
    share = links.join(out, "source").select("source", "target", (F.col("links") / F.col("all")).alias("share"))
    share = store(share, "share")
    if fits_broadcast(share) and fits_broadcast(start):
        ranks = store(_walked(share, start, rounds, damping), "ranks")
    else:
        ranks = _spread_in_rounds(share, start, rounds, damping)
    total = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("host", (F.col("rank") / F.lit(float(total))).alias("rank"))


def _walked(share: DataFrame, start: DataFrame, rounds: int | None, damping: float) -> DataFrame:
    """All rounds of a graph small enough to be broadcast, in one task."""
    seeds = start.select(F.col("host").alias("source"), F.lit(None).cast("string").alias("target"), F.col("start").alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, _GRAPH).to_pydict()
        names = sorted({x for side in ("source", "target") for x in rows[side] if x is not None})
        number = {name: k for k, name in enumerate(names)}
        links = [(number[s], number[t], w) for s, t, w in zip(*rows.values()) if t is not None]
        source, target, weight = (np.array(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 3
        first = np.zeros(len(names))
        for s, t, w in zip(*rows.values()):
            if t is None:
                first[number[s]] = w
        rank, turn, change = first, 0, 1.0
        while (change > TOLERANCE) if rounds is None else (turn < rounds):
            moved = np.bincount(target, rank[source] * weight, len(names)) if len(links) else 0.0
            new = damping * moved + (1 - damping) * first
            rank, turn, change = new, turn + 1, float(np.abs(new - rank).sum())
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rank)], ["host", "rank"])

    return share.unionByName(seeds).coalesce(1).mapInArrow(run, "host string, rank double")


def _spread_in_rounds(share: DataFrame, start: DataFrame, rounds: int | None, damping: float) -> DataFrame:
    """Each round is a join and an aggregation with a map-side part; the ranks are stored after every eighth."""
    restart = start.select("host", ((1 - damping) * F.col("start")).alias("rank"))
    ranks = start.select("host", F.col("start").alias("rank"))
    turn = 0
    while rounds is None or turn < rounds:
        step = _ROUNDS_AT_ONCE if rounds is None else min(_ROUNDS_AT_ONCE, rounds - turn)
        before, turn = ranks, turn + step
        for _ in range(step):
            moved = ranks.join(share, ranks["host"] == share["source"]).select(
                F.col("target").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank")
            )
            ranks = moved.union(restart).groupBy("host").agg(F.sum("rank").alias("rank"))
        ranks = store(ranks, "ranks")
        if rounds is None:
            change = ranks.union(before.select("host", -F.col("rank"))).groupBy("host").agg(F.sum("rank").alias("change"))
            if (change.agg(F.sum(F.abs("change"))).first()[0] or 0.0) <= TOLERANCE:
                break
    return ranks


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path; no rule fits it, it takes no
    part in the graph, and it is allowed. A null html has no links. ``trust`` and ``distrust`` are
    the ranks of the page's host, rounded to six digits after the verdict. Rows are judged one by one; a repeated
    row weighs twice as a seed.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    placed = placed.withColumns({"rule": name, "own": verdict})
    known = store(placed.drop("html"), "pages")
    links = store(host_links(placed.select("host", "html")), "links")

    def seeds(verdict: str) -> DataFrame:
        return known.filter((F.col("own") == verdict) & (F.col("host") != "")).groupBy("host").agg(F.count(F.lit(1)).alias("weight"))

    trust = spread(links, seeds("allow")).withColumnRenamed("rank", "trust")
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "links")
    distrust = spread(back, seeds("block")).withColumnRenamed("rank", "distrust")
    scores = trust.join(distrust, "host", "full")
    judged = lookup_join(known, scores, "host", "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")}
    )
    # The ranks sum to one over all hosts, so they are held against the mean start of a seed, before
    # they are rounded. Sums of another order do not make equal ranks differ.
    seed_hosts = known.filter((F.col("own") == "block") & (F.col("host") != "")).select("host").distinct().count()
    bad = (F.col("distrust") * seed_hosts > MIN_DISTRUST) & (F.col("distrust") > F.col("trust") * (1 + _EQUAL))
    verdict = F.coalesce("own", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    rounded = (F.round(c, 6).alias(c) for c in ("trust", "distrust"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), *rounded)
