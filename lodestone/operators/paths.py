"""Shortest paths of claims over one predicate, searched from both ends.

Claims that an edge answers are told apart first, in parts of bounded size; the search is for the others. Claims of one
subject share the search ahead, claims of one object the search back. A round widens the side whose frontier
is smaller, so a claim ends as soon as the smaller of its two cones is exhausted. Where the edges know which nodes a path can
pass through, a frontier keeps those alone. What is visited holds one row a root and
node, with the neighbour it was reached from; paths are put together for the claims that are answered, by following those.
Of the shortest paths the one whose nodes come first by id stands: ahead, a node's rank in its level orders the paths to it (its
parent's rank, then its id); back, the smallest next node does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_shuffles, forget, keep
from .adjacency import Adjacency, adjacency
from .ordinals import numbered

ROOT = ["root", "predicate"]
JOINS = 8  # steps of a path that one plan holds
CLAIMS_A_PART = 5_000_000
CLAIM = ["claim_id", "subject", "predicate", "object"]


def _ahead(edges: Adjacency, frontier: DataFrame, visited: list[DataFrame]) -> DataFrame:
    """The next level (root, predicate, node, parent, rank) of frontiers (root, predicate, node, rank)."""
    links = edges.out.select(F.col("subject").alias("node"), "predicate", F.col("object").alias("to"))
    step = frontier.join(links, ["node", "predicate"]).groupBy(*ROOT, "to").agg(F.min(F.struct("rank", "node")).alias("by"))
    new = step.select(*ROOT, F.col("to").alias("node"), F.col("by.node").alias("parent"), F.col("by.rank").alias("before"))
    for level in visited:
        new = new.join(level.select(*ROOT, "node"), [*ROOT, "node"], "left_anti")
    ranked = numbered(new, [*ROOT, "before", "node"], "rank")
    return ranked.drop("before")


def _back(edges: Adjacency, frontier: DataFrame, visited: list[DataFrame]) -> DataFrame:
    """The next level (root, predicate, node, next) of frontiers (root, predicate, node)."""
    links = edges.into.select(F.col("object").alias("node"), "predicate", F.col("subject").alias("to"))
    step = frontier.join(links, ["node", "predicate"]).groupBy(*ROOT, "to").agg(F.min("node").alias("next"))
    new = step.select(*ROOT, F.col("to").alias("node"), "next")
    for level in visited:
        new = new.join(level.select(*ROOT, "node"), [*ROOT, "node"], "left_anti")
    return keep(new)


def _followed(met: DataFrame, ahead: list[DataFrame], back: list[DataFrame], made: list[DataFrame]) -> DataFrame:
    """claim_id, hops and path of claims (subject, predicate, object, node) that met between the given levels."""
    rows, steps = met.select("claim_id", "subject", "predicate", "object", "node", F.col("node").alias("at"), F.array("node").alias("path")), 0

    def step(rows: DataFrame, level: DataFrame, end: str, by: str, first: bool) -> DataFrame:
        nonlocal steps
        links = level.select(F.col("root").alias(end), "predicate", F.col("node").alias("at"), F.col(by).alias("to"))
        path = F.concat(F.array("to"), "path") if first else F.concat("path", F.array("to"))
        rows = rows.join(links, [end, "predicate", "at"]).select("claim_id", "subject", "predicate", "object", "node", F.col("to").alias("at"), path.alias("path"))
        steps += 1
        if steps % JOINS == 0:
            rows = keep(rows)
            made.append(rows)
        return rows

    for level in reversed(ahead[1:]):
        rows = step(rows, level, "subject", "parent", True)
    rows = rows.withColumn("at", F.col("node"))
    for level in reversed(back[1:]):
        rows = step(rows, level, "object", "next", False)
    return rows.select("claim_id", F.size("path").alias("hops"), "path")


def _answered_by_an_edge(near: Adjacency, asked: DataFrame) -> list[DataFrame]:
    """The claims, each with hit: whether its edge is there. What was shuffled is deleted before each part of many."""
    parts, made = max(1, -(-asked.count() // CLAIMS_A_PART)), []
    pairs = near.out.select("subject", "predicate", "object")
    if parts > 1:
        drop_shuffles(asked.sparkSession)
    for k in range(parts):
        of_part = lambda df: df.where(F.pmod(F.xxhash64("subject"), F.lit(parts)) == k) if parts > 1 else df  # noqa: B023, E731
        claims = asked.where(F.coalesce(F.pmod(F.xxhash64("subject"), F.lit(parts)), F.lit(0)) == k) if parts > 1 else asked
        made.append(keep(claims.join(of_part(pairs).distinct().withColumn("hit", F.lit(True)), ["subject", "predicate", "object"], "left").select(*CLAIM, F.coalesce("hit", F.lit(False)).alias("hit"))))
        if parts > 1:
            drop_shuffles(asked.sparkSession)
    return made


def _met(open_: DataFrame, ahead: DataFrame, back: DataFrame, first: bool, width: dict[str, float]) -> DataFrame:
    """The claims whose levels share a node, with the first of those by rank. The level of fewer nodes a root is joined first; objects alone (first) are nodes themselves."""
    reached = ahead.withColumnRenamed("root", "subject").select("subject", "predicate", "node", "rank")
    if first:
        met = open_.withColumn("node", F.col("object")).join(reached, ["subject", "predicate", "node"])
    else:
        sides = [(reached, ["subject", "predicate"]), (back.withColumnRenamed("root", "object").select("object", "predicate", "node"), ["object", "predicate"])]
        (one, by), (other, on) = sides if width["ahead"] <= width["back"] else sides[::-1]
        met = open_.join(one, by).join(other, [*on, "node"])
    return keep(met.groupBy(*CLAIM).agg(F.min_by("node", "rank").alias("node")))


def reached_paths(edges: DataFrame | Adjacency, asked: DataFrame, most_hops: int | None = None, unanswered: bool = False) -> DataFrame:
    """claim_id, hops and path (the objects on the way) of each claim (claim_id, subject, predicate, object) that has one.

    A claim of a node to itself needs a cycle. A claim whose ends are unknown has none. Levels follow until every claim is answered or
    one of its ends has nowhere to go; most_hops is an optional bound of the caller's. With unanswered, claims without a path
    are given too, with null hops and path, and each claim's subject, predicate and object.
    """
    edges, asked = adjacency(edges), keep(asked.select(*CLAIM))
    predicates = [r["predicate"] for r in asked.select("predicate").distinct().collect()]  # a closed vocabulary
    path = asked.select(F.array("object").alias("path")).schema["path"].dataType
    near = edges.at(asked.select(F.col("subject").alias("node")), predicates) if predicates and (most_hops is None or most_hops > 0) else None
    flagged = _answered_by_an_edge(near, asked) if near else [keep(asked.withColumn("hit", F.lit(False)))]
    if near:
        near.release()
    flags = reduce(DataFrame.unionByName, flagged)
    found, lost, made = [flags.where("hit").select(*CLAIM, F.lit(1).alias("hops"), F.array("object").alias("path"))], [], [asked, *flagged]
    open_ = flags.where("NOT hit").drop("hit")
    inner = edges.through(predicates) if hasattr(edges, "through") else None  # where any node may be passed through
    going_on = inner is None or not inner.isEmpty()
    onward = lambda front: front if inner is None else front.join(inner, ["predicate", "node"], "left_semi")
    start = lambda end: open_.select(F.col(end).alias("root"), "predicate", F.col(end).alias("node")).distinct()
    if going_on and (most_hops is None or most_hops > 1) and not open_.isEmpty():
        ahead, back = [], [keep(start("object"))]
        front = start("subject").withColumn("rank", F.lit(0).cast("long"))
        sizes, width = {"ahead": 0, "back": back[0].count()}, {"ahead": 1.0, "back": 1.0}
        while most_hops is None or len(ahead) + len(back) - 1 < most_hops:
            forward = not ahead or sizes["ahead"] <= sizes["back"]
            side, end = ("ahead", "subject") if forward else ("back", "object")
            live = (front if forward else back[-1]).join(open_.select(F.col(end).alias("root"), "predicate").distinct(), ROOT, "left_semi")
            live = live if len(ahead if forward else back) == (0 if forward else 1) else onward(live)
            near = edges.at(live, predicates)
            if forward:
                ahead.append(_ahead(near, live, ahead))
                front = ahead[-1].select(*ROOT, "node", "rank")
            else:
                back.append(_back(near, live, back))
            near.release()
            newest = (ahead if forward else back)[-1]
            rows, roots = newest.agg(F.count("*"), F.approx_count_distinct(F.struct(*ROOT))).first()
            width[side] = rows / max(1, roots)
            met = _met(open_, ahead[-1], back[-1], len(back) == 1, width)
            made.append(met)
            if not met.isEmpty():
                ends = _followed(met, ahead, back, made).join(met.select(*CLAIM), "claim_id") if unanswered else _followed(met, ahead, back, made)
                found.append(ends)
            # A claim stays open while the side just widened still has somewhere to go.
            going = onward(newest).select(F.col("root").alias(end), "predicate").distinct()
            rest = open_.join(met.select("claim_id"), "claim_id", "left_anti")
            if unanswered:
                lost.append(rest.join(going, [end, "predicate"], "left_anti"))
            open_ = keep(rest.join(going, [end, "predicate"], "left_semi"))
            made.append(open_)
            sizes[side] = onward(newest).join(open_.select(F.col(end).alias("root"), "predicate").distinct(), ROOT, "left_semi").count()
            if open_.isEmpty():
                break
        made += [*ahead, *back]
    columns = [*CLAIM, "hops", "path"] if unanswered else ["claim_id", "hops", "path"]
    parts = [x.select(*columns) for x in found]
    if unanswered:
        parts += [x.select(*CLAIM, F.lit(None).cast("int").alias("hops"), F.lit(None).cast(path).alias("path")) for x in (*lost, open_)]
    result = keep(reduce(DataFrame.unionByName, parts))
    forget(*made)
    return result
