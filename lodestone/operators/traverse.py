"""Bounded traversal, batched over queries: levels of two capped set operations, edges and nodes.

Which edges and nodes survive a cap is decided by commit order: the frontier's rank, the place of the predicate, the
side, and the ordinals of pair and edge (an edge met at its object goes by its subject first). Caps are small constants, so each
level keeps a bounded number of rows a query, and a hub's other edges are cut before they are shuffled (a ranking filter
with a literal bound). A level reads the edges of its frontier alone and is one job; what its levels wrote is
deleted before a traversal returns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, keep
from .adjacency import Adjacency, adjacency

DIRECTIONAL = ("CALLS", "IMPLEMENTS")
EDGE = ["subject", "predicate", "object"]
FOUND = ["kind", *EDGE]


def _touched(edges: Adjacency, frontier: DataFrame, predicates: DataFrame) -> DataFrame:
    """Edges at a frontier node (query_id, node, rank, seed) over the query's predicates, once for each side."""
    directional = F.coalesce(F.col("wanted").isin(*DIRECTIONAL), F.lit(False))
    asked = frontier.join(predicates.withColumnRenamed("predicate", "wanted"), "query_id")
    fits = F.col("wanted").isNull() | (F.col("wanted") == F.col("predicate"))
    out = asked.join(edges.out, asked["node"] == edges.out["subject"]).where(fits)
    into = asked.join(edges.into, asked["node"] == edges.into["object"]).where(fits)
    common = ["query_id", "rank", "pidx", *EDGE, "pair_seq", "edge_seq"]
    return out.select(*common, F.lit(0).alias("side"), F.col("object").alias("other"), (~directional | F.col("reverse")).alias("collected")).unionByName(
        into.select(*common, F.lit(1).alias("side"), F.col("subject").alias("other"), (~directional | (~F.col("reverse") & F.col("seed"))).alias("collected"))
    )


def _order(*places: str) -> Column:
    """An edge's (or node's) place in its level: three small numbers, then commit order."""
    return F.struct(*(F.col(c).cast("int").alias(f"n{k}") for k, c in enumerate(places)))


def _edge_order(*places: str) -> Column:
    # At the subject by pair, at the object by the other end's id; then by edge.
    pair = F.when(F.col("side") == 0, F.col("pair_seq"))
    end = F.when(F.col("side") == 0, "").otherwise(F.col("subject"))
    return F.struct(_order(*places).alias("places"), pair.alias("pair"), end.alias("end"), F.col("edge_seq").alias("edge"))


def _node_order(*places: str) -> Column:
    return F.struct(_order(*places).alias("places"), F.col("pair_seq").alias("pair"), F.lit("").alias("end"), F.col("edge_seq").alias("edge"))


def _capped(touched: DataFrame, edge_order: Column, node_order: Column, taken: DataFrame, requests: DataFrame, most: int) -> DataFrame:
    """New edges (kind edge) and nodes (kind node, as object) in their order: rank, and whether the caps still admit them (open).

    taken: query_id and FOUND of what the levels before kept. Of what is refused, the first stands for all.
    """
    none = F.lit("")
    edge = F.when(F.col("collected"), F.struct(F.lit("edge").alias("kind"), *EDGE, edge_order.alias("order")))
    node = F.struct(F.lit("node").alias("kind"), none.alias("subject"), none.alias("predicate"), F.col("other").alias("object"), node_order.alias("order"))
    found = touched.select("query_id", F.explode(F.array_compact(F.array(edge, node))).alias("f")).select("query_id", "f.*")
    first = found.groupBy("query_id", *FOUND).agg(F.min("order").alias("order")).join(taken.select("query_id", *FOUND), ["query_id", *FOUND], "left_anti")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("order", *EDGE))).where(F.col("rank") <= most + 1)
    used = taken.groupBy("query_id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"used_{k}") for k in ("edge", "node")))
    ranked = ranked.join(requests.select("query_id", "max_nodes", "max_edges").join(used, "query_id", "left"), "query_id")
    room = F.when(F.col("kind") == "edge", F.col("max_edges") - F.coalesce("used_edge", F.lit(0))).otherwise(F.col("max_nodes") - F.coalesce("used_node", F.lit(0)))
    return ranked.select("query_id", *FOUND, "rank", (F.col("rank") <= room).alias("open"))


def traverse(edges: DataFrame | Adjacency, seeds: DataFrame, requests: DataFrame, predicates: DataFrame, depth: int, most_nodes: int = 100, most_edges: int = 250) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (query_id, entity, distance), edges (query_id, subject, predicate, object) and flags (query_id, truncated).

    seeds: query_id, entity, rank. requests: query_id, depth, max_nodes, max_edges, reverse. predicates: query_id,
    predicate (null: any), pidx, supplementary. depth, most_nodes and most_edges bound what any request asks.
    Seeds are admitted even beyond max_nodes, which then cuts the nodes by id without a flag.
    """
    edges, most = adjacency(edges), max(most_nodes, most_edges)
    requests = keep(requests.select("query_id", "depth", "max_nodes", "max_edges", "reverse"))
    seeds = keep(seeds.select("query_id", "entity", "rank"))
    wanted: dict[bool, list[str | None]] = {False: [], True: []}
    for r in predicates.select("supplementary", "predicate").distinct().collect():  # a closed vocabulary
        wanted[r["supplementary"]].append(r["predicate"])
    asked = lambda extra: predicates.where(F.col("supplementary") == extra).select("query_id", "predicate", "pidx")
    near = lambda frontier, extra: edges.at(frontier, None if None in wanted[extra] else wanted[extra])
    blank = F.lit("")
    start = seeds.select("query_id", F.lit("node").alias("kind"), blank.alias("subject"), blank.alias("predicate"), F.col("entity").alias("object"), F.lit(0).alias("distance"), F.lit(True).alias("open"))
    seen, levels = start, []

    def step(touched: DataFrame, at: Adjacency, edge_order: Column, node_order: Column, distance: int) -> DataFrame:
        nonlocal seen
        levels.append(keep(_capped(touched, edge_order, node_order, seen.where("open"), requests, most).withColumn("distance", F.lit(distance))))
        at.release()
        seen = seen.unionByName(levels[-1].drop("rank"))
        return levels[-1]

    frontier = seeds.select("query_id", F.col("entity").alias("node"), "rank", F.lit(True).alias("seed"))
    for level in range(depth if wanted[False] else 0):
        now = frontier.join(requests.where(F.col("depth") > level).select("query_id", "reverse"), "query_id")
        at = near(now, False)
        got = step(_touched(at, now, asked(False)), at, _edge_order("rank", "pidx", "side"), _node_order("rank", "side", "pidx"), level + 1)
        frontier = got.where("open AND kind = 'node'").select("query_id", F.col("object").alias("node"), "rank", F.lit(False).alias("seed"))
    if wanted[True]:
        now = seeds.select("query_id", F.col("entity").alias("node"), "rank", F.lit(True).alias("seed")).join(requests.select("query_id"), "query_id").withColumn("reverse", F.lit(False))
        at = near(now, True)
        both = _touched(at, now, asked(True)).withColumn("collected", F.lit(True))  # both sides, whatever the direction
        step(both, at, _edge_order("pidx", "rank", "side"), _node_order("pidx", "side", "rank"), 1)
    by_id = Window.partitionBy("query_id", "kind", "open").orderBy("object")
    limit = F.when(F.col("open") & (F.col("kind") == "node"), F.col("max_nodes")).otherwise(F.lit(2**31 - 1))
    result = seen.withColumn("nth", F.row_number().over(by_id)).join(requests.select("query_id", "max_nodes"), "query_id").where(F.col("nth") <= limit)
    result = keep(result.select("query_id", *FOUND, "distance", "open").unionByName(requests.select("query_id", F.lit("request").alias("kind"), *(blank.alias(c) for c in EDGE), F.lit(0).alias("distance"), F.lit(True).alias("open"))))
    forget(requests, seeds, *levels)
    return (
        result.where("kind = 'node' AND open").select("query_id", F.col("object").alias("entity"), "distance"),
        result.where("kind = 'edge' AND open").select("query_id", *EDGE),
        result.groupBy("query_id").agg(F.max(~F.col("open")).alias("truncated")),
    )


def expand_for_location(edges: DataFrame | Adjacency, entities: DataFrame, ranked: DataFrame, cycles: int = 2, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities (query_id, entity) of packages that need a source location, widened until one has it, and queries (query_id, partial) that none satisfied.

    ranked: query_id, entity, rank. Each cycle admits up to `most` neighbours over any predicate, out before in. Entities are met
    with the few that packages hold, and are never dealt themselves.
    """
    edges = adjacency(edges)
    located = entities.where("located").select(F.col("canonical_id").alias("other"))
    visited = keep(ranked.select("query_id", F.col("entity").alias("other"), "rank"))
    seen, cycle = [visited], visited.select("query_id", F.col("other").alias("node"), "rank", F.lit(True).alias("seed"), F.lit(True).alias("reverse"))
    any_ = visited.select("query_id").distinct().select("query_id", F.lit(None).cast("string").alias("predicate"), F.lit(0).alias("pidx"))
    every = lambda: reduce(DataFrame.unionByName, seen)
    there = lambda: located.join(F.broadcast(every().select("other").distinct()), "other", "left_semi")
    satisfied = lambda: every().join(F.broadcast(there()), "other", "left_semi").select("query_id").distinct()
    for _ in range(cycles):
        now = cycle.join(satisfied(), "query_id", "left_anti")
        if now.isEmpty():
            break
        at = edges.at(now)
        touched = _touched(at, now, any_)
        first = touched.groupBy("query_id", "other").agg(F.min(_node_order("rank", "side", "pidx")).alias("order")).join(every().select("query_id", "other"), ["query_id", "other"], "left_anti")
        new = keep(first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "other"))).where(F.col("rank") <= most).drop("order"))
        at.release()
        seen.append(new)
        cycle = new.select("query_id", F.col("other").alias("node"), "rank", F.lit(False).alias("seed"), F.lit(True).alias("reverse"))
    result = keep(every().select("query_id", F.col("other").alias("entity"), (F.col("other").isNull()).alias("partial")).unionByName(visited.select("query_id").distinct().join(satisfied(), "query_id", "left_anti").select("query_id", F.lit(None).cast("string").alias("entity"), F.lit(True).alias("partial"))))
    forget(*seen)
    return result.where("entity IS NOT NULL").select("query_id", "entity"), result.groupBy("query_id").agg(F.max("partial").alias("partial"))
