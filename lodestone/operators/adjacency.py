"""The edges of a graph in two orders: bucketed and sorted by subject, and again by object.

A lookup of a few nodes is a literal IN list, from which Spark takes the buckets to read and skips the others' files; one of more
nodes is a join that deals only the nodes to the buckets, never the edges. Both orders are also partitioned by
predicate, so that a stated set of predicates reads only its folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep_bucketed

EDGES_A_BUCKET, MOST_BUCKETS = 250_000, 4096
LITERALS = 2000  # more nodes than this are joined instead of listed


@dataclass(frozen=True)
class Adjacency:
    """edges by subject and by object; both hold every edge (subject, predicate, object, pair_seq, edge_seq, ...)."""

    out: DataFrame
    into: DataFrame

    def at(self, nodes: DataFrame, predicates: list[str] | None = None) -> Adjacency:
        """What a level needs: the edges of these nodes (column node) where they are few, all of them otherwise; of these predicates, if given."""
        found = [r["node"] for r in nodes.select("node").distinct().limit(LITERALS + 1).collect()]
        out, into = self.out, self.into
        if predicates is not None:
            out, into = (e.where(F.col("predicate").isin(*predicates)) for e in (out, into))
        if len(found) <= LITERALS:
            out, into = out.where(F.col("subject").isin(*found)), into.where(F.col("object").isin(*found))
        return Adjacency(out, into)

    def release(self) -> None:
        """A level's edges are read from what is stored, so that nothing is deleted with it."""


def adjacency(edges: DataFrame | Adjacency) -> Adjacency:
    """Edges that nobody stored in two orders serve as both."""
    return Adjacency(edges, edges) if isinstance(edges, DataFrame) else edges


def store(edges: DataFrame) -> Adjacency:
    """Write edges in both orders."""
    buckets = max(1, min(MOST_BUCKETS, -(-edges.count() // EDGES_A_BUCKET)))
    by = lambda end: keep_bucketed(edges, end, buckets, [end, "edge_seq"], "predicate")
    return Adjacency(by("subject"), by("object"))
