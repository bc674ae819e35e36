"""The published graph: entities and relationships of one version, and lookups on it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, keep
from .adjacency import Adjacency, store
from .ordinals import numbered
from .target_index import Names


@dataclass(frozen=True)
class Graph:
    """entities (canonical_id, name, qualified_name, base_type, roles, located, ...) and edges (subject, predicate, object, pair_seq, edge_seq, ...).

    into holds the same edges by object; without it, edges serve both ways. A source reads the edges of given nodes
    from where they are kept otherwise: out, into and at() as Adjacency has them.
    """

    entities: DataFrame
    edges: DataFrame
    version: str
    into: DataFrame | None = None
    made: dict[str, Names] = field(default_factory=dict, compare=False, repr=False)
    source: object | None = field(default=None, compare=False, repr=False)

    @property
    def targets(self) -> Names:
        """Lookups of names; a version's entities never change."""
        if "targets" not in self.made:
            self.made["targets"] = Names(self.entities)
        return self.made["targets"]

    @property
    def adjacency(self) -> Adjacency:
        if self.source is not None:
            return self.source
        return Adjacency(self.edges, self.edges if self.into is None else self.into)


def materialize(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships of which both ends are known entities, with pair_seq: the first commit ordinal between the two.

    Without commit ordinals (edge_seq) relationships stand in the order of predicate, subject and object.
    """
    ids = entities.select("canonical_id")
    known = relationships.join(ids.withColumnRenamed("canonical_id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("canonical_id", "object"), "object", "left_semi")
    if "edge_seq" not in known.columns:
        known = numbered(known, ["predicate", "subject", "object"], "edge_seq")
    return known.withColumn("pair_seq", F.min("edge_seq").over(Window.partitionBy("subject", "object")))


def publish(entities: DataFrame, relationships: DataFrame, version: str) -> Graph:
    """Write entities once and edges in two orders."""
    entities = keep(entities)
    edges = keep(materialize(entities, relationships))
    both = store(edges)
    forget(edges)
    return Graph(entities, both.out, version, both.into)


def get_entity(graph: Graph, canonical_id: str) -> DataFrame:
    return graph.entities.where(F.col("canonical_id") == canonical_id)


def find_entities(graph: Graph, name: str | None = None, qualified_name: str | None = None, base_type: str | None = None) -> DataFrame:
    """Substrings of the names, whatever the case, and the exact type, by canonical_id; all where nothing is asked."""
    found = graph.entities
    for column, wanted in (("name", name), ("qualified_name", qualified_name)):
        if wanted is not None:
            found = found.where(F.contains(F.lower(column), F.lit(wanted.lower())))
    if base_type is not None:
        found = found.where(F.col("base_type") == base_type)
    return found.orderBy("canonical_id")


def has_role(role: str) -> Column:
    return F.array_contains("roles", role)


def get_relationships(graph: Graph, subject: str | None = None, predicate: str | None = None, object_id: str | None = None) -> DataFrame:
    found = graph.edges
    if subject is not None or object_id is not None:
        node = graph.entities.sparkSession.createDataFrame([(object_id if subject is None else subject,)], "node string")
        near = graph.adjacency.at(node, None if predicate is None else [predicate])
        found = near.into if subject is None else near.out
    for column, wanted in (("subject", subject), ("predicate", predicate), ("object", object_id)):
        if wanted is not None:
            found = found.where(F.col(column) == wanted)
    return found


def neighbors(graph: Graph, canonical_id: str, direction: str = "out", predicate: str | None = None) -> DataFrame:
    """Entities one edge away, once each."""
    if direction not in ("out", "in"):
        raise ValueError(f"direction must be 'out' or 'in', got {direction!r}")
    here, there = ("subject", "object") if direction == "out" else ("object", "subject")
    edges = get_relationships(graph, **{"subject" if direction == "out" else "object_id": canonical_id}, predicate=predicate)
    return graph.entities.join(edges.select(F.col(there).alias("canonical_id")).distinct(), "canonical_id", "left_semi")
