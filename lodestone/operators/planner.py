"""Planning and executing questions, batched: a state machine over traversals, budgets and prunings.

One row a question runs through: resolve, budget, seeds cut or UNSUPPORTED, depth cut or BLOCKED, an exploring
traversal, and where that is cut, a second one over the one best predicate. Each step touches only the questions
that need it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.identity import query_identity
from ..storage import forget, keep
from .coverage import capability_coverage
from .graph import Graph
from .rank import rank_entities, tokens
from .targets import resolve_targets
from .traverse import expand_for_location, traverse

DEPTH = 2
UNSUPPORTED = "token_budget cannot support even the target entities themselves"
TOO_DEEP = "latency_budget cannot afford the required EXHAUSTIVE traversal depth"
TOO_WIDE = "budget ceiling cannot support EXHAUSTIVE completeness"
FEWER_LEVELS, FEWER_TYPES, STOP_SOONER = "reduce traversal depth", "remove optional relationship types", "increase stop-sufficiency threshold"


class VersionMismatch(ValueError):
    """The graph is not the version that a plan is locked to."""


@dataclass
class Plans:
    """rows: one a question. seeds, predicates: what execution traverses. entities, edges, flags: the last traversal."""

    rows: DataFrame
    seeds: DataFrame
    predicates: DataFrame
    entities: DataFrame
    edges: DataFrame
    version: str


def _types(rows: DataFrame) -> DataFrame:
    """query_id, predicate, pidx of each question's relationship types; one null where it has none."""
    asked = rows.select("query_id", F.posexplode_outer(F.when(F.size("relationship_types") > 0, F.col("relationship_types"))).alias("pidx", "predicate"))
    return asked.select("query_id", "predicate", F.coalesce("pidx", F.lit(0)).alias("pidx"))


def prioritized(types: DataFrame, edges: DataFrame) -> DataFrame:
    """types (query_id, predicate, pidx) with `place`: those that the edges show first, in their order, then the others."""
    shown = edges.select("query_id", "predicate").distinct().withColumn("shown", F.lit(0))
    rows = types.join(shown, ["query_id", "predicate"], "left").withColumn("shown", F.coalesce("shown", F.lit(1)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("shown", "pidx")))


def plan(graph: Graph, contracts: DataFrame, outcomes: DataFrame | None = None) -> Plans:
    """contracts: the rows of understand() that are RESOLVED, with completeness (EXHAUSTIVE or not) and constraints."""
    identity = query_identity(F.struct("intent", "targets", "relationship_types", "constraints", "completeness", "required_evidence", "token_budget", "latency_budget_ms"))
    rows = keep(
        contracts.withColumns({
            "query_identity": identity, "max_nodes": S.node_ceiling(F.col("token_budget")), "max_edges": S.edge_ceiling(F.col("token_budget")),
            "allowed": S.depth_ceiling(F.col("latency_budget_ms"), F.col("depth")), "all": F.col("completeness") == "EXHAUSTIVE", "forward": F.col("intent") == "TRACE_EXECUTION",
        })
    )
    named = keep(resolve_targets(graph.targets, rows.select("query_id", F.explode("targets").alias("target"))))
    rows = rows.join(named.groupBy("query_id").agg(F.count("*").alias("n_seeds")), "query_id", "left").fillna(0, ["n_seeds"])
    over = F.col("n_seeds") > F.col("max_nodes")
    early = F.when(over & (F.col("all") | (F.col("max_nodes") == 0)), "PLAN_UNSUPPORTED").when((F.col("allowed") < F.col("depth")) & F.col("all"), "PLAN_BLOCKED")
    steps = F.array_compact(F.array(F.when(over, F.concat(F.lit("reduce target-entity set to budget ("), F.col("n_seeds").cast("string"), F.lit(" -> "), F.col("max_nodes").cast("string"), F.lit(")"))), F.when(F.col("allowed") < F.col("depth"), F.lit(FEWER_LEVELS))))
    rows = keep(rows.withColumns({"early": early, "steps": steps}))
    live = rows.where("early IS NULL")
    seeds = keep(named.join(live.select("query_id", "max_nodes"), "query_id").where("rank <= max_nodes").select("query_id", "entity", "rank"))
    forget(named)
    requests = live.select("query_id", F.col("allowed").alias("depth"), "max_nodes", "max_edges", F.col("forward").alias("reverse"))
    types = keep(_types(live))
    main = lambda t: t.select("query_id", "predicate", "pidx", F.lit(False).alias("supplementary"))
    nodes, edges, flags = traverse(graph.adjacency, seeds, requests, main(types), DEPTH)
    first = nodes.groupBy("query_id").agg(F.count("*").alias("original_nodes")).join(edges.groupBy("query_id").agg(F.count("*").alias("original_edges")), "query_id", "full_outer")
    cut = live.join(flags.where("truncated").select("query_id"), "query_id", "left_semi")
    blocked = cut.where(F.col("all")).select("query_id", F.lit(True).alias("too_wide"))
    again = keep(cut.where(~F.col("all") & (F.size("relationship_types") > 1)).select("query_id", "intent"))
    # The one type to keep, and for an impact question the others that showed anything, at the seeds alone.
    order = prioritized(types, edges).join(again, "query_id")
    narrow = order.where("place = 1").select("query_id", "predicate", "pidx", F.lit(False).alias("supplementary")).unionByName(order.where("place > 1 AND shown = 0 AND intent = 'FIND_IMPACT'").select("query_id", "predicate", F.col("place").alias("pidx"), F.lit(True).alias("supplementary")))
    predicates = keep(main(types).join(again, "query_id", "left_anti").unionByName(narrow))
    if again.isEmpty():
        last = nodes, edges, flags
    else:
        only = lambda df: df.join(again.select("query_id"), "query_id", "left_semi")
        second = traverse(graph.adjacency, only(seeds), only(requests), only(predicates), DEPTH)
        last = tuple(keep(a.join(again.select("query_id"), "query_id", "left_anti").unionByName(b)) for a, b in zip((nodes, edges, flags), second, strict=True))
    final = last[0].groupBy("query_id").agg(F.count("*").alias("nodes")).join(last[1].groupBy("query_id").agg(F.count("*").alias("edges")), "query_id", "full_outer")
    rows = rows.join(first, "query_id", "left").join(final, "query_id", "left").join(blocked, "query_id", "left").join(again.select("query_id", F.lit(True).alias("narrowed")), "query_id", "left").join(last[2], "query_id", "left")
    rows = rows.fillna(0, ["original_nodes", "original_edges", "nodes", "edges"]).fillna(False, ["too_wide", "narrowed", "truncated"])
    steps = F.concat("steps", F.array_compact(F.array(F.when(F.col("narrowed"), F.lit(FEWER_TYPES)), F.when(F.col("truncated"), F.lit(STOP_SOONER)))))
    status = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("too_wide"), "PLAN_BLOCKED").when(F.size(steps) > 0, "PRUNED").otherwise("OK")
    reason = F.when(F.col("early") == "PLAN_UNSUPPORTED", UNSUPPORTED).when(F.col("early") == "PLAN_BLOCKED", TOO_DEEP).when(F.col("too_wide"), TOO_WIDE).when(F.size(steps) > 0, F.array_join(steps, "; "))
    works = F.col("status").isin("OK", "PRUNED")
    rows = rows.withColumns({"status": status, "reason": reason})
    rows = rows.withColumn("negative_candidate", works & F.col("negative") & (F.col("edges") == 0))
    if outcomes is not None:
        asked = rows.where("negative_candidate AND size(required_evidence) > 0").select("query_id", F.element_at("required_evidence", 1).alias("capability"))
        covered = capability_coverage(outcomes, asked.select("capability").distinct())
        found = asked.join(covered, "capability").select("query_id", S.negative_coverage(F.col("coverage")).alias("negative_result"))
        rows = rows.join(found, "query_id", "left")
    else:
        rows = rows.withColumn("negative_result", F.lit(None).cast("string"))
    kept_types = predicates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(~F.col("supplementary"), F.struct("pidx", "predicate")))).alias("k"), F.array_sort(F.collect_list(F.when(F.col("supplementary"), F.struct("pidx", "predicate")))).alias("s"))
    names = lambda c: F.coalesce(F.filter(F.transform(c, lambda x: x["predicate"]), lambda p: p.isNotNull()), F.array().cast("array<string>"))
    rows = rows.join(kept_types, "query_id", "left").withColumns({"effective_types": names("k"), "supplementary_types": names("s"), "effective_depth": F.when(works, F.col("allowed")).otherwise(0)})
    return Plans(keep(rows.drop("early", "steps", "too_wide", "narrowed", "k", "s")), seeds, predicates, last[0], last[1], graph.version)


@dataclass
class Packages:
    """What a question gets to see: rows (limitations, partial), entities (ranked), edges, evidence."""

    rows: DataFrame
    entities: DataFrame
    edges: DataFrame


def execute(graph: Graph, plans: Plans) -> Packages:
    """Packages of plans, on the version they are locked to. BLOCKED and UNSUPPORTED ones are empty, with the reason."""
    if graph.version != plans.version:
        raise VersionMismatch(f"CONCURRENT_UPDATE_DETECTED: the plan is locked to {plans.version!r}, the graph is {graph.version!r}")
    works = plans.rows.where("status IN ('OK', 'PRUNED')")
    only = lambda df: df.join(works.select("query_id"), "query_id", "left_semi")
    nodes, edges = only(plans.entities), only(plans.edges)
    names = only(plans.seeds).join(graph.entities.select(F.col("canonical_id").alias("entity"), "name", "qualified_name"), "entity")
    asked = names.select("query_id", F.explode(tokens(F.concat_ws(" ", "name", "qualified_name"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    queries = works.select("query_id", F.try_element_at("effective_types", F.lit(1)).alias("primary"), F.transform("constraints", F.lower).alias("constraints"))
    ranked = keep(rank_entities(nodes, edges, graph.entities, asked, queries))
    needy = works.where(F.array_contains("required_evidence", "SOURCE_LOCATION")).select("query_id")
    short = ranked.join(needy, "query_id", "left_semi")
    widened, missing = expand_for_location(graph.adjacency, graph.entities, short.select("query_id", "entity", "rank"))
    more = widened.join(ranked.select("query_id", "entity"), ["query_id", "entity"], "left_anti")
    entities = ranked.unionByName(more, allowMissingColumns=True)
    rows = plans.rows.join(missing, "query_id", "left").fillna(False, ["partial"])
    ok = F.col("status").isin("OK", "PRUNED")
    limits = F.when(~ok, F.array("reason")).otherwise(
        F.array_compact(F.array(
            F.when(F.least("n_seeds", "max_nodes") > 1, F.concat(F.lit("ambiguous target: "), F.least("n_seeds", "max_nodes").cast("string"), F.lit(" distinct entities match this query"))),
            F.when(F.col("status") == "PRUNED", F.concat(F.lit("plan pruned: "), F.col("reason"))),
            F.when(F.col("negative_candidate") & F.col("negative_result").isNotNull(), F.concat(F.lit("negative_query_result="), F.col("negative_result"))),
            F.when(F.col("partial"), F.lit("SOURCE_CONTEXT expansion bound exhausted without satisfying it")),
        ))
    )
    rows = rows.withColumns({"limitations": limits, "partial": ~ok | F.col("partial") | F.col("truncated")})
    return Packages(rows.select("query_id", "query_identity", "status", "limitations", "partial"), entities, edges)


def trace(packages: Packages) -> DataFrame:
    """query_id, entity, score, rank: the ranking that execution itself made, so that no replay can drift."""
    return packages.entities.where("rank IS NOT NULL").select("query_id", "entity", "score", "rank")


class PlanCache:
    """Plans by graph version, schema, policy and query identity."""

    def __init__(self, schema: str = "1.0", policy: str = "1.0"):
        self.known, self.about = {}, (schema, policy)

    def key(self, version: str, identity: str) -> tuple[str, ...]:
        return (version, *self.about, identity)

    def get(self, version: str, identity: str) -> dict | None:
        found = self.known.get(self.key(version, identity))
        return found and found | {"cache_hit": True}

    def put(self, version: str, identity: str, row: dict) -> None:
        self.known[self.key(version, identity)] = row | {"cache_hit": False}


