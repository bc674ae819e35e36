"""Questions, plans, packages, providers, verification and evaluation, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import evaluate, planner, registry, verify
from ..operators.coverage import best
from ..operators.reconcile import KEY, combined
from ..operators.traverse import DIRECTIONAL
from ..operators.understand import INTENTS, candidates, contract_table, normalized, predicates_of, understand
from ..schema import CAPABILITIES, METRICS
from ..storage import keep, table
from . import retrieval
from .graph_view import REL_SQL, graph, traversal_sql

#: Forms of the questions that the tables ask; a is an order, b its customer's nation. Together they touch every rule, several rules, or none.
FORMS = (
    "Who calls {a}?", "please  find the callers of {a}", "What calls {a}.x", "list callers of {a}", "Which tests cover {b}?", "find tests for {a}", "find implementations of {b}", "Who implements {b}",
    "What references {b}?", "show references to {b}", "impact of changing {a}", "what does {a} depend on", "history of {b}", "architecture of {b}", "What happens when {a}() is called", "trace what happens from {a}",
    "call path from {a}", "if {a} changes, what is affected?", "Why does {a} call {b}?", "trace the execution of {a}", "everything related to {b}", "{a} calls {b}", "what is the meaning of {a}", "who calls x",
    "who calls {a} and what references {b}", " \t ",
)
#: Planned questions: text, token budget, latency budget, completeness.
PLANNED = (
    ("p01", "What references NATION_3?", 4000, 5000, ""), ("p02", "What references EUROPE?", 4000, 5000, ""), ("p03", "Who calls order_12?", 4000, 5000, ""), ("p04", "What does order_77 depend on?", 4000, 5000, ""),
    ("p05", "find implementations of Supplier", 4000, 5000, ""), ("p06", "impact of changing NATION_4", 4000, 5000, ""), ("p07", "trace execution of order_5", 4000, 5000, ""), ("p08", "architecture of NATION_7", 4000, 5000, ""),
    ("p09", "What references NATION_3?", 400, 5000, "EXHAUSTIVE"), ("p10", "impact of NATION_4", 4000, 1000, ""), ("p11", "impact of NATION_4", 4000, 1000, "EXHAUSTIVE"), ("p12", "what calls nowhere_at_all", 4000, 5000, ""),
    ("p13", "who calls order_1", 40, 5000, ""), ("p14", "history of NATION_2", 4000, 5000, ""), ("p15", "What references AMERICA.NATION_1", 4000, 5000, ""),
)


def questions(spark, sf_dir) -> DataFrame:
    """query_id and text: a question for each order, in the form that its key gives, and the text of each benchmark item."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("o_orderkey") % len(FORMS) + 1).cast("int"))
    text = F.replace(F.replace(form, F.lit("{a}"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))), F.lit("{b}"), F.col("n_name"))
    asked = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("query_id"), text.alias("text"))
    return asked.unionByName(t("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text"))


def tier0_intents(spark, sf_dir):
    """What the rules find in each question, best first."""
    rows = questions(spark, sf_dir).select("query_id", F.posexplode(candidates(normalized(F.col("text")))).alias("nth", "c"))
    return rows.select("query_id", "nth", "c.intent", "c.score", F.array_join("c.targets", "|").alias("targets"))


def contract_fields(spark, sf_dir):
    """Status and contract of each question."""
    join = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    rows = understand(questions(spark, sf_dir), contract_table(spark))
    return rows.select("query_id", "status", F.coalesce("intent", F.lit("")).alias("intent"), join("targets"), join("relationship_types"), join("required_evidence"), F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def ambiguity_complexity(spark, sf_dir):
    rows = understand(questions(spark, sf_dir), contract_table(spark)).where("status = 'RESOLVED'")
    return rows.select("query_id", F.round("ambiguity", 6).alias("ambiguity"), F.round("complexity", 6).alias("complexity"))


def depth_ceiling(spark, sf_dir):
    """Depth that each order's price, as milliseconds, affords of two levels."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.depth_ceiling(F.floor("o_totalprice").cast("long"), F.lit(2)).alias("depth"))


def _contracts(spark) -> DataFrame:
    terms = spark.createDataFrame([(q, t, m, c) for q, _, t, m, c in PLANNED], "query_id string, token_budget int, latency_budget_ms int, completeness string")
    asked = spark.createDataFrame([q[:2] for q in PLANNED], "query_id string, text string")
    rows = understand(asked, contract_table(spark)).where("status = 'RESOLVED'").drop("token_budget", "latency_budget_ms").join(terms, "query_id")
    return rows.withColumn("constraints", F.array().cast("array<string>"))


_PLANS: dict[tuple[str, str], planner.Plans] = {}


def _plans(spark, sf_dir) -> planner.Plans:
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _PLANS:
        _PLANS[known] = planner.plan(graph(spark, sf_dir), _contracts(spark))
    return _PLANS[known]


def plan_status(spark, sf_dir):
    rows = _plans(spark, sf_dir).rows
    return rows.select("query_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.col("n_seeds").cast("long").alias("seeds"), "effective_depth", F.array_join("effective_types", "|").alias("types"), "negative_candidate")


def prune_trace(spark, sf_dir):
    """What the budget trace of each plan that runs says."""
    rows = _plans(spark, sf_dir).rows.where("status IN ('OK', 'PRUNED')")
    return rows.select("query_id", *(F.col(c).cast("long").alias(c) for c in ("original_nodes", "original_edges", "nodes", "edges")), "truncated", F.array_join("supplementary_types", "|").alias("supplementary"))


def relationship_type_priority(spark, sf_dir):
    """Order of each question's predicates: those that its neighbourhood shows first."""
    types = spark.createDataFrame([(k, p, i) for k in INTENTS for i, p in enumerate(predicates_of(k))], "query_id string, predicate string, pidx int")
    shown = graph(spark, sf_dir).adjacency.predicates().where("predicate <> 'CALLS'").crossJoin(spark.createDataFrame([(k,) for k in INTENTS], "query_id string"))  # predicates x intents
    return planner.prioritized(types, shown).select(F.col("query_id").alias("intent"), "predicate", "place")


def rank_entities(spark, sf_dir):
    """Ranked entities of every plan that runs."""
    found = planner.execute(graph(spark, sf_dir), _plans(spark, sf_dir)).entities
    return found.select("query_id", "entity", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def evidence_package(spark, sf_dir):
    """The answer's material for "What references NATION_3?": ranked entities with their distance, the plan's status and limits."""
    g, plans = graph(spark, sf_dir), _plans(spark, sf_dir)
    got = planner.execute(g, plans)
    only = lambda df: df.where("query_id = 'p01'")
    rows = only(got.entities).join(only(plans.entities), ["query_id", "entity"])  # as many as its budget admits
    rows = g.entities.select(F.col("canonical_id").alias("entity"), "name").join(F.broadcast(rows), "entity").join(only(got.rows), "query_id")
    return rows.select("entity", "name", F.col("rank").cast("long").alias("rank"), "distance", F.round("score", 6).alias("score"), "status", F.array_join("limitations", "; ").alias("limitations"), "partial")


def neighborhood(spark, sf_dir):
    """Nodes and edges within two steps of what `NATION_3` names, under the default caps."""
    from ..service import neighborhood as around

    nodes, edges, cut = around(graph(spark, sf_dir), "NATION_3", depth=2)
    blank = F.lit("")
    return nodes.select(F.lit("node").alias("kind"), F.col("entity").alias("subject"), blank.alias("predicate"), blank.alias("object"), "distance").unionByName(edges.select(F.lit("edge").alias("kind"), "subject", "predicate", "object", F.lit(-1).alias("distance"))).withColumn("truncated", F.lit(cut))


# --- providers: suppliers stand for them


def _providers(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    names = F.array(*map(F.lit, CAPABILITIES))
    caps = F.array_distinct(F.array(F.element_at(names, (k % 10 + 1).cast("int")), F.element_at(names, (k % 7 + 1).cast("int"))))
    health = F.element_at(F.array(*map(F.lit, ("HEALTHY", "DEGRADED", "HEALTHY", "UNHEALTHY", "HEALTHY"))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("provider"), caps.alias("capabilities"), (k % 13 != 0).alias("valid"), (k % 11 != 0).alias("eligible"), health.alias("health"),
        ((k % 4) / F.lit(3.0)).alias("availability"), F.expr("timestamp'2024-01-01 00:00:00' - make_interval(0,0,0,0,s_suppkey % 100)").alias("freshness"),
        ((k % 10) / F.lit(10.0)).alias("evidence_quality"), ((k % 3) / F.lit(2.0)).alias("cost_factor"),
    )


_NOW = "timestamp'2024-01-01 00:00:00'"


def provider_evaluation(spark, sf_dir):
    return registry.evaluate(_providers(spark, sf_dir)).select("provider", "capability", "status")


def provider_score_rank(spark, sf_dir):
    """Usable providers of each capability, best first."""
    return registry.rank(_providers(spark, sf_dir), F.expr(_NOW)).select("provider", "capability", F.round("score", 6).alias("score"), "rank")


def provider_selection(spark, sf_dir):
    """Providers of every capability an intent needs, best first, maybe none."""
    required = contract_table(spark).select(F.col("intent").alias("query_id"), F.explode("required_evidence").alias("capability"))
    ranked = registry.rank(_providers(spark, sf_dir), F.expr(_NOW))
    return registry.select_providers(ranked, required).select(F.col("query_id").alias("intent"), "capability", F.array_join("providers", "|").alias("providers"))


def provider_skips(spark, sf_dir):
    return registry.skip_reasons(registry.evaluate(_providers(spark, sf_dir))).select("provider", F.array_join("capabilities", "|").alias("capabilities"), "reason")


def provider_authority(spark, sf_dir):
    return registry.authority(_providers(spark, sf_dir))


# --- verification: a claim for each order and supplier


def _records(spark, sf_dir) -> DataFrame:
    """Evidence of order -> supplier: one record for each distinct line, on the side its return flag says."""
    cols = ["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_discount", "l_shipdate"]
    line = table(spark, sf_dir, "lineitem").groupBy(*cols[:4]).agg(F.max("l_returnflag").alias("l_returnflag"), F.min("l_discount").alias("l_discount"), F.max("l_shipdate").alias("l_shipdate"))
    return line.select(
        F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("evidence_id"), F.lit("lines").alias("provider"),
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("subject"), F.lit("REFERENCES").alias("predicate"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("object"),
        F.greatest(F.lit(0.0), 1 - 5 * F.col("l_discount")).alias("confidence"), F.col("l_shipdate").cast("timestamp").alias("freshness"), F.col("l_partkey").cast("string").alias("independence_group"), (F.col("l_returnflag") == "R").alias("against"),
    )


def _verified(spark, sf_dir) -> DataFrame:
    """What is said of each claim. Records and edges are read several times, by different columns, and would be made anew each time."""
    records = keep(_records(spark, sf_dir))
    numbers = combined(records.select(*KEY, F.col("independence_group").alias("group"), "against", F.col("confidence").alias("weight")), KEY)
    ids = records.groupBy(*KEY).agg(F.collect_set(F.when(~F.col("against"), F.col("evidence_id"))).alias("supporting_evidence_ids"))
    edges = keep(numbers.join(ids, KEY).select(*KEY, F.col("contradiction").alias("contradiction_score"), "supporting_evidence_ids"))
    claims = edges.select(F.concat_ws(">", "subject", "object").alias("claim_id"), *KEY)
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 5, "FAILED").when(F.col("value") < 20, "PARTIAL").otherwise("COMPLETE")
    coverage = e.groupBy("event_type").agg(best(status).alias("coverage"))
    return verify.verify_claims(claims, edges, records, coverage, F.lit("1998-12-01").cast("timestamp")).withColumn("subject", F.substring_index("claim_id", ">", 1))


def verification_factors(spark, sf_dir):
    return _verified(spark, sf_dir).select("claim_id", *(F.round(c, 6).alias(c) for c in verify.FACTORS))


def verification_confidence(spark, sf_dir):
    return _verified(spark, sf_dir).select("claim_id", "contradiction_level", F.round("confidence", 6).alias("confidence"))


def claim_status(spark, sf_dir):
    return _verified(spark, sf_dir).groupBy("status", "contradiction_level").agg(F.count("*").alias("n"))


def answer_status(spark, sf_dir):
    """An answer for each order, of the claims on its suppliers; orders without any abstain."""
    rows = _verified(spark, sf_dir)
    claims = rows.select(F.col("subject").alias("query_id"), "subject", F.lit("REFERENCES").alias("predicate"), F.substring_index("claim_id", ">", -1).alias("object"), "status", (F.col("contradiction_level") == "SIGNIFICANT").alias("removed"))
    queries = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("query_id"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("negative"))
    return verify.answers(claims, queries).select("query_id", "decision", "verification_status", "label", "bucket", F.size("limitations").alias("limitations"))


# --- evaluation: events are telemetry, benchmark texts the ranked questions


def _telemetry(spark, sf_dir) -> DataFrame:
    result = S.mapped(F.col("event_type"), {"click": "VERIFIED", "view": "PARTIALLY_VERIFIED", "purchase": "QUALIFIED", "signup": "INCONCLUSIVE", "error": "REJECTED"})
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_id").cast("string").alias("query_id"), result.alias("verification_result"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("event_id"), F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("query_id"), F.lit(None).cast("string").alias("verification_result"))
    return events.unionByName(items).withColumn("graph_version_id", F.lit("v1"))


def _labels(spark, sf_dir) -> DataFrame:
    """What is expected of the events; the benchmark texts have relevant documents instead."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query_id"), F.when(F.col("quality") == 1, "VERIFIED").otherwise("REJECTED").alias("expected_verification_status"), (F.col("toxic") == 1).alias("should_abstain"))


def _relevant(spark, sf_dir, traces: DataFrame) -> DataFrame:
    """query_id and entity of each relevant candidate of a trace; a null one for each other."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("entity")).distinct()
    return traces.join(good.withColumn("good", F.lit(True)), "entity", "left").select("query_id", F.when(F.col("good"), F.col("entity")).alias("entity"))


def _traces(spark, sf_dir) -> DataFrame:
    """The first documents of each text and the first relevant one, which are all that the metrics look at."""
    rows = retrieval.ranking(spark, sf_dir, retrieval._relevant(spark, sf_dir))
    return keep(rows.select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("query_id"), F.lit("v1").alias("graph_version_id"), F.col("doc_id").cast("string").alias("entity"), "rank"))


def claim_accuracy(spark, sf_dir):
    rows = evaluate.claim_pairs(_telemetry(spark, sf_dir), _labels(spark, sf_dir))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))


def abstention_precision(spark, sf_dir):
    rows = evaluate.abstentions(_telemetry(spark, sf_dir), _labels(spark, sf_dir))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("precision"))


def metric_report(spark, sf_dir):
    """All nine metrics, with why the others have no value."""
    traces = _traces(spark, sf_dir)
    counts = retrieval.relevant_candidates(spark, sf_dir).select(F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("query_id"), "n")
    sizes = traces.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_relevant"))
    return evaluate.report(_telemetry(spark, sf_dir), _labels(spark, sf_dir), traces, _relevant(spark, sf_dir, traces), sizes).withColumn("reason", F.coalesce("reason", F.lit("")))


FUNCTIONS = (
    tier0_intents, contract_fields, ambiguity_complexity, depth_ceiling, plan_status, prune_trace, relationship_type_priority, rank_entities, evidence_package, neighborhood,
    provider_evaluation, provider_score_rank, provider_selection, provider_skips, provider_authority, verification_factors, verification_confidence, claim_status, answer_status,
    claim_accuracy, abstention_precision, metric_report,
)

# --- twins

_text = lambda s: "'" + s.replace("'", "''") + "'"
_lists = lambda xs: "[" + ",".join(map(_text, xs)) + "]::VARCHAR[]"


#: The rules, written out for the twins: place, intent, score, how many groups name targets, pattern.
_RULES_SQL = r"""rules AS (SELECT * FROM (VALUES
  (0, 'FIND_CALLERS', 0.97::DOUBLE, 1, '\bwho\s+calls\s+([A-Za-z0-9_.]+)'),
  (1, 'FIND_CALLERS', 0.97, 1, '\bfind\s+(the\s+)?callers\s+of\s+(?P<t>[A-Za-z0-9_.]+)'),
  (2, 'FIND_CALLERS', 0.97, 1, '\bwhat\s+calls\s+([A-Za-z0-9_.]+)'),
  (3, 'FIND_CALLERS', 0.97, 1, '\blist\s+(the\s+)?callers\s+of\s+(?P<t>[A-Za-z0-9_.]+)'),
  (4, 'FIND_TESTS', 0.97, 1, '\bwhich\s+tests?\s+(?:call|cover|test|exercise)\s+([A-Za-z0-9_.]+)'),
  (5, 'FIND_TESTS', 0.97, 1, '\bfind\s+tests?\s+(?:for|covering|that\s+call)\s+([A-Za-z0-9_.]+)'),
  (6, 'FIND_IMPLEMENTATIONS', 0.97, 1, '\b(?:find\s+)?implementations?\s+of\s+([A-Za-z0-9_.]+)'),
  (7, 'FIND_IMPLEMENTATIONS', 0.97, 1, '\b(?:who|what)\s+implements?\s+([A-Za-z0-9_.]+)'),
  (8, 'FIND_REFERENCES', 0.97, 1, '\b(?:who|what)\s+references?\s+([A-Za-z0-9_.]+)'),
  (9, 'FIND_REFERENCES', 0.97, 1, '\breferences?\s+to\s+([A-Za-z0-9_.]+)'),
  (10, 'FIND_IMPACT', 0.97, 1, '\bimpact\s+of\s+(?:changing\s+)?([A-Za-z0-9_.]+)'),
  (11, 'FIND_DEPENDENCIES', 0.97, 1, '\bwhat\s+does\s+([A-Za-z0-9_.]+)\s+depend\s+on\b'),
  (12, 'HISTORY_ANALYSIS', 0.97, 1, '\bhistory\s+of\s+([A-Za-z0-9_.]+)'),
  (13, 'ARCHITECTURE_ANALYSIS', 0.97, 1, '\barchitecture\s+of\s+([A-Za-z0-9_.]+)'),
  (14, 'TRACE_EXECUTION', 0.97, 1, '\bwhat\s+happens\s+when\s+([A-Za-z0-9_.]+)(?:\(\))?\s+(?:is\s+)?(?:called|invoked|runs?)\b'),
  (15, 'TRACE_EXECUTION', 0.97, 1, '\btrace\s+what\s+happens\s+from\s+([A-Za-z0-9_.]+)'),
  (16, 'TRACE_EXECUTION', 0.97, 1, '\bcall\s+path\s+from\s+([A-Za-z0-9_.]+)'),
  (17, 'FIND_IMPACT', 0.97, 1, '\bif\s+([A-Za-z0-9_.]+)\s+changes?\b.*\baffected\b'),
  (18, 'TRACE_EXECUTION', 0.80, 2, '\bwhy\s+does\s+([A-Za-z0-9_.]+)\s+call\s+([A-Za-z0-9_.]+)'),
  (19, 'TRACE_EXECUTION', 0.97, 1, '\btrace\s+(?:the\s+)?execution\s+of\s+([A-Za-z0-9_.]+)'),
  (20, 'CODE_LOOKUP', 0.45, 1, '\beverything\s+related\s+to\s+([A-Za-z0-9_.]+)'),
  (21, 'FIND_CALLERS', 0.35, 0, '\bcalls?\b')) v(k, intent, score, groups, pattern))"""
#: What each intent needs, written out for the twins.
_INTENTS_SQL = """intent_table AS (SELECT * FROM (VALUES
  ('FIND_CALLERS', ['CALL_RELATIONSHIP','SYMBOL_REFERENCE'], ['CALLS','IMPORTS','REFERENCES'], 1, true),
  ('FIND_TESTS', ['CALL_RELATIONSHIP','SYMBOL_REFERENCE'], ['CALLS','IMPORTS','REFERENCES'], 1, true),
  ('FIND_IMPLEMENTATIONS', ['IMPLEMENTATION'], ['IMPLEMENTS'], 1, true),
  ('FIND_REFERENCES', ['SYMBOL_REFERENCE','TYPE_RELATIONSHIP'], ['IMPORTS','REFERENCES'], 1, true),
  ('FIND_DEPENDENCIES', ['DEPENDENCY'], ['DEPENDS_ON'], 1, true),
  ('TRACE_EXECUTION', ['CALL_RELATIONSHIP','DATA_FLOW'], ['CALLS','REFERENCES'], 2, true),
  ('FIND_IMPACT', ['CALL_RELATIONSHIP','DATA_FLOW','DEPENDENCY'], ['CALLS','DEPENDS_ON','REFERENCES'], 2, true),
  ('ARCHITECTURE_ANALYSIS', ['IMPLEMENTATION','SYMBOL_DEFINITION','TYPE_RELATIONSHIP'], ['IMPLEMENTS','REFERENCES'], 2, false),
  ('CODE_LOOKUP', ['SYMBOL_DEFINITION'], []::VARCHAR[], 0, false),
  ('HISTORY_ANALYSIS', ['HISTORY'], []::VARCHAR[], 0, false),
  ('UNKNOWN', []::VARCHAR[], []::VARCHAR[], 0, false)) v(intent, evidence, types, depth, negative))"""
#: questions(), written out.
_ASKED_SQL = """SELECT 'o'||o_orderkey AS q, replace(replace([
    'Who calls {a}?','please  find the callers of {a}','What calls {a}.x','list callers of {a}','Which tests cover {b}?','find tests for {a}','find implementations of {b}','Who implements {b}',
    'What references {b}?','show references to {b}','impact of changing {a}','what does {a} depend on','history of {b}','architecture of {b}','What happens when {a}() is called','trace what happens from {a}',
    'call path from {a}','if {a} changes, what is affected?','Why does {a} call {b}?','trace the execution of {a}','everything related to {b}','{a} calls {b}','what is the meaning of {a}','who calls x',
    'who calls {a} and what references {b}',' '||chr(9)||' '][o_orderkey%26+1], '{a}', 'order_'||o_orderkey), '{b}', n_name) AS t
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
  UNION ALL SELECT 'b'||item_id, text FROM benchmark"""
_PLANNED_ASKED = ",".join("('" + "','".join(x.replace("'", "''") for x in q[:2]) + "')" for q in PLANNED)


def _understood_sql(asked: str = _ASKED_SQL) -> str:
    """CTEs cand(q, k, intent, score, targets) and contracts(q, intent, targets, types, evidence, depth, negative, ambiguity, complexity, confidence)."""
    return rf"""ask AS MATERIALIZED (SELECT q, trim(regexp_replace(t,'\s+',' ','g')) AS text FROM ({asked}) v(q,t)), {_RULES_SQL},
      raw AS MATERIALIZED (SELECT q, k, intent, score, list_filter(CASE WHEN groups=0 THEN [] WHEN groups=2 THEN [regexp_extract(text,pattern,1,'i'),regexp_extract(text,pattern,2,'i')]
          WHEN contains(pattern,'(the') THEN [regexp_extract(text,pattern,2,'i')] ELSE [regexp_extract(text,pattern,1,'i')] END, lambda x: len(x)>=2) AS targets FROM ask, rules WHERE regexp_matches(text,pattern,'i')),
      cand AS (SELECT * FROM raw r WHERE k<21 OR NOT EXISTS (SELECT 1 FROM raw o WHERE o.q=r.q AND o.intent=r.intent AND o.k<r.k)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, k) AS nth FROM cand),
      facts AS (SELECT q, count(DISTINCT intent) AS intents, max(score) FILTER (nth=1) AS best, coalesce(max(score) FILTER (nth=2),0) AS second FROM ranked GROUP BY 1),
      {_INTENTS_SQL},
      contracts AS (SELECT r.q, r.intent, r.targets, types, evidence, depth, negative, least(second/best,1) AS ambiguity, 0.25*least(intents/5.0::DOUBLE,1)+0.15*least(len(r.targets)/5.0::DOUBLE,1)+0.15*least(second/best,1) AS complexity, r.score AS confidence
        FROM ranked r JOIN facts USING (q) JOIN intent_table i ON i.intent=r.intent WHERE nth=1 AND r.score>0.95)"""


def _planned_sql() -> str:
    """CTEs up to final_nodes, final_rels, final_flags and plan(q, status, reason, ...)."""
    terms = ",".join(f"({_text(q)},{t},{m},{_text(c)})" for q, _, t, m, c in PLANNED)
    low = retrieval._NAMED.split(", low AS", 1)[1]
    return f"""{REL_SQL}, low AS{low}, {_understood_sql(f'VALUES {_PLANNED_ASKED}')}, terms AS (SELECT * FROM (VALUES {terms}) v(q,tokens,ms,completeness)),
      asked AS (SELECT DISTINCT targets[1] AS target FROM contracts WHERE len(targets)>0), {re.sub(r"\bask\b", "wanted", retrieval._SEEDS).replace('seeds AS (', 'all_seeds AS MATERIALIZED (')},
      c AS MATERIALIZED (SELECT k.q, k.intent, k.types, k.depth, k.negative, greatest(0,least(100,tokens//50)) AS max_nodes, greatest(0,least(250,tokens//20)) AS max_edges, greatest(0,least(k.depth,ms//1500)) AS allowed, completeness='EXHAUSTIVE' AS every, k.intent='TRACE_EXECUTION' AS reverse,
        k.targets[1] AS target, (SELECT count(*) FROM all_seeds s WHERE s.target=k.targets[1]) AS n_seeds FROM contracts k JOIN terms USING (q)),
      early AS (SELECT *, CASE WHEN n_seeds>max_nodes AND (every OR max_nodes=0) THEN 'PLAN_UNSUPPORTED' WHEN allowed<depth AND every THEN 'PLAN_BLOCKED' END AS stop FROM c),
      req AS MATERIALIZED (SELECT q, allowed AS depth, max_nodes, max_edges, reverse FROM early WHERE stop IS NULL),
      seeds AS MATERIALIZED (SELECT e.q, s.canonical_id AS node, s.rank FROM early e JOIN all_seeds s ON s.target=e.target WHERE stop IS NULL AND s.rank<=max_nodes),
      ty AS MATERIALIZED (SELECT q, unnest(types) AS predicate, unnest(range(len(types))) AS pidx FROM early WHERE stop IS NULL AND len(types)>0 UNION ALL SELECT q, NULL, 0 FROM early WHERE stop IS NULL AND len(types)=0),
      pr AS MATERIALIZED (SELECT q, predicate, pidx, coalesce(predicate IN ({",".join(map(_text, DIRECTIONAL))}),false) AS directional, false AS extra FROM ty),
      {traversal_sql('a', 2)},
      again AS MATERIALIZED (SELECT e.q, e.intent FROM early e JOIN a_flags f ON f.q=e.q WHERE f.truncated AND NOT every AND len(types)>1),
      pl AS MATERIALIZED (SELECT t.q, t.predicate, shown, row_number() OVER (PARTITION BY t.q ORDER BY NOT shown, pidx) AS place FROM (SELECT t.*, EXISTS (SELECT 1 FROM a_rels r WHERE r.q=t.q AND r.predicate=t.predicate) AS shown FROM ty t) t),
      pr2 AS MATERIALIZED (SELECT p.q, predicate, place AS pidx, predicate IN ({",".join(map(_text, DIRECTIONAL))}) AS directional, place>1 AS extra FROM pl p JOIN again USING (q) WHERE place=1 OR (shown AND intent='FIND_IMPACT')),
      seeds2 AS MATERIALIZED (SELECT s.* FROM seeds s JOIN again USING (q)), req2 AS MATERIALIZED (SELECT r.* FROM req r JOIN again USING (q)),
      {traversal_sql('b', 2, 'seeds2', 'req2', 'pr2')},
      final_nodes AS MATERIALIZED (SELECT * FROM a_nodes WHERE q NOT IN (SELECT q FROM again) UNION ALL SELECT * FROM b_nodes),
      final_rels AS MATERIALIZED (SELECT * FROM a_rels WHERE q NOT IN (SELECT q FROM again) UNION ALL SELECT * FROM b_rels),
      final_flags AS (SELECT * FROM a_flags WHERE q NOT IN (SELECT q FROM again) UNION ALL SELECT * FROM b_flags),
      facts2 AS (SELECT e.*, coalesce(f.truncated,false) AS truncated, coalesce(a.truncated,false) AS first_cut, e.q IN (SELECT q FROM again) AS narrowed,
        (SELECT count(*) FROM a_nodes n WHERE n.q=e.q) AS original_nodes, (SELECT count(*) FROM a_rels n WHERE n.q=e.q) AS original_edges, (SELECT count(*) FROM final_nodes n WHERE n.q=e.q) AS nodes, (SELECT count(*) FROM final_rels n WHERE n.q=e.q) AS edges
        FROM early e LEFT JOIN final_flags f USING (q) LEFT JOIN a_flags a ON a.q=e.q),
      said AS (SELECT *, list_filter([CASE WHEN n_seeds>max_nodes THEN 'reduce target-entity set to budget ('||n_seeds||' -> '||max_nodes||')' END, CASE WHEN allowed<depth THEN '{planner.FEWER_LEVELS}' END, CASE WHEN narrowed THEN '{planner.FEWER_TYPES}' END, CASE WHEN truncated THEN '{planner.STOP_SOONER}' END], lambda x: x IS NOT NULL) AS steps FROM facts2),
      plan AS MATERIALIZED (SELECT *, CASE WHEN stop IS NOT NULL THEN stop WHEN first_cut AND every THEN 'PLAN_BLOCKED' WHEN len(steps)>0 THEN 'PRUNED' ELSE 'OK' END AS status,
        CASE WHEN stop='PLAN_UNSUPPORTED' THEN '{planner.UNSUPPORTED}' WHEN stop='PLAN_BLOCKED' THEN '{planner.TOO_DEEP}' WHEN first_cut AND every THEN '{planner.TOO_WIDE}' ELSE array_to_string(steps,'; ') END AS reason FROM said),
      kept_types AS (SELECT q, list(predicate ORDER BY pidx) FILTER (NOT extra AND predicate IS NOT NULL) AS main, list(predicate ORDER BY pidx) FILTER (extra) AS more FROM (SELECT * FROM pr WHERE q NOT IN (SELECT q FROM again) UNION ALL SELECT * FROM pr2) GROUP BY 1)"""


_RANKED = """live AS (SELECT p.q, coalesce(main[1],'') AS prim FROM plan p LEFT JOIN kept_types USING (q) WHERE status IN ('OK','PRUNED')),
      nd AS MATERIALIZED (SELECT n.q, node, distance, prim, regexp_extract_all(lower(name||' '||qualified_name||' '),'[a-z0-9]+') AS terms FROM final_nodes n JOIN live USING (q) JOIN entities e ON e.canonical_id=node),
      qa AS (SELECT q, term, count(*) AS times FROM (SELECT s.q, unnest(regexp_extract_all(lower(name||' '||qualified_name),'[a-z0-9]+')) AS term FROM seeds s JOIN live USING (q) JOIN entities e ON e.canonical_id=s.node) GROUP BY 1,2),
      qs AS (SELECT q, count(*) AS docs, avg(len(terms)) AS mean FROM nd GROUP BY 1),
      qt AS (SELECT q, node, size, term, count(*) AS tf FROM (SELECT q, node, len(terms) AS size, unnest(terms) AS term FROM nd) GROUP BY ALL),
      qd AS (SELECT q, term, count(*) AS df FROM qt GROUP BY 1,2),
      qr AS (SELECT q, node, sum(times*ln(1+(docs-df+0.5::DOUBLE)/(df+0.5::DOUBLE))*tf*2.5::DOUBLE/(tf+1.5::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*size/mean))) AS raw FROM qt JOIN qa USING (q,term) JOIN qd USING (q,term) JOIN qs USING (q) GROUP BY 1,2),
      fe AS (SELECT q, node, predicate FROM (SELECT q, subject AS node, * EXCLUDE (q) FROM final_rels UNION ALL SELECT q, object, * EXCLUDE (q) FROM final_rels) QUALIFY row_number() OVER (PARTITION BY q, node ORDER BY subject, predicate, object)=1),
      sg AS (SELECT nd.q, nd.node, distance, coalesce(raw,0) AS raw, max(coalesce(raw,0)) OVER (PARTITION BY nd.q) AS peak, CASE WHEN predicate=prim THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS st FROM nd LEFT JOIN qr ON qr.q=nd.q AND qr.node=nd.node LEFT JOIN fe ON fe.q=nd.q AND fe.node=nd.node),
      rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS rank FROM (SELECT q, node, distance, round(0.25::DOUBLE*(CASE WHEN peak>0 THEN round(raw/peak,9) ELSE 0 END)+0.4::DOUBLE*st+0.25::DOUBLE*power(0.9::DOUBLE,distance)+0.1::DOUBLE,9) AS score FROM sg))"""

_PROVIDERS = f"""pv AS (SELECT s_name AS provider, list_distinct([cp[(s_suppkey%10+1)::INT], cp[(s_suppkey%7+1)::INT]]) AS caps, s_suppkey%13<>0 AS valid, s_suppkey%11<>0 AS eligible, ['HEALTHY','DEGRADED','HEALTHY','UNHEALTHY','HEALTHY'][(s_suppkey%5+1)::INT] AS health,
      (s_suppkey%4)/3.0::DOUBLE AS av, s_suppkey%100 AS hours, (s_suppkey%10)/10.0::DOUBLE AS eq, (s_suppkey%3)/2.0::DOUBLE AS cf FROM supplier, (SELECT {_lists(CAPABILITIES)} AS cp)),
      el AS (SELECT *, CASE WHEN NOT valid THEN 'FAILED' WHEN NOT eligible THEN 'INELIGIBLE' WHEN health='UNHEALTHY' OR av=0 THEN 'UNAVAILABLE' WHEN av=1 AND health='HEALTHY' THEN 'AVAILABLE' ELSE 'PARTIAL' END AS status FROM (SELECT * EXCLUDE (caps), unnest(caps) AS capability FROM pv)),
      rp AS (SELECT provider, capability, score, row_number() OVER (PARTITION BY capability ORDER BY score DESC, provider)::INT AS rank FROM (SELECT *, round(0.4::DOUBLE+0.2::DOUBLE*eq+0.15::DOUBLE*av+0.15::DOUBLE*(CASE WHEN hours<=0 THEN 1 ELSE power(0.5::DOUBLE,hours/24.0::DOUBLE) END)+0.1::DOUBLE*cf,9) AS score FROM el WHERE status IN ('AVAILABLE','PARTIAL')))"""

_VERIFIED = """rec AS (SELECT l_orderkey, l_suppkey, l_partkey, max(l_returnflag)='R' AS against, greatest(0.0::DOUBLE, 1-5*min(l_discount)) AS conf, max(l_shipdate) AS seen FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey, l_linenumber),
      cv AS (SELECT avg(CASE WHEN p=5 THEN 1.0::DOUBLE WHEN p=3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS cov FROM (SELECT event_type, max(CASE WHEN value<5 THEN 2 WHEN value<20 THEN 3 ELSE 5 END) AS p FROM events GROUP BY 1)),
      ag AS (SELECT l_orderkey, l_suppkey, coalesce(sum(conf) FILTER (NOT against),0) AS s, coalesce(sum(conf) FILTER (against),0) AS c, count(*) FILTER (NOT against) AS n, count(DISTINCT l_partkey) FILTER (NOT against) AS g, avg(conf) FILTER (NOT against) AS q,
        avg(CASE WHEN seen>=TIMESTAMP '1998-12-01' THEN 1.0::DOUBLE ELSE power(0.5::DOUBLE,(epoch_us(TIMESTAMP '1998-12-01')-epoch_us(seen))/3.6e9::DOUBLE/24.0::DOUBLE) END) FILTER (NOT against) AS f FROM rec GROUP BY 1,2),
      sc AS (SELECT *, CASE WHEN s+c>0 THEN round(c/(s+c),9) ELSE 0.0::DOUBLE END AS x FROM ag),
      vf AS (SELECT 'order:'||l_orderkey||'>supplier:'||l_suppkey AS claim_id, 'order:'||l_orderkey AS subject, x, round(greatest(0,1-x),9) AS evidence_support, CASE WHEN n>0 THEN round(q,9) ELSE 0.0::DOUBLE END AS evidence_quality, CASE WHEN n>0 THEN round(g/n::DOUBLE,9) ELSE 0.0::DOUBLE END AS evidence_independence,
        CASE WHEN n>0 THEN round((SELECT cov FROM cv),9) ELSE 0.0::DOUBLE END AS coverage, CASE WHEN n>0 THEN round(f,9) ELSE 0.0::DOUBLE END AS freshness, CASE WHEN n>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS provider_authority FROM sc),
      lv AS (SELECT *, CASE WHEN x<=0 THEN 'NONE' WHEN x<0.4 THEN 'WEAK' WHEN x>0.6 THEN 'SIGNIFICANT' ELSE 'INTERMEDIATE' END AS contradiction_level, 0.35::DOUBLE*evidence_support+0.2::DOUBLE*evidence_quality+0.15::DOUBLE*evidence_independence+0.1::DOUBLE*coverage+0.1::DOUBLE*freshness+0.1::DOUBLE*provider_authority AS v FROM vf),
      ve AS (SELECT *, round(CASE WHEN contradiction_level='SIGNIFICANT' THEN least(v,0.5) ELSE v END,9) AS confidence FROM lv),
      cs AS (SELECT *, CASE WHEN contradiction_level='SIGNIFICANT' THEN 'DISPUTED' WHEN confidence>=0.5 THEN 'VERIFIED' ELSE 'INCONCLUSIVE' END AS status FROM ve)"""

_TELEMETRY = """tm AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'VERIFIED' WHEN 'view' THEN 'PARTIALLY_VERIFIED' WHEN 'purchase' THEN 'QUALIFIED' WHEN 'signup' THEN 'INCONCLUSIVE' WHEN 'error' THEN 'REJECTED' END AS result FROM events),
      cl AS (SELECT (result=CASE WHEN quality=1 THEN 'VERIFIED' ELSE 'REJECTED' END)::INT AS hit FROM tm JOIN labels ON doc_id=id WHERE result IS NOT NULL),
      ab AS (SELECT (toxic=1)::INT AS hit FROM tm JOIN labels ON doc_id=id WHERE result='REJECTED' AND toxic IS NOT NULL)"""


def _around_sql() -> str:
    return f"""WITH {REL_SQL}, low AS{retrieval._NAMED.split(", low AS", 1)[1]}, asked AS (SELECT 'NATION_3' AS target), {retrieval._SEEDS.replace('seeds AS (', 'all_seeds AS MATERIALIZED (')},
      seeds AS (SELECT 'q' AS q, canonical_id AS node, rank FROM all_seeds), req AS (SELECT 'q' AS q, 2 AS depth, 50 AS max_nodes, 100 AS max_edges, false AS reverse), pr AS (SELECT 'q' AS q, NULL::VARCHAR AS predicate, 0 AS pidx, false AS directional, false AS extra),
      {traversal_sql('w', 2)}, o AS (SELECT q, 'node' AS kind, node AS subject, '' AS predicate, '' AS object, distance FROM w_nodes UNION ALL SELECT q, 'edge', subject, predicate, object, -1 FROM w_rels)
      SELECT kind, subject, predicate, object, distance::INT AS distance, truncated FROM o JOIN w_flags USING (q)"""


SQL = {
    "tier0_intents": f"WITH {_understood_sql()} SELECT q AS query_id, (nth-1)::INT AS nth, intent, score, array_to_string(targets,'|') AS targets FROM ranked",
    "contract_fields": f"""WITH {_understood_sql()} SELECT ask.q AS query_id, CASE WHEN c.q IS NULL THEN 'SLM_UNAVAILABLE' ELSE 'RESOLVED' END AS status, coalesce(intent,'') AS intent, coalesce(array_to_string(targets,'|'),'') AS targets,
        coalesce(array_to_string(types,'|'),'') AS relationship_types, coalesce(array_to_string(evidence,'|'),'') AS required_evidence, coalesce(depth,-1) AS depth, coalesce(confidence,0) AS confidence FROM ask LEFT JOIN contracts c ON c.q=ask.q""",
    "ambiguity_complexity": f"WITH {_understood_sql()} SELECT q AS query_id, round(ambiguity,6) AS ambiguity, round(complexity,6) AS complexity FROM contracts",
    "depth_ceiling": "SELECT o_orderkey, greatest(0,least(2,floor(o_totalprice)::BIGINT//1500))::INT AS depth FROM orders",
    "plan_status": f"""WITH {_planned_sql()} SELECT q AS query_id, status, reason, n_seeds AS seeds, (CASE WHEN status IN ('OK','PRUNED') THEN allowed ELSE 0 END)::INT AS effective_depth, coalesce(array_to_string(main,'|'),'') AS types,
        status IN ('OK','PRUNED') AND negative AND edges=0 AS negative_candidate FROM plan LEFT JOIN kept_types USING (q)""",
    "prune_trace": f"WITH {_planned_sql()} SELECT q AS query_id, original_nodes, original_edges, nodes, edges, truncated, coalesce(array_to_string(more,'|'),'') AS supplementary FROM plan LEFT JOIN kept_types USING (q) WHERE status IN ('OK','PRUNED')",
    "relationship_type_priority": f"""WITH {REL_SQL}, {_understood_sql()}, ty AS (SELECT intent, unnest(types) AS predicate, unnest(range(len(types))) AS pidx FROM intent_table)
        SELECT intent, predicate, row_number() OVER (PARTITION BY intent ORDER BY predicate NOT IN (SELECT predicate FROM rel WHERE predicate<>'CALLS'), pidx)::INT AS place FROM ty""",
    "rank_entities": f"WITH {_planned_sql()}, {_RANKED} SELECT q AS query_id, node AS entity, rank, round(score,6) AS score FROM rk",
    "evidence_package": f"""WITH {_planned_sql()}, {_RANKED} SELECT node AS entity, name, rank, distance::INT AS distance, round(score,6) AS score, status,
        array_to_string(list_filter([CASE WHEN least(n_seeds,max_nodes)>1 THEN 'ambiguous target: '||least(n_seeds,max_nodes)||' distinct entities match this query' END, CASE WHEN status='PRUNED' THEN 'plan pruned: '||reason END], lambda x: x IS NOT NULL),'; ') AS limitations, truncated AS partial
        FROM rk JOIN plan USING (q) JOIN entities e ON e.canonical_id=node WHERE q='p01'""",
    "neighborhood": _around_sql(),
    "provider_evaluation": f"WITH {_PROVIDERS} SELECT provider, capability, status FROM el",
    "provider_score_rank": f"WITH {_PROVIDERS} SELECT provider, capability, round(score,6) AS score, rank FROM rp",
    "provider_selection": f"""WITH {_PROVIDERS}, {_understood_sql()}, need AS (SELECT intent, unnest(evidence) AS capability FROM intent_table)
        SELECT intent, n.capability, coalesce(string_agg(provider,'|' ORDER BY rank),'') AS providers FROM need n LEFT JOIN rp ON rp.capability=n.capability GROUP BY 1,2""",
    "provider_skips": f"""WITH {_PROVIDERS} SELECT provider, string_agg(capability,'|' ORDER BY capability) AS capabilities, string_agg(capability||': '||status,'; ' ORDER BY capability||': '||status) AS reason FROM el GROUP BY 1 HAVING NOT bool_or(status IN ('AVAILABLE','PARTIAL'))""",
    "provider_authority": f"WITH {_PROVIDERS} SELECT provider, eq AS authority FROM pv",
    "verification_factors": f"WITH {_VERIFIED} SELECT claim_id, {', '.join(f'round({c},6) AS {c}' for c in verify.FACTORS)} FROM vf",
    "verification_confidence": f"WITH {_VERIFIED} SELECT claim_id, contradiction_level, round(confidence,6) AS confidence FROM ve",
    "claim_status": f"WITH {_VERIFIED} SELECT status, contradiction_level, count(*) AS n FROM cs GROUP BY 1,2",
    "answer_status": f"""WITH {_VERIFIED}, an AS (SELECT subject, count(*) FILTER (contradiction_level<>'SIGNIFICANT') AS retained, count(*) FILTER (status='VERIFIED') AS verified, count(*) FILTER (contradiction_level='SIGNIFICANT') AS gone FROM cs GROUP BY 1),
        al AS (SELECT 'order:'||o_orderkey AS query_id, coalesce(retained,0) AS r, coalesce(verified,0) AS v, coalesce(gone,0) AS g FROM orders LEFT JOIN an ON subject='order:'||o_orderkey),
        st AS (SELECT *, CASE WHEN v=0 AND g=0 THEN 'INCONCLUSIVE' WHEN r=0 THEN 'DISPUTED' WHEN v=r THEN CASE WHEN g>0 THEN 'QUALIFIED' ELSE 'VERIFIED' END WHEN v=0 THEN 'INCONCLUSIVE' ELSE 'PARTIALLY_VERIFIED' END AS s FROM al)
        SELECT query_id, CASE WHEN v=0 AND g=0 THEN 'ABSTAIN' WHEN s='VERIFIED' THEN 'STRONG_ANSWER' ELSE 'QUALIFIED_ANSWER' END AS decision, s AS verification_status, CASE s WHEN 'VERIFIED' THEN 'FULLY_VERIFIED' WHEN 'DISPUTED' THEN 'CONTRADICTED' WHEN 'INCONCLUSIVE' THEN 'UNVERIFIED' ELSE 'PARTIALLY_VERIFIED' END AS label,
          CASE s WHEN 'VERIFIED' THEN 'VERIFIED' ELSE 'QUALIFIED' END AS bucket, ((g>0)::INT + r - v)::INT AS limitations FROM st""",
    "claim_accuracy": f"WITH {_TELEMETRY} SELECT count(*) AS n, round(avg(hit),6) AS accuracy FROM cl",
    "abstention_precision": f"WITH {_TELEMETRY} SELECT count(*) AS n, round(avg(hit),6) AS precision FROM ab",
    "metric_report": f"""WITH {retrieval._METRICS}, {_TELEMETRY}, f AS (SELECT 'CLAIM_VERIFICATION_ACCURACY' AS metric, count(*) AS n, avg(hit) AS v FROM cl UNION ALL SELECT 'ABSTENTION_PRECISION', count(*), avg(hit) FROM ab UNION ALL SELECT 'PRECISION_AT_10', count(*), avg(hits/10.0::DOUBLE) FROM me
        UNION ALL SELECT 'RECALL_AT_10', count(*), avg(hits::DOUBLE/relevant) FROM me WHERE relevant>0 UNION ALL SELECT 'MRR', count(*), avg(rr) FROM me), x AS (SELECT * FROM (VALUES {",".join(f"('{k}','{v}')" for k, v in evaluate.EXCLUDED.items())}) v(metric,why))
        SELECT m.metric, why IS NULL AND n>0 AS evaluable, CASE WHEN why IS NULL AND n>0 THEN round(v,6) END AS value, CASE WHEN why IS NULL THEN n ELSE 0 END AS sample_size, CASE WHEN why IS NOT NULL THEN why WHEN n=0 THEN 'INSUFFICIENT_SAMPLE' ELSE '' END AS reason
        FROM (VALUES {",".join(f"('{m}')" for m in METRICS)}) m(metric) LEFT JOIN f USING (metric) LEFT JOIN x USING (metric)""",
}
