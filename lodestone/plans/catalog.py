"""Registered graph queries and their DuckDB twins, by the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators.graph import find_entities, get_relationships
from ..operators.reconcile import combined
from ..streaming import telemetry
from . import questions, retrieval, traversals
from .graph_view import ENTITIES_SQL, REL_SQL, entities, graph, table

Query = Callable[[SparkSession, str], DataFrame]
LINES_A_TASK = 250_000


def canonical_ids(spark, sf_dir):
    return entities(spark, sf_dir)


def _plain(found: DataFrame) -> DataFrame:
    return found.select("canonical_id", "name", "qualified_name", "base_type")


def entity_search_name(spark, sf_dir):
    return _plain(find_entities(graph(spark, sf_dir), name="nation_1"))


def entity_search_type(spark, sf_dir):
    """Entities of one type whose name holds a text: both conditions hold."""
    return _plain(find_entities(graph(spark, sf_dir), name="#00000000", base_type="INTERFACE"))


def edge_scan(spark, sf_dir):
    return get_relationships(graph(spark, sf_dir), predicate="IMPLEMENTS").select("subject", "predicate", "object")


def _weights(spark, sf_dir) -> DataFrame:
    """Line items as evidence on their order: group, side and weight, which halves every 365 days before the newest line."""
    line = table(spark, sf_dir, "lineitem")
    now = line.agg(F.max("l_shipdate").alias("now"))  # one row
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.lit(5.0) * F.col("l_discount")))
    fresh = S.freshness(F.col("l_shipdate"), F.col("now"), 365 * 24.0)
    return line.join(F.broadcast(now)).select("l_orderkey", F.col("l_suppkey").alias("group"), (F.col("l_returnflag") == "R").alias("against"), (confidence * fresh).alias("weight"))


def _reconciled(spark, sf_dir) -> DataFrame:
    """Evidence of each order folded to support, contradiction and status; an order without lines is unresolved."""
    found = combined(_weights(spark, sf_dir), ["l_orderkey"])
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = orders.join(found, "l_orderkey", "left").fillna(0, ["supports", "contradicts"]).fillna(0.0, ["support", "against", "contradiction"])
    return rows.withColumn("status", S.relationship_status(F.lit(True), F.col("supports"), F.col("contradicts"), F.col("support"), F.col("contradiction")))


def independence_combine(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("l_orderkey", "support", F.col("against").alias("contradiction"))


def contradiction_score(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("l_orderkey", F.round("contradiction", 6).alias("score"))


def reconcile_status(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def relationship_confidence(spark, sf_dir):
    rows = _reconciled(spark, sf_dir)
    return rows.select("l_orderkey", "status", F.round(S.relationship_confidence(F.col("status"), F.col("support"), F.col("contradiction")), 6).alias("confidence"))


def co_change_pairs(spark, sf_dir):
    """Parts that are in one order, by pair, with confidence least(1, n/3)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-line.count() // LINES_A_TASK))  # as many as keep a task's pairs few
    basket = line.repartition(parts, "l_orderkey").distinct()
    pairs = basket.alias("x").join(basket.alias("y"), "l_orderkey").where("x.l_partkey < y.l_partkey").select(F.col("x.l_partkey").alias("a"), F.col("y.l_partkey").alias("b"))
    n = pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))  # few pairs repeat: they are not counted before they are dealt
    return n.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / 3), 6))


def session_30m(spark, sf_dir):
    """Sessions of each user: a gap of over 30 minutes starts the next."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.lag("ts").over(w) + F.expr("interval 30 minutes") < F.col("ts")).cast("int"), F.lit(1))
    return e.withColumn("new", new).withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"))


def telemetry_hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def artifact_dedupe(spark, sf_dir):
    """Distinct page bodies by digest, with the smallest page that has each."""
    return table(spark, sf_dir, "pages").groupBy(F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def page_references(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("object")).groupBy("page_id", "object").agg(F.count("*").alias("n"))


FUNCTIONS = (
    canonical_ids, entity_search_name, entity_search_type, edge_scan, independence_combine, contradiction_score,
    reconcile_status, relationship_confidence, co_change_pairs, session_30m, telemetry_hourly, artifact_dedupe, page_references,
)

_RECONCILED_SQL = """w AS (
  SELECT l_orderkey, l_suppkey, l_returnflag='R' AS against, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE-5.0::DOUBLE*l_discount))
    * power(0.5::DOUBLE, (epoch_us((SELECT max(l_shipdate) FROM lineitem))-epoch_us(l_shipdate))/3.6e9::DOUBLE/8760.0::DOUBLE) AS w FROM lineitem), g AS (
  SELECT l_orderkey, l_suppkey, max(w) FILTER (NOT against) AS wf, max(w) FILTER (against) AS wa, sum(w) FILTER (NOT against) AS sf, sum(w) FILTER (against) AS sa,
    count(*) FILTER (NOT against) AS nf, count(*) FILTER (against) AS na FROM w GROUP BY 1,2), k AS (
  SELECT l_orderkey, round(1-coalesce(product(1-wf),1),9) AS support, round(1-coalesce(product(1-wa),1),9) AS against, coalesce(sum(sf),0) AS s, coalesce(sum(sa),0) AS c, sum(nf) AS nf, sum(na) AS na FROM g GROUP BY 1), r AS (
  SELECT o_orderkey AS l_orderkey, coalesce(support,0) AS support, coalesce(against,0) AS against, CASE WHEN s+c>0 THEN round(c/(s+c),9) ELSE 0.0::DOUBLE END AS score, coalesce(nf,0) AS nf, coalesce(na,0) AS na
  FROM orders LEFT JOIN k ON o_orderkey=l_orderkey), st AS (
  SELECT *, CASE WHEN nf>0 AND na>0 THEN CASE WHEN score>=0.5 THEN 'CONTRADICTED' ELSE 'DISPUTED' END WHEN na>0 THEN 'UNSUPPORTED'
    WHEN nf>0 THEN CASE WHEN support>=0.5 THEN 'SUPPORTED' ELSE 'WEAKLY_SUPPORTED' END ELSE 'UNRESOLVED' END AS status FROM r)"""

SQL = {
    "canonical_ids": f"WITH {ENTITIES_SQL} SELECT canonical_id, name, qualified_name, base_type FROM entities",
    "entity_search_name": f"WITH {ENTITIES_SQL} SELECT canonical_id, name, qualified_name, base_type FROM entities WHERE contains(lower(name),'nation_1')",
    "entity_search_type": f"WITH {ENTITIES_SQL} SELECT canonical_id, name, qualified_name, base_type FROM entities WHERE contains(lower(name),'#00000000') AND base_type='INTERFACE'",
    "edge_scan": f"WITH {REL_SQL} SELECT subject, predicate, object FROM rel WHERE predicate='IMPLEMENTS'",
    "independence_combine": f"WITH {_RECONCILED_SQL} SELECT l_orderkey, support, against AS contradiction FROM st",
    "contradiction_score": f"WITH {_RECONCILED_SQL} SELECT l_orderkey, round(score,6) AS score FROM st",
    "reconcile_status": f"WITH {_RECONCILED_SQL} SELECT status, count(*) AS n FROM st GROUP BY 1",
    "relationship_confidence": f"WITH {_RECONCILED_SQL} SELECT l_orderkey, status, CASE WHEN status='UNRESOLVED' THEN 0.0::DOUBLE ELSE round(support*(1-score),6) END AS confidence FROM st",
    "co_change_pairs": """WITH k AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
        SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n, round(least(1.0::DOUBLE, count(*)/3.0::DOUBLE),6) AS confidence
        FROM k x JOIN k y USING (l_orderkey) WHERE x.l_partkey<y.l_partkey GROUP BY 1,2""",
    "session_30m": """WITH n AS (SELECT user_id, event_id, ts, coalesce((lag(ts) OVER w + INTERVAL 30 MINUTE < ts)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM n)
        SELECT user_id, session, count(*) AS n FROM s GROUP BY 1,2""",
    "telemetry_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1,2",
    "artifact_dedupe": "SELECT sha256(coalesce(html,'')) AS digest, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1",
    "page_references": """SELECT page_id, object, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS object FROM pages) GROUP BY 1,2""",
}


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*FUNCTIONS, *retrieval.FUNCTIONS, *traversals.FUNCTIONS, *questions.FUNCTIONS, *telemetry.FUNCTIONS)}


def oracle_sql() -> dict[str, str]:
    return SQL | retrieval.SQL | traversals.SQL | questions.SQL | telemetry.SQL
