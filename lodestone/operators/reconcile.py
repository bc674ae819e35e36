"""Folding evidence to relationships, and their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

KEY = ["subject", "predicate", "object"]


def independence_group() -> Column:
    """The group of a record; without one, all records of its provider are one."""
    return F.coalesce(F.nullif(F.col("independence_group"), F.lit("")), F.concat(F.lit("provider_default:"), F.col("provider")))


def remapped(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """Evidence with its ends as entity resolution names them: ids (raw_id, canonical_id). The record's own id stays."""
    for end in ("subject", "object"):
        names = ids.select(F.col("raw_id").alias(end), F.col("canonical_id").alias("_to"))
        evidence = evidence.join(names, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return evidence


def weighted(evidence: DataFrame, now: Column, authority: DataFrame | None = None, half_life_hours: float = S.HALF_LIFE_HOURS) -> DataFrame:
    """Adds weight: confidence x authority (1 where the provider has none) x freshness."""
    if authority is None:
        trust = F.lit(1.0)
    else:
        evidence = evidence.join(authority.select("provider", "authority"), "provider", "left")
        trust = F.coalesce("authority", F.lit(1.0))
    return evidence.withColumn("weight", F.col("confidence") * trust * S.freshness(F.col("freshness"), now, half_life_hours))


def combined(rows: DataFrame, key: list[str]) -> DataFrame:
    """Support and contradiction of each key: rows have key, group, against, weight.

    Records of one group count by their largest weight in the combination; the contradiction score sums all records.
    """
    grouped = rows.groupBy(*key, "group").agg(*(F.max(F.when(side, F.col("weight"))).alias(n) for n, side in _sides("w")), *(F.sum(F.when(side, F.col("weight"))).alias(n) for n, side in _sides("s")), *(F.count(F.when(side, 1)).alias(n) for n, side in _sides("n")))
    product = lambda c: F.round(1 - F.coalesce(F.product(F.when(F.col(c).isNotNull(), 1 - F.col(c))), F.lit(1.0)), 9)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = grouped.groupBy(*key).agg(product("w_for").alias("support"), product("w_against").alias("against"), total("s_for").alias("s"), total("s_against").alias("c"), F.sum("n_for").alias("supports"), F.sum("n_against").alias("contradicts"))
    score = F.when(F.col("s") + F.col("c") > 0, F.round(F.col("c") / (F.col("s") + F.col("c")), 9)).otherwise(0.0)
    return out.withColumn("contradiction", score).drop("s", "c")


def _sides(prefix: str) -> list[tuple[str, Column]]:
    return [(f"{prefix}_for", ~F.col("against")), (f"{prefix}_against", F.col("against"))]


def fold(evidence: DataFrame, contradicting: DataFrame | None = None) -> DataFrame:
    """One row a (subject, predicate, object) with its distinct evidence ids, in order.

    Where records carry their commit ordinal (commit_seq), edge_seq is the first of a relationship's.
    """
    rows = evidence.withColumn("against", F.lit(False))
    if contradicting is not None:
        rows = rows.unionByName(contradicting.withColumn("against", F.lit(True)), allowMissingColumns=True)
    ids = lambda side: F.array_sort(F.collect_set(F.when(side, F.col("evidence_id"))))
    first = [F.min("commit_seq").alias("edge_seq")] if "commit_seq" in rows.columns else []
    return rows.groupBy(*KEY).agg(ids(~F.col("against")).alias("supporting_evidence_ids"), ids(F.col("against")).alias("contradicting_evidence_ids"), *first)


def reconcile(evidence: DataFrame, entities: DataFrame, now: Column, contradicting: DataFrame | None = None, authority: DataFrame | None = None, half_life_hours: float = S.HALF_LIFE_HOURS) -> DataFrame:
    """Relationships with status, confidence, contradiction score and evidence ids. An unknown end leaves a relationship UNRESOLVED."""
    rows = evidence.withColumn("against", F.lit(False))
    if contradicting is not None:
        rows = rows.unionByName(contradicting.withColumn("against", F.lit(True)), allowMissingColumns=True)
    rows = weighted(rows.dropDuplicates(["evidence_id", *KEY]), now, authority, half_life_hours).withColumn("group", independence_group())
    numbers = combined(rows, KEY).join(fold(evidence, contradicting).hint("merge"), KEY)  # both are dealt by KEY
    for end in ("subject", "object"):
        known = entities.select(F.col("canonical_id").alias(end), F.lit(True).alias(f"_{end}")).distinct()
        numbers = numbers.join(known.hint("merge"), end, "left")  # all entities: their number is not bounded
    known = F.coalesce("_subject", F.lit(False)) & F.coalesce("_object", F.lit(False))
    numbers = numbers.withColumn("status", S.relationship_status(known, F.col("supports"), F.col("contradicts"), F.col("support"), F.col("contradiction")))
    contradiction = F.when(known, F.col("contradiction")).otherwise(0.0)
    return numbers.select(*KEY, F.round(S.relationship_confidence(F.col("status"), F.col("support"), contradiction), 9).alias("confidence"), "status", contradiction.alias("contradiction_score"), "supporting_evidence_ids", "contradicting_evidence_ids", *(["edge_seq"] if "edge_seq" in numbers.columns else []))


def collect_evidence(relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence behind relationships, each once, by id; ids without a record are left out."""
    ids = relationships.select(F.explode(F.array_union("supporting_evidence_ids", "contradicting_evidence_ids")).alias("evidence_id")).distinct()
    return evidence.join(ids, "evidence_id", "left_semi").orderBy("evidence_id")
