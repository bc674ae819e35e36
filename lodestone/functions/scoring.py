"""Scores, thresholds and status rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COVERED

# Weights, half-lives and thresholds.
HALF_LIFE_HOURS = 24.0
PROVIDER_WEIGHTS = {"capability_match": 0.40, "evidence_quality": 0.20, "availability": 0.15, "freshness": 0.15, "cost_factor": 0.10}
COMPLEXITY_WEIGHTS = {"intent_count": 0.25, "target_count": 0.15, "relationship_depth": 0.25, "ambiguity": 0.15, "temporal_dimension": 0.10, "reasoning_requirement": 0.10}
RANK_WEIGHTS = {"semantic": 0.25, "structural": 0.40, "proximity": 0.25, "constraint": 0.10}
VERIFICATION_WEIGHTS = {"evidence_support": 0.35, "evidence_quality": 0.20, "evidence_independence": 0.15, "coverage": 0.10, "freshness": 0.10, "provider_authority": 0.10}
SUPPORTED_AT, CONTRADICTED_AT = 0.5, 0.5
WEAK_BELOW, SIGNIFICANT_ABOVE, CONTRADICTION_CAP, VERIFIED_AT = 0.40, 0.60, 0.50, 0.50
NODE_TOKENS, EDGE_TOKENS, MOST_NODES, MOST_EDGES, DEPTH_MS = 50, 20, 100, 250, 1500
LABELS = {"VERIFIED": "FULLY_VERIFIED", "PARTIALLY_VERIFIED": "PARTIALLY_VERIFIED", "QUALIFIED": "PARTIALLY_VERIFIED", "DISPUTED": "CONTRADICTED", "INCONCLUSIVE": "UNVERIFIED", "REJECTED": "CONTRADICTED"}
BUCKETS = {"VERIFIED": "VERIFIED", "PARTIALLY_VERIFIED": "QUALIFIED", "QUALIFIED": "QUALIFIED", "DISPUTED": "QUALIFIED", "INCONCLUSIVE": "QUALIFIED", "REJECTED": "ABSTAIN"}


def weighted(weights: dict[str, float], columns: dict[str, Column] | None = None) -> Column:
    return reduce(Column.__add__, (F.lit(w) * (columns[k] if columns else F.col(k)) for k, w in weights.items()))


def freshness(at: Column, now: Column, half_life_hours: float = HALF_LIFE_HOURS) -> Column:
    """0 where never observed, 1 where not past, else a half for each half-life."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3.6e9)
    return F.when(at.isNull(), 0.0).when(hours <= 0, 1.0).otherwise(F.pow(F.lit(0.5), hours / F.lit(half_life_hours)))


def provider_score(**columns: Column) -> Column:
    return F.when(columns["capability_match"] == 0, 0.0).otherwise(weighted(PROVIDER_WEIGHTS, columns))


def complexity(**columns: Column) -> Column:
    return weighted(COMPLEXITY_WEIGHTS, columns)


def capped_share(n: Column, most: int = 5) -> Column:
    """n / most, one at most; a negative count is an error."""
    return F.when(n < 0, F.raise_error(F.lit("a count must not be negative")).cast("double")).otherwise(F.least(n / F.lit(float(most)), F.lit(1.0)))


def ambiguity(scores: Column) -> Column:
    """Second score over the first of an array in falling order; 0 without a second or a positive first."""
    first, second = F.try_element_at(scores, F.lit(1)), F.try_element_at(scores, F.lit(2))
    return F.when((F.size(scores) < 2) | (first <= 0), 0.0).otherwise(F.least(second / first, F.lit(1.0)))


def node_ceiling(tokens: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MOST_NODES), F.floor(tokens / NODE_TOKENS))).cast("int")


def edge_ceiling(tokens: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MOST_EDGES), F.floor(tokens / EDGE_TOKENS))).cast("int")


def depth_ceiling(milliseconds: Column, requested: Column) -> Column:
    return F.greatest(F.lit(0), F.least(requested, F.floor(milliseconds / DEPTH_MS))).cast("int")


def relationship_status(known: Column, supports: Column, contradicts: Column, support_weight: Column, contradiction: Column) -> Column:
    """Status of a relationship from the numbers of its records on either side."""
    return (
        F.when(~known, "UNRESOLVED")
        .when((supports > 0) & (contradicts > 0), F.when(contradiction >= CONTRADICTED_AT, "CONTRADICTED").otherwise("DISPUTED"))
        .when(contradicts > 0, "UNSUPPORTED")
        .when(supports > 0, F.when(support_weight >= SUPPORTED_AT, "SUPPORTED").otherwise("WEAKLY_SUPPORTED"))
        .otherwise("UNRESOLVED")
    )


def relationship_confidence(status: Column, support_weight: Column, contradiction: Column) -> Column:
    return F.when(status == "UNRESOLVED", 0.0).otherwise(support_weight * (1 - contradiction))


def contradiction_level(score: Column) -> Column:
    return F.when(score <= 0, "NONE").when(score < WEAK_BELOW, "WEAK").when(score > SIGNIFICANT_ABOVE, "SIGNIFICANT").otherwise("INTERMEDIATE")


def coverage_factor(status: Column) -> Column:
    return F.when(status.isin(*COVERED), 1.0).when(status == "PARTIAL", 0.5).otherwise(0.0)


def verification_confidence(level: Column, columns: dict[str, Column] | None = None) -> Column:
    v = weighted(VERIFICATION_WEIGHTS, columns)
    return F.when(level == "SIGNIFICANT", F.least(v, F.lit(CONTRADICTION_CAP))).otherwise(v)


def claim_status(entailed: Column, level: Column, confidence: Column) -> Column:
    return F.when(~entailed, "INCONCLUSIVE").when(level == "SIGNIFICANT", "DISPUTED").when(confidence >= VERIFIED_AT, "VERIFIED").otherwise("INCONCLUSIVE")


def answer_status(retained: Column, verified: Column, removed: Column) -> Column:
    return (
        F.when(retained == 0, F.when(removed > 0, "DISPUTED").otherwise("INCONCLUSIVE"))
        .when(verified == retained, F.when(removed > 0, "QUALIFIED").otherwise("VERIFIED"))
        .when(verified == 0, "INCONCLUSIVE")
        .otherwise("PARTIALLY_VERIFIED")
    )


def mapped(status: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), status)


def negative_coverage(status: Column) -> Column:
    return F.when(status.isin(*COVERED), "NO_EVIDENCE_FOUND").otherwise("INCONCLUSIVE")


def proximity(distance: Column) -> Column:
    return F.when(distance.isNull(), 0.0).otherwise(F.pow(F.lit(0.9), distance))


def constraint_match(tags: Column, constraints: Column) -> Column:
    """Jaccard similarity; 1 without constraints, 0 without tags."""
    return F.when(F.size(constraints) == 0, 1.0).when(F.size(tags) == 0, 0.0).otherwise(F.size(F.array_intersect(tags, constraints)) / F.size(F.array_union(tags, constraints)))
