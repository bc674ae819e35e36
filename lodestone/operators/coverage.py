"""What providers covered, by capability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..schema import COVERAGE, COVERED


def outcome_status(capability: Column) -> Column:
    """What one provider outcome says of a capability it was asked for."""
    return (
        F.when(F.col("status") == "SKIPPED", "UNAVAILABLE")
        .when((F.col("status") == "FAILED") | F.col("coverage_status").isNull(), "FAILED")
        .when(F.array_contains("failed", capability), "FAILED")
        .when(F.array_contains("partial", capability), "PARTIAL")
        .when(~F.array_contains("successful", capability), "UNAVAILABLE")
        .when((F.col("entities_upserted") == 0) & (F.col("evidence_upserted") == 0), "EMPTY_SUCCESS")
        .otherwise("COMPLETE")
    )


def best(status: Column) -> Column:
    """The aggregate with the highest priority."""
    names = F.array(*map(F.lit, COVERAGE))
    return F.element_at(names, F.max(F.array_position(names, status)).cast("int"))


def capability_coverage(outcomes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """capability, coverage of every capability asked about; NOT_SUPPORTED where no provider was asked."""
    said = outcomes.withColumn("capability", F.explode("capabilities_requested"))
    found = said.groupBy("capability").agg(best(outcome_status(F.col("capability"))).alias("coverage"))
    return capabilities.select("capability").join(found, "capability", "left").select("capability", F.coalesce("coverage", F.lit("NOT_SUPPORTED")).alias("coverage"))


def is_complete() -> Column:
    """Whether a provider's outcome covers all it was asked for."""
    return (F.col("status") == "COMMITTED") & F.coalesce(F.col("coverage_status") == "FULL", F.lit(False))


def negative(coverage: DataFrame) -> DataFrame:
    """Whether the absence of evidence says anything, by capability."""
    return coverage.withColumn("negative", S.negative_coverage(F.col("coverage")))


def exhaustive(coverage: DataFrame) -> DataFrame:
    """One row: whether every capability is covered; true of none."""
    return coverage.agg(F.coalesce(F.bool_and(F.col("coverage").isin(*COVERED)), F.lit(True)).alias("exhaustive"))
