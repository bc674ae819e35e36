"""Providers: evaluation, score, rank and selection for a capability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S

USABLE = ("AVAILABLE", "PARTIAL")


def evaluation_status(valid: Column, eligible: Column, health: Column, availability: Column) -> Column:
    return (
        F.when(~valid, "FAILED")
        .when(~eligible, "INELIGIBLE")
        .when((health == "UNHEALTHY") | (availability == 0), "UNAVAILABLE")
        .when((availability == 1) & (health == "HEALTHY"), "AVAILABLE")
        .otherwise("PARTIAL")
    )


def evaluate(providers: DataFrame) -> DataFrame:
    """One row a provider and capability it declares, with its status.

    providers: provider, capabilities, valid, eligible, health, availability, freshness, evidence_quality, cost_factor
    (the last two null where no profile was given).
    """
    rows = providers.withColumn("capability", F.explode("capabilities")).drop("capabilities")
    return rows.withColumn("status", evaluation_status(F.col("valid"), F.col("eligible"), F.col("health"), F.col("availability")))


def rank(providers: DataFrame, now: Column) -> DataFrame:
    """provider, capability, score, rank of the usable ones; one without a profile is an error."""
    usable = evaluate(providers).where(F.col("status").isin(*USABLE))
    missing = F.raise_error(F.concat(F.lit("no score profile for provider "), F.col("provider"))).cast("double")
    profile = lambda c: F.when(F.col(c).isNull(), missing).otherwise(F.col(c))
    score = S.provider_score(capability_match=F.lit(1.0), evidence_quality=profile("evidence_quality"), availability=F.col("availability"), freshness=S.freshness(F.col("freshness"), now), cost_factor=profile("cost_factor"))
    scored = usable.withColumn("score", F.round(score, 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("capability").orderBy(F.desc("score"), "provider"))).select("provider", "capability", "score", "rank")


def select_providers(ranked: DataFrame, required: DataFrame) -> DataFrame:
    """query_id, capability, providers (best first, maybe none) of required (query_id, capability)."""
    names = ranked.groupBy("capability").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "provider"))), lambda x: x["provider"]).alias("providers"))
    return required.join(names, "capability", "left").select("query_id", "capability", F.coalesce("providers", F.array().cast("array<string>")).alias("providers"))


def authority(providers: DataFrame) -> DataFrame:
    """provider, authority: its profile's evidence quality, where it has one."""
    return providers.where("evidence_quality IS NOT NULL").select("provider", F.col("evidence_quality").alias("authority"))


def skip_reasons(evaluations: DataFrame) -> DataFrame:
    """provider, capabilities, reason of the providers that are usable for no capability asked."""
    lost = evaluations.groupBy("provider").agg(F.bool_or(F.col("status").isin(*USABLE)).alias("usable"), F.array_sort(F.collect_list(F.concat_ws(": ", "capability", "status"))).alias("why"), F.array_sort(F.collect_set("capability")).alias("capabilities"))
    return lost.where("NOT usable").select("provider", "capabilities", F.array_join("why", "; ").alias("reason"))
