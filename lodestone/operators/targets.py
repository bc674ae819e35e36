"""From target texts to seed entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching as M
from ..storage import keep
from .target_index import SCANNED, Names, TargetIndex, index


def _matches(entities: TargetIndex | Names, lookups: DataFrame, few: bool) -> DataFrame:
    """Entities (canonical_id, name, qualified_name) of each lookup (query_id, lookup, lower-case).

    By a substring of the name, or of the symbol path; where an entity's whole qualified name equals the lookup, the
    second axis gives those alone. Buried matches stand only where there are no better ones. What a few lookups find may be most of the
    entities: it is written once, and what decides is counted and sent to it.
    """
    symbol = F.lower(M.symbol_path(F.col("qualified_name")))
    found = entities.candidates(lookups).where(F.contains(F.lower("name"), F.col("lookup")) | F.contains(symbol, F.col("lookup")))
    per, result = Window.partitionBy("query_id", "lookup"), ["query_id", "lookup", "canonical_id", "name", "qualified_name", "tier"]
    found = found.withColumns({"by_name": F.contains(F.lower("name"), F.col("lookup")), "exact": F.contains(symbol, F.col("lookup")) & (F.lower("qualified_name") == F.col("lookup"))})
    found = found.withColumn("tier", M.tier(F.col("name"), F.col("qualified_name"), F.col("lookup")))
    named = F.when(F.col("by_name") | F.col("exact"), F.col("tier"))
    if few:
        found = keep(found)
        facts = found.groupBy("query_id", "lookup").agg(F.max("exact").alias("any_exact"), F.when(F.max("exact"), F.min(named)).otherwise(F.min("tier")).alias("best"))
        return found.join(F.broadcast(facts), ["query_id", "lookup"]).where("(by_name OR exact OR NOT any_exact) AND (best = 2 OR tier <= 1)").select(*result)
    found = found.withColumn("any_exact", F.max("exact").over(per)).where("by_name OR exact OR NOT any_exact")
    return found.withColumn("best", F.min("tier").over(per)).where("best = 2 OR tier <= 1").select(*result)


def resolve_targets(entities: DataFrame | TargetIndex | Names, targets: DataFrame) -> DataFrame:
    """Seeds (query_id, entity, qualifier_tier, tier, rank) of targets (query_id, target).

    A dotted target, unless it ends like a file, also asks for its last part: candidates that its qualifier
    confirms, or all of them where it confirms none. Order: qualifier tier, match tier, canonical_id.
    """
    entities = index(entities, stored=False) if isinstance(entities, DataFrame) else entities
    targets = targets.select("query_id", F.lower("target").alias("target")).where("target <> ''").distinct()
    few = targets.limit(SCANNED + 1).count() <= SCANNED
    small = F.broadcast if few else (lambda rows: rows)
    dotted = targets.where(F.contains("target", F.lit("."))).withColumns({"symbol": F.substring_index("target", ".", -1), "qualifier": F.regexp_replace("target", r"\.[^.]*$", "")})
    qualified = dotted.where((F.col("symbol") != "") & (F.col("qualifier") != "") & ~F.col("symbol").isin(*M.EXTENSIONS))
    whole = _matches(entities, targets.select("query_id", F.col("target").alias("lookup")), few).select("query_id", "canonical_id", "name", "qualified_name", F.lit(None).cast("int").alias("qualifier_tier"))
    parts = _matches(entities, qualified.select("query_id", F.col("symbol").alias("lookup")).distinct(), few)
    parts = parts.join(small(qualified.select("query_id", F.col("symbol").alias("lookup"), "target", "qualifier")), ["query_id", "lookup"])
    parts = parts.withColumn("qualifier_tier", M.qualifier_tier(F.col("qualified_name"), F.col("qualifier")))
    confirmed = F.max(F.col("qualifier_tier").isNotNull()).over(Window.partitionBy("query_id", "target"))
    parts = parts.withColumn("confirmed", confirmed).where("NOT confirmed OR qualifier_tier IS NOT NULL")
    found = whole.unionByName(parts.select(*whole.columns))
    texts = targets.unionByName(dotted.where("symbol <> ''").select("query_id", F.col("symbol").alias("target"))).distinct()
    tiers = found.join(small(texts), "query_id").withColumn("tier", M.tier(F.col("name"), F.col("qualified_name"), F.col("target"))).drop("target")
    tiers = tiers.repartition("query_id", "canonical_id")  # both counts below, dealt once
    tiers = tiers.groupBy("query_id", "canonical_id", "name", "qualified_name").agg(F.coalesce(F.min("qualifier_tier"), F.lit(2)).alias("qualifier_tier"), F.min("tier").alias("tier"))
    tiers = tiers.groupBy("query_id", "canonical_id", "qualifier_tier").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("query_id").orderBy("qualifier_tier", "tier", "entity")
    return tiers.select("query_id", F.col("canonical_id").alias("entity"), "qualifier_tier", "tier").withColumn("rank", F.row_number().over(order))
