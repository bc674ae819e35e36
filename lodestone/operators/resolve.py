"""Entity resolution: one row a real entity, whatever its providers call it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import canonical_id, normalized_path

PATHS = ("FILE", "DIRECTORY")
SYMBOLS = ("FUNCTION", "METHOD", "CLASS")
LOCATION_TAG = "symbol_location"
DECORATED = r"\(\)\.|#"


def with_target(entities: DataFrame) -> DataFrame:
    """Adds target_id and reason: files by their normalised path, symbols by file and first line, all others by their own id."""
    path = normalized_path(F.col("qualified_name"))
    ident = lambda q: canonical_id(F.col("repository_id"), F.col("repository_revision"), F.col("base_type"), q, F.col("language"))
    place = F.concat_ws(":", F.lit(LOCATION_TAG), "source_location.file_path", F.col("source_location.start_line").cast("string"))
    is_path = F.col("base_type").isin(*PATHS)
    is_placed = F.col("base_type").isin(*SYMBOLS) & F.col("source_location").isNotNull()
    target = F.when(is_path, ident(path)).when(is_placed, ident(place)).otherwise(F.col("canonical_id"))
    rows = entities.withColumn("target_id", target)
    moved = F.col("target_id") != F.col("canonical_id")
    reason = F.when(is_path & moved, "NORMALIZED_PATH_IDENTITY").when(is_placed, "SYMBOL_LOCATION_IDENTITY").otherwise("EXACT_CANONICAL_ID")
    return rows.withColumns({"reason": reason, "qualified_name": F.when(is_path & moved, path).otherwise(F.col("qualified_name"))})


def resolve_entities(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved entities, and one merge record for each: canonical_id, reason, source_canonical_ids.

    entities needs `ordinal`, the row's place in its batch. The base of a merge is the row with the least
    (canonical_id, ordinal). Roles are united in first-seen order; a status other than ACTIVE wins; the first
    location and language that are there stand; of two symbol names the undecorated one, else the base's.
    """
    rows = with_target(entities)
    fields = ["canonical_id", "ordinal", "reason", "repository_id", "repository_revision", "name", "qualified_name", "base_type", "language", "roles", "source_location", "lifecycle_status"]
    # One real entity's rows: as many as providers report it.
    merged = rows.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct(*fields, F.array_sort(F.map_entries("provider_ids")).alias("ids")))).alias("m"))
    base = F.col("m")[0]
    roles = F.aggregate("m", F.array().cast("array<string>"), lambda acc, x: F.array_union(acc, F.coalesce(x["roles"], F.array().cast("array<string>"))))
    first = lambda name: F.try_element_at(F.filter(F.transform("m", lambda x: x[name]), lambda v: v.isNotNull()), F.lit(1))
    status = F.coalesce(F.try_element_at(F.filter(F.transform("m", lambda x: x["lifecycle_status"]), lambda v: v != "ACTIVE"), F.lit(1)), F.lit("ACTIVE"))
    plain = F.try_element_at(F.filter(F.transform("m", lambda x: x["name"]), lambda v: ~v.rlike(DECORATED)), F.lit(1))
    name = F.when(base["base_type"].isin(*SYMBOLS) & base["name"].rlike(DECORATED), F.coalesce(plain, base["name"])).otherwise(base["name"])
    none = F.array().cast("array<string>")
    every = F.flatten(F.transform("m", lambda x: F.coalesce(x["ids"], F.array().cast("array<struct<key:string,value:string>>"))))
    entries = F.aggregate(every, F.map_from_arrays(none, none), lambda acc, e: F.when(F.map_contains_key(acc, e["key"]), acc).otherwise(F.map_concat(acc, F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))))
    renamed = F.try_element_at(F.filter(F.transform("m", lambda x: x["reason"]), lambda r: r != "EXACT_CANONICAL_ID"), F.lit(-1))
    out = merged.select(
        F.col("target_id").alias("canonical_id"), base["repository_id"].alias("repository_id"), base["repository_revision"].alias("repository_revision"), name.alias("name"), base["qualified_name"].alias("qualified_name"), base["base_type"].alias("base_type"),
        first("language").alias("language"), roles.alias("roles"), first("source_location").alias("source_location"), status.alias("lifecycle_status"), entries.alias("provider_ids"),
        F.coalesce(renamed, F.lit("EXACT_CANONICAL_ID")).alias("reason"), F.array_sort(F.array_distinct(F.transform("m", lambda x: x["canonical_id"]))).alias("source_canonical_ids"),
    )
    return out.drop("reason", "source_canonical_ids"), out.select("canonical_id", "reason", "source_canonical_ids")


def id_map(merges: DataFrame) -> DataFrame:
    """raw_id, canonical_id."""
    return merges.select(F.explode("source_canonical_ids").alias("raw_id"), "canonical_id")


def with_ordinal(entities: DataFrame, *order: str) -> DataFrame:
    """A place for each row of a batch, from its own columns."""
    return entities.withColumn("ordinal", F.row_number().over(Window.partitionBy("canonical_id").orderBy(*order)))
