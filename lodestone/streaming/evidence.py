"""Evidence as a stream: each batch is one committed version of the graph, which reads and writes only the buckets it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import ENTITY, GraphVersions
from ..schema import EVIDENCE, RELATIONSHIP, split_valid
from ..storage import work_folder


def evidence_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVIDENCE).parquet(folder)


def reconcile_stream(stream: DataFrame, entities: DataFrame, now: Column, folder: str | None = None, authority: DataFrame | None = None) -> DataFrame:
    """Run a stream of EVIDENCE to its end: the current relationships, each as the last batch that touched it left it.

    folder keeps the graph's versions, the progress and the rows that break a rule of the schema (`rejected`); a second
    run goes on there, with the entities that are known by then. A batch that is run again changes nothing: its records
    are known by id. Weights are those of `now`; relationships that no batch touches keep the weights they had.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    store = GraphVersions(spark, f"{folder}/graph")
    missing = [(n, t) for n, t in (x.split() for x in ENTITY.split(", ")) if n not in entities.columns]
    store.upsert(entities.withColumns({n: F.lit(None).cast(t) for n, t in missing}), spark.createDataFrame([], EVIDENCE), now, "entities", authority)
    none = spark.createDataFrame([], ENTITY)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read by the check and the store; recomputed where an executor is lost
        good, bad = split_valid(batch, "evidence")
        bad.write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        store.upsert(none, good, now, f"batch:{number}", authority)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return relationships(spark, folder)


def relationships(spark: SparkSession, folder: str) -> DataFrame:
    """The current relationships of a folder that reconcile_stream wrote."""
    return GraphVersions(spark, f"{folder}/graph").relationships().select(*(x.split()[0] for x in RELATIONSHIP.split(", ")))
