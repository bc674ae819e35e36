"""Stores as tables: artifacts that never change, evidence and telemetry that only grow."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import event_id, query_event_id
from ..schema import EVIDENCE, FAILURE, TELEMETRY


class ArtifactConflict(ValueError):
    """A reference that already names other bytes."""


class Table:
    """Rows appended to a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def append(self, rows: DataFrame) -> None:
        rows.select(*(x.split()[0] for x in self.schema.split(", "))).write.mode("append").parquet(self.path)

    def read(self, **wanted) -> DataFrame:
        """Rows whose columns equal what is wanted."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        for column, value in wanted.items():
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows


class EvidenceStore(Table):
    def __init__(self, spark, path):
        super().__init__(spark, path, EVIDENCE)

    def add(self, rows: DataFrame) -> None:
        """A record whose id is there already is not added again."""
        self.append(rows.dropDuplicates(["evidence_id"]).join(self.read().select("evidence_id"), "evidence_id", "left_anti"))


class ArtifactStore(Table):
    """reference -> content; storing the same bytes again changes nothing, other bytes are an error."""

    def __init__(self, spark, path):
        super().__init__(spark, path, "reference string, content binary")

    def put(self, rows: DataFrame) -> None:
        both = rows.join(self.read().withColumnRenamed("content", "held"), "reference")
        twice = rows.groupBy("reference").agg(F.countDistinct(F.sha2("content", 256)).alias("n")).where("n > 1").select("reference")
        clash = both.where(F.sha2("content", 256) != F.sha2("held", 256)).select("reference").union(twice).first()
        if clash:
            raise ArtifactConflict(f"{clash[0]} is stored with other content")
        self.append(rows.dropDuplicates(["reference"]).join(self.read().select("reference"), "reference", "left_anti"))


class TelemetryStore:
    def __init__(self, spark, path):
        self.spark, self.queries, self.failures = spark, Table(spark, f"{path}/queries", TELEMETRY), Table(spark, f"{path}/failures", FAILURE)

    def record_query(self, recorded_at: datetime, query_id: str, repository_id: str, version: str, **facts) -> str:
        ident = query_event_id(query_id, version, recorded_at)
        row = {"event_id": ident, "recorded_at": recorded_at, "query_id": query_id, "repository_id": repository_id, "graph_version_id": version} | facts
        self.queries.append(self.spark.createDataFrame([tuple(row.get(x.split()[0]) for x in TELEMETRY.split(", "))], TELEMETRY))
        return ident

    def record_failure(self, recorded_at: datetime, code: str, repository_id: str, detail: str, query_id: str | None = None, version: str | None = None) -> str:
        ident = event_id("failure", code, repository_id, query_id or "", recorded_at.isoformat())
        self.failures.append(self.spark.createDataFrame([(ident, recorded_at, code, repository_id, query_id, version, detail)], FAILURE))
        return ident

    def record_mismatch(self, recorded_at: datetime, error: Exception, repository_id: str, query_id: str) -> str:
        """A query refused because the graph moved on."""
        return self.record_failure(recorded_at, "CONCURRENT_UPDATE_DETECTED", repository_id, str(error), query_id)
