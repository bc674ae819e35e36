"""Tables, closed vocabularies and checks of the evidence graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<file_path:string,start_line:int,end_line:int,start_column:int,end_column:int>"
ENTITY = f"canonical_id string, repository_id string, repository_revision string, name string, qualified_name string, base_type string, language string, roles array<string>, source_location {LOCATION}, lifecycle_status string, provider_ids map<string,string>"
EVIDENCE = "evidence_id string, provider string, provider_version string, snapshot_id string, source_revision string, subject string, predicate string, object string, confidence double, freshness timestamp, independence_group string, raw_reference string"
RELATIONSHIP = "subject string, predicate string, object string, confidence double, status string, contradiction_score double, supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>"
OUTCOME = "provider_name string, provider_version string, status string, capabilities_requested array<string>, successful array<string>, failed array<string>, partial array<string>, coverage_status string, failure_reason string, detail string, entities_upserted int, evidence_upserted int"
TELEMETRY = "event_id string, recorded_at timestamp, query_id string, repository_id string, graph_version_id string, candidate_count int, mss_size int, llm_calls int, verification_result string, cache_hit boolean, plan_status string"
FAILURE = "event_id string, recorded_at timestamp, code string, repository_id string, query_id string, graph_version_id string, detail string"

# Names of the data model.
BASE_TYPES = ("REPOSITORY", "DIRECTORY", "FILE", "MODULE", "NAMESPACE", "CLASS", "INTERFACE", "FUNCTION", "METHOD", "VARIABLE", "TEST", "CONFIGURATION", "EXTERNAL_LIBRARY", "API", "DATABASE", "RUNTIME_COMPONENT")
PREDICATES = ("CONTAINS", "IMPORTS", "DEPENDS_ON", "CALLS", "REFERENCES", "IMPLEMENTS", "EXTENDS", "OVERRIDES", "TESTED_BY", "CONFIGURED_BY", "EXPOSES", "CONSUMES", "PERSISTS_TO", "CO_CHANGED_WITH", "OBSERVED_CALL", "READS", "WRITES")
DERIVED = {"REACHES": "CALLS", "TRANSITIVE_CALLS": "CALLS", "INDIRECTLY_DEPENDS_ON": "DEPENDS_ON"}
CAPABILITIES = ("SYMBOL_DEFINITION", "SYMBOL_REFERENCE", "IMPLEMENTATION", "CALL_RELATIONSHIP", "TYPE_RELATIONSHIP", "DATA_FLOW", "SOURCE_LOCATION", "DEPENDENCY", "CO_CHANGE", "HISTORY")
LIFECYCLES = ("ACTIVE", "DELETED", "RENAMED")
CLAIM_TYPES = ("FACT", "DERIVED", "INFERENCE", "UNKNOWN")
VERIFICATION = ("VERIFIED", "PARTIALLY_VERIFIED", "QUALIFIED", "DISPUTED", "INCONCLUSIVE", "REJECTED")
#: Best evidence wins: the later status has priority.
COVERAGE = ("NOT_SUPPORTED", "UNAVAILABLE", "FAILED", "PARTIAL", "EMPTY_SUCCESS", "COMPLETE")
COVERED = ("COMPLETE", "EMPTY_SUCCESS")
METRICS = ("PRECISION_AT_10", "RECALL_AT_10", "MRR", "FACTUAL_ACCURACY", "CLAIM_VERIFICATION_ACCURACY", "UNSUPPORTED_CLAIM_RATE", "ABSTENTION_PRECISION", "TOKEN_EFFICIENCY", "ASSERTION_TRACEABILITY")


def _location_ok(c: Column) -> Column:
    line, column = (c["start_line"] >= 0) & (c["end_line"] >= c["start_line"]), c["start_column"].isNull() == c["end_column"].isNull()
    same = (c["start_line"] != c["end_line"]) | c["start_column"].isNull() | ((c["start_column"] >= 0) & (c["end_column"] >= c["start_column"]))
    return c.isNull() | (line & column & same)


#: What a row must satisfy, by table.
RULES = {
    "entities": {
        "base_type": lambda: F.col("base_type").isin(*BASE_TYPES),
        "lifecycle_status": lambda: F.col("lifecycle_status").isin(*LIFECYCLES),
        "source_location": lambda: _location_ok(F.col("source_location")),
    },
    "evidence": {
        "predicate": lambda: F.col("predicate").isin(*PREDICATES),
        "confidence": lambda: F.col("confidence").between(0, 1),
        "raw_reference": lambda: F.col("raw_reference").isNull() | F.col("raw_reference").rlike("^(artifact|s3|file)://"),
    },
    "contracts": {
        "token_budget": lambda: F.col("token_budget") > 0,
        "latency_budget_ms": lambda: F.col("latency_budget_ms") > 0,
        "unknown": lambda: (F.col("intent") != "UNKNOWN") | ((F.size("targets") == 0) & (F.size("relationship_types") == 0)),
    },
}


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the table's rules, and the others with the names of the rules they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule(), F.lit(False)), F.lit(name)) for name, rule in RULES[table].items())))
    marked = df.withColumn("broken_rules", broken)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)
