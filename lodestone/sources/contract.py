"""What a provider is, and the rows that it gives."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_id_of
from ..schema import ENTITY, EVIDENCE


class ExtractionError(RuntimeError):
    """A provider that cannot extract: UNAVAILABLE or TIMEOUT, with detail."""

    def __init__(self, provider: str, reason: str, detail: str):
        super().__init__(f"{provider}: {reason}: {detail}")
        self.provider, self.reason, self.detail = provider, reason, detail


@dataclass(frozen=True)
class Repository:
    repository_id: str
    path: str
    head_revision: str


@dataclass
class Cohort:
    """What one extraction covered. FULL where all that was asked succeeded, NONE where nothing was, else PARTIAL."""

    provider: str
    provider_version: str
    source_revision: str
    successful: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    partial: list[str] = field(default_factory=list)
    observed_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    @property
    def coverage_status(self) -> str:
        if self.failed or self.partial:
            return "PARTIAL"
        return "FULL" if self.successful else "NONE"

    def supports(self, capability: str) -> bool:
        return capability in self.successful


@dataclass
class Normalized:
    """Entities (with ordinal, their place in the batch) and evidence of one extraction."""

    entities: DataFrame
    evidence: DataFrame
    cohort: Cohort


class Provider(ABC):
    name: str
    version: str = "1.0.0"
    capabilities: tuple[str, ...] = ()

    def health(self) -> str:
        return "HEALTHY"

    def availability(self, capability: str, repository: Repository) -> float:
        return 1.0 if capability in self.capabilities and self.eligible(repository) else 0.0

    def validate(self) -> bool:
        return True

    def eligible(self, repository: Repository) -> bool:
        return True

    @abstractmethod
    def extract(self, spark: SparkSession, repository: Repository, capabilities: list[str]) -> tuple[Cohort, object]:
        """The cohort, and a payload that only normalize() reads."""

    @abstractmethod
    def normalize(self, spark: SparkSession, repository: Repository, cohort: Cohort, payload) -> Normalized: ...


def entity(repository: Repository, base_type: str, qualified_name: str, name: str | None = None, revision: str | None = None, roles=(), location=None, status: str = "ACTIVE", provider_ids=None) -> tuple:
    """A row of ENTITY with its canonical id; location is (file, first line, last line, first column, last column)."""
    at = revision or repository.head_revision
    ident = canonical_id_of(repository.repository_id, at, base_type, qualified_name)
    return ident, repository.repository_id, at, name or qualified_name.rsplit("/", 1)[-1] or qualified_name, qualified_name, base_type, None, list(roles), location, status, dict(provider_ids or {})


def entity_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows that entity() made, with their places."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{ENTITY}, ordinal int")


def evidence_of(cohort: Cohort, links: DataFrame) -> DataFrame:
    """EVIDENCE rows of links (evidence_id, subject, predicate, object, confidence, raw_reference)."""
    about = {"provider": cohort.provider, "provider_version": cohort.provider_version, "snapshot_id": cohort.source_revision, "source_revision": cohort.source_revision}
    rows = links.withColumns({k: F.lit(v) for k, v in about.items()} | {"freshness": F.lit(cohort.observed_at).cast("timestamp"), "independence_group": F.lit(None).cast("string")})
    return rows.select(*(x.split()[0] for x in EVIDENCE.split(", ")))


LINK = "evidence_id string, subject string, predicate string, object string, confidence double, raw_reference string"
