"""Identities: canonical ids, normalised paths, event ids and version ids."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "lode:"
EXTERNAL = "external"  # the revision of every external library


def canonical_id(repository: Column, revision: Column, base_type: Column, qualified_name: Column, language: Column | None = None) -> Column:
    """Prefix and 32 hex digits of the SHA-256 of the five fields, joined by `|`; a missing language is empty."""
    language = F.lit("") if language is None else F.coalesce(language, F.lit(""))
    key = F.concat(repository, F.lit("|"), revision, F.lit("|"), base_type, F.lit("|"), language, F.lit("|"), qualified_name)
    return F.concat(F.lit(PREFIX), F.substring(F.sha2(key, 256), 1, 32))


def canonical_id_of(repository: str, revision: str, base_type: str, qualified_name: str, language: str | None = None) -> str:
    """The same of plain strings, for code that runs on the driver."""
    key = "|".join((repository, revision, base_type, language or "", qualified_name))
    return PREFIX + hashlib.sha256(key.encode()).hexdigest()[:32]


def normalized_path(path: Column) -> Column:
    """Forward slashes, relative to the root, no doubled slash. `..` is left alone."""
    plain = F.regexp_replace(path, r"\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^(\./)+", ""), "^/+", ""), "/{2,}", "/")


def event_id(*parts: str) -> str:
    return "telemetry:" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]


def query_event_id(query_id: str, version_id: str, recorded_at: datetime) -> str:
    return event_id("query", query_id, version_id, recorded_at.isoformat())


def query_identity(contract: Column) -> Column:
    """32 hex digits of the SHA-256 of a contract's JSON."""
    return F.substring(F.sha2(F.to_json(contract), 256), 1, 32)


def version_id(repository: str, revision: str, providers: dict[str, str]) -> str:
    """repository:revision and, where providers committed, their versions in name order."""
    names = ",".join(f"{k}={v}" for k, v in sorted(providers.items()))
    return f"{repository}:{revision}:{names}" if names else f"{repository}:{revision}"
