"""Git history: the files of the tip commit with their fate, and files that change together."""

from __future__ import annotations

import shutil
import subprocess
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_id_of
from ..operators.ordinals import numbered
from .contract import Cohort, ExtractionError, Normalized, Provider, Repository, entity, entity_frame, evidence_of

WINDOW, SATURATION, TIMEOUT = 20, 3.0, 30.0
FATES = {"A": "ACTIVE", "M": "ACTIVE", "T": "ACTIVE", "D": "DELETED", "R": "RENAMED"}


def run_git(path: str, *args: str, timeout: float = TIMEOUT) -> str:
    return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=True, timeout=timeout).stdout


def head(path: str) -> str:
    return run_git(path, "rev-parse", "HEAD").strip()


def clone(url: str, path: str) -> str:
    subprocess.run(["git", "clone", "-q", url, path], check=True, capture_output=True)
    return head(path)


def changed_files(path: str, old: str | None, new: str, timeout: float = TIMEOUT) -> list[tuple[str, str, str]]:
    """(fate letter, old path, path) between two revisions, or of a root commit against the empty tree."""
    args = ["diff-tree", "-r", "-M", "-z", "--no-commit-id", "--name-status", *([old, new] if old else ["--root", new])]
    parts, out = iter(run_git(path, *args, timeout=timeout).split("\0")), []
    for letter in parts:
        if letter:
            was = next(parts)
            out.append((letter[0], was, next(parts) if letter[0] in "RC" else was))
    return out


def changeset(spark: SparkSession, repository: Repository, old: str, new: str) -> DataFrame:
    """path, old_path, change (added, modified, deleted, renamed) between two revisions."""
    names = {"A": "added", "D": "deleted", "R": "renamed"}
    return spark.createDataFrame([(p, o, names.get(c, "modified")) for c, o, p in changed_files(repository.path, old, new)], "path string, old_path string, change string")


class GitProvider(Provider):
    name, capabilities = "git", ("HISTORY", "CO_CHANGE")

    def __init__(self, window: int = WINDOW, timeout: float = TIMEOUT):
        self.window, self.timeout = window, timeout

    def health(self) -> str:
        return "HEALTHY" if shutil.which("git") else "UNHEALTHY"

    def eligible(self, repository: Repository) -> bool:
        try:
            run_git(repository.path, "rev-parse", "--git-dir")
            return True
        except (subprocess.SubprocessError, OSError):
            return False

    def extract(self, spark, repository, capabilities):
        cohort = Cohort(self.name, self.version, repository.head_revision)
        payload: dict[str, list] = {}
        deadline = time.monotonic() + self.timeout
        try:
            chain = run_git(repository.path, "rev-list", "--first-parent", "--parents", f"-n{self.window}", repository.head_revision).split("\n")
        except subprocess.SubprocessError as e:
            raise ExtractionError(self.name, "UNAVAILABLE", f"revision {repository.head_revision!r}: {e}") from e
        commits = [(c[0], c[1] if len(c) > 1 else None) for c in (x.split() for x in chain) if c]
        for capability in (c for c in self.capabilities if c in capabilities):
            try:
                rows = []
                for commit, parent in commits[:1] if capability == "HISTORY" else commits:
                    left = deadline - time.monotonic()
                    if left <= 0:
                        raise subprocess.TimeoutExpired("git", self.timeout)
                    rows += [(commit, c, p) for c, _, p in changed_files(repository.path, parent, commit, left)]
                payload[capability] = rows
                cohort.successful.append(capability)
            except subprocess.SubprocessError:
                cohort.failed.append(capability)
        return cohort, payload

    def normalize(self, spark, repository, cohort, payload):
        files = [entity(repository, "FILE", p, status=FATES.get(c, "ACTIVE")) for _, c, p in payload.get("HISTORY", [])]
        rows = [(commit, p, canonical_id_of(repository.repository_id, repository.head_revision, "FILE", p)) for commit, _, p in payload.get("CO_CHANGE", [])]
        return Normalized(entity_frame(spark, files), evidence_of(cohort, co_changes(spark.createDataFrame(rows, "commit string, path string, id string"), repository.head_revision)), cohort)


def co_changes(changed: DataFrame, revision: str) -> DataFrame:
    """Pairs of files in one commit, with confidence least(1, commits / SATURATION), numbered by path."""
    files = changed.distinct()
    pairs = files.alias("x").join(files.alias("y"), "commit").where("x.path < y.path")
    counted = pairs.groupBy("x.path", "y.path", "x.id", "y.id").agg(F.count("*").alias("n")).toDF("a", "b", "subject", "object", "n")
    counted = numbered(counted, ["a", "b"], "nth")
    return counted.select(F.concat(F.lit(f"git:co_change:{revision}:"), F.col("nth").cast("string")).alias("evidence_id"), "subject", F.lit("CO_CHANGED_WITH").alias("predicate"), "object", F.least(F.lit(1.0), F.col("n") / SATURATION).alias("confidence"), F.lit(None).cast("string").alias("raw_reference"))
