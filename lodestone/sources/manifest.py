"""Project manifests (pyproject.toml): what a project depends on."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from ..functions.identity import EXTERNAL
from .contract import LINK, Cohort, ExtractionError, Normalized, Provider, entity, entity_frame, evidence_of

NAME = re.compile(r"\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)")


def dependency_names(document: dict) -> list[str]:
    """Distinct distribution names of a manifest's dependencies, optional ones too, in order."""
    project = document.get("project")
    if not isinstance(project, dict):
        return []
    optional = project.get("optional-dependencies")
    lists = [project.get("dependencies"), *(optional.values() if isinstance(optional, dict) else ())]
    wanted = (NAME.match(x) for xs in lists if isinstance(xs, list) for x in xs if isinstance(x, str))
    return sorted({m[1] for m in wanted if m})


class ManifestProvider(Provider):
    name, capabilities = "manifest", ("DEPENDENCY",)
    file = "pyproject.toml"

    def eligible(self, repository) -> bool:
        return (Path(repository.path) / self.file).is_file()

    def extract(self, spark, repository, capabilities):
        try:
            document = tomllib.loads((Path(repository.path) / self.file).read_text())
        except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
            raise ExtractionError(self.name, "UNAVAILABLE", str(e)) from e
        return Cohort(self.name, self.version, repository.head_revision, ["DEPENDENCY"]), dependency_names(document)

    def normalize(self, spark, repository, cohort, payload):
        project = entity(repository, "REPOSITORY", repository.repository_id)
        libraries = [entity(repository, "EXTERNAL_LIBRARY", f"pypi:{n}", name=n, revision=EXTERNAL) for n in payload]
        links = [(f"manifest:{repository.head_revision}:dependency:{k}", project[0], "DEPENDS_ON", x[0], 1.0, None) for k, x in enumerate(libraries)]
        return Normalized(entity_frame(spark, [project, *libraries]), evidence_of(cohort, spark.createDataFrame(links, LINK)), cohort)
