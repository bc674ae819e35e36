"""`python -m lodestone REPOSITORY_ID PATH [PORT]`: ingests a repository and serves it on 127.0.0.1."""

from __future__ import annotations

import sys
import threading

from pyspark.sql import SparkSession

from .operators.ingest import Ingestion, Registry
from .service import Service, serve
from .sources.contract import Repository
from .sources.git import GitProvider, head
from .sources.pycalls import PythonCallsProvider


def main(argv: list[str]) -> int:
    if len(argv) not in (2, 3):
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    registry = Registry()
    for provider in (GitProvider(), PythonCallsProvider()):
        registry.register(provider, (0.8, 0.5))
    ingestion = Ingestion(spark, registry)
    service = Service(spark, lambda name, path: ingestion.run(Repository(name, path, head(path))))
    job = service.register(argv[0], argv[1])
    server = serve(service, int(argv[2]) if len(argv) == 3 else 0)
    print(f"http://127.0.0.1:{server.server_address[1]} (job {job.job_id})", flush=True)
    job.done.wait()
    print(job.phase, job.error or "", flush=True)
    threading.Event().wait()  # until interrupted
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
