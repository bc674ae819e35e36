"""The engine's service: repositories, ingestion jobs, lookups and neighbourhoods, with a small HTTP server."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import Graph
from .operators.targets import resolve_targets
from .operators.traverse import traverse

MOST_NODES, MOST_EDGES, MOST_SYMBOLS = 50, 100, 25


def _seeds(graph: Graph, symbol: str) -> DataFrame:
    """Seeds of a text; a canonical id names its entity."""
    spark = graph.entities.sparkSession
    by_name = resolve_targets(graph.targets, spark.createDataFrame([("q", symbol)], "query_id string, target string")).select("query_id", "entity", "rank")
    by_id = graph.entities.where(F.col("canonical_id") == symbol).select(F.lit("q").alias("query_id"), F.col("canonical_id").alias("entity"), F.lit(0).alias("rank"))
    return by_name.unionByName(by_id)


def lookup_symbols(graph: Graph, query: str, limit: int = MOST_SYMBOLS) -> DataFrame:
    """The first seeds of a text, in their order; none of an empty one."""
    return _seeds(graph, query).where(F.col("rank") <= limit).orderBy("rank").limit(limit)


def neighborhood(graph: Graph, symbol: str, depth: int = 1, max_nodes: int = MOST_NODES, max_edges: int = MOST_EDGES, relationship_types: list[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (entity, distance), edges (with status, confidence and evidence_count, where known) and whether a cap refused any, around what a symbol names."""
    if depth < 0:
        raise ValueError(f"depth must be >= 0, got {depth}")
    spark = graph.entities.sparkSession
    requests = spark.createDataFrame([("q", depth, max_nodes, max_edges, False)], "query_id string, depth int, max_nodes int, max_edges int, reverse boolean")
    predicates = spark.createDataFrame([("q", p, k, False) for k, p in enumerate(relationship_types or [None])], "query_id string, predicate string, pidx int, supplementary boolean")
    nodes, edges, flags = traverse(graph.adjacency, _seeds(graph, symbol), requests, predicates, depth, max_nodes, max_edges)
    key = ["subject", "predicate", "object"]
    ends = edges.select(F.col("subject").alias("node")).distinct()
    stored = graph.adjacency.at(ends).out
    about = [stored[c] for c in ("status", "confidence") if c in stored.columns]
    if "supporting_evidence_ids" in stored.columns:
        about.append((F.size("supporting_evidence_ids") + F.size("contradicting_evidence_ids")).alias("evidence_count"))
    return nodes.select("entity", "distance"), edges.select(*key).join(stored.select(*key, *about), key), flags.first()["truncated"]


class NotFound(LookupError):
    pass


class Conflict(RuntimeError):
    pass


@dataclass
class Job:
    job_id: str
    repository_id: str
    phase: str = "REGISTERED"
    error: str | None = None
    done: threading.Event = field(default_factory=threading.Event)


class Service:
    """Repositories, one running ingestion each, and questions to the graph published last."""

    def __init__(self, spark: SparkSession, ingest):
        """ingest(repository_id, path) publishes a repository and returns (Graph, outcomes)."""
        self.spark, self.ingest, self.lock = spark, ingest, threading.Lock()
        self.paths: dict[str, str] = {}
        self.jobs: dict[str, Job] = {}
        self.graphs: dict[str, Graph] = {}
        self.active: dict[str, Job] = {}

    def register(self, repository_id: str, path: str) -> Job:
        with self.lock:
            if repository_id in self.active:
                raise Conflict(f"an ingestion of {repository_id} is running")
            self.paths[repository_id] = path
            job = Job(uuid.uuid4().hex, repository_id)
            self.jobs[job.job_id] = self.active[repository_id] = job
        threading.Thread(target=self._run, args=(job,), daemon=True).start()
        return job

    def _run(self, job: Job) -> None:
        job.phase = "INGESTING"
        try:
            graph, _ = self.ingest(job.repository_id, self.paths[job.repository_id])
            self.graphs[job.repository_id] = graph
            job.phase = "READY"
        except Exception as e:  # the job tells it
            job.phase, job.error = "FAILED", str(e)
        with self.lock:
            self.active.pop(job.repository_id, None)
        job.done.set()

    def job(self, job_id: str) -> Job:
        if job_id not in self.jobs:
            raise NotFound(f"no job {job_id}")
        return self.jobs[job_id]

    def status(self, repository_id: str) -> dict:
        if repository_id not in self.paths:
            raise NotFound(f"no repository {repository_id}")
        graph = self.graphs.get(repository_id)
        return {"repository_id": repository_id, "phase": "READY" if graph else "REGISTERED", "graph_version": graph and graph.version}

    def _graph(self, repository_id: str) -> Graph:
        self.status(repository_id)
        if repository_id not in self.graphs:
            raise NotFound(f"{repository_id} has no published graph")
        return self.graphs[repository_id]

    def symbols(self, repository_id: str, query: str, limit: int = MOST_SYMBOLS) -> dict:
        graph = self._graph(repository_id)
        return {"center": query, "nodes": [r.asDict() for r in self._named(graph, lookup_symbols(graph, query, limit))], "edges": [], "graph_version": graph.version}

    def neighborhood(self, repository_id: str, symbol: str, **options) -> dict:
        graph = self._graph(repository_id)
        nodes, edges, cut = neighborhood(graph, symbol, **options)
        return {"center": symbol, "nodes": [r.asDict() for r in self._named(graph, nodes)], "edges": [r.asDict() for r in edges.orderBy("subject", "predicate", "object").collect()], "truncated": cut, "graph_version": graph.version}

    @staticmethod
    def _named(graph: Graph, rows: DataFrame) -> list:
        names = graph.entities.select(F.col("canonical_id").alias("entity"), "name", "qualified_name", "base_type")
        return rows.join(names, "entity").orderBy("entity").collect()  # under the caller's cap


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def guarded(self, route) -> None:
            try:
                self.answer(*route())
            except NotFound as e:
                self.answer(404, {"error": str(e)})
            except Conflict as e:
                self.answer(409, {"error": str(e)})
            except (KeyError, ValueError) as e:
                self.answer(400, {"error": str(e)})
            except Exception as e:
                self.answer(500, {"error": str(e)})

        def do_POST(self) -> None:
            def route():
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                if urlparse(self.path).path != "/repositories":
                    raise NotFound(self.path)
                job = service.register(body["repository_id"], body["path"])
                return 202, {"job_id": job.job_id, "phase": job.phase}

            self.guarded(route)

        def do_GET(self) -> None:
            def route():
                at = urlparse(self.path)
                asked, parts = {k: v[0] for k, v in parse_qs(at.query).items()}, at.path.strip("/").split("/")
                if parts[0] == "jobs" and len(parts) == 2:
                    job = service.job(parts[1])
                    return 200, {"job_id": job.job_id, "repository_id": job.repository_id, "phase": job.phase, "error": job.error}
                if parts[0] == "repositories" and parts[-1] == "status":
                    return 200, service.status(parts[1])
                if parts == ["symbols"]:
                    return 200, service.symbols(asked["repository_id"], asked["query"], int(asked.get("limit", MOST_SYMBOLS)))
                if parts == ["neighborhood"]:
                    options = {k: int(asked[k]) for k in ("depth", "max_nodes", "max_edges") if k in asked}
                    if "types" in asked:
                        options["relationship_types"] = asked["types"].split(",")
                    return 200, service.neighborhood(asked["repository_id"], asked["symbol"], **options)
                raise NotFound(at.path)

            self.guarded(route)

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(service: Service, port: int = 0) -> ThreadingHTTPServer:
    """A server on 127.0.0.1; port 0 takes a free one (server_address tells which)."""
    server = ThreadingHTTPServer(("127.0.0.1", port), handler(service))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
