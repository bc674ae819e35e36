"""Sources, ingestion, stores, streams and the service on small files."""

import json
import random
import subprocess
import urllib.error
import urllib.request
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.operators.ingest import Ingestion, Registry
from lodestone.operators.reconcile import reconcile
from lodestone.operators.stores import ArtifactConflict, ArtifactStore, EvidenceStore, TelemetryStore
from lodestone.service import Service, serve
from lodestone.sources import git, manifest, pycalls, sarif, scopes, symbols
from lodestone.sources.contract import Cohort, ExtractionError, Provider, Repository
from lodestone.streaming import evidence, telemetry


def normal(spark, provider, repository):
    cohort, payload = provider.extract(spark, repository, list(provider.capabilities))
    return provider.normalize(spark, repository, cohort, payload)


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for files in ({"a.py": "x = 1\n" * 30, "b.py": "y\n"}, {"a.py": "x = 2\n" * 30, "b.py": "z\n"}):
        for name, text in files.items():
            (tmp_path / name).write_text(text)
        run("add", "-A")
        run("commit", "-qm", "m")
    run("mv", "a.py", "c.py")
    (tmp_path / "b.py").unlink()
    (tmp_path / "d.py").write_text("new\n")
    run("add", "-A")
    run("commit", "-qm", "m")
    return Repository("r", str(tmp_path), git.head(str(tmp_path)))


def test_git(spark, repo):
    found = normal(spark, git.GitProvider(), repo)
    assert {r.qualified_name: r.lifecycle_status for r in found.entities.collect()} == {"c.py": "RENAMED", "b.py": "DELETED", "d.py": "ACTIVE"}
    ids = {git.canonical_id_of("r", repo.head_revision, "FILE", p): p for p in ("a.py", "b.py", "c.py", "d.py")}
    pairs = {(ids[r.subject], ids[r.object]): (r.evidence_id.rsplit(":", 1)[1], r.confidence) for r in found.evidence.collect()}
    assert pairs == {("a.py", "b.py"): ("0", 2 / 3), ("b.py", "c.py"): ("1", 1 / 3), ("b.py", "d.py"): ("2", 1 / 3), ("c.py", "d.py"): ("3", 1 / 3)}
    changes = {(r.path, r.change) for r in git.changeset(spark, repo, f"{repo.head_revision}~1", repo.head_revision).collect()}
    assert changes == {("c.py", "renamed"), ("b.py", "deleted"), ("d.py", "added")}
    cohort, _ = git.GitProvider(timeout=0.0).extract(spark, repo, ["HISTORY"])
    assert cohort.failed == ["HISTORY"] and cohort.coverage_status == "PARTIAL"
    assert not git.GitProvider().eligible(Repository("r", "/", "x"))
    with pytest.raises(ExtractionError):
        git.GitProvider().extract(spark, Repository("r", repo.path, "nope"), ["HISTORY"])


def test_manifest(spark, tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project]\ndependencies = ["six>=1", "Foo.bar[x]; python_version>\'3\'", "-bad", "six"]\n[project.optional-dependencies]\ndev = ["pytest ~= 8"]\n')
    found = normal(spark, manifest.ManifestProvider(), Repository("r", str(tmp_path), "v"))
    assert sorted(r.qualified_name for r in found.entities.where("base_type = 'EXTERNAL_LIBRARY'").collect()) == ["pypi:Foo.bar", "pypi:pytest", "pypi:six"]
    assert [r.evidence_id for r in found.evidence.orderBy("evidence_id").collect()] == [f"manifest:v:dependency:{k}" for k in range(3)]
    (tmp_path / "pyproject.toml").write_text("not = [toml")
    with pytest.raises(ExtractionError):
        manifest.ManifestProvider().extract(spark, Repository("r", str(tmp_path), "v"), ["DEPENDENCY"])


def test_sarif(spark, tmp_path):
    at = lambda uri, line=None, index=None: {"physicalLocation": {"artifactLocation": {k: v for k, v in (("uri", uri), ("index", index)) if v is not None}, "region": {"startLine": line} if line else {}}}
    flow = lambda *places: {"codeFlows": [{"threadFlows": [{"locations": [{"location": p} for p in places]}]}]}
    good = {"tool": {"driver": {"name": "t", "rules": [{"id": "r1", "defaultConfiguration": {"level": "error"}}]}}, "artifacts": [{"location": {"uri": "src/art.js"}}], "results": [
        {"ruleId": "r1", **flow(at("src/a.js", 1), at("x", 2), at("src/db.js", 9))}, {"ruleId": "r2", "level": "note", **flow(at("src/a.js", 1), at(None, 2, 0))},
        {"ruleId": "r3", **flow(at("s.js", 1), at("s.js", 1)), "locations": [at("s.js", 1)]}, {"ruleId": "r4", "locations": [at("bad uri")]}, {"locations": [at("y.js")]},
    ]}
    (tmp_path / "results.sarif").write_text(json.dumps({"runs": [good, {"results": 5}]}))
    provider = sarif.SarifProvider()
    found = normal(spark, provider, Repository("r", str(tmp_path), "v"))
    names = {r.canonical_id: r.qualified_name for r in found.entities.collect()}
    assert found.cohort.partial == ["DATA_FLOW"]
    assert sorted((names[r.subject], names[r.object], r.confidence) for r in found.evidence.collect()) == [("src/a.js", "src/art.js", 0.4), ("src/a.js", "src/db.js", 1.0)]
    assert {r.qualified_name: r.roles for r in found.entities.collect()}["s.js"] == ["finding:r3"]
    (tmp_path / "results.sarif").write_text('{"runs": []}')
    assert normal(spark, provider, Repository("r", str(tmp_path), "v")).cohort.successful == ["DATA_FLOW"]


def test_python_calls(spark, tmp_path):
    files = {
        "src/pkg/__init__.py": "", "src/pkg/util.py": "def help():\n    pass\ndef other():\n    help()\n", "broken.py": "def (", "venv/x.py": "def v(): pass", "env/pyvenv.cfg": "", "env/y.py": "def w(): pass",
        "src/pkg/main.py": "from pkg.util import help as h\nfrom . import util\nimport pkg.util as u\nimport os as o\nclass A:\n    def run(self):\n        self.step()\n        h()\n        o.getcwd()\n    def step(self):\n        util.other()\n        u.help()\ndef top():\n    def inner():\n        help2()\n    top()\n    missing()\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert pycalls.source_files(str(tmp_path)) == ["broken.py", "src/pkg/__init__.py", "src/pkg/main.py", "src/pkg/util.py"]
    assert pycalls.absolute("a.b.c", 1, "x") == "a.b.x" and pycalls.absolute("a", 3, "x") is None and pycalls.module_keys("src/p/q.py") == ["src.p.q", "p.q"]
    found = normal(spark, pycalls.PythonCallsProvider(), Repository("r", str(tmp_path), "v"))
    names = {r.canonical_id: r.qualified_name for r in found.entities.collect()}
    m, t = "src/pkg/main.py::", "src/pkg/util.py::"
    got = {(names[r.subject], names[r.object]) for r in found.evidence.collect()}
    assert got == {(m + "A.run", m + "A.step"), (m + "A.run", t + "help"), (m + "A.step", t + "help"), (m + "top", m + "top"), (t + "other", t + "help")} | {(m + "A.step", t + "other")}
    place = {r.qualified_name: r.source_location for r in found.entities.collect()}[m + "A.step"]
    assert (place.file_path, place.start_line, place.end_line) == ("src/pkg/main.py", 9, 11)


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(n, value):
    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(n << 3 | 2) + varint(len(value)) + value


def occurrence(symbol, roles, *place):
    return field(2, field(1, b"".join(map(varint, place))) + field(2, symbol) + field(3, roles))


def test_symbol_index(spark, tmp_path):
    s = lambda d, version="v": f"scip-python python pkg {version} {d}"
    info = lambda symbol, kind=0, *rel: field(3, field(1, symbol) + b"".join(field(4, r) for r in rel) + field(5, kind))
    base, sub, run = s("`pkg.m`/Base#"), s("`pkg.m`/Sub#"), s("`pkg.m`/Sub#run().")
    doc = field(1, "pkg/m.py") + occurrence(base, 1, 0, 6, 10) + occurrence(sub, 1, 5, 6, 5, 9) + occurrence(run, 1, 6, 8, 11) + occurrence(run, 8, 20, 8, 11) + occurrence(run, 8, 90, 8, 11)
    doc += occurrence("local 3", 1, 7, 0, 1) + occurrence(s("os/path#", "3.1"), 0, 1, 0, 2) + occurrence(s("`sys`/x.", "3.1"), 2, 2, 0, 2) + occurrence(s("`pkg.m`/Ghost#"), 0, 3, 0, 2)
    doc += info(base, 7) + info(sub, 0, field(1, base) + field(3, 1)) + info(run) + info(run)
    (tmp_path / "index.scip").write_bytes(field(2, doc))
    found = normal(spark, symbols.SymbolIndexProvider(), Repository("r", str(tmp_path), "v"))
    rows = {r.qualified_name: r for r in found.entities.collect()}
    assert {k: r.base_type for k, r in rows.items()} == {"`pkg.m`/Base#": "CLASS", "`pkg.m`/Sub#": "CLASS", "`pkg.m`/Sub#run().": "METHOD", "python:pkg@3.1": "EXTERNAL_LIBRARY", "`pkg.m`/Ghost#": "CLASS", "pkg/m.py": "FILE"}
    assert rows["`pkg.m`/Base#"].roles == ["scip:Class"] and rows["`pkg.m`/Ghost#"].roles == ["scip:inferred-from-relationship-only"]
    assert rows["`pkg.m`/Sub#run()."].source_location.start_line == 20  # the last of its family; line 90 is too far
    names = {r.canonical_id: q for q, r in rows.items()}
    got = {(names[r.subject], r.predicate, names[r.object]) for r in found.evidence.collect()}
    assert got == {("`pkg.m`/Sub#", "IMPLEMENTS", "`pkg.m`/Base#"), ("pkg/m.py", "REFERENCES", "python:pkg@3.1"), ("pkg/m.py", "IMPORTS", "python:pkg@3.1"), ("pkg/m.py", "REFERENCES", "`pkg.m`/Ghost#"), ("pkg/m.py", "REFERENCES", "`pkg.m`/Sub#run().")}
    for bad in (b"\x00\x01", b"\x0a\x05ab", b"\x0f", b"\x08" + b"\xff" * 10):
        with pytest.raises(ValueError):
            list(symbols.fields(bad))


NESTED_SOURCE = """class A:
    def one(self):
        def helper(): ...
        def index():
            def inner(): ...
    async def two(self):
        def helper(): ...
        def index():
            def inner(): ...
    def helper(self): ...
def again(): ...
def again(): ...
"""


def scoped_index(source, symbol):
    """Every def and class of a source as a definition; a function's descriptor names the class around it, no function."""
    rows, owner = b"", ""
    for at, text in enumerate(source.splitlines()):
        name = text.split("(")[0].split(":")[0].split()[-1]
        if text.startswith(("class ", "def ")):
            owner = name + "#" if text.startswith("class ") else ""
        descriptor = f"`pkg.m`/{owner}" + ("" if text.startswith("class ") else f"{name}().")
        column = text.index(name + (":" if text.startswith("class ") else "("))
        rows += occurrence(symbol(descriptor), 1, at, column, column + len(name))
    return rows


def test_scopes_that_share_a_descriptor(spark, tmp_path):
    s = lambda d: f"scip-python python pkg v {d}"
    doc = field(1, "pkg/m.py") + scoped_index(NESTED_SOURCE, s)
    doc += occurrence(s("`pkg.m`/A#helper()."), 0, 40, 0, 1) + occurrence(s("`pkg.m`/again()."), 0, 41, 0, 1)
    other = field(1, "pkg/n.py") + occurrence("local 1", 0, 1, 0, 1)
    index = field(1, field(2, field(1, "tool") + field(2, "7"))) + field(2, doc) + field(2, other)
    (tmp_path / "index.scip").write_bytes(index)
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/m.py").write_text(NESTED_SOURCE)
    provider = symbols.SymbolIndexProvider()
    found = normal(spark, provider, Repository("r", str(tmp_path), "v"))
    rows = {r.qualified_name: r for r in found.entities.collect()}
    m = "`pkg.m`/A#"
    want = {m: 0, m + "one().": 1, m + "one().<locals>.A#helper().": 2, m + "one().<locals>.A#index().": 3, m + "one().<locals>.A#index().<locals>.A#inner().": 4}
    want |= {m + "two().": 5, m + "two().<locals>.A#helper().": 6, m + "two().<locals>.A#index().": 7, m + "two().<locals>.A#index().<locals>.A#inner().": 8}
    want |= {m + "helper().": 9, "`pkg.m`/again().": 10}  # a method is told by its class; again() is one thing in one scope
    assert {k: r.source_location.start_line for k, r in rows.items() if k != "pkg/m.py"} == want
    assert {k for k, r in rows.items() if r.roles == ["scip:nested-scope-disambiguated"]} == {k for k in want if "<locals>" in k} | {m + "helper()."}
    assert "pkg/n.py" not in rows and provider.version == "tool@7"  # a file without references is no end of an edge
    names = {r.canonical_id: q for q, r in rows.items()}
    assert {(names[r.subject], names[r.object]) for r in found.evidence.collect()} == {("pkg/m.py", "`pkg.m`/again().")}  # which helper is meant cannot be told


def test_scope_of_a_place_against_a_backward_search():
    draw = random.Random(5)
    for _ in range(300):
        rows = []
        for line in range(draw.randint(0, 14)):
            kind = draw.choice(["f().", "g().", "C#", "x."])
            rows.append(("p", kind, kind, line, 0, line, 1, draw.randint(0, 4), kind != "x.", draw.random() < 0.8))
        places = pd.DataFrame(rows, columns=[c.split()[0] for c in scopes.PLACES.split(", ")])
        identity, want = {}, {}  # line: (symbol, identity of the scope around)
        for p in places.itertuples():
            around = next((identity[q.line] for q in reversed(list(places.itertuples())) if q.line < p.line and q.opens and q.indent < p.indent), None)
            identity[p.line] = (p.symbol, around)
            if p.defines and around:
                want.setdefault(p.symbol, {})[around] = p.line
        got = scopes.nested(places)
        assert sorted(zip(got["symbol"], got["line"], strict=True)) == sorted((k, line) for k, by in want.items() if len(by) > 1 for line in by.values())


def test_scopes_without_a_source(tmp_path):
    place = symbols.Source(tmp_path, "../outside.py")
    assert place.lines is None and place.indent(3, 7) == 7 and not place.declares(3, 7)
    (tmp_path / "a.py").write_text("async def f(x: C): ...\n")
    known = symbols.Source(tmp_path, "a.py")
    assert known.indent(0, 10) == 0 and known.declares(0, 10) and not known.declares(0, 15) and not known.declares(9, 0)


def test_ranges_of_occurrences():
    one, many = field(1, 3) + field(2, 4) + field(3, 9), field(1, 3) + field(2, 4) + field(3, 5)
    ranges = [field(9, many + field(4, 6)) + field(8, one), field(8, one) + field(1, b"\x01\x02\x03"), field(8, field(3, 2)), b""]
    document = field(2, field(1, "p") + b"".join(field(2, r) for r in ranges))
    assert [o[3] for o in symbols.read_index(document)[1]] == [(3, 4, 5, 6), (3, 4, 3, 9), (0, 0, 0, 2), None]
    for bad in (b"", field(2, field(4, "py")), field(2, field(1, "p") + field(2, field(1, b"\x01\x02"))), field(2, field(1, "p") + field(3, field(5, 7)))):
        with pytest.raises(ValueError):
            symbols.read_index(bad)


class Fake(Provider):
    capabilities = ("DEPENDENCY",)

    def __init__(self, name, fault=None):
        self.name, self.fault = name, fault

    def eligible(self, repository):
        return self.fault != "ineligible"

    def extract(self, spark, repository, capabilities):
        if self.fault == "extract":
            raise ExtractionError(self.name, "TIMEOUT", "slow")
        return Cohort("other" if self.fault == "cohort" else self.name, "1", repository.head_revision, ["DEPENDENCY"]), None

    def normalize(self, spark, repository, cohort, payload):
        found = manifest.ManifestProvider().normalize(spark, repository, cohort, ["six"])
        if self.fault == "late":  # shows only when the rows are computed
            found.evidence = found.evidence.withColumn("confidence", F.raise_error(F.lit("late")).cast("double"))
        return found


def test_ingestion_isolates_faults(spark):
    registry = Registry()
    for name, fault in (("good", None), ("slow", "extract"), ("wrong", "cohort"), ("late", "late"), ("off", "ineligible")):
        registry.register(Fake(name, fault), (0.5, 0.5))
    graph, outcomes = Ingestion(spark, registry).run(Repository("r", "/", "v"), now=datetime(2026, 8, 31))
    got = {r.provider_name: r for r in outcomes.collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "COMMITTED", "slow": "FAILED", "wrong": "FAILED", "late": "FAILED", "off": "SKIPPED"}
    assert got["slow"].failure_reason == "TIMEOUT" and got["off"].detail == "DEPENDENCY: INELIGIBLE" and (got["good"].entities_upserted, got["good"].evidence_upserted) == (2, 1)
    assert graph.version == "r:v:good=1.0.0" and graph.entities.count() == 2
    assert [(r.predicate, r.status) for r in graph.edges.collect()] == [("DEPENDS_ON", "SUPPORTED")]


def test_ingesting_twice_changes_nothing(spark, repo):
    registry = Registry()
    registry.register(git.GitProvider(), (1.0, 0.5))
    ingestion = Ingestion(spark, registry)
    first, _ = ingestion.run(repo)
    again, _ = ingestion.run(repo)
    assert first.version == again.version and first.entities.count() == again.entities.count() and first.edges.count() == again.edges.count() == 3  # a.py is unknown: its pair is left out


def test_stores(spark, tmp_path):
    put = lambda *rows: spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "reference string, content binary")
    artifacts = ArtifactStore(spark, f"{tmp_path}/a")
    artifacts.put(put(("x", b"1"), ("x", b"1"), ("y", b"2")))
    artifacts.put(put(("x", b"1")))
    assert artifacts.read().count() == 2 and artifacts.read(reference="y").first().content == b"2"
    for bad in (put(("x", b"3")), put(("z", b"1"), ("z", b"2"))):
        with pytest.raises(ArtifactConflict):
            artifacts.put(bad)
    evidence = EvidenceStore(spark, f"{tmp_path}/e")
    row = ("e1", "p", "1", "s", "v", "a", "CALLS", "b", 0.5, datetime(2026, 1, 1), None, None)
    for _ in range(2):
        evidence.add(spark.createDataFrame([row, row], schema.EVIDENCE))
    assert evidence.read(predicate="CALLS", object=None).count() == 1 and evidence.read(subject="b").count() == 0
    store, at = TelemetryStore(spark, f"{tmp_path}/t"), datetime(2026, 1, 1)
    ident = store.record_query(at, "q", "r", "v", candidate_count=3)
    assert ident == store.record_query(at, "q", "r", "v") and store.queries.read(query_id="q").count() == 2
    store.record_mismatch(at, ValueError("moved"), "r", "q")
    assert store.failures.read(code="CONCURRENT_UPDATE_DETECTED").first().detail == "moved"


def test_streams_go_on_where_they_ended(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts", "id % 3 AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    rows(0, 100).write.parquet(f"{tmp_path}/events.parquet")
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    run = lambda: telemetry.drain(telemetry.hourly(telemetry.events(spark, str(tmp_path))), "complete", check, out)
    assert sum(r.n for r in run().collect()) == 100
    rows(100, 150).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert sum(r.n for r in run().collect()) == 150
    rows(140, 160).write.mode("append").parquet(f"{tmp_path}/events.parquet")  # repeats ten events
    assert telemetry.stream_dedupe(spark, str(tmp_path)).count() == 160


def test_history_keeps_what_a_window_can_need():
    draw = random.Random(3)
    for _ in range(300):
        entries = [(seq, draw.randint(0, 40)) for seq in range(draw.randint(0, 40))]
        cut = draw.randint(0, len(entries))
        kept = telemetry.latest(telemetry.latest(entries[:cut], 4) + entries[cut:], 4)
        for now in range(0, 60, 7):
            last = lambda rows, now=now: sorted((e for e in rows if now - e[1] <= 12), reverse=True)[:4]
            assert last(kept) == last(entries)
    assert len(telemetry.latest([(k, k) for k in range(1000)], 10)) == 10


def test_history_goes_on_where_it_ended(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 2) AS ts", "if(id % 7 = 0, null, id % 3) AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    run = lambda: telemetry.drain_history(telemetry.history(telemetry.events(spark, str(tmp_path)).selectExpr("user_id AS repository_id", "event_id AS seq", "ts AS observed_at")), f"{tmp_path}/check", f"{tmp_path}/out")
    want = lambda n: {(k, i) for k in range(3) for i in [i for i in range(n) if i % 3 == k and i % 7][-10:]}
    rows(0, 100).write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.repository_id, r.seq) for r in run().collect()} == want(100)
    rows(100, 130).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert {(r.repository_id, r.seq) for r in run().collect()} == want(130)


def test_evidence_stream_equals_one_reconciliation(spark, tmp_path):
    at, draw = datetime(2026, 8, 31), random.Random(2)
    row = lambda k: (f"e{k}", f"p{k % 3}", "1", "s", "v", f"n{draw.randint(0, 4)}", "CALLS", f"n{draw.randint(0, 6)}", draw.random(), at, None, None)
    first, second = [row(k) for k in range(30)], [row(k) for k in range(30, 60)]
    second += [first[0], (*row(60)[:8], 1.5, *row(60)[9:])]  # one is known, one breaks a rule
    entities = spark.createDataFrame([(f"n{k}",) for k in range(6)], "canonical_id string")  # n6 is unknown
    now, plain = F.lit(at).cast("timestamp"), lambda df: sorted(df.select(*schema_names).collect())
    schema_names = [x.split()[0] for x in schema.RELATIONSHIP.split(", ")]
    for known, rows in ((first, first), (first + second[:30], second)):
        spark.createDataFrame(rows, schema.EVIDENCE).write.mode("append").parquet(f"{tmp_path}/in")
        got = evidence.reconcile_stream(evidence.evidence_stream(spark, f"{tmp_path}/in"), entities, now, f"{tmp_path}/work")
        assert plain(got) == plain(reconcile(spark.createDataFrame(known, schema.EVIDENCE), entities, now))
    assert [(r.evidence_id, r.broken_rules) for r in spark.read.parquet(f"{tmp_path}/work/rejected").collect()] == [("e60", ["confidence"])]


def test_service(spark, repo):
    registry = Registry()
    registry.register(git.GitProvider(), (1.0, 0.5))
    ingestion = Ingestion(spark, registry)
    service = Service(spark, lambda name, path: ingestion.run(Repository(name, path, git.head(path))))
    server = serve(service)
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode() if body else None), timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    code, job = call("/repositories", {"repository_id": "r", "path": repo.path})
    assert code == 202
    busy, _ = call("/repositories", {"repository_id": "r", "path": repo.path})
    assert busy == 409
    assert service.job(job["job_id"]).done.wait(120) and call(f"/jobs/{job['job_id']}")[1]["phase"] == "READY"
    assert call("/repositories/r/status")[1]["graph_version"].startswith("r:")
    assert [n["name"] for n in call("/symbols?repository_id=r&query=c.py")[1]["nodes"]] == ["c.py"]
    code, around = call("/neighborhood?repository_id=r&symbol=c.py&depth=1")
    assert code == 200 and {n["name"] for n in around["nodes"]} == {"b.py", "c.py", "d.py"} and len(around["edges"]) == 2 and not around["truncated"]
    assert all(e["status"].endswith("SUPPORTED") and e["evidence_count"] == 1 and 0 < e["confidence"] <= 1 for e in around["edges"]), around["edges"]
    by_id = next(n["entity"] for n in around["nodes"] if n["name"] == "c.py")
    assert len(call(f"/neighborhood?repository_id=r&symbol={by_id}")[1]["nodes"]) == 3
    assert [call(p)[0] for p in ("/symbols?query=x", "/jobs/none", "/nowhere", "/neighborhood?repository_id=r&symbol=c.py&depth=-1")] == [400, 404, 404, 400]
    server.shutdown()
