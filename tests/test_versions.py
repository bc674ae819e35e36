"""Versions: batches equal one ingestion, one commit point, only touched buckets are written."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.operators import versions
from lodestone.operators.reconcile import reconcile
from lodestone.operators.traverse import traverse

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
NAMES = [x.split()[0] for x in schema.RELATIONSHIP.split(", ")]


def entities_of(spark, names):
    return spark.createDataFrame([(n, n, f"m::{n}", "FUNCTION", [], n == "n1") for n in names], versions.ENTITY)


def evidence_of(spark, links, start=0):
    rows = [(f"p:r:call:{start + k}", "p", "1", "s", "r", s, p, o, 0.9, NOW, None, None) for k, (s, p, o) in enumerate(links)]
    return spark.createDataFrame(rows, schema.EVIDENCE)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def links():
    r = random.Random(2)
    out = [(f"n{r.randrange(12)}", r.choice(["CALLS", "REFERENCES"]), f"n{r.randrange(14)}") for _ in range(40)]
    return list(dict.fromkeys(out))


def test_two_batches_equal_one(spark, tmp_path, links):
    all_, half = [f"n{k}" for k in range(12)], len(links) // 2  # n12 and n13 stay unknown
    whole = versions.GraphVersions(spark, f"{tmp_path}/one", 8)
    whole.upsert(entities_of(spark, all_), evidence_of(spark, links), NOW, "r:1")
    parts = versions.GraphVersions(spark, f"{tmp_path}/two", 8)
    # The second batch brings the entities that relationships of the first were waiting for, and repeats a record.
    parts.upsert(entities_of(spark, all_[:6]), evidence_of(spark, links[:half]), NOW, "r:1")
    parts.upsert(entities_of(spark, all_[4:]), evidence_of(spark, links[:half][-1:], half - 1).unionByName(evidence_of(spark, links[half:], half)), NOW, "r:2")
    plain = reconcile(evidence_of(spark, links), entities_of(spark, all_), F.lit(NOW).cast("timestamp"))
    assert rows_of(whole.relationships().select(NAMES)) == rows_of(parts.relationships().select(NAMES)) == rows_of(plain.select(NAMES))
    a, b = whole.read(), parts.read()
    assert rows_of(a.edges.select("subject", "predicate", "object", "edge_seq", "pair_seq")) == rows_of(b.edges.select("subject", "predicate", "object", "edge_seq", "pair_seq"))
    seq = {(r.subject, r.predicate, r.object): r.edge_seq for r in a.edges.collect()}
    assert all(links.index(k) == v for k, v in seq.items()) and {e for k in seq for e in (k[0], k[2])} <= set(all_)
    assert a.entities.count() == b.entities.count() == 12 and (a.version, b.version) == ("r:1", "r:2")
    assert parts.read(1).entities.count() == 6 and parts.numbers() == [1, 2]  # the version before is still whole
    seeds = spark.createDataFrame([("q", "n1", 1)], "query_id string, entity string, rank int")
    req = spark.createDataFrame([("q", 1, 5, 4, False)], "query_id string, depth int, max_nodes int, max_edges int, reverse boolean")
    pr = spark.createDataFrame([("q", None, 0, False)], "query_id string, predicate string, pidx int, supplementary boolean")
    assert [rows_of(x) for x in traverse(a.adjacency, seeds, req, pr, 1)] == [rows_of(x) for x in traverse(b.adjacency, seeds, req, pr, 1)]


def test_nothing_of_a_batch_is_broadcast(spark, tmp_path, links, monkeypatch):
    plans, write = [], versions.GraphVersions._write
    monkeypatch.setattr(versions, "keep", lambda df, k=versions.keep: plans.append(df) or k(df))
    monkeypatch.setattr(versions.GraphVersions, "_write", lambda self, at, table, rows, touched: plans.append(rows) or write(self, at, table, rows, touched))
    store = versions.GraphVersions(spark, f"{tmp_path}/g", 4)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen = []
    monkeypatch.setattr(versions.GraphVersions, "_commit", lambda self, new, c=versions.GraphVersions._commit: seen.extend(map(text, plans)) or c(self, new))
    store.upsert(entities_of(spark, ["n1", "n2"]), evidence_of(spark, links), NOW, "r:1")
    assert len(seen) > 5 and not any("BroadcastHashJoin" in p for p in seen)


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path, links):
    store = versions.GraphVersions(spark, f"{tmp_path}/g", 32)
    first = store.upsert(entities_of(spark, [f"n{k}" for k in range(14)]), evidence_of(spark, links), NOW, "r:1")
    second = store.upsert(entities_of(spark, []), evidence_of(spark, [("n1", "CALLS", "n2")], 900), NOW, "r:2")
    changed = {t: sum(a != b for a, b in zip(first.folders[t], second.folders[t], strict=True)) for t in versions.TABLES}
    assert changed == {"entities": 0, "evidence": 1, "relationships": 1, "waiting": 0}
    nothing = store.upsert(entities_of(spark, []), evidence_of(spark, []), NOW, "r:3")
    assert nothing.folders == second.folders and nothing.number == 3


def test_a_failed_publish_leaves_the_version_before(spark, tmp_path, links, monkeypatch):
    store = versions.GraphVersions(spark, f"{tmp_path}/g", 4)
    assert store.read().entities.count() == 0 and store.numbers() == []
    store.upsert(entities_of(spark, ["n1", "n2"]), evidence_of(spark, [("n1", "CALLS", "n2")]), NOW, "r:1")
    with monkeypatch.context() as m:
        m.setattr(versions.GraphVersions, "_commit", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(entities_of(spark, ["n3"]), evidence_of(spark, [("n2", "CALLS", "n3")], 5), NOW, "r:2")
    assert store.numbers() == [1] and store.read().version == "r:1" and store.read().edges.count() == 1
    store.upsert(entities_of(spark, ["n3"]), evidence_of(spark, [("n2", "CALLS", "n3")], 5), NOW, "r:2")
    assert store.read().edges.count() == 2 and store.read(1).edges.count() == 1


def test_of_two_writers_from_one_version_the_second_is_refused(spark, tmp_path):
    store = versions.GraphVersions(spark, f"{tmp_path}/g", 4)
    store.upsert(entities_of(spark, ["n1"]), evidence_of(spark, []), NOW, "r:1")
    late = store.manifest()
    store.upsert(entities_of(spark, ["n2"]), evidence_of(spark, []), NOW, "r:2")
    late.number += 1
    with pytest.raises(versions.Conflict):
        store._commit(late)
    assert store.manifest().label == "r:2"
