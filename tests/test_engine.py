"""Rules of the engine against hand-computed values, and traversal against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import identity, matching, scoring
from lodestone.operators import coverage, evaluate, planner, reconcile, registry, resolve, verify
from lodestone.operators.graph import Graph, find_entities, neighbors, publish
from lodestone.operators.targets import resolve_targets
from lodestone.operators import adjacency
from lodestone.operators.adjacency import store
from lodestone.operators.ordinals import numbered
from lodestone.operators import target_index
from lodestone.operators.paths import reached_paths
from lodestone.operators.traverse import expand_for_location, traverse
from lodestone.operators.understand import contract_table, session_weights, understand

NOW = datetime(2026, 8, 31)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_identity(spark):
    want = identity.canonical_id_of("r", "v", "FILE", "a/b.py")
    assert want == "lode:" + __import__("hashlib").sha256(b"r|v|FILE||a/b.py").hexdigest()[:32]
    assert one(spark, identity.canonical_id(*map(F.lit, ("r", "v", "FILE", "a/b.py")))) == want
    for raw, plain in (("././a//b", "a/b"), ("/a/b", "a/b"), ("\\a\\b", "a/b"), ("a/../b", "a/../b")):
        assert one(spark, identity.normalized_path(F.lit(raw))) == plain
    assert identity.version_id("r", "v", {"b": "2", "a": "1"}) == "r:v:a=1,b=2" and identity.version_id("r", "v", {}) == "r:v"


def test_match_tiers(spark):
    rows = [
        ("Storage#", "`pkg.store`/Storage#", "storage", 0), ("add().", "`m`/add().", "add", 0), ("AddHelper", "m.py::AddHelper", "add", 1), ("_is_bool", "src/approx.py::_is_bool", "approx", 2),
        ("SubclassableObject", "a.py::SubclassableObject", "classab", 2), ("test_add", "t.py::test_add", "add", 1), ("NATION_10", "EUROPE/NATION_10", "nation_1", 1), ("x", "EUROPE/NATION_1/Customer#1", "nation_1", 2),
    ]
    df = spark.createDataFrame(rows, "n string, q string, t string, want int")
    for r in df.select("*", matching.tier(F.col("n"), F.col("q"), F.col("t")).alias("got")).collect():
        assert r.got == r.want, r


def test_targets_by_name_path_and_qualifier(spark):
    rows = [("1", "send().", "`django.dispatch`/Signal#send()."), ("2", "send", "mail.py::Mailer.send"), ("3", "send_robust", "x.py::Signal.send_robust"), ("4", "auth.py", "src/auth.py"), ("5", "resend", "y.py::resend"), ("6", "login", "src/auth.py::login")]
    e = spark.createDataFrame(rows, "canonical_id string, name string, qualified_name string")
    ask = lambda t: [r.entity for r in resolve_targets(e, spark.createDataFrame([("q", t)], "query_id string, target string")).orderBy("rank").collect()]
    assert ask("send") == ["1", "2", "3"]  # buried `resend` goes
    assert ask("Signal.send") == ["1", "3"]  # confirmed by the qualifier, the exact name first
    assert ask("Nobody.send") == ["1", "2", "3"]  # a qualifier that confirms nothing changes nothing
    assert ask("auth.py") == ["4"] and ask("nothing") == []


def test_reconciliation(spark):
    ev = lambda i, o, provider, c, age, group=None: (i, provider, "1", "s", "v", "a", "CALLS", o, c, NOW - timedelta(hours=age), group, None)
    support = [ev("e1", "b", "p", 0.9, 0), ev("e2", "c", "p", 0.4, 0), ev("e3", "c", "q", 0.5, 0), ev("e4", "d", "p", 0.9, 24), ev("e5", "x", "p", 0.9, 0), ev("e6", "f", "p", 0.4, 0, ""), ev("e7", "f", "p", 0.3, 0), ev("e8", "g", "p", 0.4, 0), ev("e9", "h", "p", 0.9, 0)]
    against = [ev("n1", "g", "q", 0.6, 0), ev("n2", "h", "q", 0.3, 0), ev("n3", "i", "q", 0.9, 0)]
    entities = spark.createDataFrame([(x,) for x in "abcdfghi"], "canonical_id string")
    got = {r.object: r for r in reconcile.reconcile(spark.createDataFrame(support, schema.EVIDENCE), entities, F.lit(NOW).cast("timestamp"), spark.createDataFrame(against, schema.EVIDENCE)).collect()}
    want = {"b": ("SUPPORTED", 0.9, 0.0), "c": ("SUPPORTED", 0.7, 0.0), "d": ("WEAKLY_SUPPORTED", 0.45, 0.0), "x": ("UNRESOLVED", 0.0, 0.0), "f": ("WEAKLY_SUPPORTED", 0.4, 0.0), "g": ("CONTRADICTED", 0.4 * 0.4, 0.6), "h": ("DISPUTED", 0.9 * 0.75, 0.25), "i": ("UNSUPPORTED", 0.0, 1.0)}
    assert {k: (r.status, pytest.approx(r.confidence), pytest.approx(r.contradiction_score)) for k, r in got.items()} == want
    assert got["g"].supporting_evidence_ids == ["e8"] and got["g"].contradicting_evidence_ids == ["n1"]


def test_freshness_and_scores(spark):
    at = lambda h: F.lit(NOW - timedelta(hours=h)).cast("timestamp")
    now = F.lit(NOW).cast("timestamp")
    assert [one(spark, scoring.freshness(a, now)) for a in (F.lit(None).cast("timestamp"), at(-5), at(0), at(24), at(48))] == [0.0, 1.0, 1.0, 0.5, 0.25]
    assert one(spark, scoring.ambiguity(F.array(F.lit(0.97), F.lit(0.35)))) == pytest.approx(0.35 / 0.97)
    assert one(spark, scoring.node_ceiling(F.lit(4000))) == 80 and one(spark, scoring.edge_ceiling(F.lit(9000))) == 250 and one(spark, scoring.node_ceiling(F.lit(49))) == 0
    assert [one(spark, scoring.contradiction_level(F.lit(x))) for x in (0.0, 0.39, 0.4, 0.6, 0.61)] == ["NONE", "WEAK", "INTERMEDIATE", "INTERMEDIATE", "SIGNIFICANT"]
    providers = spark.createDataFrame([("a", ["HISTORY"], True, True, "HEALTHY", 1.0, NOW, 0.8, 0.5), ("b", ["HISTORY"], True, True, "DEGRADED", 1.0, NOW, 0.9, 0.5), ("c", ["HISTORY"], False, True, "HEALTHY", 1.0, NOW, None, None)], "provider string, capabilities array<string>, valid boolean, eligible boolean, health string, availability double, freshness timestamp, evidence_quality double, cost_factor double")
    assert {r.provider: r.status for r in registry.evaluate(providers).collect()} == {"a": "AVAILABLE", "b": "PARTIAL", "c": "FAILED"}
    assert [(r.provider, r.score) for r in registry.rank(providers, now).orderBy("rank").collect()] == [("b", pytest.approx(0.93)), ("a", pytest.approx(0.91))]
    with pytest.raises(Exception, match="no score profile"):
        registry.rank(providers.withColumn("evidence_quality", F.lit(None).cast("double")), now).collect()


def test_checks_split_rows(spark):
    good = ("e", "p", "1", "s", "v", "a", "CALLS", "b", 0.5, NOW, None, "file://x")
    rows = spark.createDataFrame([good, (*good[:8], 1.5, *good[9:]), (*good[:6], "LIKES", *good[7:11], "ftp://x")], schema.EVIDENCE)
    fine, bad = schema.split_valid(rows, "evidence")
    assert fine.count() == 1 and sorted(r.broken_rules for r in bad.collect()) == [["confidence"], ["predicate", "raw_reference"]]


def test_index_names_all_that_hold_a_lookup(spark, monkeypatch):
    r = random.Random(8)
    text = lambda: "".join(r.choices("abAB.é", k=r.randrange(0, 9)))
    rows = [(f"e{k}", text(), f"{text()}::{text()}") for k in range(300)] + [("none", None, "x::aab")]
    entities = spark.createDataFrame(rows, "canonical_id string, name string, qualified_name string")
    lookups = ["a", "ab", "é.", "aba", "abab", "zzz", "bé.a", "", "aaaaaaaa", ".", "ba.ab"]
    asked = spark.createDataFrame([("q", x) for x in lookups] + [("p", "aba")], "query_id string, lookup string")
    symbol = {x.canonical_id: x.s for x in entities.select("canonical_id", F.lower(matching.symbol_path(F.col("qualified_name"))).alias("s")).collect()}
    want = {(q, x, i) for q, x in [*(("q", x) for x in lookups), ("p", "aba")] if x for i, n, _ in rows if x in (n or "").lower() or x in symbol[i]}
    holds = F.contains(F.lower("name"), F.col("lookup")) | F.contains(F.lower(matching.symbol_path(F.col("qualified_name"))), F.col("lookup"))
    stored, loose = target_index.index(entities), target_index.index(entities, stored=False)
    for built in (stored, loose):
        got = built.candidates(asked)
        assert {(x.query_id, x.lookup, x.canonical_id) for x in got.where(holds).collect()} == want
        assert got.count() == got.distinct().count() and "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    monkeypatch.setattr(target_index, "LITERALS", 1)
    assert stored.candidates(asked).where(holds).count() == len(want)
    ask = spark.createDataFrame([("q", "ab"), ("q", "x.aab")], "query_id string, target string")
    assert sorted(map(tuple, resolve_targets(stored, ask).collect())) == sorted(map(tuple, resolve_targets(entities, ask).collect()))


def plain_walk(edges, seeds, preds, depth, max_nodes, max_edges, reverse, extra):
    """The traversal as a loop over one query: edges is a list of (s, p, o) in the order of their commits.

    Adjacency as dictionaries that remember insertion: node -> other end -> predicates.
    """
    directional = ("CALLS", "IMPLEMENTS")
    ahead, back = ({n: {} for n in sorted({x for s, _, o in edges for x in (s, o)})} for _ in range(2))
    for s, p, o in edges:
        ahead[s].setdefault(o, []).append(p)
        back[o].setdefault(s, []).append(p)
    out_of = lambda n, p: [(n, q, o) for o, qs in ahead.get(n, {}).items() for q in qs if p is None or p == q]
    into = lambda n, p: [(s, q, n) for s in ahead for q in ahead[s].get(n, []) if p is None or p == q]
    by_insertion = lambda n, p: [(s, q, n) for s, qs in back.get(n, {}).items() for q in qs if p is None or p == q]
    seen, kept, cut, frontier = dict.fromkeys(seeds, 0), [], False, list(seeds)

    def collect(found):
        nonlocal cut
        for e in found:
            if e not in kept:
                if len(kept) >= max_edges:
                    cut = True
                else:
                    kept.append(e)

    def visit(names, level, into_list):
        nonlocal cut
        for n in names:
            if n not in seen:
                if len(seen) >= max_nodes:
                    cut = True
                else:
                    seen[n] = level
                    into_list.append(n)

    for level in range(depth):
        nxt = []
        for n in frontier:
            for p in preds or [None]:
                d = p in directional
                if not d or reverse:
                    collect(out_of(n, p))
                if not d or (not reverse and n in seeds):
                    collect(into(n, p))
            for side in (0, 1):
                for p in preds or [None]:
                    found = out_of(n, p) if side == 0 else by_insertion(n, p)
                    visit([e[2] if side == 0 else e[0] for e in found], level + 1, nxt)
        frontier = nxt
    for p in extra:
        for n in seeds:
            collect(out_of(n, p))
            collect(into(n, p))
        for side in (0, 1):
            for n in seeds:
                found = out_of(n, p) if side == 0 else by_insertion(n, p)
                visit([e[2] if side == 0 else e[0] for e in found], 1, [])
    nodes = {k: seen[k] for k in sorted(seen)[:max_nodes]}
    return nodes, sorted(kept), cut


def test_traversal_equals_a_plain_loop(spark, monkeypatch):
    r = random.Random(4)
    preds = ["CALLS", "CONTAINS", "IMPLEMENTS", "REFERENCES"]
    edges = sorted({(f"n{r.randrange(14)}", r.choice(preds), f"n{r.randrange(14)}") for _ in range(60)})
    r.shuffle(edges)
    df = spark.createDataFrame([(*e, k) for k, e in enumerate(edges)], "subject string, predicate string, object string, edge_seq long").withColumn("pair_seq", F.expr("min(edge_seq) over (partition by subject, object)"))
    stored = store(df)
    asked = []
    for k in range(60):
        seeds = r.sample([f"n{i}" for i in range(14)], r.choice([1, 2, 3]))
        asked.append((f"q{k}", seeds, r.sample(preds, r.choice([0, 1, 2, 3])), r.choice([0, 1, 2]), r.choice([2, 4, 8, 50]), r.choice([1, 3, 10, 50]), r.random() < 0.4, r.sample(preds, r.choice([0, 0, 1, 2]))))
    seeds = spark.createDataFrame([(q, s, i) for q, ss, *_ in asked for i, s in enumerate(ss)], "query_id string, entity string, rank int")
    req = spark.createDataFrame([(q, d, n, e, v) for q, _, _, d, n, e, v, _ in asked], "query_id string, depth int, max_nodes int, max_edges int, reverse boolean")
    pr = spark.createDataFrame([(q, p, i, False) for q, _, ps, *_ in asked for i, p in enumerate(ps or [None])] + [(a[0], p, i, True) for a in asked for i, p in enumerate(a[7])], "query_id string, predicate string, pidx int, supplementary boolean")
    nodes, kept, flags = (x.collect() for x in traverse(stored, seeds, req, pr, 2, 50, 50))
    plain = traverse(df, seeds, req, pr, 2, 50, 50)  # the same edges, not stored in two orders
    assert sorted(map(tuple, plain[0].collect())) == sorted(map(tuple, nodes)) and sorted(map(tuple, plain[1].collect())) == sorted(map(tuple, kept))
    monkeypatch.setattr(adjacency, "LITERALS", 3)  # frontiers that are joined
    joined = traverse(stored, seeds, req, pr, 2, 50, 50)
    assert sorted(map(tuple, joined[0].collect())) == sorted(map(tuple, nodes)) and sorted(map(tuple, joined[2].collect())) == sorted(map(tuple, flags))
    cuts = 0
    for q, ss, ps, d, n, e, v, extra in asked:
        want = plain_walk(edges, ss, ps, d, n, e, v, extra)
        got = {x.entity: x.distance for x in nodes if x.query_id == q}, sorted((x.subject, x.predicate, x.object) for x in kept if x.query_id == q), next(x.truncated for x in flags if x.query_id == q)
        assert got == want, (q, ss, ps, d, n, e, v, extra)
        cuts += want[2]
    assert 5 < cuts < 55


def test_ordinals_follow_the_order_over_many_partitions(spark):
    rows = [(random.Random(k).randrange(50), k) for k in range(3000)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", F.desc("b")], "n", start=5, partitions=13).collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.n)] == sorted(rows, key=lambda x: (x[0], -x[1])) and sorted(x.n for x in got) == list(range(5, 3005))
    assert numbered(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_levels_read_buckets_and_never_deal_edges(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "EDGES_A_BUCKET", 50)
    edges = spark.range(2000).select(F.concat(F.lit("n"), F.col("id") % 97).alias("subject"), F.when(F.col("id") % 2 == 0, "CALLS").otherwise("CONTAINS").alias("predicate"), F.concat(F.lit("n"), F.col("id") % 89).alias("object"), F.col("id").alias("edge_seq"), F.col("id").alias("pair_seq"))
    both = store(edges)
    nodes = spark.createDataFrame([("n1",), ("n2",)], "node string")
    near = both.at(nodes, ["CALLS"])
    assert near.out.count() == edges.where("subject IN ('n1', 'n2') AND predicate = 'CALLS'").count() and near.into.count() == edges.where("object IN ('n1', 'n2') AND predicate = 'CALLS'").count()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan reads the same buckets, but does not show them
    for df, end in ((near.out, "subject"), (near.into, "object")):
        plan = plan_of(df)
        assert "SelectedBucketsCount: 2 out of 40" in plan and "PartitionFilters: [isnotnull(predicate" in plan and f"PushedFilters: [In({end}" in plan and "Exchange" not in plan
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    monkeypatch.setattr(adjacency, "LITERALS", 1)
    near = both.at(nodes)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(nodes.join(near.out, F.col("node") == F.col("subject")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the nodes alone


def test_traversals_leave_one_table_behind(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    g = small_graph(spark)
    before = set(os.listdir(folder))
    seeds = spark.createDataFrame([("q", "id_authenticate", 1)], "query_id string, entity string, rank int")
    req = spark.createDataFrame([("q", 2, 50, 50, False)], "query_id string, depth int, max_nodes int, max_edges int, reverse boolean")
    traverse(g.adjacency, seeds, req, spark.createDataFrame([("q", None, 0, False)], "query_id string, predicate string, pidx int, supplementary boolean"), 2)
    assert len(set(os.listdir(folder)) - before) == 1


def shortest(edges, s, p, o):
    """The first of the shortest paths from s to o, level by level over whole paths."""
    level, seen = [(s, ())], set()
    while level:
        level = sorted((n, (*path, n)) for at, path in level for a, q, n in edges if a == at and q == p and n not in seen)
        level = sorted({n: path for n, path in sorted(level, key=lambda x: x[1], reverse=True)}.items(), key=lambda x: x[1])
        seen |= {n for n, _ in level}
        for n, path in level:
            if n == o:
                return list(path)
    return None


def test_paths_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr("lodestone.operators.paths.JOINS", 2)
    r = random.Random(3)
    edges = sorted({(f"n{r.randrange(25)}", r.choice(["CALLS", "DEPENDS_ON"]), f"n{r.randrange(25)}") for _ in range(70)} | {(f"c{k}", "CALLS", f"c{k + 1}") for k in range(9)} | {("loop", "CALLS", "loop")})
    names = [f"n{k}" for k in range(25)]
    asked = [(f"{s}{p}{o}", s, p, o) for s in names for o in r.sample(names, 8) for p in ("CALLS", "DEPENDS_ON")]
    asked += [(f"self{n}", n, "CALLS", n) for n in names] + [("chain", "c0", "CALLS", "c9"), ("loop", "loop", "CALLS", "loop"), ("gone", "nowhere", "CALLS", "n1"), ("away", "n1", "CALLS", "nowhere"), ("alone", "c9", "CALLS", "c9")]
    want = {i: path for i, s, p, o in asked if (path := shortest(edges, s, p, o))}
    df = spark.createDataFrame(edges, "subject string, predicate string, object string")
    claims = spark.createDataFrame(asked, "claim_id string, subject string, predicate string, object string")
    got = reached_paths(df, claims).collect()
    assert {x.claim_id: x.path for x in got} == want and all(x.hops == len(x.path) for x in got) and len(got) == len(want)
    assert "chain" in want and "loop" in want and 50 < len(want) < len(asked) - 20
    assert {x.claim_id for x in reached_paths(df, claims, most_hops=2).collect()} == {i for i, path in want.items() if len(path) <= 2}
    assert reached_paths(df, claims.where("false")).count() == 0


def test_paths_and_expansion(spark):
    edges = spark.createDataFrame([("a", "CALLS", "b"), ("b", "CALLS", "c"), ("c", "CALLS", "a"), ("a", "CALLS", "d"), ("d", "CALLS", "c"), ("c", "DEPENDS_ON", "e")], "subject string, predicate string, object string").withColumns({"edge_seq": F.lit(0).cast("long"), "pair_seq": F.lit(0).cast("long")})
    asked = spark.createDataFrame([("1", "a", "CALLS", "c"), ("2", "a", "CALLS", "a"), ("3", "a", "CALLS", "e"), ("4", "c", "DEPENDS_ON", "e")], "claim_id string, subject string, predicate string, object string")
    assert {r.claim_id: r.path for r in reached_paths(edges, asked).collect()} == {"1": ["b", "c"], "2": ["b", "c", "a"], "4": ["e"]}
    entities = spark.createDataFrame([(x, x == "e") for x in "abcde"], "canonical_id string, located boolean")
    ranked = spark.createDataFrame([("q", "a", 1)], "query_id string, entity string, rank int")
    found, partial = expand_for_location(edges, entities, ranked)
    assert {r.entity for r in found.collect()} == set("abcde") and not partial.first().partial
    found, partial = expand_for_location(edges, entities, ranked, cycles=1)
    assert {r.entity for r in found.collect()} == set("abcd") and partial.first().partial


def test_merge_fold(spark):
    place = ("m.py", 4, 6, None, None)
    row = lambda i, name, q, kind, roles, loc, status, ids, k: (i, "r", "v", name, q, kind, None, roles, loc, status, ids, k)
    rows = [row("z", "add().", "`m`/add().", "FUNCTION", ["scip:Function"], place, "ACTIVE", {"s": "add()."}, 0), row("y", "add", "m.py::add", "FUNCTION", [], place, "ACTIVE", {"p": "add", "s": "old"}, 1), row("f1", "a.py", "./src//a.py", "FILE", ["x"], None, "ACTIVE", {}, 2), row("f2", "a.py", "src/a.py", "FILE", ["y", "x"], None, "DELETED", {}, 3), row("lib", "six", "pypi:six", "EXTERNAL_LIBRARY", [], None, "ACTIVE", {}, 4)]
    entities, merges = resolve.resolve_entities(spark.createDataFrame(rows, schema.ENTITY + ", ordinal int"))
    by = {r.base_type: r for r in entities.collect()}
    assert by["FUNCTION"].name == "add" and by["FUNCTION"].provider_ids == {"p": "add", "s": "old"} and by["FUNCTION"].roles == ["scip:Function"]  # `y` sorts first and is the base
    assert by["FILE"].qualified_name == "src/a.py" and by["FILE"].lifecycle_status == "DELETED" and by["FILE"].roles == ["x", "y"]
    assert by["EXTERNAL_LIBRARY"].canonical_id == "lib"
    assert sorted((r.reason, len(r.source_canonical_ids)) for r in merges.collect()) == [("EXACT_CANONICAL_ID", 1), ("NORMALIZED_PATH_IDENTITY", 2), ("SYMBOL_LOCATION_IDENTITY", 2)]


def test_understanding_and_sessions(spark):
    asked = spark.createDataFrame([("1", "  Who   calls order_1 "), ("2", "why does a_b call c_d"), ("3", "hello"), ("4", "who calls x")], "query_id string, text string")
    got = {r.query_id: r for r in understand(asked, contract_table(spark)).collect()}
    assert (got["1"].status, got["1"].intent, got["1"].targets, got["1"].relationship_types) == ("RESOLVED", "FIND_CALLERS", ["order_1"], ["CALLS", "IMPORTS", "REFERENCES"])
    assert got["1"].complexity == pytest.approx(0.25 / 5 + 0.15 / 5) and got["4"].targets == [] and got["2"].status == got["3"].status == "SLM_UNAVAILABLE"

    def slm(rows):
        return rows.select("query_id", F.lit("TRACE_EXECUTION").alias("intent"), F.array(F.lit("a_b")).alias("targets"), F.array(F.lit("CALLS")).alias("relationship_types"), F.lit(0.0).alias("ambiguity"), F.lit("NONE").alias("temporal"), F.lit(0.5).alias("reasoning"), F.when(F.col("query_id") == "2", 0.6).otherwise(0.4).alias("confidence"))

    got = {r.query_id: r for r in understand(asked, contract_table(spark), slm).collect()}
    assert got["2"].status == "RESOLVED" and got["2"].complexity == pytest.approx(0.05 + 0.03 + 0.05 + 0.05) and got["3"].status == "LLM_ESCALATION_REQUIRED"
    history = spark.createDataFrame([("r", k, NOW - timedelta(minutes=40 - 3 * k)) for k in range(14)], "repository_id string, seq int, observed_at timestamp")
    weights = {r.seq: r.weight for r in session_weights(history, F.lit(NOW).cast("timestamp")).collect()}
    assert sorted(weights) == list(range(4, 14)) and weights[13] == 1.0 and weights[8] == 0.5


def small_graph(spark):
    kinds = {"test_valid_login": "FUNCTION", "test_invalid_login": "FUNCTION", "authenticate": "FUNCTION", "AuthService": "CLASS", "AuthService.check": "METHOD"}
    entities = spark.createDataFrame([(f"id_{n}", n, f"auth.py::{n}", k, [], False) for n, k in kinds.items()], "canonical_id string, name string, qualified_name string, base_type string, roles array<string>, located boolean")
    links = [("test_valid_login", "CALLS", "authenticate"), ("test_invalid_login", "CALLS", "authenticate"), ("AuthService", "CONTAINS", "AuthService.check"), ("AuthService", "CALLS", "nowhere")]
    return publish(entities, spark.createDataFrame([(f"id_{s}", p, f"id_{o}") for s, p, o in links], "subject string, predicate string, object string"), "r:v")


def test_question_to_answer(spark):
    g = small_graph(spark)
    assert g.edges.count() == 3 and neighbors(g, "id_authenticate", "in").count() == 2 and find_entities(g, "auth", base_type="CLASS").count() == 1
    with pytest.raises(ValueError):
        neighbors(g, "id_authenticate", "up")
    asked = spark.createDataFrame([("q", "Which tests call authenticate?"), ("n", "what calls check_nothing")], "query_id string, text string")
    contracts = understand(asked, contract_table(spark)).withColumns({"completeness": F.lit(""), "constraints": F.array().cast("array<string>")})
    outcomes = spark.createDataFrame([("p", "1", "COMMITTED", ["CALL_RELATIONSHIP"], ["CALL_RELATIONSHIP"], [], [], "FULL", None, None, 5, 3)], schema.OUTCOME)
    plans = planner.plan(g, contracts, outcomes)
    rows = {r.query_id: r for r in plans.rows.collect()}
    assert rows["q"].status == "OK" and rows["q"].intent == "FIND_TESTS" and not rows["q"].negative_candidate
    assert rows["n"].negative_candidate and rows["n"].negative_result == "NO_EVIDENCE_FOUND" and rows["n"].n_seeds == 0
    got = planner.execute(g, plans)
    assert {r.entity for r in got.entities.collect()} == {"id_authenticate", "id_test_valid_login", "id_test_invalid_login"} and got.edges.count() == 2
    assert {r.query_id: r.limitations for r in got.rows.collect()} == {"q": [], "n": ["negative_query_result=NO_EVIDENCE_FOUND"]}
    with pytest.raises(planner.VersionMismatch):
        planner.execute(Graph(g.entities, g.edges, "r:w"), plans)
    cache = planner.PlanCache()
    cache.put("r:v", rows["q"].query_identity, rows["q"].asDict())
    assert cache.get("r:v", rows["q"].query_identity)["cache_hit"] and cache.get("r:w", rows["q"].query_identity) is None


def test_verification_and_final_answer(spark):
    edges = spark.createDataFrame([("a", "CALLS", "b", 0.0, ["e1", "e2"]), ("b", "CALLS", "c", 0.5, ["e3"]), ("a", "CALLS", "x", 0.7, ["e4"]), ("a", "CALLS", "y", 0.0, ["gone"])], "subject string, predicate string, object string, contradiction_score double, supporting_evidence_ids array<string>")
    ev = lambda i, g: (i, "p", "1", "s", "v", "a", "CALLS", "b", 0.8, NOW, g, None)
    evidence = spark.createDataFrame([ev("e1", "g1"), ev("e2", "g1"), ev("e3", "g2"), ev("e4", None)], schema.EVIDENCE)
    covered = spark.createDataFrame([("A", "COMPLETE"), ("B", "PARTIAL")], "capability string, coverage string")
    claims = spark.createDataFrame([("direct", "a", "CALLS", "b"), ("path", "a", "REACHES", "c"), ("bad", "a", "CALLS", "x"), ("bare", "a", "CALLS", "y"), ("none", "c", "CALLS", "a")], "claim_id string, subject string, predicate string, object string")
    got = {r.claim_id: r for r in verify.verify_claims(claims, edges, evidence, covered, F.lit(NOW).cast("timestamp")).collect()}
    d = got["direct"]
    assert (d.method, d.evidence_support, d.evidence_quality, d.evidence_independence, d.coverage, d.status) == ("DIRECT_EDGE", 1.0, 0.8, 0.5, 0.75, "VERIFIED")
    assert d.confidence == pytest.approx(0.35 + 0.2 * 0.8 + 0.15 * 0.5 + 0.1 * 0.75 + 0.1 + 0.1)
    assert got["path"].method == "PATH_EXISTENCE" and got["path"].evidence_support == 0.75 and got["path"].contradiction_level == "INTERMEDIATE"
    assert got["bad"].status == "DISPUTED" and got["bad"].confidence <= 0.5
    assert (got["bare"].evidence_support, got["bare"].coverage, got["bare"].status) == (1.0, 0.0, "INCONCLUSIVE") and got["none"].status == "INCONCLUSIVE"
    made = iter([verify.Generation("MALFORMED_OUTPUT"), verify.Generation("OK", "text", [{"subject": "a", "predicate": "CALLS", "object": "x"}, {"subject": "a", "predicate": "CALLS", "object": "b"}])])
    told = []
    done = verify.verification_loop(spark, lambda f: (told.append(f), next(made))[1], lambda c: verify.verify_claims(c, edges, evidence, covered, F.lit(NOW).cast("timestamp")))
    assert (done.outcome, done.attempts, len(done.retained), len(done.removed)) == ("RESOLVED", 2, 1, 1) and told[0] is None and told[1]
    assert verify.verification_loop(spark, lambda f: verify.Generation("TIMEOUT"), None).failure_reason == "generation_status=TIMEOUT"
    rows = [("1", "a", "P", "b", "VERIFIED", False), ("2", "a", "P", "b", "VERIFIED", False), ("2", "a", "P", "c", "DISPUTED", True), ("3", "a", "P", "b", "INCONCLUSIVE", False), ("4", "a", "P", "b", "VERIFIED", False), ("4", "a", "P", "c", "INCONCLUSIVE", False), ("5", "a", "P", "c", "DISPUTED", True)]
    queries = spark.createDataFrame([(str(k), k == 6, {7: "NO_EVIDENCE_FOUND", 8: "INCONCLUSIVE"}.get(k)) for k in range(1, 9)], "query_id string, failed boolean, negative string")
    final = {r.query_id: (r.decision, r.verification_status) for r in verify.answers(spark.createDataFrame(rows, "query_id string, subject string, predicate string, object string, status string, removed boolean"), queries).collect()}
    assert final == {"1": ("STRONG_ANSWER", "VERIFIED"), "2": ("QUALIFIED_ANSWER", "QUALIFIED"), "3": ("ABSTAIN", "INCONCLUSIVE"), "4": ("QUALIFIED_ANSWER", "PARTIALLY_VERIFIED"), "5": ("QUALIFIED_ANSWER", "DISPUTED"), "6": ("ABSTAIN", "REJECTED"), "7": ("STRONG_ANSWER", "VERIFIED"), "8": ("ABSTAIN", "INCONCLUSIVE")}
    claims, bad = verify.parse_claims(spark.createDataFrame([("1", '{"explanation":"e","claims":[{"subject":"a","predicate":"CALLS","object":"b","claim_type":"FACT"}]}'), ("2", '{"claims":[{"subject":"a","predicate":"LIKES","object":"b"}]}'), ("3", "no")], "answer_id string, json string"))
    assert [r.answer_id for r in claims.collect()] == ["1"] and sorted(r.answer_id for r in bad.collect()) == ["2", "3"]


def test_coverage_and_metrics(spark):
    rows = [("a", "1", "COMMITTED", ["X", "Y"], ["X"], ["Y"], [], "PARTIAL", None, None, 1, 0), ("b", "1", "COMMITTED", ["Y", "Z"], ["Y", "Z"], [], [], "FULL", None, None, 0, 0), ("c", "1", "SKIPPED", ["W"], [], [], [], None, None, None, 0, 0)]
    asked = spark.createDataFrame([(c,) for c in "WXYZV"], "capability string")
    got = coverage.capability_coverage(spark.createDataFrame(rows, schema.OUTCOME), asked)
    assert {r.capability: r.coverage for r in got.collect()} == {"W": "UNAVAILABLE", "X": "COMPLETE", "Y": "EMPTY_SUCCESS", "Z": "EMPTY_SUCCESS", "V": "NOT_SUPPORTED"}
    assert not coverage.exhaustive(got).first()[0] and coverage.exhaustive(got.where("false")).first()[0]
    telemetry = spark.createDataFrame([("e1", "q1", "v", "VERIFIED"), ("e2", "q2", "v", "REJECTED"), ("e3", "q3", "w", "REJECTED"), ("e4", "q4", "v", None)], "event_id string, query_id string, graph_version_id string, verification_result string")
    labels = spark.createDataFrame([("q1", "VERIFIED", False, ["a", "b"]), ("q2", "VERIFIED", True, []), ("q3", None, False, ["a"]), ("q4", "VERIFIED", None, None)], "query_id string, expected_verification_status string, should_abstain boolean, relevant array<string>")
    traces = spark.createDataFrame([("q1", "v", "c", 1), ("q1", "v", "a", 2), ("q2", "v", "a", 1), ("q3", "v", "a", 1)], "query_id string, graph_version_id string, entity string, rank int")
    full = {r.metric: (r.value, r.sample_size, r.reason) for r in evaluate.report(telemetry, labels, traces).collect()}
    assert full["PRECISION_AT_10"] == (0.05, 2, None) and full["RECALL_AT_10"] == (0.5, 1, None) and full["MRR"] == (0.25, 2, None)
    assert full["CLAIM_VERIFICATION_ACCURACY"] == (0.5, 2, None) and full["ABSTENTION_PRECISION"] == (0.5, 2, None) and full["TOKEN_EFFICIENCY"][2] == "UNDEFINED_FORMULA"
    assert [r.metric for r in evaluate.report(telemetry).collect()] == list(schema.METRICS)
    assert {r.reason for r in evaluate.report(telemetry).collect()} == {"MISSING_TELEMETRY_DATA", "UNDEFINED_FORMULA", "MISSING_GROUND_TRUTH"}


def test_edges_read_from_tables_equal_all_edges_and_are_not_stored(spark, monkeypatch):
    from lodestone import storage
    from lodestone.plans import graph_view

    written = []
    monkeypatch.setattr(graph_view, "keep", lambda df, *a: written.append(df.columns) or storage.keep(df, *a))
    monkeypatch.setattr(graph_view, "_PUBLISHED", {})
    sf = "/root/testdata/sf0.001"
    g = graph_view.graph(spark, sf)
    assert written == [g.entities.columns]  # the entities alone
    every = sorted((r.subject, r.predicate, r.object) for r in g.edges.collect())
    keyed = {r.key: r.canonical_id for r in g.entities.select("key", "canonical_id").collect()}
    raw = [(keyed.get(r.subject), r.predicate, keyed.get(r.object)) for r in graph_view.edges(spark, sf).collect()]
    assert every == sorted(x for x in raw if None not in x)
    nodes = [keyed[k] for k in ("nation:3", "customer:1", "supplier:2", "part:5", "region:0")]
    for most in (2000, 2):  # nodes that are listed, and nodes that are joined
        monkeypatch.setattr(adjacency, "LITERALS", most)
        for predicates in (None, ["REFERENCES"]):
            near = g.adjacency.at(spark.createDataFrame([(n,) for n in nodes], "node string"), predicates)
            fits = [x for x in every if predicates is None or x[1] in predicates]
            assert sorted((r.subject, r.predicate, r.object) for r in near.out.collect()) == [x for x in fits if x[0] in nodes]
            assert sorted((r.subject, r.predicate, r.object) for r in near.into.collect()) == [x for x in fits if x[2] in nodes]


def test_few_lookups_read_the_names_and_many_go_by_the_index(spark, monkeypatch):
    rows = [(f"id_{k}", f"Name_{k}", f"a/b::name_{k % 3}") for k in range(40)]
    names = target_index.Names(spark.createDataFrame(rows, "canonical_id string, name string, qualified_name string"))
    asked = [("1", "name_1"), ("2", "e_2"), ("3", "zz"), ("4", ""), ("5", "name_1")]
    ask = spark.createDataFrame(asked, "query_id string, target string")
    few = sorted(map(tuple, resolve_targets(names, ask).collect()))
    assert few and not names.made
    monkeypatch.setattr(target_index, "SCANNED", 1)
    assert sorted(map(tuple, resolve_targets(names, ask).collect())) == few and names.made


def test_rules_run_once_a_question(spark):
    from lodestone.operators.understand import RULES, contract_table, understand

    asked = spark.createDataFrame([("a", "Who calls  order_1?"), ("b", "nothing"), ("c", None)], "query_id string, text string").repartition(2)
    rows = understand(asked, contract_table(spark))
    plan = rows.where("status = 'RESOLVED'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(RULES[0][1]) <= 3  # its own match and target, and the last rule's look at it
    assert {r.query_id: (r.status, r.targets) for r in rows.collect()} == {"a": ("RESOLVED", ["order_1"]), "b": ("SLM_UNAVAILABLE", None), "c": ("SLM_UNAVAILABLE", None)}


def test_levels_over_tables_delete_what_they_wrote(spark):
    import os

    from lodestone.plans import graph_view

    g = graph_view.graph(spark, "/root/testdata/sf0.001")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    seeds = g.entities.where("name = 'EUROPE'").select(F.lit("q").alias("query_id"), F.col("canonical_id").alias("entity"), F.lit(1).alias("rank"))
    req = spark.createDataFrame([("q", 2, 50, 50, False)], "query_id string, depth int, max_nodes int, max_edges int, reverse boolean")
    nodes, _, _ = traverse(g.adjacency, seeds, req, spark.createDataFrame([("q", None, 0, False)], "query_id string, predicate string, pidx int, supplementary boolean"), 2)
    assert nodes.count() > 10 and len(set(os.listdir(folder)) - before) == 1


def test_expansion_meets_entities_where_they_lie(spark, monkeypatch):
    from lodestone import storage
    from lodestone.operators import traverse as walks

    plans = []
    monkeypatch.setattr(walks, "keep", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or storage.keep(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([("a", "CALLS", "b"), ("b", "CALLS", "c")], "subject string, predicate string, object string").withColumns({"edge_seq": F.lit(0).cast("long"), "pair_seq": F.lit(0).cast("long")})
        entities = storage.keep(spark.createDataFrame([(x, x == "c") for x in "abc"], "canonical_id string, located boolean"))
        found, partial = expand_for_location(edges, entities, spark.createDataFrame([("q", "a", 1)], "query_id string, entity string, rank int"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.entity for r in found.collect()} == set("abc") and not partial.first().partial
    assert any("located" in p for p in plans) and not any("SortMergeJoin [other#" in p for p in plans)


def test_what_few_lookups_find_is_dealt_twice_and_sorted_once(spark):
    rows = [(f"id_{k}", f"order_{k}", f"orders/{k % 5}::order_{k}") for k in range(300)]
    entities = spark.createDataFrame(rows + rows[:9], "canonical_id string, name string, qualified_name string")  # some are listed twice
    ask = spark.createDataFrame([("1", "order_1"), ("2", "orders.order_12"), ("3", "rder_2"), ("4", "nothing")], "query_id string, target string")
    got = resolve_targets(target_index.Names(entities), ask)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, resolve_targets(entities, ask).collect()))
    of = lambda q: {r.entity for r in got.where(F.col("query_id") == q).collect()}
    assert of("1") == {"id_1", *(f"id_{k}" for k in range(300) if str(k).startswith("1"))} - {f"id_{k}" for k in range(300) if not str(k).startswith("1")}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count(" Window [") <= 2  # whether a qualifier confirms, and the rank


def test_claims_are_matched_once(spark):
    from lodestone import storage

    claims = storage.keep(spark.createDataFrame([("1", "a", "CALLS", "b"), ("2", "a", "CALLS", "z")], "claim_id string, subject string, predicate string, object string"))
    edges = spark.createDataFrame([("a", "CALLS", "b", 0.0, ["e1", "e2"])], "subject string, predicate string, object string, contradiction_score double, supporting_evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "p", 0.5, NOW, "g"), ("e2", "p", 1.0, NOW, "g")], "evidence_id string, provider string, confidence double, freshness timestamp, independence_group string")
    covered = spark.createDataFrame([("c", "COMPLETE")], "capability string, coverage string")
    rows = verify.verify_claims(claims, edges, evidence, covered, F.lit(NOW).cast("timestamp"))
    got = {r.claim_id: (r.method, r.evidence_quality, r.evidence_independence) for r in rows.collect()}
    assert got == {"1": ("DIRECT_EDGE", 0.75, 0.5), "2": ("NONE", 0.0, 0.0)}
    assert not any(claims._lodestone_kept.rpartition("/")[2] in f for f in rows.inputFiles())  # what matched is written, and not matched anew for each use
