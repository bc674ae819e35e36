"""Small tables whose edges dangle."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest

from lodestone.operators import paths, search
from lodestone.plans import catalog, graph_view, retrieval, traversals


@pytest.fixture
def graph(spark, tmp_path):
    def write(**rows):
        kinds = {
            "region": "r_regionkey long",
            "nation": "n_nationkey long, n_regionkey long",
            "customer": "c_custkey long, c_nationkey long",
            "supplier": "s_suppkey long, s_nationkey long",
            "part": "p_partkey long",
            "orders": "o_orderkey long, o_custkey long",
            "lineitem": "l_orderkey long, l_partkey long, l_suppkey long",
        }
        for name, kind in kinds.items():
            spark.createDataFrame(rows.get(name, []), kind).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_known_endpoints_of_dangling_edges(spark, graph):
    # nation 9, customer 8, part 7 and supplier 6 are nowhere
    at = graph(
        region=[(1,)], nation=[(1, 1), (2, 5)], customer=[(1, 1), (2, 2), (3, 9)], supplier=[(1, 1)], part=[(1,), (2,)],
        orders=[(1, 1), (2, 2), (3, 8)], lineitem=[(1, 1, 1), (1, 2, 1), (2, 7, 6), (3, 1, 6), (4, 1, 1)],
    )
    got = {r.predicate: r.n for r in retrieval.known_endpoint_edges(spark, at).collect()}
    # CONTAINS: region 1 - nation 1, nations 1 and 2 - customers 1 and 2, nation 1 - supplier 1
    assert got == {"CONTAINS": 4, "REFERENCES": 2 + 1 + 1, "CALLS": 2, "DEPENDS_ON": 3, "IMPLEMENTS": 2}


def test_transitive_depends_reaches_parts(spark, graph):
    at = graph(
        region=[(1,), (2,)], nation=[(1, 1), (2, 1), (3, 2)], customer=[(1, 1), (2, 3)], supplier=[(1, 2)], part=[(1,), (2,), (3,)],
        orders=[(1, 1), (2, 1), (3, 2)], lineitem=[(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 3, 1)],
    )
    # nations 1 and 2; customer 1 and supplier 1; orders 1 and 2; parts 1 and 2
    assert {r.depth: r.n for r in retrieval.transitive_depends(spark, at).collect()} == {1: 2, 2: 2, 3: 2, 4: 2}


def test_transitive_depends_of_a_long_chain_with_a_cycle(spark, monkeypatch):
    chain = [("region:1", "CONTAINS", "n0")] + [(f"n{i}", "DEPENDS_ON", f"n{i + 1}") for i in range(12)] + [("n12", "CALLS", "n3"), ("n1", "CALLS", "n5"), ("n2", "REFERENCES", "x")]
    monkeypatch.setattr(retrieval, "edges", lambda *_: spark.createDataFrame(chain, "subject string, predicate string, object string"))
    # n5 at depth 3 as n1 calls it, with n2; n3 and n6 at 4, n4 and n7 at 5, then n8 to n12
    assert {r.depth: r.n for r in retrieval.transitive_depends(spark, "").collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2} | dict.fromkeys(range(6, 11), 1)


def bm25_by_hand(docs, query):
    """doc -> raw score of the documents that hold a term of the query."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    corpus = {d: Counter(words(t)) for d, t in docs}
    mean = sum(sum(c.values()) for c in corpus.values()) / len(corpus)
    out = {}
    for d, c in corpus.items():
        size = sum(c.values())
        parts = []
        for w in words(query):
            df = sum(w in x for x in corpus.values())
            if c[w]:
                parts.append(math.log(1 + (len(corpus) - df + 0.5) / (df + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size / mean)))
        if parts:
            out[d] = sum(parts)
    return out


def test_search_equals_scoring_every_document(spark):
    r = random.Random(5)
    pool = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(d, " ".join(r.choices(pool, k=r.randrange(0, 120)))) for d in range(400)] + [(900, None), (901, ""), (902, "only here"), (903, "tied one"), (904, "tied one"), (905, "tied one")]
    df = spark.createDataFrame(docs, "doc long, text string")
    found = search.index(df, block=16)
    texts = {f"q{k}": " ".join(r.choices(pool, k=r.randrange(1, 9))) for k in range(25)} | {"rare": "only", "ties": "tied", "none": "nowhere", "both": "tied w1 w1"}
    asked = spark.createDataFrame([(q, w, n) for q, t in texts.items() for w, n in Counter(t.split()).items()], "query_id string, term string, times long")
    got = {}
    for x in found.top(asked, 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.doc, x.score))
    for q, t in texts.items():
        raw = bm25_by_hand(docs, t)
        best = max(raw.values(), default=0)
        want = sorted((-round(v / best, 9), d) for d, v in raw.items())[:5]
        assert [(d, s) for _, d, s in sorted(got.get(q, []))] == [(d, pytest.approx(-s, abs=2e-9)) for s, d in want], q
    weights = found.weights(asked)
    least = spark.createDataFrame([(q, 0.6 * max(bm25_by_hand(docs, t).values(), default=0)) for q, t in texts.items()], "query_id string, least double")
    above = {(x.query_id, x.doc) for x in found.at_least(weights, least).collect()}
    assert above == {(q, d) for q, t in texts.items() for raw in [bm25_by_hand(docs, t)] for d, v in raw.items() if v >= 0.6 * max(raw.values())}
    # Some blocks are never scored: their bounds stay under the threshold.
    bounds, tops = found.block_bounds(weights), found.at_least(weights, least)
    assert tops.select("query_id").distinct().count() < bounds.count() and bounds.join(least, "query_id").where("bound < least").count() > 50


def test_holders_and_the_first_of_some_documents(spark, monkeypatch):
    monkeypatch.setattr(search, "BITS", 16)
    r = random.Random(4)
    texts = [(k, " ".join(r.choice("abcdefghij") for _ in range(r.randrange(0, 5)))) for k in range(120)]
    found = search.index(spark.createDataFrame(texts, "doc long, text string"), block=8)
    asked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "j", 1), ("q3", "z", 1)], "query_id string, term string, times long")
    some = [k for k in range(120) if k % 3 == 1] + [500]
    docs = spark.createDataFrame([(k,) for k in some + some[:2]], "doc long")
    weights = found.weights(asked)
    terms = {"q1": {"a", "b"}, "q2": {"j"}}
    assert {x.query_id: x.n for x in found.holders(weights, docs).collect()} == {q: sum(bool(w & set(dict(texts).get(k, "").split())) for k in some) for q, w in terms.items()}
    first = {}
    for x in search.ranked(found.scored(weights)).orderBy("rank").collect():
        if x.doc in some:
            first.setdefault(x.query_id, (x.doc, x.rank))
    assert {x.query_id: (x.doc, x["rank"]) for x in found.first_of(asked, docs).collect()} == first


def test_blocks_are_met_before_postings(spark):
    found = search.index(spark.createDataFrame([(k, "a b") for k in range(9)], "doc long, text string"), block=2)
    weights = found.weights(spark.createDataFrame([("q", "a", 1)], "query_id string, term string, times long"))
    rows = found.scored(weights, spark.createDataFrame([("q", 1), ("q", 1)], "query_id string, block long"))
    assert {x.doc for x in rows.collect()} == {2, 3}
    assert "LeftSemi" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_traces_of_the_report_hold_what_metrics_look_at(spark):
    from lodestone.plans import questions

    traces = questions._traces(spark, "/root/testdata/sf0.001")
    assert max(r["count"] for r in traces.groupBy("query_id").count().collect()) <= retrieval.TOP + 1


def test_search_of_nothing(spark):
    found = search.index(spark.createDataFrame([], "doc long, text string"))
    assert found.top(spark.createDataFrame([("q", "a", 1)], "query_id string, term string, times long"), 3).count() == 0


def test_the_tables_ask_questions_that_touch_every_rule():
    import duckdb

    from lodestone.plans import questions

    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    hit = con.sql(f"WITH {questions._understood_sql()} SELECT k, count(*) FROM cand GROUP BY 1").fetchall()
    assert {k for k, _ in hit} == set(range(22))


def test_metrics_of_claims_rank_nothing_and_the_report_ranks_once(spark, monkeypatch):
    from lodestone.plans import questions, retrieval

    made, ranking = [], retrieval.ranking
    monkeypatch.setattr(retrieval, "ranking", lambda *a: made.append(a) or ranking(*a))
    sf = "/root/testdata/sf0.001"
    questions.claim_accuracy(spark, sf).collect()
    questions.abstention_precision(spark, sf).collect()
    assert not made
    assert questions.metric_report(spark, sf).count() == 9 and len(made) == 1


ODD = [None, -1, -12, 0, 1, 2, 9, 10, 100, 19, 10**15 - 1, 10**15, 10**18]


@pytest.mark.parametrize("keys", [ODD, ODD[3:11]])  # with and without keys that the packed form has no room for
def test_first_edge_by_names(spark, graph, keys):
    rng = random.Random(5)
    pick = lambda n, k: [tuple(rng.choice(keys) for _ in range(k)) for _ in range(n)]
    at = graph(nation=pick(6, 2), customer=pick(20, 2), supplier=pick(10, 2), orders=pick(20, 2), lineitem=pick(60, 3))
    found = retrieval.structural_first_edge(spark, at)
    got = {tuple(r) for r in found.select("node", "subject", "predicate", "object").collect()}
    first, order = {}, lambda e: tuple((x is not None, x or "") for x in e)
    for r in retrieval.edges(spark, at).collect():
        e = (r.subject, r.predicate, r.object)
        for node in (e[0], e[2]):
            first[node] = min(first.get(node, e), e, key=order)
    assert got == {(n, *e) for n, e in first.items()}
    if None not in keys:  # longs are compared, which needs no sorted groups of texts
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_known_endpoints_are_compared_by_number(spark, graph):
    at = graph(region=[(1,)], nation=[(1, 1)])
    assert "concat" not in retrieval.known_endpoint_edges(spark, at)._jdf.queryExecution().optimizedPlan().toString()


def test_predicates_shown_by_a_few_rows_or_by_all(spark, graph, monkeypatch):
    at = graph(region=[(1,)], nation=[(1, 1)], customer=[(1, 9), (2, 1)], supplier=[(1, 9)], part=[(1,)], orders=[(1, 7)], lineitem=[(1, 1, 1), (5, 5, 5)])
    known = [(f"{k}:{n}", f"{k}{n}") for k, n in (("region", 1), ("nation", 1), ("customer", 1), ("customer", 2), ("supplier", 1), ("part", 1), ("order", 1))]
    read = graph_view.Reported(spark, at, spark.createDataFrame(known, "key string, canonical_id string")).predicates
    want = {"CONTAINS", "REFERENCES", "DEPENDS_ON", "IMPLEMENTS"}
    assert {r[0] for r in read().collect()} == want
    monkeypatch.setattr(graph_view, "WITNESSES", 0)
    assert {r[0] for r in read().collect()} == want
    assert "Exchange" not in read()._jdf.queryExecution().executedPlan().toString()


def test_claims_of_one_edge_are_not_searched(spark, graph, monkeypatch):
    # customers 1 and 2 share an id; customer 8 and order 5 are nowhere
    at = graph(customer=[(1, 1), (2, 1), (3, 1)], orders=[(1, 1), (2, 3), (3, 2), (4, 8)])
    known = [("customer:1", "c"), ("customer:2", "c"), ("customer:3", "d"), *((f"order:{k}", f"o{k}") for k in range(1, 5))]
    named = graph_view.Reported(spark, at, spark.createDataFrame(known, "key string, canonical_id string"))
    monkeypatch.setattr(traversals, "graph", lambda *_: SimpleNamespace(adjacency=named))
    for name in ("_ahead", "_back"):
        monkeypatch.setattr(paths, name, lambda *_: pytest.fail("searched"))
    monkeypatch.setattr(paths, "CLAIMS_A_PART", 2)
    got = {r.claim_id: (r.method, r.hops) for r in traversals.entail_path(spark, at).collect()}
    yes, no = ("PATH_EXISTENCE", 1), ("NONE", 0)
    assert got == {"customer:1>order:1": yes, "customer:1>order:2": no, "customer:3>order:2": yes, "customer:3>order:3": no, "customer:2>order:3": yes, "customer:2>order:4": no}


def test_one_subject_of_many_claims_is_searched_from(spark, monkeypatch):
    edges = [("r", "CONTAINS", f"n{k}") for k in range(5)] + [(f"n{k % 5}", "CONTAINS", f"c{k}") for k in range(40)]
    claims = [(f"c{k}", "r", "CONTAINS", f"c{k}") for k in range(50)]
    monkeypatch.setattr(paths, "_back", lambda *_: pytest.fail("searched from the objects"))
    found = paths.reached_paths(spark.createDataFrame(edges, "subject string, predicate string, object string"), spark.createDataFrame(claims, "claim_id string, subject string, predicate string, object string"))
    assert {r.claim_id: r.path for r in found.collect()} == {f"c{k}": [f"n{k % 5}", f"c{k}"] for k in range(40)}


def test_co_change_tasks_grow_in_number(spark, graph, monkeypatch):
    at = graph(lineitem=[(k // 3, k, 1) for k in range(300)])
    monkeypatch.setattr(catalog, "LINES_A_TASK", 10)
    assert "30" in re.findall(r"hashpartitioning\(a#\d+L, b#\d+L, (\d+)\)", catalog.co_change_pairs(spark, at)._jdf.queryExecution().executedPlan().toString())
    assert catalog.co_change_pairs(spark, at).count() == 300
