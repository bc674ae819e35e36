"""Operators 11 to 13: the divergence audit, centroid clustering and language-model scoring."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestone.llm import clusters, divergence, lm, queries, scoring
from lodestone.llm.common import cut_words, tokenizer_path

TABLES = "/root/testdata/sf0.001"


def as_rows(df):
    return Counter(map(tuple, df.collect()))


def twin(name, **tables):
    c = duckdb.connect()
    for k, v in tables.items():
        c.register(k, v)
    return c.sql(queries.oracle_sql()[name])


# --- source divergence


def audit_by_hand(rows, least=10):
    """The contract's rules over Python counters."""
    term = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(lang or "", source or "", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) for text, lang, source in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = [w.decode() for w in term.findall(text)]
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang})

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, part, item.decode(), -value, rank) for part, found in (("pair", pairs), ("term", terms)) for rank, (value, item) in enumerate(found, 1)]
    return Counter(out)


def test_audit_equals_direct_counts(spark):
    r = random.Random(11)
    pool = ["the", "Of", "été", "straße", "a1b", "x_y", "end.", "Ünder", "日本", "plain"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(r.choices(pool, k=r.randrange(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "é", None, "Z"])) for _ in range(400)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("!!", "yy", "a"), (None, "yy", "b")] + [("the the été", "en", "s1")] * 30
    docs = spark.createDataFrame([(t, lang, s, 1, "t") for t, lang, s in rows], "text string, lang string, source string, count int, term string")
    assert as_rows(divergence.audit(docs)) == audit_by_hand(rows)
    assert divergence.audit(docs.where("false")).count() == 0


def test_audit_of_the_table_equals_its_twin(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{TABLES}/documents.parquet'")
    got = as_rows(queries.op11_source_divergence(spark, TABLES).select("lang", "source", "part", "item", "value", "rank"))
    assert got == Counter(c.sql(queries.oracle_sql()["op11_source_divergence"]).select("lang, source, part, item, value, rank").fetchall())


def test_audit_joins_many_groups_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a b c d{i % 7}", "en", f"s{i % 5}") for i in range(200)], "text string, lang string, source string")
    want = as_rows(divergence.audit(docs))
    monkeypatch.setattr(divergence, "FEW_GROUPS", 1)
    assert as_rows(divergence.audit(docs)) == want


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence._share(F.lit(10**12), F.lit(10**13))).first()[0]
    assert got == 1 + 10**9 * (10**12 + 2) // 10**13


# --- centroid clustering


def lloyd(rows, k=40, rounds=5):
    """Plain rounds over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, x) for i, x in kept if max(map(abs, x)) <= 1 << 27]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", np.array(r[1], "<i4").tobytes())
    c = [x for _, x in sorted(kept, key=key)[:k]]
    for turn in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c)) for _, x in kept]
        if turn < rounds:
            for j in range(len(c)):
                mine = [x for (_, x), (_, o) in zip(kept, own, strict=True) if o == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    total = Counter()
    for d, j in own:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(kept, own, strict=True))


VECTORS = "vec_id long, embedding array<double>, cluster int, x string"


def cluster_rows(spark, rows, **more):
    return as_rows(clusters.cluster(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS), **more))


def test_clusters_of_odd_vectors(spark):
    r = random.Random(12)
    rows = [(i, [r.choice([-1, 0, 1]) / 256 for _ in range(64)]) for i in range(80)]  # small integers: ties everywhere
    rows += [(200 + i, rows[0][1]) for i in range(90)] + [(7, rows[1][1]), (7, rows[2][1]), (None, rows[3][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 63), (303, [0.0] * 63 + [None]), (304, [0.0] * 63 + [float("nan")]), (305, [float("inf")] + [0.0] * 63), (306, [1e30] + [0.0] * 63)]
    rows += [(400 + i, [r.uniform(-5e5, 5e5) for _ in range(64)]) for i in range(8)]
    assert cluster_rows(spark, rows) == lloyd(rows)


def test_clusters_of_fewer_vectors_and_of_nothing(spark):
    rows = [(i, [float(i + k) for k in range(64)]) for i in range(5)]
    assert cluster_rows(spark, rows) == lloyd(rows)
    assert cluster_rows(spark, [(1, None)]) == Counter()
    assert clusters.cluster(spark.createDataFrame([], VECTORS)).count() == 0


def test_clusters_of_the_table_equal_the_twin(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS FROM '{TABLES}/embeddings.parquet'")
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert as_rows(queries.op12_centroid_clustering(spark, TABLES).select(cols)) == Counter(c.sql(queries.oracle_sql()["op12_centroid_clustering"]).select(", ".join(cols)).fetchall())


def test_bounds_hold_and_skip_distances():
    r = np.random.default_rng(5)
    centers = r.integers(-300, 300, (12, 64))
    x = centers[r.integers(0, 12, 3000)] + r.integers(-20, 20, (3000, 64))
    rows, before = x[:12].copy(), None
    own, best, upper, lower = clusters.Centroids(rows).first(x)
    made = 0
    for _ in range(4):
        new = np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else rows[j] for j in range(12)])
        before, rows = rows, new
        own, best, upper, lower, n = clusters.Centroids(rows, before).assign(x, own, upper, lower, True)
        made += n
        d = clusters.squared(x, rows)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
        assert (upper.astype(float) ** 2 >= best).all() and (lower.astype(float) ** 2 <= d).all()
    assert made < 4 * 3000 * 12 / 3


# --- language-model scoring


def test_words_are_cut_as_the_pattern_says():
    import pyarrow as pa

    texts = ["Ab\x0bc d é", "", None, "x", " y\tZ\n", "\x1fq\x7f"]
    words, doc = cut_words(pa.array(texts), scoring.WORD)
    want = [(i, w.encode().lower() if w.isascii() else w.encode().replace(b"A", b"a")) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(zip(doc.tolist(), words.to_pylist(), strict=True)) == want


def small_model(seed=3, n=60, steps=30):
    r = np.random.default_rng(seed)
    docs = [r.integers(0, n, r.integers(1, 90)).astype(np.int32) for _ in range(30)]
    return lm.train(lm.start(np.bincount(np.concatenate(docs), minlength=n) + 0.5), docs, steps=steps, batch=16), docs


def plain(m, doc):
    """Each next id's distribution from the definitions, one token at a time."""
    t, p, out = m.tables, m.p, []
    x = [m.n, *doc[:-1].tolist()]
    for i, want in enumerate(doc.tolist()):
        seen = range(max(0, i // lm.STRIDE * lm.STRIDE - lm.STRIDE), i + 1)
        w = np.array([math.exp(float(t["q"][x[i]] @ t["k"][x[j]]) + float(p["near"][i - j])) for j in seen])
        a = (w[:, None] * np.array([t["v"][x[j]][: lm.WIDTH] for j in seen])).sum(0) / w.sum()
        h = t["e"][x[i]] + (t["last"][x[i - 1]] if i else t["last"][m.n + 1]) + a
        f = np.maximum(h @ p["w1"] + p["b1"], 0)
        z = np.exp(f @ p["cw"] + p["cb"])
        every = np.concatenate([z[c] / z.sum() * (e := np.exp(f @ p["mw"][:, lo:hi] + p["mb"][lo:hi])) / e.sum() for c, (lo, hi) in enumerate(zip(m.starts[:-1], m.starts[1:], strict=True))])
        assert abs(every.sum() - 1) < 1e-4
        out.append(math.log(every[want]))
    return out


def test_windows_score_each_token_once_as_the_definition_says(monkeypatch):
    m, docs = small_model()
    inputs, targets, at = lm.lay_out(docs, m.n, m.n + 1)
    assert (targets >= 0).sum() == sum(map(len, docs))
    got = m.log_probs(inputs, targets)
    for d, start in zip(docs, at, strict=False):
        assert np.allclose(got[start + lm.STRIDE : start + lm.STRIDE + len(d)], plain(m, d), atol=2e-3)
    monkeypatch.setattr(lm, "BLOCKS", 3)
    assert np.allclose(m.log_probs(inputs, targets), got, atol=1e-4)


def test_a_document_in_stretches_scores_as_a_whole():
    m, docs = small_model()
    for d in docs:
        r, s, at, total = random.Random(len(d)), lm.Stream(m), 0, 0.0
        while at < len(d) - 1:
            end = min(len(d) - 1, at + r.randrange(0, 40))
            total += s.add(d[at:end], False)
            at = end
        total += s.add(d[at:], True)
        assert abs(total - sum(m.log_probs(*lm.lay_out([d], m.n, m.n + 1)[:2]))) < 1e-3


def test_gradients_equal_differences():
    m, docs = small_model(steps=5)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    m.make_tables()
    inputs, targets, _ = lm.lay_out(docs[:4], m.n, m.n + 1)
    _, g = lm.gradients(m, inputs, targets)
    r = np.random.default_rng(0)
    for k, v in m.p.items():
        for at in [tuple(r.integers(0, s) for s in v.shape) for _ in range(4)]:
            side = []
            for by in (1e-2, -1e-2):
                v[at] += by
                side.append(lm.gradients(m.make_tables(), inputs, targets)[0])
                v[at] -= by
            m.make_tables()
            assert abs((side[0] - side[1]) / 2e-2 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_overflowing_logits_are_computed_again():
    m, docs = small_model()
    before = m.p["cb"].copy()
    m.p["cb"] = before + np.float32(300)
    inputs, targets, _ = lm.lay_out(docs, m.n, m.n + 1)
    far = m.log_probs(inputs, targets)
    m.p["cb"] = before
    assert np.allclose(far, m.log_probs(inputs, targets), atol=1e-2)


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(13)
    pool = [f"word{i}" for i in range(40)] + ["Über", "été,", "the"]
    rows = [(i, " ".join(r.choices(pool, k=r.randrange(0, 80)))) for i in range(150)] + [(1, "the THE the"), (1, "the THE the"), (None, "word1 new"), (None, None), (900, ""), (901, None), (902, " \n"), (903, "unseen" * 40), (904, "the word1 " * 9000)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    return rows, docs, scoring.score(docs, steps=20, hot=8).collect()


def test_base_scores_equal_direct_counts(scored):
    rows, _, got = scored
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    c = Counter(w for i, ws in words if not held(i) for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 6)) for i, ws in words)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 1 and r.n_tokens == 4}) == 1


def test_long_texts_in_stretches_score_alike(scored):
    _, docs, got = scored
    again = scoring.score(docs, steps=20, hot=8, long=100).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score)
    for a, b in zip(sorted(got, key=key), sorted(again, key=key), strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
        assert abs(a.score - b.score) < 1e-4 * abs(a.score) + 1e-3 and abs(a.base_score - b.base_score) < 1e-6 * abs(a.base_score)


def test_scores_of_nothing_and_without_learning_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert scoring.score(docs.where("false"), steps=2).count() == 0
    for r in scoring.score(docs, steps=2).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_ranks_keep_every_id_apart():
    counts = np.zeros(scoring.IDS)
    counts[:100] = np.arange(100)
    ranks = scoring.Ranks(counts, 0, modelled=20)
    assert ranks.end < 20 and len(ranks.counts) == 21 and abs(np.exp(ranks.rare[ranks.rank == 20]).sum() - 1) < 1e-9


def test_frequent_words_are_the_largest_counts_and_bounded(spark):
    rows = [(f"w{k}", 1 + k * k) for k in range(100)] + [(f"x{k}", 3) for k in range(50)]
    counts = spark.createDataFrame(rows, "word string, n long")
    for most in (0, 1, 7, 60, 149, 150, 999):
        got = scoring.frequent(counts, most).collect()
        out = {n for w, n in rows} - {r.n for r in got}
        assert len(got) <= most and (not out or max(out) < min([r.n for r in got], default=10**9))
    assert scoring.frequent(counts, 999).count() == 150 and scoring.frequent(counts, 7).count() >= 3
    assert scoring.frequent(counts.where("false"), 5).count() == 0


def test_subword_ids_give_the_words_back():
    encode = scoring.Encoder(tokenizer_path(scoring.VOCABULARY))
    words = ["the", "été,", "日本語", "x\x00y", "a" * 500, "🙂", "der"]
    ids, starts = encode(words)
    assert [encode.model.decode(ids[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)] == words


def test_held_out_texts_score_above_the_word_counts(spark):
    got = [r for r in scoring.score(spark.read.parquet(f"{TABLES.replace('0.001', '0.01')}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
