"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns; brute force beside each operator."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import ann, bpe, chat, chunks, jaccard, langid, licenses, packing, quality, warc
from lodestone.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, key string, digest string"


def words(n, seed, pool=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(60, 1, 4000)
    texts = [None, "", " ", "one two", "One TWO", "Über\u0130 ſ", base, base + " tail", base.upper(), words(300, 3), words(300, 3) + " x y", "a " * 40, "x" * 3000, words(9, 8), words(9, 8)]
    rows = [(i, t, "en" if i % 2 else None, "k", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = packing.pack_documents(docs, budget=64).collect()
    seqs, by_doc = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in texts_of(docs).items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for r in sorted(by_doc[i], key=lambda r: r.piece):
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r.length for r in by_doc[i]) == len(ids)


def test_bpe_with_small_chunks(docs):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:4] for r in bpe.encode_documents(docs, chunk=200, overlap=40).collect()}
    for i, t in texts_of(docs).items():
        ids = enc.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert got[i] == want


def test_exact_groups(docs):
    low = {i: (t or "").translate(jaccard.UPPER) for i, t in texts_of(docs).items()}
    for r in chunks.exact_groups(docs).collect():
        same = [i for i, t in low.items() if t == low[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256(low[r.doc_id].encode()).hexdigest()


def test_pigeonhole_finds_every_link():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120, 400]))
        r = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        apart = int(rng.integers(0, jaccard.most_apart(n) + 2))
        gone = int(rng.integers(0, apart + 1))
        if gone >= n:
            continue
        s = np.unique(np.concatenate([rng.choice(r, n - gone, replace=False), rng.integers(0, 2**63, apart - gone, dtype=np.uint64)]))
        a, b = (r, s) if len(r) >= len(s) else (s, r)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            keys, tags = jaccard.entries(a)
            shared = np.isin(keys, jaccard.entries(b)[0]) | (rng.random(len(keys)) < rng.random())
            costs = np.where(rng.random(len(keys)) < 0.5, 1, rng.integers(1, 1000, len(keys)))
            probe = jaccard.allocate(len(a), tags[shared], costs[shared])
            assert np.isin(keys[shared][probe], jaccard.entries(b)[0]).any()


def test_near_duplicates(docs, spark):
    r = random.Random(5)
    base = words(80, 11, 9000).split()
    chain = [(100 + i, " ".join(base[i:] + [f"n{i}{j}" for j in range(i)])) for i in range(0, 24, 2)]
    copies = [(200 + i, " ".join(w if r.random() > 0.005 else "z" for w in base)) for i in range(40)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(chain + copies, "doc_id long, text string"))
    sets = {}
    for i, t in texts_of(df).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(jaccard.UPPER))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/ é\r\nX: y", "<p>é\r\n\r\nWARC/1.1</p>", 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<p>é\r\n\r\nWARC/1.1</p>", 1), (5, "v", "z", 1)], "page_id long, url string, html string, type int")
    got = {r.page_id: tuple(r)[1:] for r in warc.page_captures(pages).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    body = "<p>é\r\n\r\nWARC/1.1</p>"
    n = len(body.encode())
    assert got == {1: (n, sha(body), "revisit", 4), 2: (0, sha(""), "revisit", 3), 3: (0, sha(""), "response", None), 4: (n, sha(body), "response", None), 5: (1, sha("z"), "response", None)}


def test_warc_of_nothing(spark):
    assert warc.page_captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licenses(spark):
    lines = list(licenses.TEMPLATES.values())
    rows = [(i, f"{words(i * 3 + 1, i)} {t.upper()}\n{words(30, i + 1)}") for i, t in enumerate(lines)] + [(50, words(200, 1)), (51, None), (52, ""), (53, "a b")]
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, k) for i, k in enumerate(licenses.TEMPLATES)}


def test_licenses_of_texts_and_altered_notices(spark):
    from pathlib import Path

    there = Path(licenses.__file__).parent / "license_texts"
    body = lambda name: (there / f"{name}.txt").read_text()
    header = '''/*
 * Copyright 2019 The Authors. Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */'''
    mit = body("MIT__text").split("\n\n")[0].replace("hereby granted", "herewith granted")
    wanted = {
        0: (f"{words(40, 1)}\n{header}\n{words(50, 2)}", "Apache-2.0"),
        1: (f"{words(9, 3)} Released under the MIT License {words(9, 4)}", "MIT"),
        2: ("MIT License\n\nCopyright (c) 2020 A B\n\n" + mit + "\n\n" + "\n\n".join(body("MIT__text").split("\n\n")[1:]), "MIT"),
        3: (body("BSD-2-Clause__text").replace("COPYRIGHT HOLDERS", "AUTHOR"), "BSD-2-Clause"),
        4: (body("BSD-3-Clause__text").replace("the copyright holder nor", "Acme Inc. nor"), "BSD-3-Clause"),
        5: (words(300, 5) + " " + re.sub(r"(?m)^", "# ", body("GPL-2.0__header")), "GPL-2.0"),
        6: (body("GPL-3.0__header"), "GPL-3.0"),
        7: ("// " + body("LGPL-2.1__header").replace("library", "program"), "LGPL-2.1"),
        8: (body("MPL-2.0__header").replace("http:", "https:"), "MPL-2.0"),
        9: (body("GPL-3.0__text"), "GPL-3.0"),
        10: (words(200, 6) + body("Apache-2.0__text").replace("Licensor", "Grantor"), "Apache-2.0"),
        11: ("Released under the Licensed MIT", None),
    }
    rows = [(i, t) for i, (t, _) in wanted.items()]
    got = [(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted((i, k) for i, (_, k) in wanted.items() if k)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[60:120] = x[60]  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [None] * 8)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    hits = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.argsort(-s, kind="stable")[:20].tolist()
        hits += len(set(want) & set(got[q].values()))
        assert len(got[q]) == 20
    assert set(got) == set(range(0, 300, 20)) and hits >= 0.9 * 20 * len(got)


def test_nearest_neighbours_beyond_a_few_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.search(rows, step=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 400):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & got[q])
    assert set(got) == set(range(0, len(x), 400)) and hits >= 0.97 * 20 * len(got)


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] <|turn|>\\l"), (1, 1, "assistant", "\\<|end|>\u00e9\U0001f600 ok"), (1, 2, "assistant", None), (2, 1, "assistant", " b"), (2, 0, None, ""), (3, 0, "assistant", "..")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c in (1, 2, 3):
        turns = [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: r[:2]) if r[0] == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


def test_models_on_edge_rows(spark, docs):
    found = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert len(found) == 15 and found[0].lang_pred == found[1].lang_pred == "und" and found[3].lang_pred == "en"
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 15)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.learn(docs, labels)).collect())
    nothing = docs.where("false")
    assert langid.predict(nothing, langid.learn(nothing)).count() == quality.score(nothing, quality.learn(nothing, labels)).count() == 0


def test_line_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    s, trans = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    p, _ = quality.marginals(s, trans)
    total, good = 0.0, np.zeros(4)
    for k in range(16):
        y = [k >> j & 1 for j in range(4)]
        w = np.exp(sum(s[0, j] * y[j] for j in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    assert np.allclose(p[0], good / total)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    p = langid.predict(d, langid.learn(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (p.lang_pred == p.lang).mean() >= 0.97
    q = quality.score(d, quality.learn(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() >= 0.95
