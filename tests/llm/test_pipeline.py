"""Each stage and the whole run against a brute-force version, with nulls, repeated ids, empty and extra columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from lodestone.llm import jaccard, langid, packing, quality
from lodestone.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row int, name string"
EN = "the quick brown fox and the lazy dog went over to that house with all of their friends and then they walked home".split()
DE = "der schnelle braune Fuchs und die Hunde gingen nicht in das alte Haus weil sie noch eine lange Reise vor sich hatten".split()


def prose(words, n, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = []
    for i in range(160):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        text = prose(words, 6, i) if i % 8 else "\n".join("x%d$$ 0101 %%%%" % r.randrange(9) for _ in range(9))
        out.append((i, text, lang))
    out += [(200, out[3][1].upper(), "en"), (201, out[5][1] + " Indeed.", "en"), (5, prose(EN, 6, 900), "en"), (None, prose(DE, 6, 901), "de"), (None, out[7][1], "en"), (None, None, None), (202, "", "en"), (203, "12 34 $$", None), (9, out[9][1], "en"), (9, out[9][1], "en")]
    return [(i, t, lang, "s", len(t or ""), 3, "n") for i, t, lang in out]


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(0, 160, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def brute_language(rows, model):
    found = [model.predict(r[1]) for r in rows]
    return [r for r, (lang, score) in zip(rows, found, strict=True) if lang != langid.UNKNOWN and score >= pipeline.LEAST_LANGUAGE_SCORE]


def brute_quality(rows, field):
    return [r for r in rows if field.score([quality.line_features(r[1])])[0] >= quality.THRESHOLD]


def brute_exact(rows):
    best = {}
    for r in rows:
        key = (r[1] or "").translate(jaccard.UPPER)
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    return list(best.values())


def brute_near(rows):
    sets, group = [jaccard.shingles_of(r[1] or "") for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and jaccard.linked(sets[a], sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        if g not in best or (r[0] is not None and (best[g][0] is None or r[0] < best[g][0])):
            best[g] = r
    return list(best.values())


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def want(rows):
    return Counter(r[:2] for r in rows)


def test_stages_against_brute_force(spark, rows, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    now = rows
    for (name, stage), brute in zip(pipeline.STAGES[:-1], (brute_language, brute_quality, brute_exact, brute_near), strict=True):
        args = []
        if name == "language_id":
            args = [langid.learn(docs)]
        if name == "quality":
            args = [quality.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))]
        before, now = now, brute(now, *args)
        out = pipeline.keep(stage(spark, docs, tables))
        assert kept(out) == want(now), name
        assert len(now) < len(before), name  # every stage has something to do
        assert out.columns == docs.columns
        docs = out
    ids = packing.word_ids(tokenizer_path("word_bpe_49k.json"))
    packed = pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sum(r.length for r in packed) == sum(len(ids(r[1] or "")) // 4 + 1 for r in now)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in now)
    got = pipeline.run(spark, tables).collect()
    assert Counter(r[:5] for r in map(tuple, got)) == Counter(r[:5] for r in map(tuple, packed))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
