"""Stages on rows whose doc_id is null or repeats."""

import random

import pytest

import corpus_pipeline as pipeline
from lodestone.llm import langid, quality


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


A, B, C = words(80, 1), words(80, 2), words(80, 3)
ROWS = [(1, A), (1, B), (None, C), (None, A), (2, B), (None, words(70, 4)), (3, A + " tail"), (4, None), (5, ""), (6, words(60, 5)), (6, words(60, 5))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], "doc_id long, text string, lang string")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_dedup(spark, docs):
    # ids 1 and null hold A, 1 and 2 hold B, 6 twice one text; a null text equals an empty one
    want = [(1, A), (2, B), (None, C), ROWS[5], ROWS[6], (5, ""), ROWS[9]]
    assert pairs(pipeline.exact_dedup(spark, docs, "")) == sorted(want, key=repr)


def test_near_dedup(spark, docs):
    # A and its copy with a tail link; texts without shingles link with nothing
    want = [(1, A), (1, B), (None, C), ROWS[5], (4, None), (5, ""), ROWS[9]]
    assert pairs(pipeline.near_dedup(spark, docs, "")) == sorted(want, key=repr)


def test_filters_judge_each_row(spark, docs, monkeypatch):
    clean = [r for r in ROWS if r[1] and r[1] != B]
    mark = lambda d: d.where(f"coalesce(text, '') not in ('', '{B}')")
    monkeypatch.setattr(langid, "learn", lambda d: None)
    monkeypatch.setattr(langid, "speaking", lambda d, m, least: mark(d))
    monkeypatch.setattr(quality, "learn", lambda d, m: None)
    monkeypatch.setattr(quality, "good", lambda d, m: mark(d))
    monkeypatch.setattr(pipeline, "table", lambda *_: None)
    for stage in (pipeline.language, pipeline.quality_filter):
        assert pairs(stage(spark, docs, "")) == sorted(clean, key=repr)
