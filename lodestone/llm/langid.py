"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased whole text are hashed to DIMS counters. Document frequencies
come from all learning rows. The weights are fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample (SAMPLE rows per language, fewer where the languages would exceed MOST_ROWS in
all, the smallest by a hash of the id), and a temperature is fitted on learning rows of one other fold, bounded alike (SAMPLE rows).

Defined results: a null text or one without any letter is `und` with score 0; so is every text where
nothing can be learned (no labelled rows); repeated rows get equal results; an empty table gives an empty
result; extra columns are ignored. Texts of any length are read in blocks, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, ship, slices, smallest

DIMS = 1 << 15
BLOCK = 1 << 20
SAMPLE, MOST_ROWS = 600, 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"


def counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed character 1- to 3-grams; blocks overlap by two characters, so none is lost."""
    out = np.zeros(dims, np.float32)
    low = text.lower()
    for start in range(0, len(low), BLOCK):
        block = low[max(0, start - 2) : start + BLOCK]
        c = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        skip = min(start, 2)  # characters that the block before has counted
        for k in (1, 2, 3):
            if len(c) < k:
                continue
            h = np.full(len(c) - k + 1, k, np.uint64)
            for j in range(k):
                h = (h * np.uint64(1_000_003) + c[j : len(c) - k + 1 + j]) & np.uint64(0xFFFFFFFFFFFF)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            out += np.bincount((h[max(0, skip - k + 1) :] % np.uint64(dims)).astype(np.int64), minlength=dims)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text, len(idf))) * idf
    return v / (np.sqrt(v @ v) or 1.0)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x dims
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not _has_letter(text):
            return UNKNOWN, 0.0
        z = self.weights @ vector(text, self.idf) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, dims: int) -> np.ndarray:
    """rows: (indices, values, class). One proximal step per row; weights inside the L1 ball stay zero."""
    z, n = np.zeros((k, dims), np.float64), np.zeros((k, dims), np.float64)

    def at(i: np.ndarray) -> np.ndarray:
        zi = z[:, i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[:, i])) / ALPHA + L2))

    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            i, x, y = rows[r]
            w = at(i)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * x[None, :]
            step = (np.sqrt(n[:, i] + g * g) - np.sqrt(n[:, i])) / ALPHA
            z[:, i] += g - step * w
            n[:, i] += g * g
    return at(np.arange(dims)).astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of a fixed grid with the least log loss."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 4.0, 60):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        best = min(best, (float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean()), float(t)))
    return best[1]


def document_frequencies(docs: DataFrame, dims: int = DIMS) -> tuple[np.ndarray, int]:
    """In how many of all the texts each feature occurs: one partial row of `dims` counts a task, then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[:dims] += counts(text.as_py(), dims) > 0
                n += 1
        df[dims] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["dim", "df"])

    ship(docs.sparkSession)
    total = docs.select("text").mapInArrow(run, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df"))
    df = np.zeros(dims + 1)
    for r in total.collect():  # at most dims + 1 rows
        df[r["dim"]] = r["df"]
    return df[:dims], int(df[dims])


def learn(docs: DataFrame, sample: int = SAMPLE, dims: int = DIMS) -> Model:
    """Fit on docs (doc_id, text, lang) outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out()).where("lang IS NOT NULL AND text IS NOT NULL AND text rlike '\\\\p{L}'")
    df, n = document_frequencies(rows, dims)
    if not n:
        return Model([], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), 1.0)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            vs = [vector(t.as_py(), idf) for t in batch.column("text")]
            at = [np.flatnonzero(v).astype(np.int32) for v in vs]
            cols = [batch.column("lang"), batch.column("part"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v[a].tobytes() for v, a in zip(vs, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "part", "at", "x"])

    # The same bounded choice whatever the partitioning: the smallest hashes of each language and part.
    langs = docs.where(~held_out()).where("lang IS NOT NULL").select("lang").distinct().count()
    sample = max(1, min(sample, MOST_ROWS // max(1, langs)))
    rows = rows.withColumn("part", (fold() == 1).cast("int"))
    chosen = smallest(rows.select("doc_id", "lang", "part"), ["lang", "part"], F.xxhash64("doc_id", F.lit(9)), sample, ["doc_id"]).select("doc_id").distinct()
    picked = rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most 2 * MOST_ROWS ids, or two a language
    picked = picked.groupBy("doc_id", "lang", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of a repeated id, one text
    got = picked.select("lang", "part", "text").mapInArrow(sparse, "lang string, part int, at binary, x binary").orderBy("lang", "at", "x").collect()
    langs = sorted({r["lang"] for r in got})
    number = {x: i for i, x in enumerate(langs)}
    data = [(r["part"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), number[r["lang"]]) for r in got]
    train = [d[1:] for d in data if d[0] == 0] or [d[1:] for d in data]
    weights = fit_ftrl(train, len(langs), dims)
    tune = [d[1:] for d in data if d[0] == 1] or train
    logits = np.array([weights[:, i] @ x for i, x, _ in tune])
    return Model(langs, idf, weights, fit_temperature(logits, np.array([y for *_, y in tune])))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x dims weights: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def speaking(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, whole, whose text has a language with a score of `least` or more."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
