"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). Emissions come from FEATURES of the line and of its two neighbours;
transitions are learned. Labels are known per document only, so each line of a labelled document carries
the document's label in training. The forward-backward marginals of the lines, weighted by length,
aggregate to one number, and a logistic fit on learning rows turns it into the score.

The field is fitted on a bounded sample: at most SAMPLE labelled documents per class, the smallest by a
hash of the id, whatever their length; of rows that share an id, one text. A longer one lends TRAIN_LINES
lines in a row, which begin at a place that its id chooses. Scoring reads every line of every text, in blocks of bounded size.

Defined results: null and empty texts have one empty line; without learning rows every score is 0.5;
repeated rows get equal scores; a label row that is repeated or disputed counts by its largest value;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ship, slices, smallest

SAMPLE, TRAIN_LINES, THRESHOLD = 1500, 400, 0.3
CELLS = 1 << 15
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
BASE = 12


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 space, 5 full stop or comma."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".," else 0
    out[0x3000:0xD800] = 1
    return out


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x BASE) and lengths of the lines."""
    lines = (text or "").split("\n")
    out = np.zeros((len(lines), BASE), np.float64)
    table = _classes()
    for k, line in enumerate(lines):
        n = len(line)
        out[k, 0] = 1.0
        if not n:
            out[k, 1] = 1.0
            continue
        c = np.bincount(table[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=6) / n
        words = line.split()
        m = max(1, len(words))
        distinct = len(set(words))
        again = sum(map(str.__eq__, words, words[1:])) / m
        out[k, 2:] = (c[0] * 4, c[1], c[2] * 2, c[3] * 4, c[5] * 4, distinct / m, again * 2, np.log1p(n) / 5, n / m / 10, line[-1] in ".!?")
    return out, np.array([len(x) + 1 for x in lines], np.float64)


def some_lines(x: np.ndarray, n: np.ndarray, doc_id: int, most: int = TRAIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` lines in a row, from a place that the id chooses."""
    at = zlib.crc32(str(doc_id).encode()) // 5 % max(1, len(n) - most + 1)
    return x[at : at + most], n[at : at + most]


def with_neighbours(x: np.ndarray) -> np.ndarray:
    zero = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero])])


def emissions(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """with_neighbours(x) @ weights, without the wide matrix."""
    out = x @ weights[:BASE]
    out[1:] += (x @ weights[BASE : 2 * BASE])[:-1]
    out[:-1] += (x @ weights[2 * BASE :])[1:]
    return out


def line_marginals(score: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(line good) of one document: both passes carry one number, the log-odds of the message."""
    (t00, t01), (t10, t11) = trans.tolist()
    fwd, bwd, at = np.empty(len(score)), np.zeros(len(score)), 0.0
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for k, s in enumerate(score.tolist()):
        at = s if k == 0 else s + add(t01, at + t11) - add(t00, at + t10)
        fwd[k] = at
    at = 0.0
    for k in range(len(score) - 2, -1, -1):
        at += float(score[k + 1])
        at = add(t10, at + t11) - add(t00, at + t01)
        bwd[k] = at
    return 1 / (1 + np.exp(-np.clip(fwd + bwd, -700, 700)))


def marginals(score: np.ndarray, trans: np.ndarray, count_moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward in log space. score: docs x lines emission of state 1 over state 0, NaN after a document's end.

    Returns P(line good) and, where asked for, P(transition) summed over lines: docs x 4.
    """
    docs, lines = score.shape
    live = ~np.isnan(score)
    emit = np.stack([np.zeros_like(score), np.nan_to_num(score)], -1)
    fwd, bwd = np.zeros((docs, lines, 2)), np.zeros((docs, lines, 2))
    fwd[:, 0] = emit[:, 0]
    for t in range(1, lines):
        step = np.logaddexp(fwd[:, t - 1, 0, None] + trans[0], fwd[:, t - 1, 1, None] + trans[1]) + emit[:, t]
        fwd[:, t] = np.where(live[:, t, None], step, fwd[:, t - 1])
    for t in range(lines - 2, -1, -1):
        nxt = bwd[:, t + 1] + emit[:, t + 1]
        step = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
        bwd[:, t] = np.where(live[:, t + 1, None], step, 0.0)
    both = fwd + bwd
    p = 1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -700, 700)))
    total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    moves = np.zeros((docs, 4))
    for t in range(1, lines if count_moves else 1):
        joint = fwd[:, t - 1, :, None] + trans[None] + (emit[:, t] + bwd[:, t])[:, None, :] - total[:, None, None]
        moves += np.where(live[:, t, None], np.exp(np.minimum(joint, 0.0)).reshape(docs, 4), 0.0)
    return p, moves


def _padded(scores: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(scores), max(map(len, scores))), np.nan)
    for k, s in enumerate(scores):
        out[k, : len(s)] = s
    return out


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def raw(self, xs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean log-odds of each document's line marginals, in blocks of at most CELLS lines with their padding."""
        out = np.zeros(len(xs))
        order = sorted(range(len(xs)), key=lambda i: len(xs[i][1]))  # of like length: little padding
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(xs[order[end]][1]) <= CELLS:
                end += 1
            ids = order[at:end]
            scores = [emissions(xs[i][0], self.weights) for i in ids]
            found = [line_marginals(scores[0], self.trans)] if len(ids) == 1 else marginals(_padded(scores), self.trans, False)[0]
            for p, i in zip(found, ids, strict=True):
                n = xs[i][1]
                q = np.clip(p[: len(n)], 1e-6, 1 - 1e-6)
                out[i] = float((np.log(q / (1 - q)) * n).sum() / n.sum())
            at = end
        return out

    def score(self, xs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(xs) + self.shift)))


def fit(xs: list[np.ndarray], lens: list[np.ndarray], y: np.ndarray) -> Field:
    """Maximum conditional likelihood by Adam, a document counting once whatever its length; then the logistic fit."""
    wide = 3 * BASE
    if not len(y) or len(set(y.tolist())) < 2:
        return Field(np.zeros(wide), np.zeros((2, 2)), 0.0, 0.0)
    order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
    full = [with_neighbours(x) for x in xs]
    blocks = []
    for at in range(0, len(order), 256):
        ids = order[at : at + 256]
        lines = max(len(full[i]) for i in ids)
        x = np.full((len(ids), lines, wide), np.nan)
        for k, i in enumerate(ids):
            x[k, : len(full[i])] = full[i]
        live = ~np.isnan(x[..., 0])
        blocks.append((np.nan_to_num(x), live, y[ids].astype(float), 1.0 / live.sum(1)))
    theta = np.zeros(wide + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    rate_of = {1.0: 0.5 / max(1, int((y == 1).sum())), 0.0: 0.5 / max(1, int((y == 0).sum()))}
    for step in range(1, STEPS + 1):
        grad = RIDGE * theta
        for x, live, label, per in blocks:
            s = np.where(live, x @ theta[:wide], np.nan)
            p, moves = marginals(s, theta[wide:].reshape(2, 2))
            weight = per * np.where(label == 1, rate_of[1.0], rate_of[0.0])
            grad[:wide] += np.einsum("dl,dlf->f", np.where(live, (p - label[:, None]) * weight[:, None], 0.0), x)
            want = np.zeros_like(moves)
            stays = live.sum(1) - 1.0
            want[label == 0, 0] = stays[label == 0]
            want[label == 1, 3] = stays[label == 1]
            grad[wide:] += ((moves - want) * weight[:, None]).sum(0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    out = Field(theta[:wide].copy(), theta[wide:].reshape(2, 2).copy(), 1.0, 0.0)
    raw = out.raw(list(zip(xs, lens, strict=True)))
    a, b = 1.0, 0.0
    w = np.where(y == 1, rate_of[1.0], rate_of[0.0])
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-(a * raw + b)))
        g = np.array([(w * (p - y) * raw).sum() + 1e-3 * a, (w * (p - y)).sum()])
        h = w * p * (1 - p)
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    out.slope, out.shift = max(float(a), 1e-6), float(b)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on docs (doc_id, text) that labels (doc_id, quality) marks, outside the held-out fold."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").where(~held_out())
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out())
    known = texts.select("doc_id").distinct().join(marks, "doc_id")
    chosen = smallest(known, ["quality"], F.xxhash64("doc_id", F.lit(10)), sample, ["doc_id"]).select("doc_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [some_lines(*line_features(t.as_py()), d.as_py()) for t, d in zip(batch.column("text"), batch.column("doc_id"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["doc_id", "quality", "x", "n"])

    picked = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    picked = picked.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of a repeated id, one text
    rows = picked.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary, n binary").orderBy("doc_id").collect()
    xs = [np.frombuffer(r["x"]).reshape(-1, BASE) for r in rows]
    return fit(xs, [np.frombuffer(r["n"]) for r in rows], np.array([r["quality"] for r in rows], int))


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = field.score([line_features(t.as_py()) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, whose text scores `threshold` or more."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(field.score([line_features(t.as_py()) for t in batch.column("text")]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
