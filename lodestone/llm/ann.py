"""Nearest neighbours by inner product: anisotropic four-bit quantisation whose error bounds make the search exact.

Each vector is coded in subspaces of DIMS_PER_CODE dimensions with 16 centres, chosen by a loss that weighs
the part of the residual parallel to the vector PARALLEL times the rest, as that part is what distorts large
inner products. Codes are made once and stored, two to a byte, with the length of what they leave out. A query sums its
tables over the codes of all vectors; by the Cauchy-Schwarz inequality its product with a vector exceeds that sum by the length
left out times its own length at most. The products of the vectors with the best sums are a threshold, and every vector
whose bound reaches it is scored exactly, in double precision, in the task that holds it. So no nearest vector is missed,
whatever the rows: where codes cannot tell vectors apart, more of them are scored. The scan's work
is queries x vectors, a lookup for each byte of code, and at worst a product.

Codebooks are fitted on the SAMPLE vectors with the smallest hash; every vector is indexed. Equal vectors are
one entry that knows its smallest ids, so a vector held by a third of all rows costs one scan. A task takes a
block of codes with their vectors and a part of the queries, both of bounded size, and returns the nearest of its block.

Defined results: vectors that are null, zero, of another length than the most frequent one, or that hold
null or non-finite components take no part; neither do rows with a null id, which nothing could name; rows that
repeat id and vector count once; rows that repeat an id with another vector are rows of their own, as
candidates and as queries (the id then has several rankings); equal scores go by the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, parts_for, ship

TOP, QUERY_STEP = 20, 20
DIMS_PER_CODE, CENTRES, PARALLEL = 1, 16, 4.0
SAMPLE = 10_000
BLOCK, QUERIES, PAIRS = 4_096, 256, 1 << 15
MOST_VECTORS, MOST_QUERIES, TASKS = 1 << 17, 1 << 15, 16  # of a task; tasks that a small table is dealt to
EPS, TINY = 2.0**-22, 1e-30  # what a term of a sum in single precision may be off, relatively and at all


@dataclass
class Index:
    books: np.ndarray  # subspaces x CENTRES x DIMS_PER_CODE

    @property
    def scale(self) -> float:
        return float(np.abs(self.books).max()) or 1.0

    def _split(self, x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % DIMS_PER_CODE
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, DIMS_PER_CODE)

    def codes(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Four-bit codes: nearest centres, then coordinate descent on the anisotropic loss."""
        parts = self._split(x)
        square = np.maximum((x**2).sum(1), 1e-30)
        diff = parts[:, :, None, :] - self.books[None]
        perp, along = (diff**2).sum(-1), np.einsum("nskd,nsd->nsk", diff, parts)
        code = perp.argmin(2)
        rows = np.arange(len(x))
        total = along[rows[:, None], np.arange(parts.shape[1]), code].sum(1)
        for _ in range(passes):
            for s in range(parts.shape[1]):
                rest = total - along[rows, s, code[:, s]]
                loss = perp[:, s] + (PARALLEL - 1) * (rest[:, None] + along[:, s]) ** 2 / square[:, None]
                code[:, s] = loss.argmin(1)
                total = rest + along[rows, s, code[:, s]]
        return code.astype(np.uint8)

    def packed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, two to a byte, and for each vector what the sum of a query of length one may be off, both over the scale."""
        code = self.codes(x)
        left = np.linalg.norm(self._split(x) - self.books[np.arange(code.shape[1]), code], axis=(1, 2))
        off = (left + EPS * x.shape[1] * (np.linalg.norm(x, axis=1) + left)) / self.scale + TINY
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return code[:, ::2] * np.uint8(CENTRES) + code[:, 1::2], off

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, taken as of length one, and byte of code, what the byte's two centres add to the product, over the scale."""
        one = np.einsum("qsd,skd->qsk", self._split(q / np.linalg.norm(q, axis=1)[:, None]), self.books / self.scale).astype(np.float32)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def products(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, in double precision, some PAIRS at a time."""
    parts = [np.einsum("nd,nd->n", x[at_x[i : i + PAIRS]].astype("<f8"), y[at_y[i : i + PAIRS]]) for i in range(0, len(at_x), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def nearest(y: np.ndarray, index: Index, x: np.ndarray, codes: np.ndarray, off: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` vectors with the largest products for each query (query, place, product); of equal products the smaller id."""
    tables, unit = index.tables(y), np.linalg.norm(y, axis=1) * index.scale
    at_q, at_d, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.full(len(y), -np.inf)

    def add(q: np.ndarray, d: np.ndarray) -> None:
        nonlocal at_q, at_d, score
        at_q, at_d, score = np.concatenate([at_q, q]), np.concatenate([at_d, d]), np.concatenate([score, products(x, y, d, q)])
        order = np.lexsort((first[at_d], -score, at_q))
        rank = np.arange(len(at_q)) - np.searchsorted(at_q[order], at_q[order])
        order, rank = order[rank < most], rank[rank < most]
        at_q, at_d, score = at_q[order], at_d[order], score[order]
        least[at_q[rank == most - 1]] = score[rank == most - 1]

    for i in range(0, len(codes), BLOCK):
        block = codes[i : i + BLOCK]
        rough = np.zeros((len(tables), len(block)), np.float32)
        for s in range(block.shape[1]):
            rough += tables[:, s].take(block[:, s], axis=1)
        m = min(most, len(block))
        # The threshold: the vectors with the best sums, scored. Then all whose bound reaches it; what is no number does.
        best = np.zeros(rough.shape, bool)
        np.put_along_axis(best, np.argpartition(rough, len(block) - m, axis=1)[:, len(block) - m :], True, axis=1)
        q, d = np.nonzero(best)
        add(q, d + i)
        able = ~(np.isfinite(rough) & (rough + off[None, i : i + BLOCK] < (least / unit)[:, None])) & ~best
        q, d = np.nonzero(able)
        for j in range(0, len(q), BLOCK * most):  # so that what is held stays bounded
            add(q[j : j + BLOCK * most], d[j : j + BLOCK * most] + i)
    return at_q, at_d, score


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def fit(x: np.ndarray) -> Index:
    pad = -x.shape[1] % DIMS_PER_CODE
    parts = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, DIMS_PER_CODE)
    books = np.zeros((parts.shape[1], CENTRES, DIMS_PER_CODE))
    for s in range(parts.shape[1]):
        c = _kmeans(parts[:, s], CENTRES, s)
        books[s, : len(c)] = c
        books[s, len(c) :] = c[0]
    index = Index(books)
    square = np.maximum((x**2).sum(1), 1e-30)
    for _ in range(4):  # centres by descent on the same loss, codes held
        code = index.codes(x)
        diff = parts - index.books[np.arange(parts.shape[1]), code]
        along = (diff * parts).sum((1, 2)) / square
        pull = diff + (PARALLEL - 1) * along[:, None, None] * parts
        for s in range(parts.shape[1]):
            n = np.bincount(code[:, s], minlength=CENTRES)
            step = np.zeros((CENTRES, DIMS_PER_CODE))
            np.add.at(step, code[:, s], pull[:, s])
            index.books[s] += 0.5 * step / np.maximum(n, 1)[:, None]
    return index


def _matrix(column, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(-1, dims)


def vector_classes(rows: DataFrame, keep_ids: int) -> tuple[DataFrame, DataFrame, int, str]:
    """(vec_id, class) of every vector that takes part; (class, x, ids) with its smallest ids; the length; the bytes' type."""
    ship(rows.sparkSession)
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v) or v.values.null_count:
                    continue
                a = v.values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # one zero
                if np.isfinite(a).all() and a.any():
                    out.append((i, hashlib.blake2b(a.tobytes(), digest_size=16).digest(), a.tobytes(), len(a)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["vec_id", "class", "x", "dims"])

    embedding = F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>")
    good = keep(rows.select(F.col("vec_id").cast("long"), embedding).mapInArrow(run, "vec_id long, class binary, x binary, dims int").dropDuplicates(["vec_id", "class"]))
    most = good.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    dims = most["dims"] if most else 0
    good = good.where(F.col("dims") == dims)
    first = Window.partitionBy("class").orderBy("vec_id")
    ids = good.select("class", "vec_id").withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep_ids).groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = good.groupBy("class").agg(F.first("x").alias("x"))  # equal in a class
    return good.select("vec_id", "class"), keep(distinct.join(ids, "class")), dims, kind


def search(rows: DataFrame, top: int = TOP, step: int = QUERY_STEP, rerank: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest of each row whose vec_id is divisible by `step`.

    rerank is the least number of vectors of a block that are scored before their threshold is taken.
    """
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    members, classes, dims, kind = vector_classes(rows, top + 1)
    n = classes.count()
    if not n:
        return spark.createDataFrame([], out)
    most = max(rerank, top + 1)
    sample = classes.select("class", "x").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("x").collect()
    shared = spark.sparkContext.broadcast(fit(np.array([np.frombuffer(r["x"], kind) for r in sample], "<f8")))  # the codebooks

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                codes, off = shared.value.packed(_matrix(part.column("x"), dims, kind).astype("<f8"))
                yield pa.RecordBatch.from_arrays([part.column("class"), part.column("first"), part.column("x"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)], names=["class", "first", "x", "code", "off"])

    coded = keep(classes.select("class", F.col("ids")[0].alias("first"), "x").mapInArrow(encode, "class binary, first long, x binary, code binary, off double"))
    queries = members.where(F.col("vec_id") % step == 0)
    asked = keep(classes.join(queries.select("class").distinct(), "class", "left_semi").select("class", "x"))
    # Every pair of a vector and a query meets in one (block, part). Vectors are many, so it is queries that are repeated.
    blocks = max(parts_for(n, MOST_VECTORS), min(TASKS, parts_for(n, BLOCK)))
    parts = parts_for(asked.count(), MOST_QUERIES)
    some = lambda k: F.pmod(F.xxhash64("class"), F.lit(k)).cast("int")
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = coded.select("class", "first", "x", "code", "off", some(blocks).alias("block"), all_(parts).alias("part"))
    right = asked.select("class", "x", some(parts).alias("part"), all_(blocks).alias("block"))

    def scan(d: pa.Table, q: pa.Table) -> pa.Table:
        names, kinds = ["query", "class", "first", "score"], [pa.binary(), pa.binary(), pa.int64(), pa.float64()]
        if not d.num_rows or not q.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        codes = np.frombuffer(b"".join(d.column("code").to_pylist()), np.uint8).reshape(d.num_rows, -1)
        first, off, x, y = d.column("first").to_numpy(), d.column("off").to_numpy(), _matrix(d.column("x"), dims, kind), _matrix(q.column("x"), dims, kind).astype("<f8")
        found = []
        for j in range(0, len(y), QUERIES):
            at_q, at_d, score = nearest(y[j : j + QUERIES], shared.value, x, codes, off, first, most)
            found.append((at_q + j, at_d, score))
        at_q, at_d, score = (pa.array(np.concatenate(c)) for c in zip(*found, strict=True))
        return pa.table([q.column("class").take(at_q), d.column("class").take(at_d), d.column("first").take(at_d), score], names=names).cast(pa.schema(list(zip(names, kinds, strict=True))))

    key = ["block", "part"]
    exact = left.groupBy(*key).cogroup(right.select(*key, "class", "x").groupBy(*key)).applyInArrow(scan, "query binary, class binary, first long, score double")
    # top + 1 classes hold the top ids, the query's own apart
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", "class")
    near = exact.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).join(classes.select("class", "ids"), "class")
    near = near.select("query", "score", F.col("class").alias("other"), F.explode("ids").alias("vec_id"))
    shorter = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "other")
    near = keep(near.withColumn("r", F.row_number().over(shorter)).where(F.col("r") <= top + 1).drop("r"))
    mine = queries.select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    final = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "other")
    found = mine.join(near, "query").where("NOT (query_id = vec_id AND query = other)").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
