"""Exact deduplication through content-defined chunk recipes.

Each normalised text (A-Z lower-cased, in UTF-8) is cut where a rolling hash of its last bytes meets a
mask, so equal stretches give equal chunks. Chunks are deduplicated once, by digest and then by their
bytes, to verified identifiers: digest plus the chunk's ordinal among different chunks of that digest.
A document's recipe is its ordered identifier list. Equal recipes are equal texts. A long document's
bytes move at most once, each distinct chunk of a task once; the recipes that are compared are short.

Defined results: null and empty texts are equal to each other (the empty recipe); a repeated row counts
as one more row of its group; null ids sort before all others; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ship, slices

WINDOW = 8
LEAST, MOST, MASK_BITS = 1024, 16384, 12
BATCH_BYTES = 4 << 20

#: One random 64-bit number per byte value, from a fixed seed.
GEAR = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)


def cut_points(data: bytes, least: int = LEAST, most: int = MOST, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of data; each depends on the bytes since the last cut only."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    gear = GEAR[np.frombuffer(data, np.uint8)]
    rolled = gear.copy()
    for k in range(1, WINDOW):
        rolled[k:] += gear[:-k] << np.uint64(k * 7)
    marks = np.flatnonzero(rolled >> np.uint64(64 - mask_bits) == 0) + 1
    ends, last = [], 0
    while n - last > least:
        at = np.searchsorted(marks, last + least)
        end = min(int(marks[at]) if at < len(marks) else n, last + most, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunk_digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _chunks(text: str | None, name: Callable[[bytes], bytes]) -> tuple[bytes, list[bytes], list[bytes]]:
    data, start, digests, contents = (text or "").encode().lower(), 0, [], []
    for end in cut_points(data):
        contents.append(data[start:end])
        digests.append(name(contents[-1]))
        start = end
    return data, digests, contents


def chunk_rows(docs: DataFrame, name: Callable[[bytes], bytes] = chunk_digest) -> DataFrame:
    """One row per chunk: text_sha256, pos, digest, content."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
        for batch in slices(batches, "text", BATCH_BYTES):
            cols = ([], [], [], [])
            for text in batch.column("text"):
                data, digests, contents = _chunks(text.as_py(), name)
                for c, v in zip(cols, ([hashlib.sha256(data).hexdigest()] * len(digests), range(len(digests)), digests, contents), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["text_sha256", "pos", "digest", "content"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "text_sha256 string, pos int, digest binary, content binary")


def recipe_rows(docs: DataFrame, name: Callable[[bytes], bytes] = chunk_digest) -> DataFrame:
    """One row per document: doc_id, text_sha256, n_bytes, recipe (digests in order)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cols: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data, digests, _ = _chunks(text.as_py(), name)
                for c, v in zip(cols, (doc_id, hashlib.sha256(data).hexdigest(), len(data), digests), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "text_sha256", "n_bytes", "recipe"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text_sha256 string, n_bytes long, recipe array<binary>")


def clashes(chunks: DataFrame) -> DataFrame:
    """Different chunks that share a digest, with their ordinals: found by comparing the bytes of all distinct chunks.

    The bytes move once, to the distinct chunks; digests alone are then counted, and only chunks of a digest
    with several contents are numbered.
    """
    distinct = chunks.groupBy("digest", "content").agg(F.count("*").alias("uses"))
    several = keep(distinct.groupBy("digest").agg(F.count("*").alias("of")).where("of > 1").select("digest"))
    if several.isEmpty():
        return several.select("digest", F.lit(None).cast("binary").alias("content"), F.lit(1).alias("ordinal"))
    numbered = distinct.join(several, "digest", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("content")))
    return numbered.select("digest", "content", "ordinal")


def exact_groups(docs: DataFrame, name: Callable[[bytes], bytes] = chunk_digest) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest doc_id of equal texts), group_size, kept, text_sha256.

    Rows that repeat id and text share one decision.
    """
    clashing = keep(clashes(chunk_rows(docs, name)))
    named = recipe_rows(docs, name)
    if not clashing.isEmpty():
        named = _with_ordinals(chunk_rows(docs, name), named, clashing)
    grouped = named.groupBy("n_bytes", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    repeated = grouped.where("group_size > 1")
    joined = named.join(repeated, ["n_bytes", "recipe"], "left")
    keeps = F.coalesce("keep_id", "doc_id")
    return joined.select("doc_id", keeps.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keeps).alias("kept"), "text_sha256")


def _with_ordinals(chunks: DataFrame, recipes: DataFrame, clashing: DataFrame) -> DataFrame:
    """Adds to the clashing digests of each recipe the chunks' ordinals. Rows of one text share its recipe, whatever their ids."""
    marked = chunks.join(clashing, ["digest", "content"]).where("ordinal > 1")
    marked = marked.groupBy("text_sha256", "pos").agg(F.max("ordinal").cast("string").alias("ordinal"))
    by_text = marked.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ordinal"))).alias("marks"))
    named = F.transform("recipe", lambda x, i: F.concat(x, F.coalesce(F.try_element_at("marks", i), F.lit("")).cast("binary")))
    return recipes.join(by_text, "text_sha256", "left").withColumn("recipe", F.when(F.col("marks").isNull(), F.col("recipe")).otherwise(named)).drop("marks")
