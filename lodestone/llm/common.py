"""What the operators share: shipping code, bounded slices of Arrow batches, stable folds and bounded samples."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import drop_shuffles, forget, keep, table, work_folder  # noqa: F401

FOLDS = 5
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1000
BATCH_SETTING, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b", 4 << 20


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the same package is installed on every executor."""
    return public_tokenizers.path(name)


@functools.cache
def _package_zip() -> str:
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")  # read by the driver alone, which sends it
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per SparkContext, so that Python stages can import it.

    Also bounds the bytes of a batch on its way to Python, where the session still has Spark's default: a batch is held
    by the JVM and by the worker, and the plan of a lazy result reads the setting only when it runs. It changes no results.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    if not getattr(sc, "_lodestone_shipped", False):
        sc.addPyFile(_package_zip())
        sc._lodestone_shipped = True


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of bounded size, whatever the session's batch size; a longer text is a slice of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            end = int(np.searchsorted(size, before + most_bytes, "right"))
            end = min(max(end, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, null as empty, and where each text starts, with the end."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def cut_words(column: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts, A-Z lower-cased, and the number of each word's text.

    inside tells of each of the 256 bytes whether it belongs to words; it must hold all or none beyond ASCII, so
    that words are whole characters.
    """
    return cut_bytes(*text_bytes(column), inside)


def cut_bytes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """As cut_words, from UTF-8 bytes and where each text starts, with the end."""
    data = LOWER[data]
    mask = inside[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    first[heads] = mask[heads]  # a word ends with its text
    offsets = np.append(np.flatnonzero(first[mask]), int(mask.sum())).astype(np.int64)
    doc = np.searchsorted(starts, np.flatnonzero(first), "right") - 1
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[mask])]), doc


def stretches(data: np.ndarray, inside: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The bytes of a text in stretches of about `most`, cut outside words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        if end < len(data):
            gaps = np.flatnonzero(~inside[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word, longer than a stretch
                while end < len(data) and inside[data[end]]:
                    end += 1
        yield data[at:end]
        at = end


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out fold. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 0


def parts_for(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def smallest(rows: DataFrame, by: list[str], pick: Column, most: int, tie: list[str]) -> DataFrame:
    """Of each group, the `most` rows with the smallest `pick`, a 64-bit hash read as unsigned; ties by `tie`.

    Only rows under a threshold are sorted: it lets four times `most` rows of a group pass on average, so no
    task sorts a whole group. Where too few pass, the group is sorted whole.
    """
    rows = rows.withColumn("_pick", F.shiftrightunsigned(pick, 1))
    unit = F.col("_pick").cast("double") / F.lit(float(2**63))
    share = F.least(F.lit(1.0), F.lit(4.0 * most) / F.col("_n"))
    # One row a group: the classes of the model that is fitted on them, so broadcasting moves less than the model.
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    passed = rows.join(F.broadcast(sizes), by).where(unit < share).groupBy(*by).agg(F.count("*").alias("_passed"))
    enough = F.coalesce("_passed", F.lit(0)) >= F.least("_n", F.lit(most))
    limits = sizes.join(F.broadcast(passed), by, "left").select(*by, F.when(enough, share).otherwise(2.0).alias("_share"))
    order = Window.partitionBy(*by).orderBy("_pick", *tie)
    near = rows.join(F.broadcast(limits), by).where(unit < F.col("_share"))
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r", "_share", "_pick")
