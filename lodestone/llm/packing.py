"""Best-fit packing of token pieces into sequences.

Best-fit decreasing runs over the length histogram (at most `budget` rows, whatever the corpus), which
gives runs of planned slots: "pieces of length L with rank lo..lo+n-1 go to sequences s, s+1, ... at
offset o". Documents then take their slots by joining on rank within length. Ranks are prefix sums over
(length, hash bucket) counts plus a row number inside the bucket, so no length is gathered in one task.

Defined results: null and empty texts are the single id 0; a text of any length is cut into pieces;
repeated rows each get their own slots; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, parts_for, ship, slices, tokenizer_path

BUDGET = 2048
RANK_ROWS = 50_000
CACHE_WORDS = 300_000
LONG_WORD = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and case, so no token crosses a blank: the text is cut at blanks and
    line feeds, and before a full stop or comma that closes a word of Latin letters or digits, and the ids of
    each distinct stretch are remembered. The table is bounded: two generations, of which the older one goes.
    A text that may name a special token is encoded in one piece, as the library finds those first.
    """

    #: A closing mark after anything but these letters and digits may belong to a longer run: no text that has one is cut there.
    RUN = re.compile(r"[^0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,][ \n]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content[:2]) for t in self.tok.get_added_tokens_decoder().values()) or "(?!)")
        vocabulary = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        if "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            text = text.lower()  # the tokenizer does it too, these two letters apart; here it makes words meet
        joined = text.replace("\n", " ")
        if not self.RUN.search(text):
            joined = joined.replace(". ", " . ").replace(", ", " , ")
        return joined.split(" ")

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() and len(w) <= LONG_WORD else other).append(w)
        found: dict[str, bytes] = {}
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group):  # one word, one end
                raw, start = ids.tobytes(), 0
                for w, end in zip(group, ends.tolist(), strict=True):
                    found[w] = raw[4 * start : 4 * end]
                    start = end
            else:
                other += group
        for w, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            found[w] = np.array(e.ids, "<u4").tobytes()
        return found

    def __call__(self, text: str) -> bytes:
        if self.special.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = self._words(text), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        older, new = self.older, []
        for w in set(words):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        found = self._encode(new)
        known.update((w, b) for w, b in found.items() if len(w) <= LONG_WORD)
        out = b"".join([known[w] if w in known else found[w] for w in words])
        if len(known) > CACHE_WORDS:
            self.older, self.known = known, {"": b""}
        return out


#: One table per tokenizer in each Python worker.
@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, budget: int = BUDGET) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Every text ends with id 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, budget)):
                    cut = ids[4 * start : 4 * (start + budget)]
                    rows.append((doc_id, piece, start, len(cut) // 4, zlib.crc32(cut)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan_slots(histogram: dict[int, int], budget: int = BUDGET) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows: (length, first rank, pieces, pieces a sequence, first sequence, first offset).

    Sequences in the same state are held as ranges, so the work depends on distinct lengths and not on
    pieces. Of the sequences with room, those with the least room that suffices are filled first.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first sequence, sequences)
    sizes: list[int] = []  # keys of room in order
    made = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not room[left]:
                bisect.insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    sizes.pop(at)
                each = left // length
                full, rest = divmod(min(todo, n * each), each)
                if full:
                    runs.append((length, rank, full * each, each, first, budget - left))
                    put(left - each * length, first, full)
                    rank, todo = rank + full * each, todo - full * each
                if rest:
                    runs.append((length, rank, rest, rest, first + full, budget - left))
                    put(left - rest * length, first + full, 1)
                    rank, todo = rank + rest, todo - rest
                used = full + bool(rest)
                put(left, first + used, n - used)
            else:
                n = -(-todo // (budget // length))
                put(budget, made, n)
                made += n
    return runs


def pack(pieces: DataFrame, budget: int = BUDGET, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...). Pieces must be stable when read twice."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `budget` rows
    buckets = parts_for(sum(histogram.values()), rank_rows)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_row", F.row_number().over(inside) - 1).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_row"))
    plan = spark.createDataFrame(plan_slots(histogram, budget), "length long, _lo long, _n long, _each long, sequence long, _at long")
    slot = (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_n"))
    nth = F.col("_rank") - F.col("_lo")
    return ranked.join(F.broadcast(plan), slot).select(  # the plan's size depends on `budget` alone
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence") + F.expr("(_rank - _lo) div _each")).alias("sequence_id"),
        (F.col("_at") + nth % F.col("_each") * ranked["length"]).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, budget: int = BUDGET) -> DataFrame:
    """Tokenise documents (doc_id, text), cut the long ones and pack all pieces into sequences of at most `budget` tokens."""
    return pack(keep(token_pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), budget)), budget)
