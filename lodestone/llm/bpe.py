"""Byte-level BPE encoding and decoding of whole texts.

A text is cut into overlapping chunks of CHUNK characters. A match of the pre-token pattern depends only on
what follows its start, so once two neighbouring chunks share a boundary, all later boundaries agree: the
chunks are stitched at the first shared boundary in their overlap that no white space precedes (a run of it
is split by what follows it), and the pieces between the stitches are encoded. Where an overlap has no
shared boundary (one pre-token longer than it), the neighbours merge. Decoding concatenates the ids' raw bytes.

The chunks of a text of up to FAR characters are stitched in the task that holds the text. Those of a longer
one are dealt to many tasks, FAR / 16 characters each, pre-tokenised and encoded in parallel, and put together in order.

Defined results: null and empty texts have no ids (0 tokens, digests of nothing, one piece); repeated rows give
repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, slices, tokenizer_path

CHUNK, OVERLAP = 2_048, 256
FAR = 1 << 20
CACHE_WORDS, LONG_WORD = 300_000, 64

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long"
NAMES = [x.split()[0] for x in OUT.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

#: White space as the encoder's regular expressions define it; Python's class has four control characters more.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Encodes stretches of text; remembers those between blanks, in a table of bounded size."""

    def __init__(self, ranks_path: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?=[{SPACE}]|\\Z)").replace(r"\s+", f"[{SPACE}]+"))
        self.after_space = re.compile(r"\s ")
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _stretch(self, text: str) -> tuple[int, str, bytes]:
        ids = self.bpe.encode_ordinary(text)
        return len(ids), "".join([f"{i}," for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def __call__(self, text: str) -> tuple[int, str, bytes]:
        """Tokens, decimal ids each followed by a comma, and the ids' bytes."""
        if not text or self.after_space.search(text):
            return self._stretch(text)
        # No blank follows white space: a pre-token starts at each blank and none runs across it.
        first, *rest = text.split(" ")
        known = self.known
        try:
            found = [known[w] for w in rest]
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            found = []
            for w in rest:
                if (x := known.get(w)) is None:
                    x = self._stretch(" " + w)
                    if len(w) <= LONG_WORD:
                        known[w] = x
                found.append(x)
        found.insert(0, self._stretch(first))
        counts, ids, raw = zip(*found, strict=True)
        return sum(counts), "".join(ids), b"".join(raw)

    def boundaries(self, text: str) -> list[int]:
        """Where pre-tokens start, and the end."""
        return [m.start() for m in self.pattern.finditer(text)] + [len(text)]

    def pieces(self, text: str, chunk: int, overlap: int) -> list[str]:
        """The text cut where overlapping chunks share a pre-token boundary."""
        out, lo = [], 0
        for start in range(chunk, len(text) - overlap, chunk):
            inside = text[lo : start + overlap]
            tail = {lo + i for i in self.boundaries(inside)[:-2] if lo + i >= start and not text[lo + i - 1].isspace()}
            head = (start + i for i in self.boundaries(text[start : start + 2 * overlap]) if i <= overlap)
            meets = next((i for i in head if i in tail), None)
            if meets is not None:
                out.append(text[lo:meets])
                lo = meets
        return [*out, text[lo:]]

    def whole(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, str, str, int]:
        """Tokens, digests of the ids and of the decoded bytes, pieces."""
        pieces = self.pieces(text, chunk, overlap)
        counts, ids, raw = zip(*map(self, pieces), strict=True)
        return *_digest_row(sum(counts), "".join(ids), b"".join(raw)), len(pieces)


@functools.cache
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


def _digest_row(n: int, ids: str, raw: bytes) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids[:-1].encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _batch(cols: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def encode_near(docs: DataFrame, ranks_path: str, chunk: int, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path)
        for batch in slices(batches, "text"):
            rows = [code.whole(text.as_py() or "", chunk, overlap) for text in batch.column("text")]
            yield _batch([batch.column("doc_id"), *zip(*rows, strict=True)], NAMES, KINDS)

    return docs.mapInArrow(run, OUT)


def cut_chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Overlapping chunks (start, text): each runs `overlap` characters into the next."""
    return [(start, text[start : start + chunk + overlap]) for start in range(0, max(1, len(text) - overlap), chunk)]


def encode_far(docs: DataFrame, ranks_path: str, chunk: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                key = hashlib.sha256(text.encode()).hexdigest()
                parts = cut_chunks(text, chunk, overlap)
                yield _batch([[doc_id] * len(parts), [key] * len(parts), list(range(len(parts))), [p[0] for p in parts], [p[1] for p in parts]], ["doc_id", "key", "k", "start", "part"], [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoder(ranks_path).boundaries
        for batch in batches:
            starts, heads, tails = batch.column("start").to_pylist(), [], []
            for start, part in zip(starts, batch.column("part"), strict=True):
                at = split(text := part.as_py())
                heads.append([start + i for i in at if i <= overlap])
                # the last two may hang on what the chunk doesn't hold
                tails.append([start + i for i in at[:-2] if i >= chunk and not text[i - 1].isspace()])
            names = ["doc_id", "key", "k", "start", "part", "copies", "head", "tail"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:6]), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(ranks_path)
        for batch in batches:
            rows = []
            for start, part, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("start", "part", "from", "to")), strict=True):
                rows.append(code(part[lo - start : len(part) if hi is None else hi - start]))
            n, ids, raw = zip(*rows, strict=True) if rows else ([], [], [])
            names = ["doc_id", "key", "k", "copies", "n", "ids", "raw"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.binary())], names=names)

    def assemble(key, table):
        table = table.sort_by("k")
        raw = b"".join(table.column("raw").to_pylist())
        ids = "".join(table.column("ids").to_pylist())
        copies = table.column("copies")[0].as_py()
        row = (key[0].as_py(), *_digest_row(sum(table.column("n").to_pylist()), ids, raw), table.num_rows)
        return pa.table([pa.array([v] * copies, k) for v, k in zip(row, KINDS, strict=True)], names=NAMES)

    parts = docs.mapInArrow(cut, "doc_id long, key string, k int, start long, part string")
    parts = parts.groupBy("doc_id", "key", "k", "start").agg(F.first("part").alias("part"), F.count("*").alias("copies"))  # equal keys: equal parts
    split = parts.select("doc_id", "key", "k", "start", "part", "copies").mapInArrow(pretokenise, "doc_id long, key string, k int, start long, part string, copies long, head array<long>, tail array<long>")
    order = Window.partitionBy("doc_id", "key").orderBy("k")
    split = split.withColumn("meets", F.array_min(F.array_intersect(F.lag("tail").over(order), "head")))  # where it meets the chunk before
    whole = Window.partitionBy("doc_id", "key")
    split = split.withColumn("torn", F.max((F.col("k") > 0) & F.col("meets").isNull()).over(whole))
    owned = split.where("not torn").withColumn("from", F.coalesce("meets", F.lit(0))).withColumn("to", F.lead("meets").over(order))
    coded = owned.select("doc_id", "key", "k", "copies", "start", "part", "from", "to").mapInArrow(encode, "doc_id long, key string, k int, copies long, n long, ids string, raw binary")
    stitched = coded.groupBy("doc_id", "key").applyInArrow(assemble, OUT)

    def rejoin(key, table):
        """A text whose neighbouring chunks share no boundary is merged and encoded in one piece."""
        table = table.sort_by("k")
        text, end = "", 0
        for start, part in zip(table.column("start").to_pylist(), table.column("part").to_pylist(), strict=True):
            text += part[end - start :]
            end = start + len(part)
        row = (key[0].as_py(), *encoder(ranks_path).whole(text))
        copies = table.column("copies")[0].as_py()
        return pa.table([pa.array([v] * copies, k) for v, k in zip(row, KINDS, strict=True)], names=NAMES)

    torn = split.where("torn").select("doc_id", "key", "k", "start", "part", "copies")
    return stitched.unionByName(torn.groupBy("doc_id", "key").applyInArrow(rejoin, OUT))


def encode_documents(docs: DataFrame, ranks_path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, far: int = FAR) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 and n_pieces of every whole text."""
    ship(docs.sparkSession)
    ranks_path = ranks_path or tokenizer_path("byte_bpe_multi_50k.tiktoken")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > far, F.lit(False))
    return encode_near(docs.where(~long), ranks_path, chunk, overlap).unionByName(encode_far(docs.where(long), ranks_path, max(far // 16, chunk), overlap))
