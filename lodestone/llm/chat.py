"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is `<|turn|>` role `<|text|>` text `<|end|>`. Inside roles and
texts, a backslash and `<` are escaped, so that no mark can stand there; unescaping is exact. The rendered
string is encoded once, with offsets; the sorted spans of assistant texts meet the token spans by binary
search. The loss mask covers what both spans share.

Rows are sorted by conversation and turn and streamed: a long conversation is rendered and encoded in stretches
of whole turns of some STRETCH characters. A mark is one token, and nothing crosses it, so the stretches' tokens
are those of the whole; no task holds more than a stretch.

Defined results: null text and null role are empty; turns without a number come first,
equal numbers order by role, then text; repeated
rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, tokenizer_path

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED = "assistant"
STRETCH = 1 << 20
OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "<" if m[1] == "l" else m[1], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and the spans (start, end) of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, text = turn.removesuffix(END).split(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([TURN, TEXT, END])  # marks are tokens of their own, so no token runs across one
    return tok


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask over tokens, and the stretches of characters that the masked tokens share with spans, each once and in order."""
    mask, pieces = np.zeros(len(offsets), bool), []
    for lo, hi in spans:
        if lo == hi or not len(offsets):
            continue
        first = int(np.searchsorted(offsets[:, 1], lo, "right"))
        last = int(np.searchsorted(offsets[:, 0], hi, "left"))
        mask[first:last] = True
        at = lo
        for a, b in offsets[first:last]:
            a, b = max(at, int(a)), min(hi, int(b))
            if a < b:
                pieces.append((a, b))
                at = b
    return mask, pieces


class Digest:
    """What is returned of a conversation, gathered stretch by stretch."""

    def __init__(self, tok, stretch: int):
        self.tok, self.stretch, self.turns, self.held = tok, stretch, [], 0
        self.sums = [0, 0, 0, 0, 0]  # turns, loss characters, formatted characters, tokens, masked tokens
        self.of_turns, self.of_loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        self.held += len(role) + len(text)
        if self.held > self.stretch:
            self.flush()

    def flush(self) -> None:
        if not self.turns:
            return
        formatted, spans = render(self.turns)
        offsets = np.array(self.tok.encode(formatted, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        mask, pieces = loss_mask(offsets, spans)
        loss = unescape("".join(formatted[a:b] for a, b in pieces))
        back = read_back(formatted)
        for role, text in back:
            self.of_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.of_loss.update(loss.encode("utf-8", "surrogatepass"))
        self.sums = [a + b for a, b in zip(self.sums, (len(back), len(loss), len(formatted), len(mask), int(mask.sum())), strict=True)]
        self.turns, self.held = [], 0

    def row(self, conv_id: int | None) -> tuple:
        self.flush()
        turns, loss, formatted, tokens, masked = self.sums
        return conv_id, turns, self.of_turns.hexdigest(), loss, self.of_loss.hexdigest(), formatted, tokens, masked


def format_conversations(rows: DataFrame, tokenizer: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text); what it returns is read from the formatted string."""
    ship(rows.sparkSession)
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in OUT.split(", ")]
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        tok, now, digest, out = _tokenizer(path), None, None, []
        for batch in slices(batches, "text"):
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or conv_id != now:
                    if digest is not None:
                        out.append(digest.row(now))
                    now, digest = conv_id, Digest(tok, stretch)
                digest.add(role, text)
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if digest is not None:
            out.append(digest.row(now))
        if out:
            yield batch_of(out)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, OUT)
