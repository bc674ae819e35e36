"""License scans: MinHash bands over overlapping windows, then exact shingle containment. DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits; shingles are five words. Templates fall into size classes by
their number of shingles c/2 < t <= c (c a power of two). Windows of 3c/2 shingles start every c/2, so any
place of a template lies whole inside a window, and a window that holds 0.8 of it has a Jaccard similarity
of a quarter at least. With BANDS bands of one row, it collides with probability 1 - 0.75**BANDS > 0.999;
one-shingle templates meet windows of one shingle, which collide always. Candidates are verified by the
share of the template's shingles (the words, not their hashes) that the window holds.

The templates are a fixed parameter table, so it may be broadcast: one-line notices, and the full texts and
standard headers in license_texts (LICENSE__kind.txt, without copyright lines). A window shares a band with a
template only where it holds the template's smallest shingle of that band, so the bands' smallest shingles
are the index: a text that holds none of a size class's shares no band there and is cut into no windows.
Similar templates (BSD with two and three clauses, headers of the GPL family) share many shingles; of those
that one place holds, the one with most shingles found stands. Defined results: null, empty and short
texts (under five words) hold no template; repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

WORDS, LEAST, BANDS = 5, 0.8, 28

# Notices of public licenses.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD License.",
}

# Texts and standard headers of common licenses; a license may have several.
TEXTS = [(p.stem.split("__")[0], p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
SIMILAR = 0.5



def size_class(shingles: int) -> int:
    return 1 << max(0, shingles - 1).bit_length()


def _shingles(words: Column) -> Column:
    """Shingles of an array of words, as strings."""
    at = F.when(F.size(words) >= WORDS, F.sequence(F.lit(1), F.size(words) - (WORDS - 1)))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, WORDS), " "))


def _least(hashes: Column, band: int) -> Column:
    """The smallest shingle of a band: each band hashes shingle and number together, so its order is of its own."""
    return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(band))))


def _bands(hashes: Column, c: int) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("band"), _least(hashes, k).alias("least")) for k in range(1 if c == 1 else BANDS)))


def _smallest_of_bands(hashes: Column) -> Column:
    """The shingles that decide a template's bands."""
    def first(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("least"), x.alias("shingle"))))["shingle"]

    return F.array_distinct(F.array(*(first(k) for k in range(BANDS))))


def _windows(c: int) -> Column:
    """Overlapping windows of a size class: place, bands and words."""
    width = max(1, 3 * c // 2)
    starts = F.sequence(F.lit(1), F.size("hashes"), F.lit(max(1, c // 2)))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), _bands(F.slice("hashes", i, width), c).alias("bands"), F.slice("words", i, width + WORDS - 1).alias("part")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _wanted(notice: str) -> list[str]:
    """Different shingles of a template."""
    w = re.findall(r"[^\W_]+", notice.lower())
    return list(dict.fromkeys(" ".join(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)))


def _families(wanted: list[list[str]]) -> list[int]:
    """A number for each template, the same for templates that share SIMILAR of the larger's shingles."""
    family, sets = list(range(len(wanted))), [set(w) for w in wanted]
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= SIMILAR * max(len(sets[i]), len(sets[j])):
                family = [family[j] if f == family[i] else f for f in family]
    return family


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment (the largest of a window) and word_at (the first such window) of each row that holds a template."""
    spark, chosen = docs.sparkSession, [(k, _wanted(v)) for k, v in (sorted(templates.items()) if templates else [*sorted(TEMPLATES.items()), *TEXTS])]
    chosen = [(k, w) for k, w in chosen if w]
    family = _families([w for _, w in chosen])
    step = {f: max(1, max(size_class(len(w)) for (_, w), g in zip(chosen, family, strict=True) if g == f) // 2) for f in family}
    rows = [(k, f, step[f], size_class(len(w)), w) for (k, w), f in zip(chosen, family, strict=True)]
    known = keep(spark.createDataFrame(rows, "license string, family int, step int, c int, wanted array<string>").withColumn("own", F.transform("wanted", lambda s: F.xxhash64(s))))
    index: dict[int, set[int]] = {}
    for r in known.select("c", _smallest_of_bands(F.col("own")).alias("smallest")).collect():  # as large as the templates
        index.setdefault(r["c"], set()).update(r["smallest"])
    among = lambda hashes: f"h -> h IN ({', '.join(f'{x}L' if x > -(2**63) else 'long(-9223372036854775808)' for x in sorted(hashes))})"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), _words(F.col("text").cast("string")).alias("words")).where(F.size("words") >= WORDS)
    texts = texts.select("doc_id", "_row", "words", F.transform(_shingles(F.col("words")), lambda s: F.xxhash64(s)).alias("hashes"))
    # Kept once, as every size class reads them.
    texts = keep(texts.where(F.expr(f"exists(hashes, {among(set().union(*index.values()))})")))
    found = []
    for c in sorted(index):
        fewest = ceil(round(least * min(len(w) for _, _, _, k, w in rows if k == c), 9))
        able = texts.where(F.size("hashes") >= fewest).where(F.expr(f"exists(hashes, {among(index[c])})"))
        windows = able.select("doc_id", "_row", F.explode(_windows(c)).alias("w"))
        keyed = windows.select("doc_id", "_row", F.col("w.at").alias("at"), F.col("w.part").alias("part"), F.explode("w.bands").alias("key"))
        bands = known.where(F.col("c") == c).select("license", "family", "step", "wanted", F.explode(_bands(F.col("own"), c)).alias("key"))
        met = keyed.join(F.broadcast(bands), "key")  # as large as the templates, a parameter
        share = F.size(F.array_intersect("wanted", _shingles(F.col("part")))) / F.size("wanted")
        found.append(met.select("doc_id", "_row", "license", "family", "step", "at", share.alias("share"), F.size("wanted").alias("size")).where(F.col("share") >= least))
    # Of similar templates at one place, the one with most shingles found stands: a longer one that is nearly whole before a shorter one inside it.
    rank = F.struct(F.round(F.col("share") * F.col("size")), "share")
    same = Window.partitionBy("doc_id", "_row", "family", F.floor((F.col("at") - 1) / F.col("step")))
    both = reduce(DataFrame.unionByName, found).withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(same)).where("_rank = _best")
    best = both.groupBy("doc_id", "_row", "license").agg(F.max("share").alias("containment"), F.min("at").cast("long").alias("word_at"))
    return best.select("doc_id", "license", F.round("containment", 6).alias("containment"), (F.col("word_at") - 1).alias("word_at"))
