"""Source divergence audit: how far the term frequencies of a source stand from those of the other sources of its language.

Terms are runs of ASCII letters and bytes beyond ASCII, A-Z lower-cased. A language keeps the terms of at
least LEAST_DOCS of its documents. Tasks count the terms of their texts, Spark sums the counts by language,
source and term, and each kept term becomes one wide row: an array of its counts, indexed by the sources of
the language. Higher-order functions turn the array into smoothed shares p = 1 + floor(SCALE * (count + 2) /
(N + 2V)) and emit the contribution floor((p - q)^2 / (p + q)) of every pair of sources, which map-side
aggregation sums. All arithmetic is on integers, decimals where a product may pass 64 bits.

A row is as wide as its language has sources, and the result has a row for each pair of sources of a language;
nothing else grows with the square of anything.

Defined results: null text, lang and source read as ''; a source without terms has N = 0 and takes part; a
language without kept terms has pairs of value 0; repeated rows count as often as they stand; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_words, keep, ship, slices

LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
BATCH_TEXT = 8 << 20
FEW_GROUPS = 100_000  # more (language, source) rows than this are joined by a shuffle instead of a broadcast

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys of a sorted array starts, and its length."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))


def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, count and docs (in how many of the texts) of a batch of lang, source, text."""
    terms, doc = cut_words(batch.column("text"), LETTER)
    terms, langs, sources = terms.dictionary_encode(), batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy(zero_copy_only=False)
    many = max(1, len(terms.dictionary))
    key = np.sort(doc * many + terms.indices.to_numpy(zero_copy_only=False))
    first, times = runs(key)
    of_doc, term = np.divmod(key[first], many)
    key = group[of_doc] * many + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, docs = runs(key)
    count = np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
    of_group, term = np.divmod(key[first], many)
    of_lang, of_source = np.divmod(of_group, max(1, len(sources.dictionary)))
    cols = [langs.dictionary.take(pa.array(of_lang)), sources.dictionary.take(pa.array(of_source)), terms.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(count, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs; one row for each of the three keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_TEXT, 1 << 20):
            yield count_terms(batch)

    ship(docs.sparkSession)
    counted = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _whole(a: Column, b: Column) -> Column:
    """floor(a / b) of non-negative decimals or longs."""
    return F.call_function("div", a, b)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total); a share is at most 1, so the quotient fits 64 bits."""
    up = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return _whole(up, total.cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), p + q)


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top) if top else out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources (pair), terms used beyond the language's share (term)."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    wide = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"), F.map_from_entries(F.collect_list(F.struct("source", "count"))).alias("counts"))
    wide = keep(wide.where(F.col("docs") >= least_docs).drop("docs"))
    terms = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("count").alias("n"))
    sums = wide.select("lang", F.explode("counts").alias("source", "count")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("group"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list("group")).alias("groups")).join(terms, "lang", "left")
    langs = keep(langs.select("lang", "groups.source", F.transform("groups", lambda g: g["n"] + 2 * F.coalesce("v", F.lit(0))).alias("total"), (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("all")))
    few = langs.agg(F.coalesce(F.sum(F.size("source")), F.lit(0))).first()[0] <= FEW_GROUPS
    side = F.broadcast(langs) if few else langs
    # The wide vectors: one share a source, and that of the whole language.
    shares = F.zip_with("source", "total", lambda s, t: _share(F.coalesce(F.col("counts")[s], F.lit(0)), t))
    vectors = wide.join(side, "lang").select("lang", "term", "counts", "source", shares.alias("p"), _share(F.col("count"), F.col("all")).alias("q"))
    after = lambda i: F.slice("p", i + 1, F.size("p"))
    places = F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    gaps = F.flatten(F.transform(places, lambda i: F.transform(after(i), lambda q, k: F.struct(i.alias("a"), (i + k + 1).alias("b"), _gap(F.col("p")[i - 1], q).alias("value")))))
    pairs = vectors.select("lang", F.explode(gaps).alias("gap")).groupBy("lang", "gap.a", "gap.b").agg(F.sum("gap.value").alias("value"))
    both = pairs.select("lang", "a", "b", "value").unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    every = langs.select("lang", "source", F.posexplode("source").alias("a", "own")).select("lang", "a", "own", F.posexplode("source").alias("b", "item"))
    every = every.where("a <> b").select("lang", (F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b"), F.col("own").alias("source"), "item")
    pair = every.join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    more = F.arrays_zip("source", "p")
    used = vectors.select("lang", "term", "q", "counts", F.explode(more).alias("own")).where("own.p > q AND counts[own.source] > 0")
    term = used.select("lang", "own.source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("own.p"), F.col("q")).cast("long").alias("value"))
    return _ranked(pair).unionByName(_ranked(term, top))
