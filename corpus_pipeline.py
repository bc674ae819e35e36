"""The corpus pipeline: language ID, quality, exact dedup, near dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents. The two filters judge each row where it is. The two deduplications join their decisions
back by doc_id and 128 bits or more of the text, so rows whose doc_id is null or repeats are judged by their
own text, and no row is lost or doubled by its id. Further columns of documents travel along. An empty table
passes through every stage. ORACLE_SQL is None: trained models and token ids are beyond SQL;
tests/llm/test_pipeline.py holds each stage against a brute-force version.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, langid, quality
from lodestone.llm.chunks import exact_groups
from lodestone.llm.common import forget, keep, table
from lodestone.llm.packing import pack_documents

LEAST_LANGUAGE_SCORE = 0.4


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until docs has no such columns."""
    out = []
    for name in names:
        while name in docs.columns:
            name += "_"
        out.append(name)
    return out


def _kept(docs: DataFrame, keys: dict[str, Column], chosen: DataFrame) -> DataFrame:
    """One row of docs for each row of chosen (doc_id and the names of keys; n, how often docs holds it)."""
    names = _free(docs, *keys, "_n")
    chosen = chosen.select(F.col("doc_id").alias("_chosen_id"), *(F.col(k).alias(name) for k, name in zip(keys, names, strict=False)), F.col("n").alias(names[-1]))
    (number,) = _free(docs, "_chosen_id")
    chosen = keep(chosen.withColumnRenamed("_chosen_id", number))
    keyed = docs.withColumns(dict(zip(names, keys.values(), strict=False)))
    same_id = keyed["doc_id"].cast("long").eqNullSafe(chosen[number])
    joined = keyed.join(chosen, [same_id, *(keyed[k] == chosen[k] for k in names[:-1])]).select(*(keyed[c] for c in keyed.columns), chosen[names[-1]])
    once = joined.where(F.col(names[-1]) == 1).select(*docs.columns)
    if chosen.where(F.col(names[-1]) > 1).isEmpty():
        return once
    # Rows that repeat id and text: one of each stays.
    again = joined.where(F.col(names[-1]) > 1).dropDuplicates(["doc_id", *names[:-1]])
    return once.unionByName(again.select(*docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (`und`: null, empty or letterless texts) or with a score under LEAST_LANGUAGE_SCORE.

    Repeated rows are judged alike.
    """
    return langid.speaking(docs, langid.learn(docs), LEAST_LANGUAGE_SCORE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored under the threshold; a null text is scored as an empty one, repeated rows alike."""
    return quality.good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts, once; a null id is the smallest, a null text equals an empty one.

    Of rows that repeat id and text, one stays.
    """
    found = exact_groups(docs)
    chosen = found.where("doc_id <=> keep_id").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    low = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return _kept(docs, {"text_sha256": F.sha2(low, 256)}, chosen)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near duplicates; a null id only where all are null.

    Texts without words link with nothing and stay. Of rows that repeat id and group, one stays.
    """
    found = jaccard.linked_classes(docs).where("class IS NOT NULL").groupBy("class", "doc_id", *jaccard.TEXT_KEY).agg(F.count("*").alias("n"))
    row = F.struct("doc_id", *jaccard.TEXT_KEY, "n")
    best = F.struct(F.col("doc_id").isNull(), "doc_id", *jaccard.TEXT_KEY)
    chosen = found.groupBy("class").agg(F.min_by(row, best).alias("row")).select("row.*")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _kept(docs.where(words), dict(zip(jaccard.TEXT_KEY, jaccard.text_key(), strict=True)), chosen).unionByName(docs.where(~words))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences, one row a piece; a null text is an empty one."""
    return pack_documents(docs)


STAGES = [("language_id", language), ("quality", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
