"""An inverted index of three-character grams over names and symbol paths, for substring lookups by equi-joins.

Texts are lower-cased and end with two stops, so that every character starts a gram. A text that holds a lookup of
three characters or more holds all of its grams: the PICKED rarest of them, by the index's counts, name the candidates by
intersecting their postings. A shorter lookup takes the union of the grams that begin with it. What is a candidate is then
checked exactly by the caller. An empty lookup has no candidates. Postings are bucketed and sorted by gram: those of few
grams are read from their buckets alone, those of more are joined without being dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching as M
from ..storage import forget, keep, keep_bucketed

SIZE, PICKED, STOP = 3, 3, "\x00"
SCANNED = 64  # lookups that one scan of the names serves; more go by the index
LITERALS, POSTINGS_A_BUCKET, MOST_BUCKETS = 2000, 1_000_000, 4096


def grams(text: Column) -> Column:
    """The grams that start at each character of a lower-case text."""
    ends = F.concat(text, F.lit(STOP * (SIZE - 1)))
    return F.when(F.length(text) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(ends, i, SIZE)))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class TargetIndex:
    """entities (canonical_id, name, qualified_name), postings (gram, canonical_id) and counts (gram, n)."""

    entities: DataFrame
    postings: DataFrame
    counts: DataFrame

    def candidates(self, lookups: DataFrame) -> DataFrame:
        """query_id, lookup, canonical_id, name, qualified_name of lookups (query_id, lookup in lower case)."""
        lookups = lookups.select("query_id", "lookup").where("lookup <> ''").distinct()
        whole = lookups.where(F.length("lookup") >= SIZE)
        own = F.filter(grams(F.col("lookup")), lambda g: ~F.contains(g, F.lit(STOP)))
        asked = whole.select("query_id", "lookup", F.size(own).alias("grams"), F.explode(own).alias("gram"))
        found = asked.join(self.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a gram that no text holds is the rarest
        rarest = Window.partitionBy("query_id", "lookup").orderBy("n", "gram")
        picked = found.withColumn("nth", F.row_number().over(rarest)).where(F.col("nth") <= PICKED).select("query_id", "lookup", "gram", F.least("grams", F.lit(PICKED)).alias("needed"))
        for size in range(1, SIZE):
            short = lookups.where(F.length("lookup") == size)
            begins = self.counts.select("gram", F.substring("gram", 1, size).alias("lookup"))
            picked = picked.unionByName(short.join(begins, "lookup").select("query_id", "lookup", "gram", F.lit(1).alias("needed")))
        picked = keep(picked)  # a few grams a lookup
        wanted = [r["gram"] for r in picked.select("gram").distinct().limit(LITERALS + 1).collect()]
        postings = self.postings.where(F.col("gram").isin(*wanted)) if len(wanted) <= LITERALS else self.postings
        met = picked.join(postings, "gram").groupBy("query_id", "lookup", "canonical_id").agg(F.count("*").alias("met"), F.max("needed").alias("needed"))
        return met.where("met >= needed").select("query_id", "lookup", "canonical_id").join(self.entities, "canonical_id")


class Names:
    """Lookups over the names of a graph: some SCANNED at once read the names through, more go by the index, written when it is first needed."""

    def __init__(self, entities: DataFrame):
        self.entities, self.made = entities.select("canonical_id", "name", "qualified_name"), []

    @property
    def index(self) -> TargetIndex:
        if not self.made:
            self.made.append(index(self.entities))
        return self.made[0]

    def candidates(self, lookups: DataFrame) -> DataFrame:
        """query_id, lookup, canonical_id, name, qualified_name of lookups (query_id, lookup in lower case); an entity that is listed twice comes twice."""
        asked = keep(lookups.select("query_id", "lookup").where("lookup <> ''").distinct())
        texts = [r["lookup"] for r in asked.select("lookup").distinct().limit(SCANNED + 1).collect()]
        if len(texts) > SCANNED:
            return self.index.candidates(asked)
        name, symbol = F.lower("name"), F.lower(M.symbol_path(F.col("qualified_name")))
        held = F.filter(F.array(*map(F.lit, texts)).cast("array<string>"), lambda t: F.contains(F.col("_name"), t) | F.contains(F.col("_symbol"), t))
        found = self.entities.withColumns({"_name": name, "_symbol": symbol}).withColumn("lookup", F.explode(held)).drop("_name", "_symbol")
        return found.join(asked, "lookup").select("query_id", "lookup", "canonical_id", "name", "qualified_name")


def index(entities: DataFrame, stored: bool = True) -> TargetIndex:
    """The index of entities; written once, unless it is to serve a single question."""
    entities = entities.select("canonical_id", "name", "qualified_name")
    texts = F.array_union(grams(F.lower("name")), grams(F.lower(M.symbol_path(F.col("qualified_name")))))
    postings = entities.select(F.explode(texts).alias("gram"), "canonical_id")
    if stored:
        whole = keep(postings)
        buckets = max(1, min(MOST_BUCKETS, -(-whole.count() // POSTINGS_A_BUCKET)))
        postings = keep_bucketed(whole, "gram", buckets, ["gram", "canonical_id"])
        forget(whole)
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    return TargetIndex(entities, postings, keep(counts) if stored else counts)
