"""A graph as committed versions: batches of entities and evidence upsert it, readers see one version whole.

Tables lie in hash buckets, each a folder of files that are never written again. A batch writes the buckets that it touches
anew, under a name of its own, and takes the others over; the manifest of a version tells which folder
holds each bucket. Renaming the manifest into place is the commit: before it nobody sees the batch, a writer that fails leaves
the version before as it was, and of two writers from one version the second is refused.

entities are bucketed by id; evidence and relationships by the pair of their ends, so that a pair's order and its records
lie in one bucket; waiting, the relationships with an unknown end, by that end, so that a new entity finds what waits for it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVIDENCE, RELATIONSHIP
from ..storage import forget, keep
from .graph import Graph
from .ordinals import numbered
from .reconcile import KEY, reconcile

BUCKETS = 64
ENTITY = "canonical_id string, name string, qualified_name string, base_type string, roles array<string>, located boolean"
TABLES = {
    "entities": (ENTITY, ["canonical_id"]),
    "evidence": (f"{EVIDENCE}, commit_seq long", ["subject", "object"]),
    "relationships": (f"{RELATIONSHIP}, edge_seq long, pair_seq long", ["subject", "object"]),
    "waiting": ("end string, subject string, predicate string, object string", ["end"]),
}


class Conflict(RuntimeError):
    """Another writer has committed a version from the same parent."""


@dataclass
class Manifest:
    """folders: by table, the folder of each bucket (null: it holds nothing)."""

    number: int
    label: str
    buckets: int
    next_seq: int
    folders: dict[str, list[str | None]] = field(default_factory=dict)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows to be joined by dealing: files of ids next to null columns look small enough to be sent through the driver, and are not."""
    return rows.hint("merge")


class GraphVersions:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- manifests

    def _files(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return jvm, where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(self) -> list[int]:
        """The committed versions."""
        jvm, where, fs = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        """A version's manifest; of the last without a number, and an empty one where there is none."""
        found = self.numbers()
        if not found and number is None:
            return Manifest(0, "", self.buckets, 0, {t: [None] * self.buckets for t in TABLES})
        text = self.spark.read.text(f"{self.path}/manifests/{found[-1] if number is None else number}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest) -> None:
        jvm, where, fs = self._files()
        fs.mkdirs(where)
        draft = jvm.org.apache.hadoop.fs.Path(where, f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(where, f"{new.number}.json"), how)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {new.number} is committed already") from e
            raise

    # --- tables

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[table][1]), F.lit(self.buckets)).cast("int")

    def table(self, at: Manifest, table: str, touched: list[int] | None = None) -> DataFrame:
        """A table of a version, or some of its buckets: the files of the others are not opened."""
        schema, folders = TABLES[table][0], at.folders[table]
        paths = [f for k, f in enumerate(folders) if f and (touched is None or k in touched)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _touched(self, table: str, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(table)).distinct().collect())  # at most `buckets`

    def _write(self, at: Manifest, table: str, rows: DataFrame, touched: list[int]) -> list[str | None]:
        """rows are all that the touched buckets hold now."""
        columns = [x.split()[0] for x in TABLES[table][0].split(", ")]
        path = f"{self.path}/data/{table}-{uuid.uuid4().hex}"
        dealt = rows.select(*columns, self._bucket(table).alias("bucket"))
        dealt.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(path)
        held = {r[0] for r in self.spark.read.parquet(path).select("bucket").distinct().collect()} if touched and not rows.isEmpty() else set()
        return [(f"{path}/bucket={k}" if k in held else None) if k in touched else f for k, f in enumerate(at.folders[table])]

    def upsert(self, entities: DataFrame, evidence: DataFrame, now: datetime | Column, label: str, authority: DataFrame | None = None) -> Manifest:
        """Commit one batch: entities replace those of their id, evidence whose id is new is added, and what both touch is reconciled anew.

        entities: ENTITY columns. Weights are those of `now`; relationships that nothing touches keep theirs.
        """
        spark, parent = self.spark, self.manifest()
        made = []

        def kept(df: DataFrame) -> DataFrame:
            made.append(keep(df))
            return made[-1]

        folders = dict(parent.folders)
        at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
        # Entities: the touched buckets with the new rows in place of the old.
        names = [x.split()[0] for x in ENTITY.split(", ")]
        entities = kept(entities.select(*names).dropDuplicates(["canonical_id"]))
        places = self._touched("entities", entities)
        before = self.table(parent, "entities", places)
        fresh = kept(entities.join(_dealt(before.select("canonical_id")), "canonical_id", "left_anti").select("canonical_id"))
        folders["entities"] = self._write(parent, "entities", before.join(_dealt(entities.select("canonical_id")), "canonical_id", "left_anti").unionByName(entities), places)
        # Evidence: new by id within the buckets of its pairs.
        evidence = kept(evidence.dropDuplicates(["evidence_id"]))
        homes = self._touched("evidence", evidence)
        known = self.table(parent, "evidence", homes)
        nth = F.try_to_number(F.regexp_extract("evidence_id", r"([0-9]{1,18})$", 1), F.lit("9" * 18))
        added = numbered(evidence.join(_dealt(known.select("evidence_id")), "evidence_id", "left_anti"), ["provider", nth.asc_nulls_last(), "evidence_id"], "commit_seq", parent.next_seq)
        made.append(added)
        folders["evidence"] = self._write(parent, "evidence", known.unionByName(added.select(known.columns)), homes)
        # Relationships of new evidence, and those that waited for an entity that is here now.
        woken = self._touched("waiting", fresh.select(F.col("canonical_id").alias("end")))
        waited = self.table(parent, "waiting", woken)
        keys = kept(added.select(*KEY).unionByName(waited.join(_dealt(fresh.withColumnRenamed("canonical_id", "end")), "end", "left_semi").select(*KEY)).distinct())
        pairs = self._touched("relationships", keys)
        current = Manifest(parent.number + 1, label, self.buckets, parent.next_seq + added.count(), folders)
        records = self.table(current, "evidence", pairs).join(_dealt(keys), KEY, "left_semi")
        ends = keys.select(F.col("subject").alias("canonical_id")).union(keys.select("object")).distinct()
        whose = self.table(current, "entities", self._touched("entities", ends)).join(_dealt(ends), "canonical_id", "left_semi").select("canonical_id")
        again = kept(reconcile(records, whose, at, authority=authority))
        old = self.table(parent, "relationships", pairs)
        first = F.min("edge_seq").over(Window.partitionBy("subject", "object"))
        rows = kept(old.drop("pair_seq").join(_dealt(keys), KEY, "left_anti").unionByName(again.select(*(c for c in old.columns if c != "pair_seq"))).withColumn("pair_seq", first))
        folders["relationships"] = self._write(parent, "relationships", rows, pairs)
        # Who waits for whom: of the touched relationships, the ends that are still unknown.
        open_ = again.where("status = 'UNRESOLVED'")
        unknown = open_.select(F.explode(F.array("subject", "object")).alias("end"), *KEY).join(_dealt(whose.select(F.col("canonical_id").alias("end"))), "end", "left_anti").distinct()
        unknown = kept(unknown)
        stay = sorted({*woken, *self._touched("waiting", unknown)})
        left = self.table(parent, "waiting", stay).join(_dealt(keys), KEY, "left_anti").unionByName(unknown)
        folders["waiting"] = self._write(parent, "waiting", left.distinct(), stay)
        self._commit(current)
        forget(*made)
        return current

    def read(self, number: int | None = None) -> Graph:
        """A version's graph: its entities, and its relationships with known ends."""
        at = self.manifest(number)
        entities, edges = self.table(at, "entities"), self.table(at, "relationships")
        return Graph(entities, edges.where("status <> 'UNRESOLVED'"), at.label)

    def relationships(self, number: int | None = None) -> DataFrame:
        return self.table(self.manifest(number), "relationships")
