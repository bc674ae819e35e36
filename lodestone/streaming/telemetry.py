"""Telemetry as a stream: append, hourly counts, first of duplicates, sessions, the history of queries.

Each query reads a folder as a stream until it is exhausted (availableNow) and keeps its state in a checkpoint, so a
second run goes on where the first ended. Times are cast to timestamps, as a watermark needs them.
"""

from __future__ import annotations

from heapq import heappush, heapreplace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.understand import session_weights
from ..storage import work_folder

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str, files: str = "events.parquet") -> DataFrame:
    """The events table as a stream: one file in the folder, or a folder of files."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{files}")
    is_folder = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(EVENT)
    rows = reader.parquet(f"{sf_dir}/{files}") if is_folder else reader.option("pathGlobFilter", files).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream to its end and return what it wrote. In complete mode the last state replaces the one before."""
    spark = stream.sparkSession
    out, checkpoint = out or work_folder(spark), checkpoint or work_folder(spark)
    if mode == "complete":
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def hourly(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("hour"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user by a gap of time."""
    s = stream.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def first_of_duplicates(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark's lateness."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def latest(entries: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The (seq, time) entries that can be among the last `most` inside a window at any later moment.

    One that `most` later entries outlive never can, so a history in order of time keeps no more than `most`.
    """
    ends: list[int] = []
    out = []
    for seq, at in sorted(entries, reverse=True):
        if len(ends) < most:
            heappush(ends, at)
        elif at > ends[0]:
            heapreplace(ends, at)
        else:
            continue
        out.append((seq, at))
    return out


def history(stream: DataFrame, most: int = 10) -> DataFrame:
    """repository_id, seq, micros: after each batch, the entries that the window of a repository can still need.

    stream: repository_id, seq (the order of recording), observed_at. Entries without a repository, number or time are
    in no window. The state of a repository is what latest() leaves.
    """

    def step(key, batches, state):
        entries = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            entries = latest(entries + list(zip(batch["seq"].tolist(), batch["micros"].tolist(), strict=True)), most)
        state.update(([e[0] for e in entries], [e[1] for e in entries]))
        yield pd.DataFrame({"repository_id": [key[0]] * len(entries), "seq": [e[0] for e in entries], "micros": [e[1] for e in entries]})

    kind = stream.schema["repository_id"].dataType.simpleString()
    rows = stream.where("repository_id IS NOT NULL AND seq IS NOT NULL AND observed_at IS NOT NULL").select("repository_id", F.col("seq").cast("long").alias("seq"), F.unix_micros("observed_at").alias("micros"))
    return rows.groupBy("repository_id").applyInPandasWithState(step, f"repository_id {kind}, seq long, micros long", "seq array<long>, micros array<long>", "update", "NoTimeout")


def drain_history(stream: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run history() to its end: repository_id, seq, observed_at as each repository's last batch left them.

    A batch that is run again replaces what it wrote.
    """
    spark = stream.sparkSession
    out, checkpoint = out or work_folder(spark), checkpoint or work_folder(spark)
    writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch long").option("basePath", out).parquet(out)
    last = F.max("batch").over(Window.partitionBy("repository_id"))
    return rows.withColumn("last", last).where("batch = last").select("repository_id", "seq", F.timestamp_micros("micros").alias("observed_at"))


def stream_hourly(spark, sf_dir):
    return drain(hourly(events(spark, sf_dir)), "complete")


def stream_sessions(spark, sf_dir):
    return drain(sessions(events(spark, sf_dir)), "complete")


def stream_dedupe(spark, sf_dir):
    rows = drain(first_of_duplicates(events(spark, sf_dir)), "append")
    return rows.select("event_id", "user_id", "event_type")


def stream_history(spark, sf_dir):
    """Each user's window and its weights at their last event."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("repository_id"), F.col("event_id").alias("seq"), F.col("ts").alias("observed_at"))
    found = drain_history(history(rows)).withColumn("now", F.max("observed_at").over(Window.partitionBy("repository_id")))
    return session_weights(found, F.col("now")).select(F.col("repository_id").alias("user_id"), F.col("seq").alias("event_id"), "rank", F.round("weight", 6).alias("weight"))


FUNCTIONS = (stream_hourly, stream_sessions, stream_dedupe, stream_history)
SQL = {
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1,2",
    "stream_sessions": """WITH n AS (SELECT user_id, ts, coalesce((lag(ts) OVER w + INTERVAL 30 MINUTE <= ts)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM n)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""",
    "stream_history": """SELECT user_id, event_id, rank::INT AS rank, round(pow(0.5, (rank-1)/5.0), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank
        FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS now FROM events) WHERE now - ts <= INTERVAL 30 MINUTE) WHERE rank <= 10""",
    "stream_dedupe": "SELECT DISTINCT event_id, user_id, event_type FROM events",
}
