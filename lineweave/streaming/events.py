"""Windowed event aggregates: the same plans over a table and, with a watermark, over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of each window; on a stream, rows later than `late` are dropped."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    sums = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) of windows that overlap: one begins each `step`."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    sums = rows.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def append_to(rows: DataFrame, path: str, state: str):
    """Starts the query that appends a stream's closed rows to Parquet files, whatever is there now, and then ends. `state` is
    a folder that all executors share; with it, the next run goes on where this one ended, and no row is written twice."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) of each run of a user's events without a pause of `gap`."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    found = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def first_seen(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows of a key not met within the watermark: the filter for repeated rows of a stream."""
    rows = timed(events)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else rows.dropDuplicates(key)


def runs(events: DataFrame, idle: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, event_type, n): each run of a user's events of one type, ended by an event of another type or by a pause
    longer than `idle`.

    On a stream the open run of each user is the state (start, last, event_type, n). A run is told once it has ended: by a later
    event, or by a timer in event time when the watermark is `idle` past its last event; the timer also drops the state. Rows
    later than the watermark are dropped. A batch is sorted by user before it is folded, so a user's events count in
    order if no batch holds older ones than the batch before. Rows without a user, time or type are left out.
    """
    rows = timed(events).select("user_id", "ts", "event_type", *(["event_id"] if "event_id" in events.columns else [])).dropna()
    order = [c for c in ("ts", "event_id") if c in rows.columns]
    pause = F.expr(f"INTERVAL {idle}")
    if not events.isStreaming:
        own = Window.partitionBy("user_id").orderBy(*order)
        changed = (F.col("event_type") != F.lag("event_type").over(own)) | (F.col("ts") > F.lag("ts").over(own) + pause)
        numbered = rows.withColumn("run", F.count_if(F.coalesce(changed, F.lit(True))).over(own))
        ended = numbered.groupBy("user_id", "run", "event_type").agg(F.min("ts").alias("start"), F.count("*").alias("n"))
        return ended.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    seconds = int(rows.sparkSession.range(1).select((F.lit(0).cast("timestamp") + pause).cast("long")).first()[0])

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, now = [], state.getOption
        if state.hasTimedOut:
            state.remove()
            now, done = None, [now]
        else:
            batch = pd.concat(list(parts)).sort_values(order)
            for ts, kind in zip((batch["ts"].astype("int64") // 1000).tolist(), batch["event_type"].tolist(), strict=True):
                if now is not None and (now[2] != kind or ts > now[1] + seconds * 1_000_000):
                    done.append(now)
                    now = None
                now = (now[0], max(now[1], ts), kind, now[3] + 1) if now else (ts, ts, kind, 1)
            state.update(now)
            state.setTimeoutTimestamp(max(now[1] // 1000 + seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], pd.Timestamp(r[0], unit="us"), r[2], r[3]) for r in done], columns=["user_id", "start", "event_type", "n"])

    kind = rows.schema["user_id"].dataType.simpleString()
    keyed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(fold, f"user_id {kind}, start timestamp_ntz, event_type string, n long", "start long, last long, event_type string, n long", "append", "EventTimeTimeout")


def upsert_to(rows: DataFrame, path: str, key: list[str], state: str):
    """Starts the query that upserts a stream's rows by key into a table at `path`, whatever is there now, and then ends.

    A batch writes a whole new version, `path`/version=<batch id>, from the version before and the batch's rows; a batch
    that is tried again after a failure writes the same version again, so each batch counts once. The table is the newest
    version that is whole (see `newest`); the one before stays for readers, older ones go. Of rows that share a key in a batch the one of
    the largest other columns counts.
    """
    rest = [c for c in rows.columns if c not in key]

    def write(batch: DataFrame, version: int) -> None:
        new = batch.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else batch.select(*key).distinct()
        old = newest(batch.sparkSession, path, before=version)
        whole = new if old is None else old.select(*new.columns).join(new.select(*key), key, "left_anti").unionByName(new)
        whole.write.mode("overwrite").parquet(f"{path}/version={version}")
        for v in versions(batch.sparkSession, path):
            if v < version - 1:
                drop(batch.sparkSession, f"{path}/version={v}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions at path that were written to their end, ascending."""
    at, files = store(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    found = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return [v for v in found if files.exists(store(spark, f"{path}/version={v}/_SUCCESS")[0])]


def newest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest whole version of the table that `upsert_to` writes; with before, the newest older one; None without any."""
    found = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def drop(spark: SparkSession, path: str) -> None:
    at, files = store(spark, path)
    files.delete(at, True)
