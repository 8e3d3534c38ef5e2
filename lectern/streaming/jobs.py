"""Structured Streaming jobs, each with the same result as its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """(window, event_type, n, total) of events; on a stream, windows close when the watermark passes them."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest_sources(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Appended source lines without those whose (session, marker) has been seen."""
    if lines.isStreaming:
        return lines.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "marker"])
    return lines.dropDuplicates(["session", "marker"])


def cumulative_sources(lines: DataFrame) -> DataFrame:
    """(session, markers): all markers of a session so far, in order; on a stream a row whenever a batch brings a new one, else the last of these."""
    if not lines.isStreaming:
        return lines.groupBy("session").agg(F.sort_array(F.collect_set("marker")).alias("markers"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0]) if state.exists else set()
        every = known.union(*(f["marker"].tolist() for f in frames))
        if len(every) > len(known):
            state.update((sorted(every),))
            yield pd.DataFrame({"session": [key[0]], "markers": [sorted(every)]})

    return lines.groupBy("session").applyInPandasWithState(run, "session long, markers array<int>", "markers array<int>", "append", GroupStateTimeout.NoTimeout)


def numbered_items(events: DataFrame) -> DataFrame:
    """(session, item, marker) of a stream of (session, seq, item): items numbered per session as they are first seen.

    A session's state is its items' numbers. Rows of a batch are ordered by seq before they count.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items: list = list(state.get[0]) if state.exists else []
        known = set(items)
        rows = pd.concat(list(frames)).sort_values("seq")
        fresh = [x for x in dict.fromkeys(rows["item"].tolist()) if x not in known]
        start = len(items)
        state.update((items + fresh,))
        if fresh:
            yield pd.DataFrame({"session": key[0], "item": fresh, "marker": range(start + 1, start + len(fresh) + 1)})

    return events.groupBy("session").applyInPandasWithState(
        run, "session long, item int, marker int", "items array<int>", "append", GroupStateTimeout.NoTimeout
    )


def _newest_parts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Rows of the newest version of each part, of versions before a batch if one is given; which parts there are follows from the folders' names."""
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.select("part", "batch").distinct().groupBy("part").agg(F.max("batch").alias("batch"))  # at most as many as there are parts
    return rows.join(F.broadcast(newest), ["part", "batch"], "left_semi")


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_batches`` keeps, as of the last batch."""
    return _newest_parts(spark, path).drop("part", "batch")


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str, parts: int = 64):
    """Keep the newest row of each key of a stream in a table, by ``updated_at``; ``upserted`` reads it.

    Keys are dealt to ``parts`` parts by a hash, and a batch writes a new version of those alone that it
    touches. A batch that is run again writes the same. Older versions stay until ``dropped_versions``.
    """
    from ..operators.catalog import latest_of

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]
        if number and touched:
            rows = rows.unionByName(_newest_parts(spark, path, number).where(F.col("part").isin(touched)).drop("batch"))
        latest_of(rows, key, "updated_at").repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def numbered_batches(stream: DataFrame, path: str, checkpoint: str, keep: str = "30 days", parts: int = 64):
    """Number the items of each session of a stream (session, seq, item, ts) as they are first seen, with the state in a table.

    ``numbers`` reads what has been numbered. A batch reads the state that the batches before it left and writes under its own
    number the new rows and the parts of the state that it touches: one that runs again writes the same, so that each item is numbered once.
    A session leaves the state when its part is written and its last event is older than ``keep`` before the newest of the batch;
    if it comes back after that, it begins with 1 again. Rows of a batch are ordered by seq, ties by item, before they count.
    """
    from ..operators.sessions import marker_registry, resumed_markers
    from ..sources.shared import stored

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stored(batch.select("session", "seq", "item", "ts").withColumn("part", F.pmod(F.xxhash64("session"), F.lit(parts)).cast("int")), "batch")
        touched = [r["part"] for r in rows.select("part").distinct().collect()]
        if not touched:
            return
        oldest = rows.agg(F.max("ts")).first()[0]
        seen = rows.groupBy("session").agg(F.max("ts").alias("__ts"))
        kept = _state(spark, f"{path}/state", number)
        kept = None if kept is None else kept.where(F.col("part").isin(touched)).where(F.col("ts") >= F.lit(oldest) - F.expr(f"INTERVAL {keep}"))
        fresh = marker_registry(rows) if kept is None else resumed_markers(rows, kept)
        fresh = stored(fresh.select("session", "item", "marker"), "fresh")
        fresh.write.mode("overwrite").parquet(f"{path}/numbers/batch={number}")
        state = fresh.join(seen, "session").select("session", "item", "marker", F.col("__ts").alias("ts"))
        if kept is not None:
            old = kept.join(seen, "session", "left").select("session", "item", "marker", F.greatest("ts", "__ts").alias("ts"))
            state = state.unionByName(old)
        state = state.withColumn("part", F.pmod(F.xxhash64("session"), F.lit(parts)).cast("int"))
        state = state.unionByName(_mark(spark, touched))  # a part that all sessions have left still has a newest version
        state.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/state/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def _mark(spark: SparkSession, touched: list[int]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in touched], "part int").select(
        F.lit(None).cast("long").alias("session"), F.lit(None).cast("int").alias("item"), F.lit(None).cast("int").alias("marker"), F.lit(None).cast("timestamp").alias("ts"), "part"
    )


def _state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The state of markers that batches before a number left; None before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) or before is not None and not any(int(f.getPath().getName()[6:]) < before for f in files.listStatus(place) if f.getPath().getName().startswith("batch=")):
        return None
    return _newest_parts(spark, path, before).drop("batch").where("marker IS NOT NULL")


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """(session, item, marker) that ``numbered_batches`` has given."""
    return spark.read.parquet(f"{path}/numbers").select("session", "item", "marker")


def marker_state(spark: SparkSession, path: str) -> DataFrame:
    """(session, item, marker, ts) of the sessions that are in the state now."""
    return _state(spark, f"{path}/state").drop("part")


def dropped_versions(spark: SparkSession, path: str) -> int:
    """Delete versions of parts that newer ones replace, and return how many; to be run between batches.

    Versions are compared by Spark, from the folders' names alone; the driver gets those to be deleted.
    """
    found = spark.read.parquet(path).select("part", "batch").distinct()
    newest = found.groupBy("part").agg(F.max("batch").alias("__newest"))
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for r in found.join(newest, "part").where("batch < __newest").select("part", "batch").toLocalIterator():
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={r['batch']}/part={r['part']}"), True)
        n += 1
    return n
