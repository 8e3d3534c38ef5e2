"""Streams give what their batch twins give."""

import datetime

from pyspark.sql import functions as F

from lectern.operators import sessions as ses
from lectern.streaming import jobs


def events(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 7, i, (i * i) % 11, start + datetime.timedelta(minutes=i), "view" if i % 3 else "click", float(i)) for i in range(300)]
    return spark.createDataFrame(rows, "session long, seq long, item int, ts timestamp, event_type string, value double")


def streamed(spark, tmp_path, df, parts=3):
    folder = str(tmp_path / "in")
    for k in range(parts):
        df.where(F.floor(F.col("seq") / 100) == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def finished(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_numbered_items_continue_across_batches(spark, tmp_path):
    df = events(spark)
    out = jobs.numbered_items(streamed(spark, tmp_path, df).select("session", "seq", "item"))
    finished(out.writeStream.outputMode("append").format("memory").queryName("numbers").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    got = {(r.session, r.item): r.marker for r in spark.table("numbers").collect()}
    assert got == {(r.session, r["item"]): r.marker for r in ses.marker_registry(df).collect()}


def test_tumbling_windows(spark, tmp_path):
    df = events(spark)
    late = df.where("seq = 299").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 DAYS")).withColumn("event_type", F.lit("end"))
    out = jobs.tumbling(streamed(spark, tmp_path, df.union(late)), "1 hour")
    finished(out.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    got = {(r.window.start, r.event_type): (r.n, r.total) for r in spark.table("windows").collect() if r.event_type != "end"}
    assert got == {(r.window.start, r.event_type): (r.n, r.total) for r in jobs.tumbling(df, "1 hour").collect()}


def test_latest_sources(spark, tmp_path):
    df = events(spark).withColumnRenamed("item", "marker")
    out = jobs.latest_sources(streamed(spark, tmp_path, df), "30 days")
    finished(out.writeStream.outputMode("append").format("memory").queryName("sources").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    pairs = lambda d: sorted((r.session, r.marker) for r in d.select("session", "marker").collect())
    assert pairs(spark.table("sources")) == pairs(jobs.latest_sources(df))


def test_cumulative_sources_are_told_when_new_ones_come(spark, tmp_path):
    df = events(spark).select("session", "seq", F.when(F.col("seq") < 100, F.col("item") % 4).otherwise(F.col("item")).alias("marker"))
    out = jobs.cumulative_sources(streamed(spark, tmp_path, df).select("session", "marker"))
    finished(out.writeStream.outputMode("append").format("memory").queryName("told").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    told = {}
    for r in spark.table("told").collect():
        told.setdefault(r.session, []).append(r.markers)
    want = {r.session: r.markers for r in jobs.cumulative_sources(df).collect()}
    assert {k: max(v, key=len) for k, v in told.items()} == want
    assert all(len({len(x) for x in v}) == len(v) for v in told.values()) and any(len(v) == 2 for v in told.values())


def test_upserts_keep_the_newest(spark, tmp_path):
    df = events(spark).select(F.col("session").alias("id"), F.col("ts").alias("updated_at"), "seq")
    source = streamed(spark, tmp_path, df)
    finished(jobs.upsert_batches(source, str(tmp_path / "table"), "id", str(tmp_path / "c")).trigger(availableNow=True).start())
    want = {r.id: r.m for r in df.groupBy("id").agg(F.max("seq").alias("m")).collect()}
    assert {r.id: r.seq for r in jobs.upserted(spark, str(tmp_path / "table")).collect()} == want
    assert jobs.dropped_versions(spark, str(tmp_path / "table")) > 0 and jobs.dropped_versions(spark, str(tmp_path / "table")) == 0
    assert {r.id: r.seq for r in jobs.upserted(spark, str(tmp_path / "table")).collect()} == want


def test_upserts_leave_other_parts_alone(spark, tmp_path):
    import datetime

    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    schema = "id long, updated_at timestamp, v string"
    spark.createDataFrame([(i, at(1), "a") for i in range(20)], schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: finished(jobs.upsert_batches(spark.readStream.schema(schema).parquet(folder), table, "id", str(tmp_path / "c")).trigger(availableNow=True).start())
    run()
    spark.createDataFrame([(3, at(2), "b"), (4, at(0), "old"), (99, at(1), "new")], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = {r.id: r.v for r in jobs.upserted(spark, table).collect()}
    assert got == {i: "b" if i == 3 else "a" for i in range(20)} | {99: "new"}
    assert spark.read.parquet(table).where("batch = 1").select("part").distinct().count() <= 3
