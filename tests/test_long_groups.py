"""Long sessions, cut streams, merged moments, selection in hot groups, containers of logs and numbering with a state table."""

import datetime
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import framing, moments, numbering, runs
from lectern.operators import sessions as ses
from lectern.plans import analysis
from lectern.sources import logs
from lectern.streaming import jobs


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_numbers_and_sums_in_two_levels_equal_windows(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.8 else rng.choice([2, 3, None]), rng.randint(0, 300), rng.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "session long, ts long, item int, event_id long").repartition(7)
    want = ses.numbered(df)
    got = numbering.numbered(df, "session", ["ts", "event_id"])
    assert rows_of(got, "session", "event_id", "seq") == rows_of(want, "session", "event_id", "seq")
    with_seq = want.where("session IS NOT NULL")
    assert rows_of(numbering.seen_so_far(with_seq, "session", "item", ["seq"]), "session", "seq", "sources") == rows_of(ses.cumulative_counts(with_seq), "session", "seq", "sources")
    assert numbering.numbered(df.limit(0), "session", ["ts"]).count() == 0
    assert got.rdd.getNumPartitions() >= 1


STREAMS = {
    1: "event: a\ndata: 1\n\ndata: 2\ndata:3\n\n\n\nevent: b\n\ndata: x\n\n\ndata: odd\n\nevent: rest\ndata: open",
    2: "", 3: "\n\n\ndata: late\n\n", 4: "data: never closed\n", 5: "data: closed\n\n\n", 6: ": note\n\ndata: é日\ndata:\n\n",
}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_any_cut_of_a_stream_has_the_frames_of_the_whole(spark, size):
    whole = spark.createDataFrame(list(STREAMS.items()), "stream long, s string")
    pieces = [(k, i, s[i : i + size]) for k, s in STREAMS.items() for i in range(0, max(1, len(s)), size)] + [(2, 5, None)]
    random.Random(size).shuffle(pieces)
    cut = spark.createDataFrame(pieces, "stream long, at long, piece string")
    assert rows_of(framing.sse_frames(cut, "stream", "at", "piece"), "stream", "ord", "event", "data") == rows_of(ses.sse_frames(whole, "stream", "s"), "stream", "ord", "event", "data")


def test_json_lines_in_pieces(spark):
    text = '{"a": 1}\n\n{broken\n{"b": "é\\n"}\n  \n[1]\n{"rest": 1}'
    cut = spark.createDataFrame([(1, i, c) for i, c in enumerate(text)], "stream long, at long, piece string")
    whole = spark.createDataFrame([(1, text)], "stream long, s string")
    assert rows_of(framing.ndjson_lines(cut, "stream", "at", "piece"), "stream", "ord", "line") == rows_of(ses.ndjson_frames(whole, "stream", "s"), "stream", "ord", "line")


def test_moments_merge_in_any_order(spark):
    rng = random.Random(7)
    rows = [(f"r{i % 9}", rng.choice(["a", "b", None]), 1e8 + rng.random()) for i in range(2000)] + [("r0", "c", None), ("r1", "d", 2.5)]
    df = spark.createDataFrame(rows, "run string, track string, x double")
    parts = moments.moments(df, ["run", "track"], "x")
    first = moments.merged(parts.where("run < 'r5'").drop("run"), ["track"])
    both = moments.merged(first.unionByName(parts.where("run >= 'r5'").drop("run")), ["track"])
    got = {r["track"]: r for r in moments.spread(both).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for t in ("a", "b", None):
        values = [x for _, k, x in rows if k == t and x is not None]
        r = got[t]
        assert r["n"] == len(values) and (r["low"], r["high"]) == (min(values), max(values))
        assert r["mean"] == pytest.approx(statistics.fmean(values), rel=1e-15) and r["sigma"] == pytest.approx(statistics.stdev(values), rel=1e-7)
    assert got["d"]["sigma"] == 0 and got["d"]["n"] == 1


def test_moments_of_a_stream(spark, tmp_path):
    rows = [(i % 3, float(i * i % 17)) for i in range(90)]
    df = spark.createDataFrame(rows, "track long, x double")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = moments.moment_batches(stream, f"{tmp_path}/out", ["track"], "x", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = moments.spread(moments.stored_moments(spark, f"{tmp_path}/out", ["track"]))
    want = df.groupBy("track").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sigma"))
    for a, b in zip(sorted(got.collect(), key=lambda r: r["track"]), sorted(want.collect(), key=lambda r: r["track"]), strict=True):
        assert a["n"] == b["n"] and a["mean"] == pytest.approx(b["mean"]) and a["sigma"] == pytest.approx(b["sigma"], rel=1e-9)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.93, 1.0])
def test_selection_equals_sorting(spark, share):
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 500) if rng.random() < 0.6 else 77) for _ in range(4000)] + [("some", i) for i in range(5)] + [("null", None), ("null", 3), ("null", None), (None, 1), ("one", 9)]
    df = spark.createDataFrame(rows, "k string, v int")
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    place = lambda vs: sorted(vs, key=lambda v: (v is not None, v or 0))[min(int(len(vs) * share), len(vs) - 1)]
    assert rows_of(runs.selected(df, "k", "v", share, cuts=4), "k", "n", "value") == sorted(((k, len(vs), place(vs)) for k, vs in groups.items() if k is not None), key=repr)


def test_selections_of_several_shares_read_their_table_twice(spark, monkeypatch):
    """One pass for totals and sketches and one for counts, whatever the number of shares."""
    rng = random.Random(6)
    rows = [("ANR"[i % 3], round(rng.uniform(900, 105000), 2)) for i in range(6000)]
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double")
    monkeypatch.setattr(analysis, "read_table", lambda *_: lines.mapInArrow(through, lines.schema))
    got = rows_of(analysis.price_quantiles(spark, ""), "share", "l_returnflag", "n", "value")
    by = {k: sorted(v for f, v in rows if f == k) for k in "ANR"}
    assert got == sorted(((share, k, len(vs), vs[int(len(vs) * share)]) for share in (0.25, 0.9) for k, vs in by.items()), key=repr)
    assert seen.value <= 2 * len(rows)


@pytest.mark.parametrize("few", [1, 1 << 18])
def test_selection_cuts_again_until_few_values_are_left(spark, few):
    """Values between two bounds are sketched again where they are many, also where most rows have the bounds' values, or a sketch rounds or holds no number."""
    rng = random.Random(9)
    big = 2**60
    groups = {
        "ends": [0] * 900 + list(range(1, 200)) + [500] * 900, "near": [big + i for i in range(9)] + [big - 2**40], "even": rng.sample(range(10**6), 3000),
        "nulls": [None] * 7 + list(range(50)), "none": [None, None], "low": [-(2**63), 2**63 - 1, 0], "one": [4],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v long")
    shares = [0.0, 0.5, 0.77, 1.0, 0.5]
    place = lambda vs, share: sorted(vs, key=lambda v: (v is not None, v or 0))[min(int(len(vs) * share), len(vs) - 1)]
    want = sorted(((share, k, len(vs), place(vs, share)) for share in set(shares) for k, vs in groups.items()), key=repr)
    assert rows_of(runs.quantiles(df, "k", "v", shares, cuts=1, few=few), "share", "k", "n", "value") == want


def test_selection_of_doubles_and_dates(spark):
    nan, inf = float("nan"), float("inf")
    doubles = [nan] * 5 + [inf, -inf, 0.0] + [i / 7 for i in range(90)]
    df = spark.createDataFrame([("a", v) for v in doubles], "k string, v double").withColumn("d", F.expr("date_add(DATE '2024-01-01', IF(isnan(v) OR abs(v) > 99, 50, CAST(v * 7 AS INT)))"))
    for column in ("v", "d"):
        ordered = [r[0] for r in df.select(column).sort(column).collect()]
        got = {r.share: r.value for r in runs.quantiles(df, "k", column, [0.0, 0.3, 0.9, 1.0], cuts=1, few=2).collect()}
        assert repr(got) == repr({s: ordered[min(int(98 * s), 97)] for s in got}) and len(got) == 4


def test_log_containers(spark, tmp_path):
    rows = [(run, f"{t}_synthesis_{run}.eval" if t == "syn" else f"{t}.eval", t, "v1", "smoke", f"2024-0{9 - i}-01T00:00:00", p, f"it{p}", p / 10 if p else None, 5, p, 1, 0)
            for i, run in enumerate(["r1", "r2", "r3"]) for t in ("args", "syn") for p in range(6)]
    columns = "run string, file string, track string, version string, mode string, created string, place long, sample string, composite double, n long, valid long, fabricated long, unsupportive long"
    df = spark.createDataFrame(rows, columns)
    path = f"{tmp_path}/logs"
    logs.write_logs(df, path)
    (tmp_path / "logs/r1/broken.eval").write_bytes(b"no container")
    (tmp_path / "logs/loose.eval").write_bytes(b"not in a run")
    with zipfile.ZipFile(tmp_path / "logs/r2/zz.eval", "w") as z:
        z.writestr("_journal/start.json", '{"eval": {"metadata": {"track": "args"}}}')
        z.writestr("samples/a_epoch_1.json", '{"id": 7, "scores": {"s": {"value": "NaN"}}}')
        z.writestr("samples/b_epoch_1.json", "{broken")
    read = logs.read_logs(spark, path)
    names = [c.split()[0] for c in columns.split(", ")]
    assert rows_of(read.where("file <> 'zz.eval'"), *names) == sorted(rows, key=repr)
    assert [(r.sample, r.composite, r.created, r.version) for r in read.where("file = 'zz.eval'").collect()] == [("7", None, None, "?")]
    one = read.where("run = 'r3' AND track IN ('syn', 'other')")
    assert one.count() == 6
    reader = logs._Reader(path)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    rest = list(reader.pushFilters([EqualTo(("run",), "r3"), In(("track",), ("syn", "other")), GreaterThan(("composite",), 0.1)]))
    assert [type(f) for f in rest] == [GreaterThan] and [about["file"] for _, about, _ in reader.containers()] == ["syn_synthesis_r3.eval"]
    assert [r.run for r in logs.run_order(read.where("file <> 'zz.eval'")).orderBy("idx").collect()] == ["r3", "r2", "r1"]
    assert rows_of(logs.first_log(read), "run", "file", "sample") == sorted({(r[0], r[1], r[7]) for r in rows if r[2] == "syn"})
    scores = logs.track_scores(read)
    assert scores.where("run = 'r2' AND track = 'args'").count() == 0, "the last container by name counts, and has no score"
    assert scores.where("run = 'r1' AND track = 'args'").count() == 5


def test_long_containers_are_read_in_parts(spark, tmp_path, monkeypatch):
    rows = [("r", "a.eval", "t", "v", "m", "2024", p, f"it{p}", 0.5, 1, 1, 0, 0) for p in range(50)]
    df = spark.createDataFrame(rows, "run string, file string, track string, version string, mode string, created string, place long, sample string, composite double, n long, valid long, fabricated long, unsupportive long")
    logs.write_logs(df, f"{tmp_path}/logs")
    monkeypatch.setattr(logs, "PART", 1000)
    parts = logs._Reader(f"{tmp_path}/logs").partitions()
    assert len(parts) > 3 and sum(len(names) for p in parts for *_, names in p.parts) == 50


def test_numbers_with_a_state_table(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 5, i, (i * 7) % 11, start + datetime.timedelta(hours=i)) for i in range(150)]
    late = [(99, 200 + i, i, start + datetime.timedelta(days=400)) for i in range(3)]
    df = spark.createDataFrame(rows + late, "session long, seq long, item int, ts timestamp")
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(3):
        df.where(F.col("seq").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(folder)

    def go():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = jobs.numbered_batches(stream, out, f"{tmp_path}/c", keep="30 days", parts=2).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    go()
    want = rows_of(ses.marker_registry(df.where("seq < 150")), "session", "item", "marker")
    assert rows_of(jobs.numbers(spark, out), "session", "item", "marker") == want
    # The last batch again, as after a failure before its commit: its file goes, its rows are written anew.
    import os

    commits = sorted(os.listdir(f"{tmp_path}/c/commits"), key=lambda x: (x.startswith("."), x))
    last = [c for c in commits if not c.startswith(".")][-1]
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{tmp_path}/c/commits/{name}"):
            os.remove(f"{tmp_path}/c/commits/{name}")
    go()
    assert rows_of(jobs.numbers(spark, out), "session", "item", "marker") == want
    before = jobs.marker_state(spark, out).count()
    assert before == len(want) and jobs.dropped_versions(spark, f"{out}/state") > 0 and jobs.marker_state(spark, out).count() == before
    df.where("seq >= 200").coalesce(1).write.mode("append").parquet(folder)
    go()
    left = {r["session"] for r in jobs.marker_state(spark, out).collect()}
    assert 99 in left and len(left) < 6, "sessions that share the late one's part have left the state"
