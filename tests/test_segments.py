"""A segmented index answers as one that is built anew, whatever was added, replaced, dropped and merged."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.values import rounded
from lectern.operators import index, search, segments

CHUNKS = "chunk_id long, ordinal long, url string, title string, authors array<string>, topics array<string>, section string, category string, text string"


def chunk(rng, i, words):
    text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
    refs = "References" if i % 9 == 0 else None
    return (i, i, f"u{i % 23}", " ".join(rng.choice(words) for _ in range(3)), [rng.choice(words)], ["topic"], refs, rng.choice(["people", "research"]), text)


def whole(spark, rows):
    return spark.createDataFrame(sorted(rows.values()), CHUNKS)


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


QUERIES = [(1, "alpha beta"), (2, "researcher w3 gamma"), (3, "w7"), (4, "the of"), (5, "nowhere"), (6, "alpha alph beta w1 w2 w3 people")]


def test_segments_equal_an_index_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "FIRST", 2)
    rng = random.Random(5)
    words = ["alpha", "alphabet", "beta", "gamma", "researcher", *[f"w{i}" for i in range(40)]]
    rows = {i: chunk(rng, i, words) for i in range(120)}
    of = segments.Segments(spark, f"file://{tmp_path}/index")
    assert of.version() == 0 and of.segments() == []
    for part in range(4):
        of.add(whole(spark, {i: r for i, r in rows.items() if i % 4 == part}))
    new = {i: chunk(rng, i, words) for i in [3, 50, 51, 200, 201]}
    of.replace(whole(spark, new))
    rows |= new
    of.drop(spark.createDataFrame([(4,), (5,), (200,), (999,)], "id long"))
    for i in (4, 5, 200):
        del rows[i]
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    chunks = whole(spark, rows)
    fresh = index.write_index(chunks.select("chunk_id", "text"), f"file://{tmp_path}/fresh")
    before = of.version()
    for _ in range(2):
        assert of.statistics() == tuple(fresh.statistics.select("records", "tokens").first())
        assert plain(of.frequencies(), "term", "df") == plain(fresh.frequencies, "term", "df")
        scores = search.bm25(fresh, queries).withColumn("score", rounded(F.col("score")))
        assert plain(of.bm25(queries).withColumn("score", rounded(F.col("score"))), "query_id", "chunk_id", "score") == plain(scores, "query_id", "chunk_id", "score")
        best = {}
        for q, i, s in plain(scores, "query_id", "chunk_id", "score"):
            best.setdefault(q, []).append((-s, i))
        want = sorted((q, n + 1, i, -s) for q, found in best.items() for n, (s, i) in enumerate(sorted(found)[:7]))
        assert plain(of.top(queries, 7), "query_id", "rank", "chunk_id", "score") == want
        assert plain(of.ranked(queries, 6), "query_id", "rank", "chunk_id", "url", "score") == plain(search.ranked(chunks, fresh, queries, 6), "query_id", "rank", "chunk_id", "url", "score")
        heads = {i: " ".join([r[3], *r[4], *r[5], *([r[6]] if r[6] else [])]).lower() for i, r in rows.items()}
        terms = spark.createDataFrame([("alpha",), ("a",), ("ta w",), ("opic refer",), ("zzz",), ("",)], "term string")
        about = of._every("documents", of.segments()).select("segment", "ord", "id")
        assert plain(of.head_hits(terms).join(about, ["segment", "ord"]), "id", "term") == sorted((i, t) for i, h in heads.items() for t in ("alpha", "a", "ta w", "opic refer", "zzz") if t in h)
        typed = spark.createDataFrame([(1, " Alpha "), (2, "topic"), (3, " ")], "text_id long, typed string")
        rank = lambda t: sorted((-2 if h.startswith(t) else -1, i) for i, h in heads.items() if t in h)[:3]
        assert plain(of.complete(typed, 3), "text_id", "rank", "chunk_id", "score") == [(k, n + 1, i, -s) for k, t in ((1, "alpha"), (2, "topic")) for n, (s, i) in enumerate(rank(t))]
        of.merge()
    assert len(of.segments()) < 5 and of.version() == before + 2
    assert len(of.segments(before)) == 5, "an older version can still be read"


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 8)
    monkeypatch.setattr(segments, "FIRST", 4)
    rows = [(i, "rare common common" if i in (100, 101, 102) else "common " + "filler " * (20 + i % 30)) for i in range(400)]
    of = segments.Segments(spark, f"file://{tmp_path}/index")
    of.add(spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1))
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    assert [r.chunk_id for r in of.top(queries, 3).orderBy("rank").collect()] == [100, 101, 102]
    read = of.postings_read(queries, 3).first()
    assert read.postings == 403 and read.postings_read < 40 and read.blocks_read < read.blocks


def test_writers_that_were_overtaken_change_nothing(spark, tmp_path):
    of = segments.Segments(spark, f"file://{tmp_path}/index")
    of.add(spark.createDataFrame([(1, "alpha")], "chunk_id long, text string"))
    seen = of.version()
    of.add(spark.createDataFrame([(2, "beta")], "chunk_id long, text string"))
    with pytest.raises(Exception, match="(?i)exists"):
        of._commit([], seen)
    assert of.statistics() == (2, 2)
    empty = segments.Segments(spark, f"file://{tmp_path}/empty")
    empty.add(spark.createDataFrame([], "chunk_id long, text string"))
    assert empty.statistics() == (0, 0) and empty.top(spark.createDataFrame([(1, "alpha")], "query_id long, query string")).count() == 0
