"""Steps whose work, memory or shuffles grew faster than their tables."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions.text import tokenize
from lectern.operators import chunking, fuzzy, index, segments

ODD = ["Kelvin K-1 İstanbul x", "it's -- a--b 'q'", "w" * 39 + " " + "v" * 40 + "énd", "", None, "one\u001ctwo three\nfour\x00five", "the the THE The"]


def test_runs_count_the_tokens_of_the_column_macro(spark):
    texts = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    rows = texts.select("id", tokenize(F.col("text")).alias("t")).collect()
    want = sorted((r.id, len(r.t), w, r.t.count(w)) for r in rows if r.t for w in set(r.t))
    assert sorted(tuple(r) for r in index.postings(texts, "id").collect()) == want
    df = {w: sum(w in (r.t or []) for r in rows) for r in rows for w in r.t or []}
    assert {r.term: r.df for r in index.document_counts(texts).collect()} == df


def test_a_segment_is_written_without_ranging_its_postings(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise AssertionError("postings are shuffled")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", fail)
    monkeypatch.setattr(segments, "BLOCK", 8)
    monkeypatch.setattr(index, "RUN", 300)
    monkeypatch.setattr(segments, "runs_of", lambda texts, most=300: index.runs_of(texts, 300))
    chunks = spark.createDataFrame([(i, f"t{i % 7}", "common " * (1 + i % 5) + f"w{i % 13}") for i in range(200)], "chunk_id long, title string, text string")
    of = segments.Segments(spark, f"file://{tmp_path}/index")
    of.add(chunks)
    fresh = {r.term: r.df for r in chunks.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    assert {r.term: r.df for r in of.frequencies().collect()} == fresh
    blocks = of._every("blocks", of.segments()).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    posts = of._every("postings", of.segments()).groupBy("term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, posts.collect()))
    heads = of.head_hits(spark.createDataFrame([("t3",)], "term string"))
    assert heads.count() == len([i for i in range(200) if i % 7 == 3])


def test_texts_are_held_in_bounded_runs():
    texts = pa.array(["a" * n for n in (10, 90, 5, 200, 1, 1)] + [None, ""])
    runs = list(index.runs_of(texts, 100))
    assert [(first, [t and len(t) for t in part]) for first, part in runs] == [(0, [10, 90]), (2, [5]), (3, [200]), (4, [1, 1, None, ""])]
    assert [t for _, part in runs for t in part] == texts.to_pylist()
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 100 for _, part in runs)


def test_chunks_come_in_bounded_runs(spark, monkeypatch):
    """One batch of documents gives chunks of each run before the next one is read."""
    seen = []
    monkeypatch.setattr(chunking, "runs_of", lambda texts: (seen.append((first, len(part))) or (first, part) for first, part in index.runs_of(texts, 50)))
    run = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: run.append(f) or self.withColumn("text", F.lit("")))
    chunking.chunk_documents(spark.createDataFrame([(1, "a", "b")], "id long, body string, text string"), "id")
    bodies = [f"# t{i}\n\nbody {i}" for i in range(20)]
    batch = pa.record_batch([pa.array(range(20), pa.int64()), pa.array(bodies)], names=["id", "body"])
    made = list(run[0](iter([batch])))
    assert len(made) > 3 and [i for m in made for i in m.column(0).to_pylist()] == list(range(20)) and sum(n for _, n in seen) == 20


def test_passages_are_looked_for_by_classes_of_characters(monkeypatch):
    """Texts and patterns of a class are shorter by the number of classes: the filter takes fewer steps and misses nothing."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(6)]
    passages = [" ".join(w for i, w in enumerate(t[500:700].split(" ")) if i % 9 != 4) for t in texts[:3]] + [" ".join(word() for _ in range(30))]
    read = []
    least = fuzzy._least
    monkeypatch.setattr(fuzzy, "_least", lambda pieces, streams, signs: read.append(sum(map(len, streams)) * len(pieces)) or least(pieces, streams, signs))
    want = {(p, t): s for p, a in enumerate(passages) for t, b in enumerate(texts) if (s := fuzzy.partial_ratio(a, b)) >= 0.85}
    assert len(want) >= 3 and {(p, t): s for p, t, s in fuzzy._matches(passages, texts, 0.85)} == want
    parted, read[:] = sum(read), []
    fuzzy._within(passages, texts, 0.85, 1)
    assert sum(read[:1]) > 0 and parted < 1.5 * sum(read)
