"""Operators on small tables with known answers."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions import urls, values
from lectern.operators import chunking, citations, fuzzy, index, ingest, runs, scoring, search
from lectern.sources import tables


def one(spark, col, **named):
    row = spark.createDataFrame([tuple(named.values())], list(named))
    return row.select(col.alias("x")).first().x


NUMBERS = [
    ("Around 50% likely", "probability", 0.5), ("approximately 0.5", "probability", 0.5), ("a geometric mean of 5X across responses", "x", 5.0),
    ("around 70%", "probability", 0.7), ("AI 2027 study reports", None, 2027.0), ("AI 2027 reports a factor of 21X", "x", 21.0),
    ("In their 2022 paper, a 20% subjective probability", "probability", 0.20), ("scaled to 200,000 examples", None, 200000.0),
    ("it increased 8-fold from 1500 to 1900", "x", 8.0), ("more than half", "probability", 0.5), ("5 xylophones", "x", 5.0), ("none", "x", None), ("3.5 million", None, 3.5e6),
]


def test_first_number(spark):
    rows = spark.createDataFrame([(t, u) for t, u, _ in NUMBERS], "t string, u string").withColumn("i", F.monotonically_increasing_id()).coalesce(1)
    got = [r.x for r in rows.orderBy("i").select(scoring.first_number(F.col("t"), F.col("u")).alias("x")).collect()]
    assert [None if x is None else round(x, 9) for x in got] == [x for *_, x in NUMBERS]


def test_hedges(spark):
    cases = [
        ("we estimate around 50% probability", ["~"], []), ("It says 50%.", ["~", "might"], ["~", "might"]), ("anything", [], []), ("the result is very likely correct", ["highly likely"], []),
        ("A (maybe) answer", ["a.b"], ["a.b"]),
    ]
    rows = spark.createDataFrame([(a, h) for a, h, _ in cases], "a string, h array<string>").coalesce(1)
    assert [r.x for r in rows.select(scoring.missing_hedges(F.col("a"), F.col("h")).alias("x")).collect()] == [m for *_, m in cases]


def test_votes(spark):
    cases = {
        1: ["PRESENT", "PARTIAL", "MISSING"], 2: ["PRESENT", "PRESENT", "MISSING"], 3: ["PRESENT", "MISSING"], 4: ["PRESENT", "PARTIAL"], 5: ["PARTIAL", "MISSING"], 6: ["BANANA", "PRESENT", "PRESENT"],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k long, verdict string")
    got = {r.k: r.verdict for r in scoring.majority(rows, ["k"], scoring.RUBRIC).collect()}
    assert got == {1: "PARTIAL", 2: "PRESENT", 3: "PARTIAL", 4: "PRESENT", 5: "PARTIAL", 6: "PRESENT"}


def test_support_scores(spark):
    cases = [("short", 1, 0.10), ("x" * 1740, 1, 0.909), ("x" * 10, 0, 1.0)]
    rows = spark.createDataFrame([(t, n) for t, n, _ in cases], "t string, n long").coalesce(1)
    assert [r.x for r in rows.select(scoring.support_score(F.length("t"), F.col("n")).alias("x")).collect()] == pytest.approx([x for *_, x in cases])


def test_citations_from_marks(spark):
    answers = spark.createDataFrame([(1, "Same claim [3]. Different claim with the same source [3]. Combined claim [1, 6]. Same claim [3]."), (2, "[3] Nothing known [8].")], "output_id long, answer string")
    sources = spark.createDataFrame([(o, m, 0, f"u{m}", "t", f"s{m}", "whole" if m == 3 else None) for o in (1, 2) for m in (1, 3, 6)], "output_id long, marker int, seq int, url string, title string, snippet string, chunk_text string")
    got = citations.extract_citations(answers, sources).orderBy("output_id", "idx").collect()
    assert [(r.output_id, r.marker, r.passage) for r in got] == [(1, 3, "whole"), (1, 3, "whole"), (1, 1, "s1"), (1, 6, "s6"), (2, 3, "whole")]


def test_window_holds_the_snippet(spark):
    text, piece = "A" * 16_000 + "the snippet" + "B" * 16_000, "the snippet"
    got = one(spark, citations.doc_window(F.col("t"), F.col("s"), 4000), t=text, s=piece)
    assert piece in got and len(got) == 4000
    assert one(spark, citations.doc_window(F.col("t"), F.col("s"), 4000), t=text, s="nowhere") == text[:4000]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc d", max_size=9), st.text("abc d", max_size=24))
def test_partial_ratio_is_the_best_window(a, b):
    short, long = sorted((a, b), key=len)
    m, n = len(short), len(long)
    windows = [long[max(0, s) : min(n, s + m)] for s in range(-(m - 1), n)] if m else []
    want = max((2 * lcs(short, w) / (m + len(w)) for w in windows), default=0.0)
    assert fuzzy.partial_ratio(a, b) == pytest.approx(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc d", max_size=90), max_size=4), st.lists(st.text("abcd e", max_size=200), max_size=4), st.sampled_from([0.65, 0.8, 0.85]))
def test_fuzzy_filter_misses_nothing(passages, texts, threshold):
    passages += [t[3:80] for t in texts[:2]]
    want = {(p, t): s for p, a in enumerate(passages) for t, b in enumerate(texts) if (s := fuzzy.partial_ratio(a, b)) >= threshold}
    assert {(p, t): s for p, t, s in fuzzy._matches(passages, texts, threshold)} == pytest.approx(want)


def test_fuzzy_passages_against_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 500))) for _ in range(12)] + ["", "one", "short text"]
    worn = [w if i % 4 else w[:-1] + "z" for i, w in enumerate(texts[0].split()[:40])]
    passages = [" ".join(worn), texts[1][10:30], "short", " ".join(texts[2].split()[:3]), "a one of many", texts[3][-50:] + " and more", " ", "zzzz yyyy xxxx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = fuzzy.fuzzy_passages(spark.createDataFrame(list(enumerate(passages)), "passage_id long, passage string"), docs).collect()
    want = {(p, d): s for p, a in enumerate(passages) for d, t in enumerate(texts) if a.strip() and (s := fuzzy.partial_ratio(a.strip(), t)) >= 0.85}
    assert (0, 0) in want and (2, 14) in want and (4, 13) in want
    assert {(r.passage_id, r.doc_id): r.score for r in got} == pytest.approx(want)


def test_passages_in_cited_records(spark):
    pages = {"https://a.b/1": "the whole text of the first record, at some length", "https://a.b/2": "quite another text"}
    items = [
        (1, "https://a.b/1", "text of the first record"), (2, "https://a.b/1#x", "text of tha first  record"), (3, "https://a.b/2", "text of the first record"),
        (4, "https://no.where/", "quite another text"), (5, "https://a.b/2/", " "), (6, None, "quite"), (7, "https://a.b/2", None), (8, "https://a.b/1/", "txt f th frst rcrd"),
    ]
    records = spark.createDataFrame(list(pages.items()), "url string, text string")
    asked = spark.createDataFrame(items, "item_id long, url string, passage string")
    for threshold in (0.65, 0.8, 0.9):
        got = {r.item_id: r for r in fuzzy.verify_passages(asked, records, threshold).collect()}
        assert set(got) == {1, 2, 3, 4, 5, 8}
        for i, url, passage in items:
            if i in got:
                score = fuzzy.partial_ratio(passage.strip(), pages.get(url.split("#")[0].rstrip("/"), ""))
                assert got[i].verified == (score >= threshold) and got[i].score == (pytest.approx(score) if score >= threshold else None)
        assert got[1].score == 1 and got[1].reason is None and got[4].reason == "URL not in corpus: https://no.where/"
        assert got[3].reason == "source_passage not found in https://a.b/2 (below threshold)"
        assert got[2].verified and got[8].verified == (threshold == 0.65)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("ab \n", min_size=1, max_size=900), st.sampled_from(["# One", "## Two", "### Three", "**Abstract.** x", "#### Four"])), max_size=14))
def test_chunks_keep_all_paragraphs(paragraphs):
    body = "\n\n".join(paragraphs)
    want = [p.strip() for p in __import__("re").split(r"\n{2,}", body) if p.strip()]
    got = [p for *_, text in chunking.chunks_of(body) for p in text.split("\n\n")]
    assert got == want


def test_chunk_sections():
    body = "# Title\n\n" + "a" * 700 + "\n\n" + "b" * 700 + "\n\n## Next\n\nend"
    got = chunking.chunks_of(body)
    assert [(s, t[:4]) for s, _, t in got] == [(None, "# Ti"), ("Next", "bbbb"), ("Next", "## N")]
    tagged = chunking.chunks_of("# T\n\n**Abstract.** x\n\n## S\n\nbody")
    assert [src for _, src, _ in tagged] == ["abstract", "body"]


def test_run_lookup(spark):
    names = spark.createDataFrame([("r01_first",), ("r02_second",), ("r12_second",)], "run string")
    find = lambda w: tuple(runs.find_run(names, w).first())
    assert find("r01_first") == ("r01_first", "r01_first", 1) and find("first")[1] == "r01_first" and find("second")[1] is None and find("zzz") == ("zzz", None, 0)
    assert runs.next_run_name(names, "More, again").first().name == "r13_more_again"


def test_ranked_search_caps_and_ties(spark):
    rows = [(i, i, f"u{i % 2}", "title", ["ann"], ["topic"], None, "research", "alpha beta beta" if i < 6 else "gamma") for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id long, ordinal long, url string, title string, authors array<string>, topics array<string>, section string, category string, text string")
    got = search.Searcher(chunks).search("alpha ann", 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2]
    assert search.Searcher(chunks).search("the of and").collect() == []


def test_plain_macros(spark):
    assert one(spark, tx.markers_in(F.col("t")), t="a [3] b [1, 6] [x] [2]") == [3, 1, 6, 2]
    assert one(spark, tx.clean_snippet(F.col("t")), t="## Head\n> *it* is **bold** [l](u) `c` ![cut\n- item | x") == "Head it is bold l c item x"
    assert one(spark, urls.lookup_key(F.col("u")), u=" https://a.b/C/?q=1#x ") == "https://a.b/C/?q=1"
    assert one(spark, urls.recall_key(F.col("u")), u="https://A.b:80/C/?q=1#x") == "a.b:80/c"
    assert one(spark, values.loose_json(F.col("t")), t='So: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, values.loose_json(F.col("t")), t="no json") is None


def test_json_sources(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text('{"url": "u", "title": "t", "text": "' + "x" * 100 + '", "extra": 1}')
    (folder / "b.json").write_text('{"url": ')
    (folder / "c.json").write_text('{"url": "short", "text": "x"}')
    (folder / "_manifest.json").write_text('{"url": "m", "text": "' + "x" * 100 + '"}')
    docs = tables.read_documents(spark, str(folder))
    assert [r.url for r in docs.collect()] == ["u"]
    tables.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest")).count() == 1
    (tmp_path / "s.jsonl").write_text('{"marker": 2, "chunk_id": "c", "url": "u", "title": "t"}\n\nbroken\n{"marker": 1}\n')
    assert [r.marker for r in tables.read_source_lines(spark, str(tmp_path / "s.jsonl")).collect()] == [2]


def test_registered_queries_have_their_own_columns():
    from lectern import plans

    assert set(plans.ORACLES) <= set(plans.QUERIES) and len(plans.QUERIES) > 100
    assert not [a for a, b in itertools.combinations(plans.QUERIES, 2) if a == b]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<meta property="og:title" content="A &amp; B">', ("A & B", "", "")),
        ("<META content='single \"q\"' PROPERTY='og:title'><title>t</title>", ('single "q"', "", "")),
        ("<meta data-content=no name=description content=bare><title lang=en>T &#233; &#x1F600; &amp;lt;</title>", ("T é \U0001f600 &lt;", "bare", "")),
        ('<meta name="description" content="a > b"><meta property="og:description" content=""><h1 class=x>H</h1>', ("", "", "H")),
        ('<meta name="og:titles" content="x"><title>T &#0; &#55296;</title>', ("T � �", "", "")),
        ("", ("", "", "")),
    ],
)
def test_meta_tags_in_any_spelling(spark, html, want):
    assert tuple(one(spark, ingest.page_meta(F.col("h")), h=html, x=1)) == want


def test_citations_are_checked_against_their_records(spark):
    quote = "The quoted sentence, with several words of its own, stands here only."
    records = spark.createDataFrame(
        [("https://a.example/1", "plain text of the first record", f"# One\n\n{quote}"), ("https://a.example/2", f"Second record. {quote.replace('several', 'severel')} More.", None), ("https://a.example/3", "third", "third")],
        "url string, text string, body string",
    )
    cases = [
        (1, "https://a.example/1/", quote, "c", "SUPPORTED", "valid", True, 1.0), (2, "https://a.example/2#x", quote, "c", "partial", "partial", True, 0.98),
        (3, "https://a.example/3", quote, "c", "SUPPORTED", "fabricated", True, 1.0), (4, "https://a.example/3", "nothing like this is in any of the records at all", "c", "SUPPORTED", "fabricated", False, None),
        (5, "https://b.example/", quote, "c", "SUPPORTED", "fabricated", False, None), (6, None, quote, "c", "SUPPORTED", "fabricated", False, None), (7, "https://a.example/3", " ", "c", "no", "real_but_unsupportive", True, None),
        (8, "https://a.example/3", None, "", "SUPPORTED", "partial", True, None),
    ]
    rows = spark.createDataFrame([c[:5] for c in cases], "item_id long, url string, passage string, claim string, judged string")
    got = {r.item_id: (r.verdict, r.found, r.score) for r in fuzzy.check_citations(rows, records).collect()}
    for i, *_, verdict, found, score in cases:
        assert got[i][:2] == (verdict, found), i
        assert got[i][2] == (None if score is None else pytest.approx(score, abs=0.02)), i


def test_table_function_gives_the_chunks(spark):
    body = "# Title\n\n**Abstract.** Some words.\n\n## Part\n\n" + "\n\n".join("A paragraph that goes on. " * 12 for _ in range(9))
    spark.udtf.register("chunks", chunking.Chunks)
    spark.createDataFrame([(1, body), (2, None), (3, "")], "id long, body string").createOrReplaceTempView("bodies")
    got = spark.sql("SELECT id, c.* FROM bodies, LATERAL chunks(body) AS c").orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.section, r.source, r.text) for r in got] == [(1, k, *c) for k, c in enumerate(chunking.chunks_of(body))]


def test_index_is_stored_and_built_anew_for_other_files(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(path)
    first = index.stored_index(spark.read.parquet(path), path, "doc_id")
    assert {(r.doc_id, r.term): (r.dl, r.tf) for r in first.postings.collect()} == {(1, "alpha"): (3, 1), (1, "beta"): (3, 2), (2, "beta"): (2, 1), (2, "gamma"): (2, 1)}
    stats = first.statistics.first()
    assert (stats.version, stats.records, stats.tokens, stats["mean"]) == (3, 4, 5, 1.25)
    assert index.stored_index(spark.read.parquet(path), path, "doc_id").postings.inputFiles() == first.postings.inputFiles()
    spark.createDataFrame([(9, "delta")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    assert [r.term for r in index.stored_index(spark.read.parquet(path), path, "doc_id").postings.collect()] == ["delta"]


def test_many_terms_find_the_heads_that_few_find(spark, monkeypatch):
    about = spark.createDataFrame([(1, "alpha beta"), (2, "x"), (3, ""), (4, "alphabet soup")], "id long, hay string")
    words = spark.createDataFrame([("alpha",), ("ta",), ("soup",), ("zz",)], "term string")
    few = sorted(map(tuple, search.head_hits(about, words, "id").collect()))
    monkeypatch.setattr(search, "FEW", 1)
    assert few == sorted(map(tuple, search.head_hits(about, words, "id").collect())) == [(1, "alpha"), (1, "ta"), (4, "alpha"), (4, "soup")]
