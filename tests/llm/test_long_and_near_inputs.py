"""Inputs that are long, nearly equal, or named like what they are not."""

import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, extraction, linededup, toxicity, urlfilter

P = "<p>This paragraph says something, and then more, in a second sentence. Yes, it does.</p>"
SAID = "This paragraph says something, and then more, in a second sentence. Yes, it does."


def body(x):
    return f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav>{x}<footer>End, of it.</footer></body></html>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<main><h1>Forms</h1>{P}<section id='form-validation'><h2>Validation</h2>{P}</section><section id='search'><h2>Search</h2>{P}</section></main>", f"Forms\n{SAID}\nValidation\n{SAID}\nSearch\n{SAID}"),
        (f"<article><h1>T</h1>{P}<h2 id='related'>Related work</h2>{P}<h2 id='social-history'>Social history</h2>{P}</article>", f"T\n{SAID}\nRelated work\n{SAID}\nSocial history\n{SAID}"),
        (f"<article><h1>T</h1>{P}<div id='related-posts'><ul><li><a href=x>One post</a></li><li><a href=y>Other post</a></li></ul></div></article>", f"T\n{SAID}"),
        (f"<article><h1>T</h1>{P}<section id='comments'><p>A reader, who says a lot, and then more of it.</p></section></article>", f"T\n{SAID}"),
        (f"<div><a href=/a>Home</a><a href=/b>About</a></div><div><h1>Title</h1>{P * 3}<div>Short note</div></div><div>Copyright 2024</div>", f"Title\n{SAID}\n{SAID}\n{SAID}\nShort note"),
        (f"<div class=document><div class=body role=main><section id='search'><h1>Search</h1>{P}<section id='notification-alert'><h2>Alerts</h2>{P}</section></section></div></div><div class=sphinxsidebar><h3>Contents</h3></div>", f"Search\n{SAID}\nAlerts\n{SAID}"),
        (f"<div class='md-container'><main class='md-main'><div class='md-content'><article><h1 id='navigation'>Navigation</h1>{P}<h2 id='footer-links'>Footer links</h2>{P}</article></div></main></div>", f"Navigation\n{SAID}\nFooter links\n{SAID}"),
    ],
)
def test_sections_stay_whatever_their_ids_and_plain_menus_go(page, want):
    assert extraction.main_text(body(page)) == want


def test_chosen_text_equals_ratios_by_all_pairs_of_paths():
    """The paths' ratios, smoothed over all pairs, decide as the tree's sums do."""
    page = body(f"<div><h1>Title</h1>{P * 2}<ul>{'<li>a</li>' * 9}</ul><table><tr><td>1<td>2</table></div>")
    read = extraction._Page(page)
    stats = {}
    for block in read.blocks:
        for path, _, _, raw in block:
            if raw.strip():
                extraction._add(stats.setdefault(path, [0, 0, 0, 0]), raw, False)
    own = {p: s[0] / s[2] * (1 + s[1] / s[2]) for p, s in stats.items()}

    def up(p):
        return [p] + (up(read.parent[p]) if read.parent[p] >= 0 else [])

    def apart(a, b):
        x, y = up(a), up(b)
        common = len(set(x) & set(y))
        return len(x) + len(y) - 2 * common

    smooth = {}
    for p in own:
        w = {q: extraction.WEIGHTS[apart(p, q)] for q in own if apart(p, q) <= extraction.FAR}
        smooth[p] = sum(w[q] * own[q] for q in w) / sum(w.values())
    assert extraction.smoothed(read.parent, own) == pytest.approx(smooth)


def test_nearly_parallel_vectors_go_by_their_doubles(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 3e-7]), (2, [1.0, 2e-7]), (3, [1.0, 1e-7])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, F.col("vec_id") == 50, k=2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 2] and got[0]["score"] > got[1]["score"]


def test_a_document_of_very_many_lines(spark):
    text = "\n".join(["this very line is said again and again"] * 200_000 + ["and this other one only once, at the end"])
    docs = spark.createDataFrame([(1, text), (2, "this very line is said again and again"), (3, "short\n\nshort")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup_lines(docs).collect()}
    assert got[1] == ("this very line is said again and again\nand this other one only once, at the end", 200_001, 199_999)
    assert got[2] == ("", 1, 1) and got[3] == ("short\n", 3, 1)


def test_a_host_of_very_many_letters(spark):
    run = "goodword" * 12_500
    runs = spark.createDataFrame([(run,), ("wordgood",), ("unknown",)], "run string")
    words = spark.createDataFrame([("good", 50), ("word", 40), ("go", 5)], "word string, n long")
    got = {r["run"]: r["words"] for r in urlfilter.segment_runs(runs, words, seeds=()).collect()}
    assert got[run] == ["good", "word"] * 12_500 and got["wordgood"] == ["word", "good"]
    assert all(got[r] == urlfilter.best_split(r, [(m, len(w), n) for w, n in (("good", 50), ("word", 40), ("go", 5)) for m in range(len(r)) if r.startswith(w, m)], 95) for r in ("wordgood", "unknown"))


def test_a_labelled_id_that_repeats_trains_once(spark):
    docs = spark.range(100_000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("filler words again "), (F.col("id") % 3).cast("string")).alias("text"))
    docs = docs.union(spark.range(1, 200).select("id", F.when(F.col("id") % 2 == 0, "you awful thing").otherwise("a kind remark")))
    labels = spark.range(0, 200).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    got = toxicity.score_toxicity(docs.where("doc_id > 0"), labels).agg(F.min(F.when(F.col("doc_id") % 2 == 0, F.col("toxicity"))), F.max(F.when(F.col("doc_id") % 2 == 1, F.col("toxicity")))).first()
    again = toxicity.score_toxicity(docs, labels).where("doc_id > 0").agg(F.min(F.when(F.col("doc_id") % 2 == 0, F.col("toxicity"))), F.max(F.when(F.col("doc_id") % 2 == 1, F.col("toxicity")))).first()
    assert got[0] > 0.7 > 0.3 > got[1] and again[0] > 0.7 > 0.3 > again[1]
