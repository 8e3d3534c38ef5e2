"""Extraction, urls, lengths, pieces, neighbours, fingerprints and the pipeline, on small tables."""

import math
import random
from decimal import Decimal, localcontext
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, chroma, extraction, tokencount, urlfilter
from lectern.llm.pieces import SPACE, Pieces, applied, decode_ids, encode_n_best

PAGES = "page_id long, url string, html string"

# Extraction


def page(article, before="", after=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home, page</a></ul></nav>{before}{article}{after}</body></html>'


ARTICLE = "<article><h1>The  title &amp; more</h1><p><b>First paragraph, with\n words.<br>And a line.<p>Second &lt;one&gt;, unclosed</article>"
WANT = "The title & more\nFirst paragraph, with words. And a line.\nSecond <one>, unclosed"


@pytest.mark.parametrize(
    "before, after",
    [
        ("", ""),
        ('<header><h2>Site, name.</h2></header><div class="cookie-notice"><p>We use cookies, yes.</p></div>', '<aside><p>Related things, here.</p></aside><footer>&copy; a, b</footer>'),
        ('<!-- <p>hidden</p> --><div class="ad">Buy, now.</div>', '<section id="comments"><p>Nice post, thanks, really, a lot, I mean it.</p></section><form><p>Sign up, please.</p><input name=a></form>'),
        ('<div role="navigation"><p>Menu, menu.</p></div>', '<div class="sidebar widget"><p>More, more.</p></div><noscript><p>No script.</p></noscript>'),
    ],
)
def test_main_text_is_the_article(before, after):
    assert extraction.main_text(page(ARTICLE, before, after)) == WANT


def test_main_text_without_an_article_element():
    body = "<div id=main><p>" + "A long sentence, with marks; and words. " * 8 + "</p><p>" + "Another one, as long as that. " * 5 + "</p></div>"
    links = "<div><ul>" + "<li><a href=/x>Go</a>" * 30 + "</ul></div>"
    assert extraction.main_text(page(body, links)).splitlines()[0].startswith("A long sentence") and "Go" not in extraction.main_text(page(body, links))


PROSE = "".join(f"<p>Paragraph {i}, which says one thing and another.</p>" for i in range(3))
SAID = "\n".join(f"Paragraph {i}, which says one thing and another." for i in range(3))


@pytest.mark.parametrize(
    "around",
    ['class="page has-sidebar"', 'class="content no-comments"', 'class="post-content with-banner"', 'class="elementor-widget-text-editor elementor-widget"', 'id="main-banner-area"',
     'style="overflow:hidden" title="hidden"', 'data-role="menu"', "class='article-body' hidden-by=x"],
)
def test_names_of_the_layout_strike_no_article(around):
    assert extraction.main_text(page(f"<div {around}>{PROSE}</div>", "<div class='ad'>Buy this.</div>", "<div id=comments><p>A reader, who has much to say.</p></div>")) == SAID


def test_named_parts_go_whatever_their_length():
    long = "A reader has a lot to say, and says it here. " * 40
    for name in ("comments", "post-comments", "ad", "sidebar"):
        assert extraction.main_text(page(f"<div>{PROSE}</div>", after=f'<div class="{name}"><p>{long}</p></div>')) == SAID
    assert extraction.main_text(page(f'<div class="wrap-modal"><article>{PROSE}</article></div>', f'<div class="top-banner">{long}</div>')) == SAID


def test_math_and_unclosed_elements():
    assert extraction.main_text("<p>The value <math><mi>x</mi><annotation>$x$</annotation></math> holds, as said.</p>") == "The value x holds, as said."
    for tag in ("button", "select", "svg", "iframe", "noscript"):
        assert extraction.main_text(f"<article><{tag}>{PROSE}</article>") == SAID
        assert extraction.main_text(f"<article><{tag}>gone</{tag.upper()} >{PROSE}</article>") == SAID
    for tag in ("script", "style", "textarea"):
        assert extraction.main_text(f"<article>{PROSE}<{tag}>{PROSE}") == SAID


def test_hostile_pages_take_linear_time():
    import time

    start = time.time()
    for part in ("<b>", "<b>x", "<div>", "<div><p>x", "<li>y", "<button>", "<svg>", "</i>", "<td><p>", "<!--", "<p class='", "<a b=c", "<ul><li><b>"):
        extraction.main_text(part * 20_000)
        extraction.main_text(f"<article>{PROSE}</article>" + part * 5_000)
    extraction.main_text("<p>word and word, " * 200_000)
    assert time.time() - start < 60


def test_smoothing_matches_all_pairs():
    rng = random.Random(9)
    parent = [-1, *(rng.randrange(max(0, i - 6), i) for i in range(1, 60))]
    values = {i: rng.random() for i in rng.sample(range(60), 25)}

    def up(i):
        return [i, *up(parent[i])] if i >= 0 else []

    def steps(i, j):
        a, b = up(i), up(j)
        return len(a) + len(b) - 2 * len(set(a) & set(b))

    got = extraction.smoothed(parent, values)
    for i in values:
        w = {j: math.exp(-steps(i, j) ** 2 / 2) if steps(i, j) <= extraction.FAR else 0.0 for j in values}
        assert abs(got[i] - sum(w[j] * values[j] for j in values) / sum(w.values())) < 1e-9


def test_extraction_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain <b>text</b> &eacute;"), (4, "u", "<p>" + "word, " * 60_000), (4, "u", "<div><div <p"), (None, "u", page(ARTICLE)), (None, "u", page(ARTICLE))]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES + ", text string, __x int")
    got = extraction.extract_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = [r.text for r in got]
    assert by[:3] == ["", "", "plain text é"] and len(by[3]) > 300_000 and by[5] == by[6] == WANT
    assert extraction.extract_text(pages.limit(0)).collect() == []


# Urls


def test_hosts_paths_and_rules(spark):
    cases = [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.org/a", "x.org", "/a", "org/", "allow"), ("http://x.org", "x.org", "", None, None), ("//x.org/a", "", "", None, None), (None, "", "", None, None),
        ("ftp://com/fr/", "com", "/fr/", "com/fr/", "allow"), ("http://notcom/fr/", "notcom", "/fr/", None, None), ("x://b.com/de/?q=://z", "b.com", "/de/", "com/de/", "block"), ("a://b://c/d", "b:", "//c/d", None, None),
    ]
    df = spark.createDataFrame([(u,) for u, *_ in cases], "url string").coalesce(1)
    df = df.select(urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p"))
    rule, verdict = urlfilter.longest_rule(F.col("h"), F.col("p"))
    assert [tuple(r) for r in df.select("h", "p", rule, verdict).collect()] == [c[1:] for c in cases]


def test_segmentation_matches_brute_force():
    rng = random.Random(6)
    words = {"a": 5, "b": 2, "ab": 4, "ba": 3, "aba": 6, "bb": 1}
    total = sum(words.values())
    price = lambda w: math.log(words[w] / total) if w in words else math.log(10 / total) - len(w) * math.log(10)
    for _ in range(60):
        run = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        found = [(i, k, words[run[i : i + k]]) for i in range(len(run)) for k in range(1, len(run) - i + 1) if run[i : i + k] in words]
        cuts = [[run[i:j] for i, j in zip((0, *c), (*c, len(run)))] for n in range(len(run)) for c in __import__("itertools").combinations(range(1, len(run)), n)]
        got = urlfilter.best_split(run, found, total)
        assert "".join(got) == run and sum(map(price, got)) == pytest.approx(max(sum(map(price, c)) for c in cuts))


def test_urls_are_judged_by_words_of_their_hosts(spark):
    text = "<p>" + "cheap " * 50 + "pills " * 40 + "garden " * 60 + "club " * 30 + "the " * 90 + "</p>"
    rows = [(i, f"http://a.org/en/{i}2", text) for i in range(40)] + [(100 + i, f"http://b.com/de/{i}", text) for i in range(40)]
    rows += [(200, "https://cheappills.net/en/7", text), (201, "https://gardenclub.net/en/72", None), (202, None, text), (202, None, text)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", verdict string")
    got = {r.page_id: r for r in urlfilter.judge_urls(pages).collect()}
    assert got[200].host_words == ["cheap", "pills", "net"] and got[200].verdict == "block"
    assert got[201].host_words == ["garden", "club", "net"] and got[201].verdict == "allow"
    assert got[202].host == "" and got[202].path == "" and got[202].rule is None and got[202].verdict in ("allow", "block")
    assert all(got[i].verdict == "allow" and got[i].block_odds is None for i in range(40)) and all(got[100 + i].verdict == "block" for i in range(40))
    assert urlfilter.judge_urls(pages.limit(0)).collect() == []


def test_urls_learn_from_seeds_and_leave_other_pages_alone(spark):
    """Words that stand beside seed words speak for blocking; paths that a rule blocks on one site don't, on others."""
    text = "<p>" + "garden winner river stone and the old " * 30 + "</p>"
    rows = [(i, f"http://casinowinner{'' if i % 2 else 's'}.net/en/{i}", text) for i in range(20)] + [(100 + i, f"http://example.org/es/{i}", text) for i in range(60)]
    rows += [(200 + i, f"http://www.{h}.net/{lang}/{i}", text) for i, (h, lang) in enumerate((h, lang) for h in ("garden", "riverstone", "oldgarden", "qzxv") for lang in ("en", "es", "fr"))]
    rows += [(300, "https://winner.net/en/5", text), (301, "https://essexgarden.net/es/1", text)]
    got = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1].host_words == ["casino", "winner", "net"] and all(got[i].verdict == "block" for i in range(20))
    assert all(got[i].verdict == "block" and got[i].rule == "example.org/es/" for i in range(100, 160))
    assert {i: r.verdict for i, r in got.items() if 200 <= i < 300 and r.verdict != "allow"} == {} and got[301].verdict == "allow"


def test_counts_outweigh_seed_words():
    """Naive Bayes by hand; a seed word that stands in allowed pages' hosts, or in paths, doesn't block."""
    pages = [(["casino", "com"], "/en/1", "block")] * 8 + [(["garden", "com"], "/en/2", "allow")] * 50 + [(["family", "net"], "/farm/loans/3", "allow")] * 30
    import pyarrow as pa

    names = ["words", "path", "verdict"]
    got = next(urlfilter._count(iter([pa.record_batch([pa.array(x) for x in zip(*pages)], names=names)]))).to_pydict()

    class Labelled:
        def mapInArrow(self, *_):
            return self

        groupBy = agg = mapInArrow

        def collect(self):
            return list(zip(got["bucket"], got["allow"], got["block"]))

    prior, odds = urlfilter.learn(Labelled())
    score = lambda words, path: prior + odds[urlfilter._tokens(words, path)].sum()
    counts = {"allow": Counter(), "block": Counter({f"h {w}": urlfilter.SEED_PAGES for w in urlfilter.SEEDS})}
    for words, path, verdict in pages:
        counts[verdict].update([f"h {w}" for w in words] + [f"p {t}" for t in path.split("/") if t.isalpha()] + [f"n {t} 1" for t in path.split("/") if t.isdigit()])
    every = counts["allow"] + counts["block"]
    share = lambda side, t: (counts[side][t] + urlfilter.SMOOTHING * every[t] / every.total()) / (counts[side].total() + urlfilter.SMOOTHING)
    want = math.log(9 / 81) + sum(math.log(share("block", t) / share("allow", t)) for t in ("h casino", "h com", "p en", "n 1 1"))
    assert abs(score(["casino", "com"], "/en/1") - want) < 1e-9 and want > 0
    assert score(["family", "net"], "/farm/") < 0 and score(["garden", "com"], "/loans/9") < 0 and score(["unseen"], "/adult/") < 0


# Lengths


def test_length_table_matches_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join("word" for _ in range(rng.choice([1, 2, 3, 700, 1023, 1024, 5000]))) for _ in range(60)] + [None, "", "x", "x"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    sums = tokencount.token_length_table(docs)
    lengths = [len(tokencount.encoder().encode_ordinary(t or "")) for t in texts]
    count = Counter(lengths)
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(count)
    for n, r in got.items():
        assert r.docs == count[n] and r.docs_from == sum(x >= n for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.cut == sum(x > n for x in lengths) and r.truncated == sum(min(x, n) for x in lengths) and r.share == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    assert {r.limit: r.total for r in tokencount.truncated_totals(sums, [0, 5, 512, 10**9]).collect()} == {c: sum(min(x, c) for x in lengths) for c in (0, 5, 512, 10**9)}
    assert {r.share: r.n_tokens for r in tokencount.length_quantiles(sums, [0.0, 0.5, 1.0]).collect()} == {0.0: min(lengths), 0.5: sorted(lengths)[(len(lengths) + 1) // 2 - 1], 1.0: max(lengths)}
    assert tokencount.token_length_table(docs.limit(0)).collect() == []


# Pieces


def all_segmentations(own, text):
    s, out = SPACE + text.replace(" ", SPACE), []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        for j in range(i + 1, len(s) + 1):
            if (p := own.pieces.get(s[i:j])) is not None:
                go(j, score + p[1], [*ids, p[0]])
            elif j == i + 1:
                go(j, score + own.unknown, [*ids, *own._ids(s, i, j)])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "hello\nhi", "中文 a", "a  b", "  x", " ", "é😀z", "eating st", "x" * 17, "ab" * 7, "     q", "\n", "a\n\n b"])
def test_n_best_matches_all_segmentations(text):
    own = Pieces.load()
    links = own.links(text)
    own.ready([links])
    ids, scores, changes = own.n_best(links, 6)
    want = all_segmentations(own, text)
    assert scores == [s for s, _ in want[:6]]
    best = np.frombuffer(ids, np.int32).tolist()
    made = [tuple(applied(best, c)) for c in [[], *changes]]
    assert len(set(made)) == len(made)
    for score, ids_ in zip(scores, made):
        assert ids_ in {i for s, i in want if s == score} and own.decode(list(ids_)) == text


def test_very_long_links():
    import time

    own, start = Pieces.load(), time.time()
    rng = random.Random(1)
    score = {i: x for i, x in own.pieces.values()}
    for text in ("".join(rng.choice("ABCDabcdefghijklmnop0123456789+/") for _ in range(100_000)), "a" * 100_000, "".join(rng.choice("的一是不了在人有我他") for _ in range(100_000))):
        links = own.links(text)
        own.ready([links])
        ids, scores, changes = own.n_best(links, 4)
        ids = np.frombuffer(ids, np.int32).tolist()
        every = [ids, *(applied(ids, c) for c in changes)]
        assert len({tuple(x) for x in every}) == len(every) == len(scores) and scores == sorted(scores, reverse=True)
        assert all(own.decode(x) == text for x in every)
        if all(i in score for i in ids):
            assert all(abs(sum(score[i] for i in x) - y) <= 1e-9 * abs(y) for x, y in zip(every, scores))
    assert time.time() - start < 60


def test_long_and_short_links_are_cut_alike():
    own = Pieces.load()
    words = [SPACE + "".join(random.Random(k).choice("thearonisd") for _ in range(k)) for k in range(1, 47)]
    own.learn(words)
    for w in words:
        assert own.known[w][1:] == own._one(w)[1:]
        assert own.search(w, 1)[0][0] == own.known[w][1]


def test_encoding_edge_rows(spark):
    texts = [None, "", "plain text", "plain text", "line\nline\ttab", "▁ mark", "long " * 40_000, "y" * 3_000, "naïve 日本語 \U0001f600"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = decode_ids(encode_n_best(docs, n=3)).orderBy("doc_id").collect()
    assert (rows[0].ids, rows[0].scores, rows[0].decoded, rows[0].round_trip) == (None, None, None, None)
    assert rows[1].ids == [] and rows[1].scores == [0.0] and rows[1].decoded == ""
    assert rows[2].ids == rows[3].ids and rows[2].changes == rows[3].changes
    assert [r.round_trip for r in rows[1:]] == [t.find("▁") < 0 for t in texts[1:]]
    assert all(r.decoded == t for r, t in zip(rows[1:], texts[1:]) if "▁" not in t)
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in rows[1:])
    assert encode_n_best(docs.limit(0)).collect() == []


# Neighbours


def brute_neighbours(rows, k=5):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}

    def cos(a, b):
        """The cosine to fifty digits, as the nearest double."""
        with localcontext(prec=50):
            a, b = [Decimal(x) for x in a], [Decimal(x) for x in b]
            return float(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a).sqrt() * sum(x * x for x in b).sqrt()))

    for i, v in rows:
        if i % 50 == 0:
            best = sorted({(-cos(v, w), j) for j, w in rows if j != i})[:k]
            out[i] = [j for _, j in best]
    return out


def test_parallel_and_mirrored_vectors_tie(spark):
    rng = np.random.default_rng(8)
    v = [float(np.float32(x)) for x in rng.normal(size=4)]
    rows = [(i, [x * 2.0 ** (i % 7) * (1 + i % 3) for x in v]) for i in range(100, 0, -1)] + [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(150, 700)]
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in y]) for i, y in rows], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, dims=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    # Those that single precision holds exactly tie with each other; thrice a vector is rounded there, and so is the query.
    exact = [i for i in range(1, 101) if i % 3 != 2]
    assert got == brute_neighbours(rows) and set(got[50]).isdisjoint(exact) and got[100] == [i for i in exact if i != 100][:5]


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)] + [(50, rows[50][1]), (2000, None), (2050, [0.0] * 4), (2100, [1.0, None, 0.0, 0.0]), (2150, [1.0, float("nan"), 0.0, 0.0]), (2200, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, key int, cell int")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_neighbours(rows)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = {r.query_id: r.vec_id for r in ann.nearest(df.where("vec_id IN (50, 51)"), F.col("vec_id") % 50 == 0).collect()}
    assert few == {50: 51}


def test_neighbours_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 200)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    vectors = (centers[rng.integers(0, 12, 2000)] + 0.4 * rng.normal(size=(2000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        hits += len(found & set(np.argsort(-score)[:5].tolist()))
    assert len(got) == 40 and hits >= 0.97 * 200


def test_cells_bound_distances():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(500, 4))
    nodes = ann.fit_cells(points, 16)
    cells = ann._cell_of(points, nodes)
    for q in points[:20]:
        gaps = ann._cell_gaps(q, nodes)
        assert (((points - q) ** 2).sum(1) >= gaps[cells] - 1e-9).all() and gaps[ann._cell_of(q[None], nodes)[0]] == 0
    assert ann.chi_square_bound(0.95, 2) == pytest.approx(5.9915, abs=1e-3)


# Fingerprints


def test_filters_match_plain_sums():
    rng = np.random.default_rng(2)
    samples = rng.normal(size=chroma.FRAME + 20 * chroma.HOP) * 0.2
    picture = chroma.chroma(samples)
    codes = chroma.fingerprint(samples)
    assert len(codes) == len(picture) - chroma.WIDEST + 1
    for at in (0, 3, len(codes) - 1):
        want = 0
        for kind, low, high, wide in chroma.filters():
            box = picture[at : at + wide, low : low + high]
            t, p = wide // 2, high // 2
            a, b = {"time": (box[:t], box[t:]), "pitch": (box[:, :p], box[:, p:]), "check": (None, None)}[kind]
            a, b = (box[:t, :p].sum() + box[t:, p:].sum(), box[t:, :p].sum() + box[:t, p:].sum()) if kind == "check" else (a.sum(), b.sum())
            want = want << 2 | int(chroma.GRAY[np.searchsorted(chroma.CUTS, round(math.log((1 + a) / (1 + b)), 9), "right")])
        assert codes[at] == want


def test_cut_and_noisy_recordings_align(spark):
    rng = np.random.default_rng(7)
    tune = lambda n: np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * np.arange(2 * chroma.HOP) / chroma.RATE) for _ in range(n)])
    pcm = lambda x: (x * 12000).astype("<i2").tobytes()
    a, b = tune(60), tune(60)
    noisy = a[10 * chroma.HOP :] + 0.02 * rng.normal(size=len(a) - 10 * chroma.HOP)
    rows = [(0, pcm(a)), (1, pcm(noisy)), (2, pcm(b)), (3, pcm(a)), (4, None), (5, b""), (6, b"\x01"), (7, pcm(np.zeros(9000))), (None, pcm(b))]
    media = spark.createDataFrame([(i, m, "x") for i, m in rows], "id long, media binary, codes string")
    prints = chroma.fingerprints(media)
    got = {(r.query_id, r.match_id): r for r in chroma.align(prints, ["id"], F.col("id") % 20 == 0).collect()}
    assert set(got) == {(0, 1)}
    hit = got[0, 1]
    assert hit.offset == 10 and hit.copies == 2 and hit.bit_error < 0.15 and hit.votes >= 20
    every = {r.query_id: r.match_id for r in chroma.align(prints, ["id"], F.lit(True)).collect()}
    assert every[1] == 0 and every[2] is None and every[4] is None and every[7] is None
    assert chroma.align(prints.limit(0), ["id"], F.lit(True)).collect() == []


def brute_alignment(x, y, apart=4, least=3, most=0.25):
    """(votes, offset, overlap, error) of two recordings, by trying every pair of places."""
    def keys(c):
        k = [(c[i], c[i + apart]) for i in range(len(c) - apart)]
        return [(p, i) for i, p in enumerate(k) if i == 0 or k[i - 1] != p]

    votes = Counter(i - j for p, i in keys(x) for q, j in keys(y) if p == q)
    found = []
    for o, n in votes.items():
        pairs = [(x[i], y[i - o]) for i in range(len(x)) if 0 <= i - o < len(y)]
        error = sum((a ^ b).bit_count() for a, b in pairs) / (32 * len(pairs))
        if n >= least and error <= most:
            found.append((n, -o, len(pairs), error))
    return max(found, default=None)


def stored(spark, rows, tmp_path):
    """Rows read from a file, whose plan is not folded before it runs."""
    spark.createDataFrame(rows, "id long, codes array<long>").write.parquet(str(tmp_path / "prints"))
    return spark.read.parquet(str(tmp_path / "prints"))


def test_alignment_matches_brute_force(spark, tmp_path):
    rng = random.Random(10)
    phrases = [[rng.getrandbits(32) for _ in range(rng.randrange(4, 12))] for _ in range(5)] + [[7] * 30]
    rows = []
    for i in range(60):
        codes = [c for _ in range(rng.randrange(0, 7)) for c in rng.choice(phrases)]
        rows.append((i, [c ^ (1 << rng.randrange(32)) if rng.random() < 0.1 else c for c in codes]))
    # A clip of a phrase's second place, and a recording that lasts.
    rows += [(200 + k, list(range(k))) for k in range(1, 8)]
    rows += [(100, rows[7][1][-20:]), (101, [3] * 5000), (102, [3] * 4000 + [9, 8, 7]), (103, [])]
    got = {(r.query_id, r.match_id): (r.votes, -r.offset, r.overlap, r.bit_error) for r in chroma.align(stored(spark, rows, tmp_path), ["id"], F.lit(True)).collect() if r.match_id is not None}
    first = {}
    for i, c in rows:
        first.setdefault(tuple(c), i)
    want = {(i, j): w for i, x in rows for y, j in first.items() if tuple(x) != y and (w := brute_alignment(x, list(y)))}
    assert len(want) > 50 and set(got) == set(want)
    assert all(got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-12 for k in want)


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    shared = "this very line stands at the end of many documents of the table"
    for i in range(240):
        toxic = i % 6 == 0
        body = text(60) + (" youmoron" if toxic else "") + ("\n" + shared if i % 4 == 0 else "")
        rows.append((i, body, "en", f"src{i % 3}", len(body)))
        labels.append((i, 1, int(toxic)))
    base = rows[1][1].split()
    rows += [(300, rows[1][1], "en", "s", 1), (301, " ".join(base[:-1] + ["other"]), "en", "s", 1), (302, None, None, None, None), (303, "", "en", "s", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    docs, seen = spark.read.parquet(folder + "/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == list(cp.COLUMNS)
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}
    assert not any(i % 6 == 0 for i in ids["toxicity"] if i < 240) and {302, 303} | {i for i in range(240) if i % 6} <= ids["toxicity"]
    kept = [r for r in seen["line_dedup"] if r.text and shared in r.text]
    assert [r.doc_id for r in kept] == [4] and 300 not in ids["line_dedup"] and 301 in ids["line_dedup"]
    assert 301 not in ids["minhash_near_dedup"] and 1 in ids["minhash_near_dedup"] and ids["minhash_near_dedup"] == ids["line_dedup"] - {301}
    assert all(r.round_trip for r in seen["sentencepiece"] if r.ids is not None) and ids["sentencepiece"] == ids["mixing"]
    assert sorted(r.doc_id for r in cp.run(spark, folder).collect()) == sorted(r.doc_id for r in seen["sentencepiece"])


def test_pipeline_stages_on_edge_tables(spark, tmp_path):
    import corpus_pipeline as cp

    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i == 1)) for i in range(1, 7)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    line = "a line of text that more than one document holds"
    rows = [(None, "some text here", "en", "s", 14), (1, None, None, None, None), (2, "", "en", "s", 0), (3, line + "\n\n" + line, "en", "s", 98), (4, line + "\n \n", "en", "s", 51), (5, "word " * 30_000, "fr", "s", 150_000), (6, "x", "en", "s", 1), (6, "x", "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit("clash") for c in ("toxicity", "n_removed", "component_id", "kept", "rate", "p", "tokens", "domain", "ids", "scores", "version", "__id", "__hash", "word", "at")}
    docs = spark.createDataFrame(rows, kind).withColumns(clash)
    ids = lambda df: sorted((r.doc_id if r.doc_id is not None else -1 for r in df.collect()))
    kept = {name: ids(stage(spark, docs, folder)) for name, stage in cp.STAGES}
    assert kept["toxicity"] == kept["sentencepiece"] == [-1, 1, 2, 3, 4, 5, 6, 6]
    assert kept["line_dedup"] == [-1, 1, 2, 3, 5, 6, 6] and kept["minhash_near_dedup"] == [-1, 1, 2, 3, 4, 5, 6, 6]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
    spark.createDataFrame(rows, kind).limit(0).write.parquet(folder + "/documents.parquet")
    assert cp.run(spark, folder).collect() == []
