"""Near duplicates, lines, mixing, toxicity and the helpers under them, on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.linededup import dedup_lines
from lectern.llm.minhash import near_duplicates
from lectern.llm.mixing import fit_rates, mixed, mixing_rates
from lectern.llm.shared import bounded_labels, id_bitmap, in_bitmap
from lectern.llm.textbytes import pieces, shingle_sets
from lectern.llm.toxicity import FactorizationMachine, held_out, score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *more) for i, t, *more in rows], DOCS + extra)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_components(rows, percent):
    sets, up = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
            up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def near_rows():
    rng = random.Random(3)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(60):  # a family of near copies around the threshold, and exact copies of one of them
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[7][1].upper()) for i in range(30)]
    rows += [(200 + i, sentence(rng, rng.randrange(1, 40))) for i in range(40)]
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "two words"), (304, "Two\tWORDS"), (305, "a b c d e"), (306, "long " * 60_000), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_near_duplicates_match_brute_force(spark, percent):
    rows = near_rows()
    got = near_duplicates(docs_of(spark, rows), percent=percent).collect()
    want = brute_components(rows, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id]
        assert r.kept == (r.doc_id == want[r.doc_id])
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_near_duplicates_edge_rows(spark):
    text = "one two three four five six seven"
    docs = docs_of(spark, [(None, text, 1, "x"), (4, text, 2, "y"), (9, text, 3, None), (9, text, 3, None)], ", component_id long, key string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 4, True), (9, 4, False), (9, 4, False), (None, None, True)], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_texts_of_one_doc_id_bring_their_groups_together(spark):
    rng = random.Random(12)
    a, b, c = (sentence(rng, 80) for _ in range(3))
    near = lambda text: " ".join(text.split()[:-1] + ["other"])
    # 9 has the texts of 1 and of 3; 8 is near a copy of 4's and of 5's first text, beside a hub.
    rows = [(1, a), (3, b), (9, a), (9, b), (2, near(a)), (4, c), (5, near(c)), (8, sentence(rng, 80)), (8, near(near(c))), (8, near(near(c))), (7, "apart from all of these")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs_of(spark, rows), percent=80).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (9, 1, False), (4, 4, True), (5, 4, False), (8, 4, False), (7, 7, True)}


def test_second_round_finds_links_beside_the_hub(spark):
    """Members that are near each other, but not near the smallest of their keys."""
    rng = random.Random(8)
    common = sentence(rng, 150).split()
    rows = [(0, " ".join(common + sentence(rng, 60).split()))]
    for family in range(1, 6):
        own = common + sentence(rng, 60).split()
        rows += [(10 * family + k, " ".join(own[: -1 - k] + sentence(rng, 1 + k).split())) for k in range(4)]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, rows), percent=85).collect()}
    assert got == brute_components(rows, 85)


def test_shingle_sets_cut_at_rows():
    import pyarrow as pa

    col = pa.array(["a b c d e", None, "", "f g", "a b c d e f"])
    got = [s for _, _, data, offsets in pieces(col, 4) for s in shingle_sets(data, offsets, 5)]
    assert [len(s) for s in got] == [1, 0, 0, 1, 2]
    assert got[0][0] in got[4]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(1, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        group = {a, b} | up.get(a, set()) | up.get(b, set())
        for x in group:
            up[x] = group
    assert got == {x: min(g) for x, g in up.items() if x > min(g)}


def test_bitmap(spark):
    ids = spark.range(1000).select((F.col("id") * 7).alias("id"))
    bitmap = id_bitmap(ids, "id")
    from lectern.llm.shared import filter_bit

    bits = np.array([r[0] for r in ids.select(filter_bit("id")).collect()])
    assert in_bitmap(bits, bitmap).all()
    assert not id_bitmap(ids.limit(0), "id").any()


# Lines


def brute_lines(rows, least=20):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    seen, out = [], {}
    for i, text in sorted(rows):
        keep = []
        for line in text.split("\n"):
            if not line.strip(" \t\r"):
                keep.append(line)
                continue
            if line not in seen and not (len(line) >= least and any(len(s) >= least and near(line, s) for s in seen)):
                keep.append(line)
            seen.append(line)
        out[i] = "\n".join(keep)
    return out


def line_rows():
    rng = random.Random(5)
    lines = [sentence(rng, rng.randrange(3, 14)) for _ in range(25)] + ["é" * 30 + sentence(rng, 3), "x" * 40, "x" * 41, "x" * 42]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 6)):
            s = rng.choice(lines)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(s))
                s = rng.choice([s[:k] + s[k + 1 :], s[:k] + "z" + s[k:], s[:k] + "y" + s[k + 1 :]])
            text.append(rng.choice([s, s, "short", "shorx", "", " \t"]))
        rows.append((i, "\n".join(text)))
    return rows


def test_lines_match_brute_force(spark):
    rows = line_rows()
    got = {r.doc_id: r.text for r in dedup_lines(docs_of(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_many_lines_that_differ_in_one_place(spark):
    rows = [(i, f"Sign in as user {chr(0x4E00 + i)} to read the rest of this page") for i in range(300)]
    got = dedup_lines(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in got if r.n_removed == 0) == [0]


def test_line_edge_rows(spark):
    long = "word " * 20_000
    same = "a line that stands in more than one text"
    rows = [(None, same), (1, None), (2, ""), (3, same + "\n\n" + same), (3, same + "\n\n" + same), (4, long + "a"), (5, long + "b"), (6, "q" * 20), (7, "q" * 19), (8, "q" * 19 + "\n \n \n")]
    docs = docs_of(spark, [(*r, 5, "k") for r in rows], ", n_removed int, key string")
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got}
    assert by[None] == (same, 1, 0)
    assert by[1] == (None, None, None) and by[2] == ("", 1, 0)
    assert by[3] == ("", 3, 2)
    assert by[4][2] == 0 and by[5] == ("", 1, 1)
    assert by[6][2] == 0 and by[7][2] == 0 and by[8] == (" \n \n", 4, 1)
    assert dedup_lines(docs.limit(0)).collect() == []


# Mixing


def mix_rows():
    rng = random.Random(2)
    words = {"en": "the of and to in it", "fr": "le la des et une sur", "de": "der die das und ein von", "es": "el los las y una por"}
    rows, labels = [], []
    for i in range(400):
        lang = rng.choice(["en", "en", "en", "fr", "de", "es"])
        good = rng.random() < 0.8
        body = [rng.choice(words[lang].split()) for _ in range(rng.randrange(5, 60))] + ([] if good else ["!!"] * 9)
        rows.append((i, " ".join(body), lang, "s", 1))
        if i % 2:
            labels.append((i, int(good), 0))
    return rows, labels


def test_rates_meet_targets(spark):
    rows, labels = mix_rows()
    rates = mixing_rates(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    from lectern.llm.mixing import TARGETS

    p, t, r = np.stack(rates.p), rates.tokens.to_numpy(float), rates.rate.to_numpy()
    got = (p * (t * r)[:, None]).sum(0)
    want = np.array(list(TARGETS.values())) / sum(TARGETS.values()) * t.sum() * 1.25
    assert np.allclose(p.sum(1), 1) and (r >= 0).all()
    assert np.abs(got - want).max() < 1e-4 * t.sum()
    at = [list(TARGETS).index(d) for d in rates.domain]
    assert np.allclose(rates.wanted, want[at]) and np.allclose(rates.expected, got[at])
    truth = {i: f"{lang}/{int('!!' not in text)}" for i, text, lang, *_ in rows}
    assert np.mean([truth[i] == d for i, d in zip(rates.doc_id, rates.domain)]) > 0.97


def least_squares(tokens, p, wanted, most=np.inf):
    """Totals of the least squares over rates from 0 to most, by coordinate descent to the end."""
    a = p * tokens[:, None]
    r = np.zeros(len(a))
    got = a.T @ r
    for _ in range(20_000):
        before = got.copy()
        for i in range(len(a)):
            if tokens[i]:
                x = min(most, max(0.0, r[i] - a[i] @ (got - wanted) / (a[i] @ a[i])))
                got, r[i] = got + a[i] * (x - r[i]), x
        if np.abs(got - before).max() < 1e-10 * tokens.sum():
            break
    return got


@pytest.mark.parametrize("targets, most", [([0.1, 0.1, 0.4, 0.4], None), ([0.0, 0.0, 0.0, 1.0], None), ([0.25, 0.25, 0.25, 0.25], None), ([0.1, 0.1, 0.4, 0.4], 1.5)])
def test_rates_match_least_squares(spark, targets, most):
    rng = np.random.default_rng(6)
    # Soft memberships, so that pure targets are out of reach, and one domain with few tokens.
    p = rng.dirichlet([2.0, 1.5, 1.0, 0.2], 120)
    tokens = rng.integers(0, 400, 120).astype(float)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    rows, sums, wanted = fit_rates(members, targets, most_rate=most)
    got = rows.toPandas()
    assert (got.rate >= 0).all() and (most is None or (got.rate <= most).all())
    assert np.allclose((np.stack(got.p) * (got.tokens * got.rate).to_numpy()[:, None]).sum(0), sums)
    best = least_squares(tokens, p, np.array(wanted), most or np.inf)
    assert np.abs(best - sums).max() < 1e-4 * tokens.sum()


def test_mixing_edge_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 30_000, "fr", "s", 1), (3, "word " * 30_000, "fr", "s", 1), (None, "x y", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("bucket", F.lit("clash")).withColumn("p", F.lit(1))
    got = {(r.doc_id, r.tokens): r for r in mixing_rates(docs, labels).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 60_000), (None, 2)}
    assert all(abs(x - 1 / 8) < 1e-9 for x in got[1, 0].p)
    out = mixed(docs, labels)
    assert out.columns == docs.columns and all(r.doc_id in (1, 2, 3, None) for r in out.collect())
    assert mixing_rates(docs.limit(0), labels).collect() == []


def test_copies_follow_rates(spark):
    rows, labels = mix_rows()
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rates = {r.doc_id: r.rate for r in mixing_rates(docs, labels).collect()}
    copies = {r.doc_id: r["count"] for r in mixed(docs, labels).groupBy("doc_id").count().collect()}
    assert all(int(x) <= copies.get(i, 0) <= int(x) + 1 for i, x in rates.items())
    assert abs(sum(copies.values()) - sum(rates.values())) < 40


# Toxicity


def toxic_tables(spark, n=900):
    rng = random.Random(4)
    calm = [sentence(rng, 1) for _ in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randrange(5, 50))]
        kind = rng.randrange(6)
        if kind == 0:  # the pair is toxic, either word alone is not
            words[:2] = ["vermin", "group"]
        elif kind == 1:
            words[0] = "vermin"
        elif kind == 2:
            words[0] = "group"
        elif kind == 3:
            words[0] = "slurword" + rng.choice(["s", "ish", "er"])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind in (0, 3))))
    return rows, labels


def test_toxicity_learns_words_stems_and_pairs(spark):
    rows, labels = toxic_tables(spark)
    more = [(5000, "some slurwording here"), (5001, None), (5002, ""), (None, "vermin group"), (5003, "calm " * 50_000), (5000, "some slurwording here")]
    docs = docs_of(spark, [(*r, 0.5, 1) for r in rows + more], ", toxicity double, inputs int")
    scored = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).withColumn("out", held_out()).toPandas()
    assert len(scored) == len(rows) + len(more) and scored.toxicity.between(0, 1).all()
    truth = {i: y for i, _, y in labels}
    out = scored[scored.out & scored.doc_id.isin(list(truth))]
    wrong = [(r.toxicity >= 0.7) != truth[int(r.doc_id)] for r in out.itertuples()]
    assert len(out) > 200 and np.mean(wrong) < 0.03
    assert (scored[scored.doc_id == 5000].toxicity > 0.7).all()
    assert (scored[scored.doc_id.isin([5001, 5002])].toxicity < 0.5).all()


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = toxic_tables(spark, 30)
    kind = "doc_id long, quality int, toxic int"
    none = score_toxicity(docs_of(spark, rows), spark.createDataFrame([], kind)).toPandas()
    assert len(none) == 30 and (none.toxicity < 0.01).all()
    one = score_toxicity(docs_of(spark, rows), spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 1, 0)], kind)).toPandas()
    assert one.toxicity.nunique() == 1
    assert score_toxicity(docs_of(spark, rows).limit(0), spark.createDataFrame(labels, kind)).collect() == []


def test_toxicity_of_a_pair_without_single_effects(spark):
    rng = random.Random(8)
    calm = [sentence(rng, 1) for _ in range(60)]
    rows, labels = [], []
    for i in range(1500):
        # Either word has the label's share of all documents, alone; the pair decides.
        words = [rng.choice(calm) for _ in range(rng.randrange(10, 40))]
        a, b = i // 2 % 2, i // 4 % 2
        words += ["zorgle"] * a + ["quibber"] * b
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(a != b)))
    scored = score_toxicity(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).withColumn("out", held_out()).toPandas()
    truth = {i: y for i, _, y in labels}
    out = scored[scored.out]
    assert len(out) > 400 and np.mean([(r.toxicity >= 0.5) != truth[int(r.doc_id)] for r in out.itertuples()]) < 0.05


def test_machine_needs_pairs():
    rows = [[1, 2], [1], [2], []] * 50
    labels = np.array([0.0, 1.0, 1.0, 0.0] * 50)
    flat, sizes = np.array([x for r in rows for x in r], np.int32), np.array([len(r) for r in rows])
    model = FactorizationMachine.fit(flat, sizes, labels, np.ones(3), passes=300)
    got = model.scores(flat[:4], sizes[:4])
    assert (got[[1, 2]] > 0.7).all() and (got[[0, 3]] < 0.3).all()


def test_machine_sums_every_pair():
    rng = np.random.default_rng(3)
    model = FactorizationMachine(rng.normal(size=30), rng.normal(size=(30, 4)) / 5)
    model.factors[0] = 0
    rows = [rng.choice(np.arange(1, 30), k, replace=False) for k in (0, 1, 5, 20, 0, 3)]
    got = model.scores(np.concatenate(rows).astype(int), np.array([len(r) for r in rows]))
    for r, x in zip(rows, got):
        z = model.weights[0] + model.weights[r].sum() + sum(model.factors[i] @ model.factors[j] for k, i in enumerate(r) for j in r[:k])
        assert abs(x - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out(spark):
    import zlib

    got = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_bounded_labels(spark):
    labels = spark.createDataFrame([(i % 500, i % 2) for i in range(1000)] + [(None, 1)], "doc_id long, toxic int")
    assert bounded_labels(labels, 100).count() <= 100
    assert bounded_labels(labels, 5000).count() == 500
