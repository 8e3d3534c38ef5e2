"""The screen of passages: less work than passages times texts, and none missed."""

import random

import pytest

from lectern.operators import fuzzy, screening


def prose(rng, signs, words, n):
    known = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(words)]
    return " ".join(rng.choice(known) for _ in range(n))


def test_texts_unlike_all_passages_are_hardly_scanned(monkeypatch):
    monkeypatch.setattr(fuzzy, "FEW", 1)
    rng = random.Random(5)
    signs = "eeeeaaaoooiinnttrrsslldhcumpgb"
    texts = [prose(rng, signs, 2000, 900) for _ in range(6)]
    passages = [" ".join(w for i, w in enumerate(t[900:1150].split(" ")) if i % 9 != 4) for t in texts[:4]] + [prose(rng, signs, 2000, 40) for _ in range(12)]
    least, own, read = fuzzy._least, screening._least, []
    monkeypatch.setattr(fuzzy, "_least", lambda pieces, streams, signs: read.append(sum(map(len, streams)) * len(pieces)) or least(pieces, streams, signs))
    monkeypatch.setattr(screening, "_least", lambda sizes, masks, p, codes, starts, lengths, after: read.append(int((-(-sizes[p] // 32) * lengths).sum())) or own(sizes, masks, p, codes, starts, lengths, after))
    want = {(p, t): s for p, a in enumerate(passages) for t, b in enumerate(texts) if (s := fuzzy.partial_ratio(a, b, 0.85)) >= 0.85}
    assert len(want) >= 4 and {(p, t): s for p, t, s in fuzzy._matches(passages, texts, 0.85)} == want
    # By classes of characters alone, about a third of all words of bit vectors.
    assert sum(read) < 0.15 * sum(-(-len(p) // 32) for p in passages) * sum(map(len, texts))


@pytest.mark.parametrize("seed", range(12))
def test_the_screen_misses_nothing(seed, monkeypatch):
    """Windows cut at both ends of a text, texts shorter than passages, small stretches, blocks and groups, and any table of units, give what all windows give."""
    monkeypatch.setattr(fuzzy, "FEW", 1)
    rng = random.Random(seed)
    signs = rng.choice(["ab", "abcde", "abcdefghijklmnop", "aé漢字𝒳 \n\t", "abc  "])
    for name, sizes in (("STRETCH", (300, 1 << 16)), ("SUMMED", (500, 1 << 17)), ("COLUMNS", (2, 256)), ("STATE", (16, 1 << 15)), ("MOST", (0, 20, 10**6))):
        monkeypatch.setattr(screening, name, rng.choice(sizes))
    texts = [prose(rng, signs, 60, rng.randint(0, rng.choice([5, 30, 200]))) for _ in range(8)] + ["", "a"]

    def worn(x):
        rate = rng.choice([0.02, 0.07, 0.1])
        return "".join(c if rng.random() > rate else rng.choice(["", rng.choice(signs + "z")]) for c in x)

    passages = [worn(t[i : i + rng.randint(20, 300)]) for t in rng.choices(texts, k=6) for i in [rng.randint(0, max(0, len(t) - 1))]]
    passages += [worn(texts[0][:120]), worn(texts[1][-120:]), "xx" + texts[2][:90], texts[3][-90:] + " and no more", prose(rng, signs, 60, 25), "zzzz" * 30, passages[0]]
    for threshold in (0.65, 0.85):
        want = {(p, t): s for p, a in enumerate(passages) for t, b in enumerate(texts) if (s := fuzzy.partial_ratio(a, b)) >= threshold}
        assert {(p, t): s for p, t, s in fuzzy._matches(passages, texts, threshold)} == want


def test_units_of_the_texts_are_known_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "FEW", 1)
    rng = random.Random(8)
    texts = [prose(rng, "abcdefghijklmnopqrst", 400, 300) for _ in range(20)] + ["", "short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    passages = [(i, " ".join(w for k, w in enumerate(t[200:420].split(" ")) if k % 9 != 4)) for i, t in enumerate(texts[:5])] + [(9, "too short to be screened")]
    units = fuzzy._common_units(docs)
    assert set(screening.unit_counts([texts[0]]).most_common(1)[0][:1]) <= set(units)
    got = fuzzy.fuzzy_passages(spark.createDataFrame(passages, "passage_id long, passage string"), docs).collect()
    want = {(p, d): s for p, a in passages for d, t in enumerate(texts) if (s := fuzzy.partial_ratio(a.strip(), t or "")) >= 0.85}
    assert len(want) >= 5 and {(r.passage_id, r.doc_id): r.score for r in got} == want


def test_the_best_record_of_a_passage_comes_from_screened_texts(spark, tmp_path, monkeypatch):
    from lectern.plans import QUERIES

    monkeypatch.setattr(fuzzy, "FEW", 1)
    rng, known, know = random.Random(9), [], screening.Screen.know
    texts = [prose(rng, "abcdefghijklmnopqrst", 300, 250) for _ in range(6)]
    texts += [texts[0], texts[1].replace("a", "b", 20)]
    monkeypatch.setattr(screening.Screen, "know", lambda self, units, costs: known.append(len(units)) or know(self, units, costs))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t[100:420]) for i, t in enumerate(texts)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.passage_id: r.doc_id for r in QUERIES["passage_anywhere"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        worn = " ".join(w for k, w in enumerate(t[100:420].split(" ")) if k % 9 != 4).strip()
        scores = {d: s for d, b in enumerate(texts) if (s := fuzzy.partial_ratio(worn, b)) >= 0.85}
        assert got.get(i) == (min(scores, key=lambda d: (-round(scores[d], 6), d)) if scores else None)
    assert len(got) >= 6 and max(known) > 20
