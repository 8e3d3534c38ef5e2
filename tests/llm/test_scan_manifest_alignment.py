"""License scans, the Merkle manifest and tokenizer alignment against brute force, on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import alignment, licenses, manifest
from lectern.llm.license_rules import KEYWORDS, RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# License scan

LICENSED = [
    None, "", "...", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "cc  by, CC-BY! cc by-sa 3.0", "SPDX-License-Identifier: GPL-2.0-only", "A license to drive; she accepts the domain.", "mit mit license license mit LICENSE",
    "apache\nlicense apache" + " word" * 60 + " mit licence", "licence", "GPLv3 or later", "under the gnu gpl version 2 or any later version", "İ mit licenſe Mit License K",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)",
    "see https://www.apache.org/licenses/LICENSE-2.0 and https://creativecommons.org/licenses/by-sa/4.0/", "dual licensed under the MIT license or the Apache license 2.0", "x" * 300 + " bsd 3-clause license",
    "the mit license " * 40, "gnu general public license as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "𝔘 gnu general public license 日本 apache license", "Licensed under the MIT license", None,
]


def scanned_by_hand(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = []
    for i, w in enumerate(words):
        window = " ".join([*words[max(0, i - licenses.SPAN) : i], "@" + w, *words[i + 1 : i + 1 + licenses.SPAN]])
        tried = []
        for r in RULES:
            if w in KEYWORDS[r.kind].split() and r.needs in window and (m := re.search(f"(?:^| )({r.pattern})(?: |$)", window)):
                first = i - m[1].split("@")[0].count(" ")
                tried.append((r.level, m[1].count(" ") + 1, -r.number, first, first + m[1].count(" "), r.label))
        found += [max(tried)] if tried else []
    beaten = lambda d: any(
        e is not d and e[3] <= d[4] and d[3] <= e[4] and (e[0] > d[0] or e[0] == d[0] and e[3] <= d[3] and d[4] <= e[4] and (e[1] > d[1] or e[2] > d[2])) for e in found
    )
    kept = [d for d in found if not beaten(d)]
    join = lambda x: ",".join(sorted(set(x)))
    level = max([d[0] for d in kept] + [2] * bool(base), default=0)
    places = [i for i, _ in base]
    return (len(words), len(base), min(places, default=None), max(places, default=None), join(x for _, x in base), join([x for _, x in base] + [d[5] for d in kept]), licenses.SURE.get(level, 0.0))


def test_scan_equals_every_rule_at_every_word(spark):
    docs = spark.createDataFrame([(i, t, "n_words") for i, t in enumerate(LICENSED)], "doc_id long, text string, detections string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.label_columns(licenses.scan_licenses(docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}
    assert got == {i: scanned_by_hand(t) for i, t in enumerate(LICENSED)}
    assert got[3][5] == "apache,apache-2.0" and got[6][5] == "cc-by,cc-by-nc-4.0" and got[9][5] == "" and got[8][5] == "gpl-2.0-only"


def test_scan_sql(spark):
    docs = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(licenses.ORACLE).fetchall()
    got = licenses.label_columns(licenses.scan_licenses(docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert licenses.label_columns(licenses.scan_licenses(docs.limit(0))).count() == 0


def test_rules_have_keywords_and_stems():
    assert len(RULES) > 300
    for words in KEYWORDS.values():
        assert all(any(stem in w for stem in licenses.STEMS) for w in words.split())
    assert all(r.pattern.count("@") == 1 and re.compile(r.pattern) and r.kind in KEYWORDS for r in RULES)


def test_scan_of_a_long_text_of_licenses_is_linear(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.\n" * 30_000)], "doc_id long, text string")
    row = licenses.label_columns(licenses.scan_licenses(docs)).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (30_000, 3, 3 + 5 * 29_999, "mit")


# Merkle manifest


def by_hand(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, source, n: h(*map(field, (i, source, lang, n, t)))

    def tree(hashes):
        paths, place, now = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
        while len(now) > 1:
            for k, p in enumerate(place):
                f = p - p % 3
                paths[k].append((now[f:p], now[p + 1 : f + 3]))
                place[k] = p // 3
            now = [h(*now[i : i + 3]) for i in range(0, len(now), 3)]
        return now[0], paths

    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        made[s] = tree([leaf(*r) for r in trees[s]])
    root, tops = tree([made[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(trees[s], made[s][1]):
            steps = path + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            x = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if changed else leaf(*r)
            for a, b in steps:
                x = h(*a, x, *b)
            out.append((r[0], leaf(*r), made[s][0], root, h(*[y for a, b in steps for y in (*a, *b)]), x, x == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("sources", [1, 5])
def test_manifest_equals_brute_force(spark, sources):
    rows = [(i, f"line {i}\nand more" if i % 3 else f"no break {i}", "en", f"s{i % sources}", i) for i in range(2000 if sources == 1 else 300)]
    rows += [(None, "a\nb", None, None, None), (7, None, "de", None, 3), (7, "", "de", None, 3), (7, "", "de", None, 3), (-5, "é\n日本", "ja", "", -1), (1 << 60, "long\nid", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("hash", F.lit("x")).withColumn("i", F.lit(1))
    got = manifest.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=key) == sorted(by_hand(rows), key=key)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(1, "x\ny", "en", "s", 3)]
    got = manifest.manifest(spark.createDataFrame(one, DOCS)).first()
    assert got["leaf"] == got["root"] == got["subroot"] and got["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_manifest_sql(spark):
    rows = [(i, f"line {i}\nand more", "en" if i % 2 else None, f"s{i % 3}", i) for i in range(100)] + [(None, None, None, None, None), (3, "e", "x", "", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    got = manifest.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=key) == sorted(c.sql(manifest.ORACLE).fetchall(), key=key)


# Tokenizer alignment

TEXTS = [
    None, "", " ", "   ", "a", "Hello, world! It's a test.", "two  spaces\n\n and\tlines \r\n end ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ low line", "x▁y", "naïve café 日本語 🙂🙂 é",
    "\n\nstart", "a b 　 c d", "tab\t tab\t\n x", "supercalifragilistic antidisestablishmentarianism " * 3, "a b c " * 50, "\x00 nul \x1c sep \x85 nel   x", "end with space ", "don't we'll I'VE 1234 56.78", " lead",
    "a \n b", "a\r\n\r\nb", "word" * 400, "foo.\n \n bar", "ＦＵＬＬ ﬁ ½", "Hello, world! It's a test.",
]


def aligned_by_hand(texts):
    own = alignment.tokenizers()
    docs, counts = [], Counter()
    for t in texts:
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        ends_a, ends_b = np.cumsum([len(own.bytes_a[i]) for i in a]).tolist(), np.cumsum([len(own.bytes_b[i]) for i in b]).tolist()
        whole = (" " + (t or "")).encode()
        if b"".join(own.bytes_a[i] for i in a) != whole or b"".join(own.bytes_b[i] for i in b) != whole:
            a, b, ends_a, ends_b = [], [], [], []
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for c in cuts:
            groups.append(([x for x, e in zip(a, ends_a) if low < e <= c], [x for x, e in zip(b, ends_b) if low < e <= c]))
            low = c
        links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f]
        counts.update(links)
        docs.append((a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_alignment_equals_brute_force(spark):
    texts = TEXTS * 3
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, total string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.tokenizer_alignment(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == dict(enumerate(aligned_by_hand(texts)))
    assert alignment.tokenizer_alignment(docs.limit(0)).count() == 0
    assert alignment.tokenizers().by_word


def test_alignment_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one text"), (None, "one text"), (4, "other"), (4, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_a"] > 0, r["count_sum"]) for r in alignment.tokenizer_alignment(docs).collect()) == [(False, False, 0), (False, True, 1), (True, True, 4), (True, True, 4)]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    a, b = rng.random((9, 14)) < 0.3, rng.random((14, 11)) < 0.3
    csr = lambda m: alignment.CSR(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
    dense = np.zeros((9, 11), int)
    r, c, v = alignment.product(csr(a), csr(b))
    dense[r, c] = v
    assert (dense == a.astype(int) @ b.astype(int)).all()
    t = alignment.transposed(csr(a), 14)
    assert (t.indptr == csr(a.T).indptr).all() and (t.indices == csr(a.T).indices).all()


def test_links_of_tokens(spark):
    docs = spark.createDataFrame([(1, "Antidisestablishment now"), (2, None)], "doc_id long, text string")
    row, none = alignment.token_links(docs).orderBy("doc_id").collect()
    own = alignment.tokenizers()
    assert sum(x["bytes"] for x in row["overlaps"]) == len(" Antidisestablishment now") and not none["overlaps"]
    ends_a, ends_b = np.cumsum(own.sizes_a[row["a_ids"]]), np.cumsum(own.sizes_b[row["b_ids"]])
    assert all(x["together"] == (ends_a[x["a"]] == ends_b[x["b"]]) for x in row["overlaps"])
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    want = [(i, j) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b) if np.searchsorted(cuts, e) == np.searchsorted(cuts, f)]
    assert sorted((x["a"], x["b"]) for x in row["shared"]) == want


def test_pairs_have_a_bound(spark):
    """Of two tokens that end together one is a suffix of the other."""
    own = alignment.tokenizers()
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.pair_counts(alignment.align_tokens(docs).cache(), len(own.bytes_b)).collect():
        a, b = own.bytes_a[r["pair"] // len(own.bytes_b)], own.bytes_b[r["pair"] % len(own.bytes_b)]
        assert a.endswith(b) or b.endswith(a)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=0, max_codepoint=127), min_size=1, max_size=12), max_size=20))
def test_words_of_ascii_are_encoded_as_by_the_file(parts):
    own = alignment.tokenizers()
    text = " " + " ".join(parts)
    assert own.ascii.encode_ordinary(text) == own.a.encode(text, add_special_tokens=False).ids


def test_every_entry_is_made_by_its_own_merges():
    own = alignment.tokenizers()
    special = own.a.get_added_tokens_decoder()
    entries = [(i, b.decode()) for i, b in enumerate(own.bytes_a) if i not in special and b.isascii()]
    made = own.a.model.tokenize
    back = {v: k for k, v in own.a.get_vocab().items()}
    assert len(entries) > 40_000 and all([t.id for t in made(back[i])] == [i] for i, _ in entries)
