"""URL verdicts: rules first, then naive Bayes over host words found by unigram Viterbi segmentation.

The word model is counted over the visible words of all pages. Each distinct run of letters in a
host is cut into the words of greatest joint probability: Spark joins the run's substrings with the
counted words, so that a run meets only words that it holds, and the best path is found a run at a
time. No page has a
label, so a short list of seed words gives them: a page whose host holds such a word is an example
for blocking, any other for allowing. They teach a multinomial naive Bayes model over hashed tokens of
the segmented host and of the path, which decides the pages that no rule fits. Rules teach nothing: a
site's rule on a path says little about other sites' paths.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD = 24
#: Letters of a piece of a run that its substrings are cut from.
PIECE = 256
BUCKETS = 1 << 16
#: Words whose hosts are examples for blocking, the pages that each stands for beside those that there are, and its least share of all words in the word model.
SEEDS = "ads adult bet bets casino cheap clickbait crack escort farm gambling jackpot keygen loan loans malware pills poker porn replica sex spam torrent viagra warez xxx".split()
SEED_PAGES = 2.0
SEED_SHARE = 1e-5
#: The weight of all pages' token shares in those of either side, in tokens.
SMOOTHING = 100.0
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for a null url or one without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits host and path or null, its verdict)."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, _, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over all pages: runs of letters a-z outside of tags, in lower case, of at most 24 letters."""
    bare = F.regexp_replace(F.lower(html_col), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(bare, F.lit("[a-z]+"), 0)).alias("word"))
    return words.where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count("*").alias("n"))


def best_split(run: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """Unigram Viterbi: the words with the greatest product of probabilities that make up ``run``.

    ``found`` has (start, length, count) of the known words in it. An unknown word of k letters has
    probability 10 / (total * 10**k). Ties go to the longer last word.
    """
    size = len(run)
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
    for start, n, count in found:
        by_end[start + n].append((n, math.log(count / total)))
    best, back = [0.0] + [-math.inf] * size, [0] * (size + 1)
    base = math.log(10 / total) if total else 0.0
    for end in range(1, size + 1):
        options = by_end[end] + [(n, base - n * math.log(10)) for n in range(1, min(end, LONGEST_WORD) + 1)]
        for n, p in options:
            if (best[end - n] + p, n) > (best[end], back[end]):
                best[end], back[end] = best[end - n] + p, n
    out = []
    while size:
        out.append(run[size - back[size] : size])
        size -= back[size]
    return out[::-1]


def seeds_in(run: str, total: int, seeds=SEEDS) -> list[tuple[int, int, float]]:
    """(start, length, least count) of the seed words in a run, which the pages' prose may never use."""
    least = max(1.0, SEED_SHARE * total)
    return [(m.start(), len(w), least) for w in seeds for m in re.finditer(f"(?={w})", run)] if total else []


def segment_runs(runs: DataFrame, words: DataFrame, seeds=SEEDS) -> DataFrame:
    """(run, words) for distinct letter runs (column run), by the counts in ``words`` and the seed words.

    A run of L letters makes at most 24 L substrings, whatever the number of words. They are cut from
    pieces of it, and carry two hashes of the run, not its letters, so that a long run takes time and room
    in proportion to its length.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    runs = runs.withColumn("key", F.struct(F.xxhash64("run").alias("a"), F.hash("run").alias("b"), F.length("run").alias("c")))
    cuts = runs.select("key", "run", F.explode(F.sequence(F.lit(0), F.length("run") - 1, F.lit(PIECE))).alias("cut"))
    pieces = cuts.select("key", "cut", F.substring(F.col("run"), F.col("cut") + 1, F.lit(PIECE + LONGEST_WORD - 1)).alias("piece"))
    size = F.length("piece")
    starts = pieces.select("key", "cut", "piece", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(PIECE)))).alias("i"))
    subs = starts.select("key", "cut", "piece", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - F.col("i") + 1))).alias("k"))
    subs = subs.select("key", (F.col("cut") + F.col("i")).alias("i"), "k", F.substring(F.col("piece"), F.col("i"), F.col("k")).alias("word"))
    known = subs.join(words, "word").groupBy("key").agg(F.collect_list(F.struct(F.col("i") - 1, "k", "n")).alias("found"))
    every = runs.join(known, "key", "left").select("run", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            made = [best_split(t, [tuple(x.values()) for x in f or []] + seeds_in(t, total, seeds), total) for t, f in zip(texts, batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.string()))], names=["run", "words"])

    return every.mapInArrow(run, "run string, words array<string>")


PATH_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def _tokens(words: list[str], path: str) -> list[int]:
    """Buckets of the host's words and of the path's; numbers count by their first digit and length."""
    out = [f"h {w}" for w in words]
    for t in PATH_TOKEN.findall(path.lower()):
        out.append(f"p {t}" if t[0] > "9" else f"n {t[0]} {len(t)}")
    return [zlib.crc32(t.encode()) % BUCKETS for t in out]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, pages = np.zeros((2, BUCKETS), np.int64), [0, 0]
    for batch in batches:
        for words, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            side = int(verdict == "block")
            pages[side] += 1
            for b in _tokens(words or [], path):
                counts[side, b] += 1
    at = np.flatnonzero(counts.any(0))
    yield pa.record_batch(
        [pa.array([-1, *at.tolist()], pa.int64()), pa.array([pages[0], *counts[0, at].tolist()], pa.int64()), pa.array([pages[1], *counts[1, at].tolist()], pa.int64())],
        names=["bucket", "allow", "block"],
    )


def learn(labelled: DataFrame, seeds=SEEDS) -> tuple[float, np.ndarray]:
    """(prior log odds, log odds by bucket) for blocking, from (words, path, verdict); at most 65,537 counts reach the driver.

    Either side's shares of tokens are smoothed towards the shares in all pages, so that a side with
    few pages lends rare tokens no odds of its own. A seed word in a host counts as ``SEED_PAGES`` more
    blocked pages, and no more than that: allowed pages with the word take its odds down, and in a
    path it has only the odds that the pages give it.
    """
    rows = labelled.mapInArrow(_count, "bucket long, allow long, block long").groupBy("bucket").agg(F.sum("allow"), F.sum("block")).collect()
    counts, pages = np.zeros((2, BUCKETS)), np.zeros(2)
    for b, allow, block in rows:
        if b < 0:
            pages[:] = allow, block
        else:
            counts[:, b] = allow, block
    prior = float(np.log((pages[1] + 1) / (pages[0] + 1)))
    np.add.at(counts[1], [zlib.crc32(f"h {word}".encode()) % BUCKETS for word in seeds], SEED_PAGES)
    seen = counts.sum(0) > 0
    share = SMOOTHING * counts.sum(0)[seen] / max(1.0, counts.sum())
    block, allow = ((counts[side, seen] + share) / (counts[side].sum() + SMOOTHING) for side in (1, 0))
    odds = np.zeros(BUCKETS)
    odds[seen] = np.log(block / allow)
    return prior, odds


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with host, path, rule, verdict, host_words and block_odds.

    The verdict is that of the longest rule that fits, else ``block`` where the model's log odds for
    blocking are above 0 and ``allow`` elsewhere; block_odds is null where a rule decides. A null url,
    or one without ``://``, has an empty host and path and gets the model's prior. Null html has no
    words. Without any page the result is empty; without hosts that hold a seed word no token speaks
    for blocking but the seed words. Repeated rows are judged alike; columns that have the new names
    are replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict", "host_words", "block_odds")]
    parted = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parted = parted.select("*", rule.alias("rule"), verdict.alias("verdict"))
    hosts = parted.select("host").distinct().select("host", F.regexp_extract_all("host", F.lit("[a-z]+"), 0).alias("runs"))
    placed = hosts.select("host", F.posexplode("runs").alias("at", "run"))
    words = settled(word_counts(pages, html_col), "words")
    split = segment_runs(placed.select("run").distinct(), words, seeds)
    by_host = placed.join(split, "run").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
    by_host = by_host.select("host", F.flatten("w.words").alias("host_words"))
    rows = settled(parted.join(by_host, "host", "left"), "urls")
    discard(words)
    said = F.when(F.coalesce(F.arrays_overlap("host_words", F.array(*map(F.lit, seeds))), F.lit(False)), "block").otherwise("allow")
    prior, odds = learn(rows.select("host_words", "path", said.alias("verdict")), seeds)

    source = rows.select(*kept, "host", "path", "rule", "verdict", "host_words")
    n, names = len(kept), [*source.columns, "block_odds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, said, words = (batch.column(n + i).to_pylist() for i in (1, 3, 4))
            score = [None if s else prior + float(odds[_tokens(w or [], p)].sum()) for p, s, w in zip(path, said, words, strict=True)]
            verdict = [s or ("block" if x > 0 else "allow") for s, x in zip(said, score, strict=True)]
            columns = [*batch.columns[: n + 3], pa.array(verdict, pa.string()), batch.column(n + 4), pa.array(score, pa.float64())]
            yield pa.record_batch(columns, names=names)

    return source.mapInArrow(run, type(source.schema)([*source.schema.fields]).add("block_odds", "double"))
