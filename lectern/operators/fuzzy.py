"""Passages that a document holds nearly: a filter that misses none, then the best window's similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread
from .citations import corpus_lookup, verdict_of
from .index import runs_of
from .screening import CHOSEN, MOST, OFTEN, Screen, screened, unit_counts

#: Bits of a bit vector, characters of a text that are scanned together, words of state that are (they should fit a core's cache), passages of a block, and classes of characters.
WORD, LANE, STATE, BLOCK, CLASSES = 32, 2048, 65_536, 64, 3
#: Passages that are worth a screen: the bit vectors of fewer take less than cutting texts into units.
FEW = 16
#: Characters of the passages that a task holds at once.
SLICE = 1 << 23
#: Bytes of the texts that a task compares at once.
TEXTS = 1 << 20


def _common(masks: dict[str, int], width: int, text: str) -> int:
    """Length of the longest common subsequence, a bit a character of the shorter string."""
    full = (1 << width) - 1
    state = full
    for c in text:
        u = state & masks.get(c, 0)
        state = ((state + u) | (state - u)) & full
    return width - state.bit_count()


def partial_ratio(a: str, b: str, least: float = 0.0, within: list[tuple[int, int]] | None = None) -> float:
    """The best 2 * LCS / (sum of lengths) of the shorter string against windows of the longer one, cut ones at both ends included.

    0 if it is under ``least``. Windows go by an upper bound, the characters they have in common with
    the string, so that most are never aligned. If parts (start, end) of the longer string are given, only windows within them count.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if not m:
        return 0.0
    if short in long:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    if within is None:
        starts = np.arange(-(m - 1), n)
    else:
        starts = np.unique(np.concatenate([np.arange(i if i > 0 else 1 - m, j - m + 1 if j < n else n) for i, j in within]))
        if not len(starts):
            return 0.0
    low, high = np.clip(starts, 0, n), np.clip(starts + m, 0, n)
    first, last = int(low[0]), int(high[-1])
    long, low, high = long[first:last], low - first, high - first
    codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    shared = np.zeros(len(starts), np.int64)
    for c, mask in masks.items():
        total = np.concatenate([[0], np.cumsum(codes == ord(c))])
        shared += np.minimum(total[high] - total[low], mask.bit_count())
    bound = 2 * shared / (m + high - low)
    best = least
    found = 0.0
    for k in np.argsort(-bound, kind="stable"):
        if bound[k] < best or bound[k] <= found:
            break
        window = long[low[k] : high[k]]
        got = 2 * _common(masks, m, window) / (m + len(window))
        if got >= best and got > found:
            best = found = got
    return found


def may_hold(patterns: list[str], texts: list[str], threshold: float) -> np.ndarray:
    """Whether a text may have a window at least ``threshold`` like a pattern (a row a pattern, a column a text); none that has is missed.

    A window no longer than the pattern that is like enough is made of it by at most (1 - threshold) *
    2 * (length) insertions and deletions. Each of these is of one character, so that they are dealt out over classes of
    characters: with the other classes left out on both sides, the edits of all classes sum to no more. Texts and patterns are both shorter by
    the number of classes then, and so is the work. What passes is tried again with all characters together.
    """
    out = _within(patterns, texts, threshold, CLASSES)
    some, where = np.flatnonzero(out.any(axis=1)), np.flatnonzero(out.any(axis=0))
    if len(some):
        out[np.ix_(some, where)] &= _within([patterns[i] for i in some], [texts[t] for t in where], threshold, 1)
    return out


def _within(patterns: list[str], texts: list[str], threshold: float, classes: int) -> np.ndarray:
    """Whether the least edit distances of a pattern's pieces, of each class of characters, to parts of one stretch of the text sum to no more than its edits."""
    out = np.zeros((len(patterns), len(texts)), bool)
    longest = max(map(len, patterns), default=0)
    if not longest or not texts:
        return out
    limits = np.array([int((1 - threshold) * 2 * len(p) + 1e-6) for p in patterns])
    # The commonest characters first, each to the class that has the fewest so far.
    dealt, sizes = {}, [0] * classes
    for c, n in Counter("".join(patterns)).most_common():
        k = min(range(classes), key=sizes.__getitem__)
        dealt[ord(c)] = k
        sizes[k] += n
    # Stretches overlap by the longest window, so that one of them has the whole of it.
    size = max(LANE, 8 * longest)
    lanes: list[tuple[int, np.ndarray]] = []
    for t, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lanes += [(t, codes[i : i + size]) for i in range(0, max(1, len(codes) - longest), size - longest)]
    signs = np.array(sorted(dealt), np.uint32)
    every = np.concatenate([c for _, c in lanes])
    found = np.minimum(np.searchsorted(signs, every), len(signs) - 1).astype(np.int32)
    found[signs[found] != every] = -1
    of = np.repeat(np.arange(len(lanes)), [len(c) for _, c in lanes])
    total = np.zeros((len(lanes), len(patterns)), np.int32)
    for k in range(classes):
        own = np.array([dealt[c] == k for c in signs.tolist()])
        place = np.cumsum(own) - 1
        # A text's characters that no pattern has are insertions; without them the distance is no greater.
        kept = (found >= 0) & own[found]
        streams = np.split(place[found[kept]], np.cumsum(np.bincount(of[kept], minlength=len(lanes)))[:-1])
        at = {int(c): i for i, c in enumerate(signs[own])}
        pieces, firsts, whose = [], [], []
        for p, pattern in enumerate(patterns):
            held = [at[ord(c)] for c in pattern if ord(c) in at]
            if held:
                count = -(-len(held) // WORD)
                firsts.append(len(pieces))
                whose.append(p)
                pieces += [held[len(held) * i // count : len(held) * (i + 1) // count] for i in range(count)]
        if pieces:
            total[:, whose] += np.add.reduceat(_least(pieces, streams, int(own.sum())).astype(np.int32), firsts, axis=1)
    for (t, _), row in zip(lanes, total <= limits):
        out[:, t] |= row
    return out


def _least(pieces: list[list[int]], streams: list[np.ndarray], signs: int) -> np.ndarray:
    """The least edit distance of each piece (a column) to any part of each stream (a row), by Myers' bit vectors, of all pieces and many streams at once."""
    # Pieces end at the highest bit; the bits below them match any character, which lets a match start anywhere. The last row is for places after a stream's end.
    masks, rows = np.zeros((signs + 1, len(pieces)), np.uint32), np.zeros(len(pieces), np.uint32)
    for k, piece in enumerate(pieces):
        low = WORD - len(piece)
        rows[k] = ((1 << WORD) - 1) >> low << low
        masks[:, k] = (1 << low) - 1
        for i, c in enumerate(piece):
            masks[c, k] |= np.uint32(1 << (low + i))
    sizes = np.array([len(p) for p in pieces], np.int8)
    out = np.empty((len(streams), len(pieces)), np.int8)
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    width = max(1, STATE // len(pieces))
    one = np.uint32(1)
    for i in range(0, len(order), width):
        group = order[i : i + width]
        shape = (len(group), len(pieces))
        codes = np.full((len(streams[group[0]]), len(group)), signs)
        for j, s in enumerate(group):
            codes[: len(streams[s]), j] = streams[s]
        up, down = np.broadcast_to(rows, shape).copy(), np.zeros(shape, np.uint32)
        eq, same, plus, minus = (np.empty(shape, np.uint32) for _ in range(4))
        score = np.broadcast_to(sizes, shape).copy()
        best, sign = score.copy(), np.empty(shape, bool)
        for step in codes:
            np.take(masks, step, axis=0, out=eq, mode="clip")
            np.bitwise_and(eq, up, out=same)
            same += up
            same ^= up
            same |= eq
            same |= down
            np.bitwise_or(same, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(same, up, out=minus)
            np.less(plus.view(np.int32), 0, out=sign)
            score += sign.view(np.int8)
            np.less(minus.view(np.int32), 0, out=sign)
            score -= sign.view(np.int8)
            np.minimum(best, score, out=best)
            np.left_shift(plus, one, out=plus)
            np.left_shift(minus, one, out=minus)
            np.bitwise_or(same, plus, out=up)
            np.invert(up, out=up)
            up |= minus
            np.bitwise_and(plus, same, out=down)
        out[group] = best
    return out


def _matches(passages: list[str], texts: list[str], threshold: float, screen: Screen | None = None) -> Iterator[tuple[int, int, float]]:
    """(passage's place, text's place, score) of all pairs that are at least ``threshold`` alike; a ``screen`` of the passages may have been made before."""
    by_size = sorted((i for i, p in enumerate(passages) if p), key=lambda i: len(passages[i]))
    pairs: dict[tuple[int, int], list[tuple[int, int]] | None] = {}
    places: dict[str, list[int]] = {}
    for i in by_size:
        if screened(passages[i]):
            places.setdefault(passages[i], []).append(i)
    if screen is None and len(places) < FEW:
        places.clear()
    if places:
        if screen is None:
            screen = Screen(list(places), threshold)
            units = [u for u, _ in unit_counts(texts).most_common(screen.most())]
            screen.know(units, screen.costs(units))
        for p, t, start, end in screen.pairs(texts):
            for i in places[screen.passages[p]]:
                pairs.setdefault((i, t), []).append((start, end))
    by_size = [i for i in by_size if passages[i] not in places]
    for i in range(0, len(by_size), BLOCK):
        block = by_size[i : i + BLOCK]
        own = [passages[k] for k in block]
        # Of a pair, the shorter string is the pattern: texts between the block's shortest and longest passage are tried both ways.
        long = [t for t, x in enumerate(texts) if len(x) >= len(own[0])]
        short = [t for t, x in enumerate(texts) if 0 < len(x) < len(own[-1])]
        ways = np.argwhere(may_hold(own, [texts[t] for t in long], threshold))
        pairs |= {(block[a], long[b]): None for a, b in ways if len(own[a]) <= len(texts[long[b]])}
        ways = np.argwhere(may_hold([texts[t] for t in short], own, threshold))
        pairs |= {(block[a], short[b]): None for b, a in ways if len(own[a]) > len(texts[short[b]])}
    for (p, t), parts in sorted(pairs.items()):
        score = partial_ratio(passages[p], texts[t], threshold, parts if len(texts[t]) >= len(passages[p]) else None)
        if score >= threshold:
            yield p, t, score


def fuzzy_passages(passages: DataFrame, docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(passage_id, doc_id, score) of documents whose best window is at least ``threshold`` like the passage, of whatever length either is.

    The passages are a stated set of questions, each compared with all documents where these are read: neither
    texts nor pairs are shuffled. They are handled in slices of about ``SLICE`` characters, so that
    driver and tasks hold one slice at a time. Null and blank passages have no rows; a null text holds nothing.
    """
    known = passages.select("passage_id", "passage").where(F.trim("passage") != "")
    size = known.agg(F.sum(F.length("passage"))).first()[0] or 0
    docs, slices, out, units = spread(docs.select("doc_id", "text")), -(-size // SLICE) or 1, None, None
    for k in range(slices):
        own = known if slices == 1 else known.where(F.pmod(F.xxhash64("passage_id", "passage"), F.lit(slices)) == k)
        asked = [(r["passage_id"], p) for r in own.collect() if (p := r["passage"].strip())]
        long = sorted({p for _, p in asked if screened(p)}, key=lambda p: (len(p), p))
        screen = Screen(long, threshold) if len(long) >= FEW else None
        if screen:
            units = _common_units(docs) if units is None else units
            _informed(docs.sparkSession, screen, units)
        found = _held_against(docs, asked, threshold, screen)
        out = found if out is None else out.unionByName(found)
    return out


def _common_units(docs: DataFrame) -> list[str]:
    """The commonest units of the first texts of all partitions. Which ones these are decides how fast texts are compared, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0
        for batch in batches:
            for _, texts in runs_of(batch.column(0), TEXTS) if read < CHOSEN else ():
                if read < CHOSEN:
                    counts = unit_counts(texts)
                    read += sum(len(t or "") for t in texts)
                    yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["unit", "n"])

    counts = docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r["unit"] for r in counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "unit").limit(MOST).collect()]


def _informed(spark: SparkSession, screen: Screen, units: list[str]) -> None:
    """The screen learns the costs of units, which the cores compute."""
    units = units[: screen.most()]
    asked = spark.sparkContext.broadcast(screen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = asked.value.costs(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array([row.tobytes() for row in costs], pa.binary())], names=["at", "costs"])

    if not units:
        return
    table = spark.createDataFrame(pa.table({"at": pa.array(range(len(units)), pa.int64()), "unit": pa.array(units, pa.string())}))
    made = table.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "at long, costs binary").toArrow()
    costs = np.empty((len(units), len(screen.passages)), np.uint8)
    for batch in made.to_batches():
        costs[batch.column(0).to_numpy()] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
    screen.know(units, costs)


def _held_against(docs: DataFrame, asked: list[tuple[int, str]], threshold: float, screen: Screen | None) -> DataFrame:
    """(passage_id, doc_id, score) of one slice of passages."""
    passages, shared = [p for _, p in asked], screen and docs.sparkSession.sparkContext.broadcast(screen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in runs_of(batch.column(1), TEXTS):
                got = [(asked[p][0], ids[first + t].as_py(), score) for p, t, score in _matches(passages, [t or "" for t in texts], threshold, shared and shared.value)]
                columns = zip(*got) if got else ([], [], [])
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["passage_id", "doc_id", "score"])

    return docs.mapInArrow(run, "passage_id long, doc_id long, score double")


def _located(passage: str, text: str, body: str, threshold: float) -> float:
    """The best of a record's text and body: 1 where either holds the passage, else the better window's similarity, 0 under the threshold."""
    if not passage:
        return 0.0
    if passage in text or passage in body:
        return 1.0
    return max(partial_ratio(passage, text, threshold), partial_ratio(passage, body, threshold) if body != text else 0.0)


def verify_passages(items: DataFrame, records: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(item_id, record_url, score, verified, reason) of items (item_id, url, passage), each against its cited record (url, text, perhaps body) alone.

    Verified are those whose record has, in its text or its body, a window at least ``threshold`` like
    the passage; their score is the best window's. The others have no score and the reason. Items
    without a url or a passage are not checked and give no row. Of records that repeat a url the best
    counts.
    """
    asked = corpus_lookup(items.where(F.col("url").isNotNull() & F.col("passage").isNotNull()), records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs_of(batch.column(2), TEXTS):
                rows = batch.slice(first, len(texts))
                score = [_located((p or "").strip(), t or "", b or "", threshold) for p, t, b in zip(rows.column(1).to_pylist(), texts, rows.column(3).to_pylist())]
                yield pa.record_batch([rows.column(0), pa.array(score, pa.float64())], names=["item_id", "score"])

    body = F.col("body") if "body" in records.columns else F.lit("")
    pairs = asked.select("item_id", "passage", "record_url").join(records.select(F.col("url").alias("record_url"), "text", body.alias("body")), "record_url")
    kind = items.schema["item_id"].dataType.simpleString()
    scored = pairs.select("item_id", "passage", "text", "body").mapInArrow(run, f"item_id {kind}, score double")
    best = scored.where((F.col("score") >= threshold) & (F.col("score") > 0)).groupBy("item_id").agg(F.max("score").alias("score"))
    reason = F.when(F.col("record_url").isNull(), F.concat(F.lit("URL not in corpus: "), "url")).when(
        F.col("score").isNull(), F.concat(F.lit("source_passage not found in "), "url", F.lit(" (below threshold)"))
    )
    return asked.join(best, "item_id", "left").select("item_id", "record_url", "score", F.col("score").isNotNull().alias("verified"), reason.alias("reason"))


def check_citations(citations: DataFrame, records: DataFrame, cited_at: float = 0.80, anywhere_at: float = 0.85) -> DataFrame:
    """(item_id, verdict, found, score) of citations (item_id, url, passage, claim, judged): ``verdict_of`` with its passages looked up.

    A passage is looked for in the cited record's text and body at ``cited_at``. One that is not there is
    fabricated; it is looked for in all records at ``anywhere_at``, each different passage once, and
    counts as found if a record of another url has it. score is that of the place where it was found.
    """
    items = citations.select("item_id", "url", F.nullif(F.trim("passage"), F.lit("")).alias("passage"), "claim", "judged")
    known = corpus_lookup(items.select("item_id", "url"), records).select("item_id", "record_url")
    own = verify_passages(items.select("item_id", "url", "passage"), records, cited_at).select("item_id", F.col("score").alias("own"))
    rows = items.join(known, "item_id").join(own, "item_id", "left")
    lost = rows.where(F.col("passage").isNotNull() & F.col("record_url").isNotNull() & F.col("own").isNull()).select("passage").distinct()
    lost = lost.select(F.xxhash64("passage").alias("passage_id"), "passage")
    texts = records.select(F.xxhash64("url").alias("doc_id"), "text")
    if "body" in records.columns:
        texts = texts.union(records.select(F.xxhash64("url").alias("doc_id"), F.col("body").alias("text")))
    near = fuzzy_passages(lost, texts, anywhere_at)
    # Of a passage's places the two best, of different urls: one of them is not the citation's own.
    places = near.groupBy("passage_id", "doc_id").agg(F.max("score").alias("score"))
    first = places.groupBy("passage_id").agg(F.max(F.struct("score", "doc_id")).alias("a"))
    second = places.join(first, "passage_id").where("doc_id <> a.doc_id").groupBy("passage_id").agg(F.max(F.struct("score", "doc_id")).alias("b"))
    rows = rows.withColumn("passage_id", F.xxhash64("passage")).join(first, "passage_id", "left").join(second, "passage_id", "left")
    other = F.when(F.col("a.doc_id") != F.xxhash64("url"), F.col("a.score")).otherwise(F.col("b.score"))
    rows = rows.withColumn("elsewhere", F.when(F.col("own").isNull() & F.col("record_url").isNotNull(), other))
    verdict = verdict_of(F.col("url"), F.col("record_url").isNotNull(), F.col("passage"), F.col("own").isNotNull(), F.col("elsewhere").isNotNull(), F.col("claim"), F.col("judged"))
    return rows.select("item_id", verdict.alias("v"), F.coalesce("own", "elsewhere").alias("score")).select("item_id", "v.verdict", "v.found", "score")


def best_records(scored: DataFrame) -> DataFrame:
    """(passage_id, doc_id, score): the best document of a passage; of equals the smallest id."""
    order = F.struct((-F.col("score")).alias("s"), F.col("doc_id"))
    return scored.groupBy("passage_id").agg(F.min(order).alias("b")).select("passage_id", "b.doc_id", (-F.col("b.s")).alias("score"))
