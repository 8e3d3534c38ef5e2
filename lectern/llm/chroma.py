"""Chroma audio fingerprints, and the alignment of recordings by them.

A recording is a binary column of 16-bit samples. Overlapping frames are folded to the energies of
the twelve pitch classes; sums over a rectangle of that picture come from its integral image in four
look-ups. Sixteen filters, each the log ratio of two halves of a rectangle, are quantized to two
bits each, which makes an integer of 32 bits a frame.

Two recordings align where many of their integers agree at one offset: integers (paired with the one
some frames on) are joined, offsets are counted, and at every offset with enough votes the share of
differing bits over the whole overlap decides. Equal recordings are one class and are aligned once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, settled

RATE, FRAME, HOP = 2000, 256, 64
LOWEST = 110.0
#: Frames under a filter, and quantization of its log ratio.
WIDEST, CUTS = 8, (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[str, int, int, int]]:
    """(kind, first pitch class, classes, frames): kinds halve their rectangle in time, in pitch, or in both (checkered)."""
    kinds = ("time", "pitch", "check", "pitch")
    return [(kinds[k % 4], (5 * k) % 9, 4 if k % 2 else 2, (2, 4, 6, 8)[(k // 4 + k) % 4]) for k in range(16)]


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 energies of pitch classes, each frame's of length one (zeros for silence)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero(pitch >= LOWEST)
    fold = np.zeros((power.shape[1], 12))
    fold[used, np.round(12 * np.log2(pitch[used] / LOWEST)).astype(int) % 12] = 1
    out = power @ fold
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The packed integers of a recording, one a frame that a widest filter fits; none for a short one."""
    picture = chroma(samples)
    n = len(picture) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.int64)
    image = np.zeros((len(picture) + 1, 13))
    image[1:, 1:] = picture.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, low, high, wide in filters():
        t, p = wide // 2, low + high // 2
        if kind == "time":
            a, b = area(0, t, low, low + high), area(t, wide, low, low + high)
        elif kind == "pitch":
            a, b = area(0, wide, low, p), area(0, wide, p, low + high)
        else:
            a = area(0, t, low, p) + area(t, wide, p, low + high)
            b = area(t, wide, low, p) + area(0, t, p, low + high)
        value = np.round(np.log((1 + a) / (1 + b)), 9)
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(CUTS, value, "right")]
    return out.astype(np.int64)


def fingerprints(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` without its samples, with ``codes`` (array<long>); null media has null, a short recording no codes."""
    kept = [c for c in media.columns if c not in (media_col, "codes")]
    source = media.select(*kept, F.col(media_col).alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = [x.as_buffer() if x.is_valid else None for x in part.column(len(kept))]
                made = [fingerprint(np.frombuffer(x, "<i2", len(x) // 2).astype(np.float64) / 32768) if x is not None else None for x in raw]
                yield pa.record_batch([*part.columns[: len(kept)], pa.array(made, pa.list_(pa.int64()))], names=[*kept, "codes"])

    return source.mapInArrow(run, T.StructType(source.schema.fields[: len(kept)]).add("codes", T.ArrayType(T.LongType())))


def align(prints: DataFrame, ids: list[str], queries, apart: int = 4, least_votes: int = 3, most_error: float = 0.25) -> DataFrame:
    """For each recording that the condition ``queries`` picks: the classes of recordings that it aligns with.

    Columns: query_<id> for each of ``ids``, n_codes, copies (recordings equal to the query, itself
    included), match_<id> (of the class's first recording by ids), match_copies, offset (frames by
    which the match starts later in the query), votes, overlap and bit_error; the last are null for a query that
    aligns with no other class. A class aligns at an offset if at least ``least_votes`` pairs of integers
    agree there and at most ``most_error`` of the overlap's bits differ; of several such offsets the one
    with the most votes counts, then the smallest. Every place of an integer votes, but that one which
    lasts (a held note) votes where it begins.

    The join of the integers is many to many; a frequent one's rows are split by Spark's handling of
    skewed joins, as nothing but sums by offset follows.

    Recordings without codes, null media included, align with nothing. Repeated rows are copies. Ids may be
    null. An empty table gives no rows. Other columns are ignored.
    """
    base = prints.select(*ids, F.coalesce(queries, F.lit(False)).alias("asks"), F.coalesce("codes", F.array().cast("array<long>")).alias("codes"))
    base = base.withColumns({"h1": F.xxhash64("codes"), "h2": F.xxhash64(F.lit(7), "codes", F.size("codes"))})
    held = settled(base, "prints")
    who = F.struct(*ids)
    classes = held.groupBy("h1", "h2").agg(F.min(who).alias("first"), F.count("*").alias("copies"), F.max("asks").alias("asks"))
    unique = held.where(F.size("codes") > 0).dropDuplicates(["h1", "h2"]).select("h1", "h2", "codes")
    # A recording of no more integers than that has no pair, and the sequence would run backwards.
    keys = F.transform(F.sequence(F.lit(0), F.greatest(F.size("codes") - apart - 1, F.lit(0))), lambda i: F.xxhash64(F.get("codes", i), F.get("codes", i + apart)))
    posts = unique.where(F.size("codes") > apart).select("h1", "h2", keys.alias("keys")).select("h1", "h2", "keys", F.posexplode("keys").alias("at", "key"))
    posts = posts.where((F.col("at") == 0) | (F.col("key") != F.get("keys", F.col("at") - 1))).select("h1", "h2", "key", "at")
    posts = settled(posts, "posts")
    asked = posts.join(classes.where("asks").select("h1", "h2"), ["h1", "h2"], "left_semi").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "key", F.col("at").alias("qat"))
    votes = asked.join(posts, "key").where("NOT (q1 = h1 AND q2 = h2)").groupBy("q1", "q2", "h1", "h2", (F.col("qat") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.where(F.col("votes") >= least_votes)
    both = best.join(unique.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("codes").alias("x")), ["q1", "q2"]).join(unique.withColumnRenamed("codes", "y"), ["h1", "h2"])
    # The query's part from place max(0, offset), the match's from max(0, -offset), as far as both go.
    start_x, start_y = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    both = both.withColumn("overlap", F.least(F.size("x") - start_x, F.size("y") - start_y))
    bits = F.aggregate(
        F.zip_with(F.slice("x", start_x + 1, F.col("overlap")), F.slice("y", start_y + 1, F.col("overlap")), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x
    )
    both = both.withColumn("bit_error", bits / (32.0 * F.col("overlap"))).where(F.col("bit_error") <= most_error)
    both = both.groupBy("q1", "q2", "h1", "h2").agg(F.max(F.struct("votes", (-F.col("offset")).alias("o"), "overlap", "bit_error")).alias("b"))
    both = both.select("q1", "q2", "h1", "h2", "b.votes", (-F.col("b.o")).alias("offset"), "b.overlap", "b.bit_error")
    matches = both.join(classes.select("h1", "h2", "first", F.col("copies").alias("match_copies")), ["h1", "h2"])
    matches = settled(matches.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "first", "match_copies", "offset", "votes", "overlap", "bit_error"), "matches")
    discard(posts)
    rows = held.where("asks").select(*ids, F.size("codes").alias("n_codes"), "h1", "h2").join(classes.select("h1", "h2", "copies"), ["h1", "h2"])
    return rows.join(matches, ["h1", "h2"], "left").select(
        *[F.col(c).alias(f"query_{c}") for c in ids], "n_codes", "copies", *[F.col(f"first.{c}").alias(f"match_{c}") for c in ids],
        "match_copies", "offset", "votes", "overlap", "bit_error",
    )


def sung(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with ``media``: each word a note of one hop, its pitch from the word's checksum. It stands in for a table of recordings."""
    kept = [c for c in texts.columns if c not in (text_col, "media")]
    source = texts.select(*kept, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = np.arange(HOP) / RATE
        notes = np.stack([np.sin(2 * np.pi * 2 * LOWEST * 2 ** (k / 12) * time) for k in range(24)])
        notes = (notes * 12000).astype("<i2")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = []
                for text in part.column(len(kept)).to_pylist():
                    made.append(None if text is None else notes[np.array([zlib.crc32(w.encode()) % 24 for w in text.split()], int)].tobytes())
                yield pa.record_batch([*part.columns[: len(kept)], pa.array(made, pa.binary())], names=[*kept, "media"])

    return source.mapInArrow(run, T.StructType(source.schema.fields[: len(kept)]).add("media", "binary"))
