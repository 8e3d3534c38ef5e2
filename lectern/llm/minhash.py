"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles, runs of five words. One permutation spreads shingles
over a circle of positions; a second one, fixed, gives every position a value. Coordinate k of a
signature is the least value found k places on from the document's positions, so that the one
value table, shifted round the circle, stands for all the coordinates' permutations.

Documents with equal sets form a class, and only its representative (smallest doc_id) goes on.
Bands of a signature make keys. Representatives with a key in common are candidates: first each
against the smallest of its key, then, where members of a key still lie in different components,
all of them in blocks of bounded size. Every link is confirmed on full sets. What leaves a block is
a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, filter_bit, id_bitmap, in_bitmap, settled
from .textbytes import U64, mixed, pieces, shingle_sets

CIRCLE_BITS = 22
#: A block of the second round holds about this many documents, and this many shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
_VALUES: dict[int, np.ndarray] = {}
_WEIGHTS = np.random.default_rng(5).integers(1, 1 << 62, 64, dtype=U64) | U64(1)


def _windows(k: int) -> np.ndarray:
    """Row p holds the second permutation's values at positions p, p+1, ..., p+k-1 of the circle (a view)."""
    if k not in _VALUES:
        values = np.random.default_rng(71).permutation(1 << CIRCLE_BITS).astype(np.int32)
        _VALUES[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: k - 1]]), k)
    return _VALUES[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k coordinates of a nonempty set of shingle hashes."""
    at = np.unique((mixed(shingles) >> U64(64 - CIRCLE_BITS)).astype(np.int64))
    windows, out = _windows(k), None
    for i in range(0, len(at), 4096):
        least = windows[at[i : i + 4096]].min(0)
        out = least if out is None else np.minimum(out, least)
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = (sig.astype(U64).reshape(bands, rows) * _WEIGHTS[:rows]).sum(1, dtype=U64)
    return mixed(keys + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def _sign(bands: int, rows: int, width: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in pieces(batch.column(1)):
                n, h1, h2, keys = [], [], [], []
                for s in shingle_sets(data, offsets, width):
                    n.append(len(s))
                    h1.append(int(s.sum(dtype=U64).view(np.int64)))
                    h2.append(int(mixed(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).view(np.int64)))
                    keys.append(_band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
                yield pa.record_batch([batch.column(0)[first:end], pa.array(n), pa.array(h1), pa.array(h2), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(width: int, bitmap: np.ndarray):
    """Sets of the rows whose bit is set in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(batch.column(2).to_numpy(), bitmap)))
            for first, end, data, offsets in pieces(batch.column(1)):
                found = [s.view(np.int64) for s in shingle_sets(data, offsets, width)]
                yield pa.record_batch([batch.column(0)[first:end], pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return run


def _forest(links: np.ndarray, n: int) -> list[int]:
    """Those of the links (pairs of positions) that join two trees, taken in order."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, (x, y) in enumerate(links.tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            out.append(i)
    return out


def _links_of_block(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # A document has all its sets; equal rows count once.
        pdf = pdf[~pd.Series([(i, x.tobytes()) for i, x in zip(pdf["doc_id"], pdf["shingles"])], index=pdf.index).duplicated()]
        ids, part = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy()
        sizes = pdf["shingles"].map(len).to_numpy()
        value, column, count = np.unique(np.concatenate(pdf["shingles"].tolist()), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        shared = count > 1
        place = np.cumsum(shared) - 1
        held = shared[column]
        row, column = row[held], place[column[held]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(ids), len(ids)), np.float32)
        for start in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(column, [start, start + 2048])
            part_of = np.zeros((len(ids), 2048), np.float32)
            part_of[row[a:b], column[a:b] - start] = 1
            common += part_of @ part_of.T
        common = common.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        linked = (100 * common >= percent * union) & (part[:, None] != part[None, :])
        pairs = np.argwhere(np.triu(linked, 1))
        node, at = np.unique(ids, return_inverse=True)
        pairs = at[pairs]
        pairs = node[pairs[_forest(pairs, len(node))]] if len(pairs) else pairs
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 32, rows: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Return doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case; a set holds
    the distinct runs of ``width`` words, or, with fewer words, the whole text as one. Documents
    link when 100 * intersection >= percent * union; component_id is the smallest doc_id that is
    reachable, and kept says whether it is the row's own.

    Cases: a null or wordless text has an empty set and links with nothing. Rows that repeat a
    doc_id count as one document that has all their sets, and all stay or go together (but for those
    without words, which stay). A null
    doc_id takes no part: its component_id is null and it is kept. An empty table gives no rows.
    Other columns are ignored, whatever their names. With the default bands a pair at a similarity
    of 0.85 shares no key with a probability of 7e-9, one at 0.8 of 3e-6.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = settled(base.mapInArrow(_sign(bands, rows, width), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "signed")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")

    # Equal sets, by 128 bits of sums over all their shingles, are one class; its smallest doc_id stands for it.
    classes = usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # Texts that share a doc_id are one document, which brings their classes together.
    several = usable.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("doc_id")
    same = usable.join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "h1", "h2", "n_shingles").join(classes.hint("merge"), ["h1", "h2", "n_shingles"])
    same = same.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    posts = (
        usable.join(classes.select(F.col("rep").alias("doc_id"), F.col("h1").alias("c1"), F.col("h2").alias("c2")), "doc_id", "left_semi")
        .select("doc_id", F.explode("keys").alias("key"))
    )
    heads = posts.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
    held = settled(posts.join(heads, "key").distinct(), "buckets")

    # First round: each against the smallest of its key.
    stars = settled(held.where("doc_id <> hub").select("hub", "doc_id").distinct(), "stars")
    wanted = stars.select("doc_id").union(stars.select("hub")).distinct()
    # The bitmap keeps all but a few texts without candidates from the shuffle; the join drops those.
    texts = base.where("doc_id IS NOT NULL").withColumn("bit", filter_bit("doc_id"))
    sets = texts.mapInArrow(_sets(width, id_bitmap(wanted, "doc_id")), "doc_id long, shingles array<long>").where(F.size("shingles") > 0)
    sets = settled(sets.join(wanted, "doc_id", "left_semi"), "sets")
    left, right = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("x")), sets.withColumnRenamed("shingles", "y")
    both = F.size(F.array_intersect("x", "y"))
    links = settled(
        stars.join(left, "hub").join(right, "doc_id")
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).union(same),
        "links",
    )
    parts = components(links)

    # Second round: keys whose members, apart from the smallest, lie in different components.
    where_now = held.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_keys = (
        where_now.where("doc_id <> hub").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    )
    left_open = settled(where_now.join(open_keys, "key", "left_semi").select("hub", "doc_id", "component").distinct(), "open")
    more = None
    if left_open.limit(1).count():
        groups = components(left_open, "hub", "doc_id").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "grp")
        members = left_open.select("doc_id", "component").distinct()
        members = members.join(groups, "doc_id", "left").withColumn("grp", F.coalesce("grp", "doc_id")).join(sets, "doc_id")
        members = settled(members, "members")
        extent = members.groupBy("grp").agg(
            F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_ROWS), F.sum(F.size("shingles")) / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks")
        )
        mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = (
            members.join(extent, "grp").select("grp", "doc_id", "component", "shingles", mine.alias("mine"), other.alias("other"))
            .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
        )
        more = settled(dealt.groupBy("grp", "i", "j").applyInPandas(_links_of_block(percent), "a long, b long"), "links")
        discard(members)
        parts = components(links.union(more))
    parts = settled(parts, "parts")
    discard(held, stars, sets, links, left_open, *([more] if more is not None else []))

    # A class goes where its representative goes; nodes that repeat a doc_id bring their classes together.
    by_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", F.col("n_shingles").alias("size"), F.coalesce("component", "rep").alias("component_id")
    )
    out = signed.join(by_class, (signed.h1 == by_class.h1) & (signed.h2 == by_class.h2) & (signed.n_shingles == by_class.size), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


#: All pairs that share a shingle, and everything that their links reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.m, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id
"""
