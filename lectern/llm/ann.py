"""Approximate nearest neighbours: stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors of length one are projected on a few Gaussian (2-stable) directions: the squared distance of
two projections, over the true one, is chi-square distributed with as many degrees of freedom. A
query meets other vectors in the order of their projected distance, verifies each on the vectors
themselves, and stops when the next projected distance is so far beyond the k-th best true distance
that a nearer vector there has a probability of less than 1 - ``sure``.

The tree's upper levels part the table: they are fitted on a bounded sample, and every row goes to
its cell. A query searches its own cell first; the distance found there tells which other cells the
stopping test still allows. Within a cell, blocks of bounded size have kd-trees of their own.
Equal vectors are one point, with the few smallest ids that an answer can need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, settled

#: A cell holds about this many points, unless that makes more than the most cells.
CELL, MOST_CELLS = 8192, 1024
#: Points and queries of one search task, and points of a kd-tree's leaf.
BLOCK, QUERIES, LEAF = 8192, 2048, 128
#: Rounding in doubles moves a cosine by less than this: what is nearer to the last place than that is compared in extended precision.
SLACK = 1e-12


def chi_square_bound(sure: float, dims: int) -> float:
    """The quantile of the chi-square distribution with an even number of degrees of freedom, by bisection of its sum."""
    half = dims // 2

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < sure else (lo, mid)
    return hi


def directions(size: int, dims: int) -> np.ndarray:
    return np.random.default_rng(29).normal(size=(size, dims))


def _units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _project(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    # One row at a time has the same sums in every task.
    return np.einsum("ij,jk->ik", _units(vectors), axes)


def fit_cells(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """(axis, cut) of each inner node of a complete kd-tree in heap order, with at most ``cells`` leaves; cut at medians of the widest axis."""
    depth = max(0, int(math.floor(math.log2(max(1, cells)))))
    nodes: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        below = []
        for p in level:
            if len(p) < 2:
                axis, cut = 0, float(p[0, 0]) if len(p) else 0.0
            else:
                axis = int(np.argmax(p.max(0) - p.min(0)))
                cut = float(np.median(p[:, axis]))
            nodes.append((axis, cut))
            side = p[:, axis] <= cut if len(p) else np.zeros(0, bool)
            below += [p[side], p[~side]]
        level = below
    return nodes


def _cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if nodes:
        axis, cut = np.array([a for a, _ in nodes]), np.array([c for _, c in nodes])
        while at[0] < len(nodes) if len(at) else False:
            at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] > cut[at])
    return at - len(nodes)


def _cell_gaps(point: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """Squared distances from a point to all cells, as the cuts bound them."""
    gaps = [np.zeros(len(point))]
    for k, (axis, cut) in enumerate(nodes):
        own = gaps[k]
        left, right = own.copy(), own.copy()
        side = point[axis] - cut
        if side > 0:
            left[axis] = max(left[axis], side)
        else:
            right[axis] = max(right[axis], -side)
        gaps += [left, right]
    return np.array([(g * g).sum() for g in gaps[len(nodes) :]])


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """The positions of the points of each leaf of a kd-tree."""
    todo, out = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        p = points[at]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        order = np.argsort(p[:, axis], kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _cosines(vectors: np.ndarray, norms: np.ndarray, units: np.ndarray, query: np.ndarray, norm: float, unit: np.ndarray) -> np.ndarray:
    """On the vectors themselves, or on their unit vectors where numbers of their size have no product."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = (vectors * query).sum(1) / (norms * norm)
    return np.where(np.isfinite(out) & (norms * norm > 0), out, (units * unit).sum(1))


def _rounded_cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines summed in extended precision and rounded to doubles: parallel vectors tie, nearly parallel ones do not."""
    v, q = vectors.astype(np.longdouble), query.astype(np.longdouble)
    return ((v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))).astype(np.float64)


def _search_block(axes: np.ndarray, k: int, bound: float):
    """Search one block's points (is_query false) for the queries sent to it: the k nearest, those of equal cosine by ``least``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, held = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        found: list[pd.DataFrame] = []
        if len(asked) and len(held):
            raw = np.stack(held["embedding"].to_list()).astype(np.float64)
            units, points, ids, least = _units(raw), _project(raw, axes), held["vid"].to_numpy(), held["least"].to_numpy()
            # A leaf's points stand together, so that those of a whole leaf are a view.
            leaves = _leaves(points)
            cuts = np.cumsum([0] + [len(x) for x in leaves]).tolist()
            order = np.concatenate(leaves)
            raw, units, points, ids, least = raw[order], units[order], points[order], ids[order], least[order]
            low, high = (np.array([f(points[i:j], axis=0) for i, j in zip(cuts, cuts[1:])]) for f in (np.min, np.max))
            queries = np.stack(asked["embedding"].to_list()).astype(np.float64)
            near_to, unit = _project(queries, axes), _units(queries)
            with np.errstate(over="ignore"):
                norms, whole = np.sqrt((raw * raw).sum(1)), np.sqrt((queries * queries).sum(1))
                plain = np.isfinite(norms.max() * whole) & (norms.min() * whole > 0)
            # A distance from an earlier search bounds this one; a little slack covers rounding.
            reach = asked["reach"].to_numpy(np.float64)
            for q, qid in enumerate(asked["vid"].to_list()):
                p = near_to[q]
                gap = np.maximum(np.maximum(low - p, p - high), 0)
                gap = (gap * gap).sum(1)
                best, score = np.zeros(0, np.int64), np.zeros(0)
                worst = reach[q]
                for leaf in np.argsort(gap, kind="stable"):
                    if gap[leaf] > bound * worst + 1e-9:
                        break
                    i, j = cuts[leaf], cuts[leaf + 1]
                    d = points[i:j] - p
                    at = i + np.flatnonzero(np.einsum("ij,ij->i", d, d) <= bound * worst + 1e-9)
                    if not len(at):
                        continue
                    rows = raw[i:j] if len(at) == j - i else raw[at]
                    got = rows @ queries[q] / (norms[at] * whole[q]) if plain[q] else _cosines(rows, norms[at], units[at], queries[q], whole[q], unit[q])
                    if len(best) >= k:
                        near = np.flatnonzero(got >= 1 - worst / 2 - SLACK)
                        if not len(near):
                            continue
                        at, got = at[near], got[near]
                    best, score = np.concatenate([best, at]), np.concatenate([score, got])
                    if len(best) >= k:
                        last = np.partition(score, -k)[-k] - SLACK
                        best, score = best[score >= last], score[score >= last]
                        worst = min(worst, max(0.0, 2 - 2 * last))
                score = _rounded_cosines(raw[best], queries[q])
                order = np.lexsort((least[best], -score))[:k]
                best, score = best[order], score[order]
                found.append(pd.DataFrame({"qid": qid, "vid": ids[best], "least": least[best], "score": score}))
        if found:
            return pd.concat(found)
        return pd.DataFrame({"qid": [], "vid": [], "least": [], "score": []}).astype({"qid": "int64", "vid": "int64", "least": "int64"})

    return run


def _blocked(points: DataFrame, asked: DataFrame, axes: np.ndarray, k: int, bound: float) -> DataFrame:
    """(qid, vid, least, score): each query against the blocks of its cell, in tasks of bounded size."""
    sizes = points.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    wants = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("parts"))
    both = sizes.join(wants, "cell")
    mine = points.join(both, "cell").select(
        "cell", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("is_query"), "vid", "least", "embedding", F.lit(0.0).alias("reach"),
    )
    theirs = asked.join(both, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"),
        F.lit(True).alias("is_query"), "vid", F.lit(0).cast("long").alias("least"), "embedding", "reach",
    )
    return mine.union(theirs).groupBy("cell", "block", "part").applyInPandas(_search_block(axes, k, bound), "qid long, vid long, least long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("qid").orderBy(F.desc("score"), "least")
    return found.withColumn("r", F.row_number().over(over)).where(F.col("r") <= k).drop("r")


def nearest(
    vectors: DataFrame, queries, k: int = 5, dims: int = 8, sure: float = 0.995, sample_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition) picks, its k nearest rows by cosine.

    The cosine's double decides, however little two differ; ties, equal doubles, go to the smaller id. A row is no answer to itself, nor is another row with its id; a row
    that repeats an id and its vector counts once. Null vectors, those of zeros, those with a null or non-finite component and those of
    another length than most take no part, as queries or as answers; nor do null ids. Fewer rows
    than k give shorter answers; an empty table, or one without queries, gives no rows. Other columns
    are ignored. ``sample_rows`` vectors, picked by a hash, place the cells' cuts; every row is
    indexed. A true neighbour is missed with a probability of at most 1 - ``sure``.
    """
    spark = vectors.sparkSession
    sound = F.expr(f"forall({vec_col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vec_col}, x -> x <> 0)")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(sound)
    asked_for = queries if not isinstance(queries, str) else F.expr(queries)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding"), asked_for.alias("asks"))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = common["n"] if common else 1
    rows = rows.where(F.size("embedding") == size)
    axes, bound = directions(size, dims), chi_square_bound(sure, dims)

    # Equal vectors: the smallest id stands for them; an answer needs at most k + 1 of their ids.
    few = Window.partitionBy("embedding").orderBy("id")
    ids = rows.select("id", "embedding").distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    points = ids.groupBy("embedding").agg(F.min("id").alias("vid"), F.array_sort(F.collect_list("id")).alias("ids"))
    # Equal ids with different vectors are points apart: those of one id are numbered.
    points = settled(points.select(F.xxhash64("vid", "embedding").alias("key"), F.col("vid").alias("least"), "ids", "embedding"), "points")
    asking = rows.where("asks").select("id", "embedding").distinct()
    asking = asking.join(points.select("embedding", "key"), "embedding").select(F.col("id").alias("query_id"), F.col("key").alias("qid"))
    asking = settled(asking, "asking")

    n = points.count()
    share = 1.0 if n <= sample_rows else sample_rows / n
    picked = points.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").limit(2 * sample_rows)
    sample = [r[0] for r in picked.collect()]
    nodes = fit_cells(_project(np.array(sorted(sample)), axes), min(MOST_CELLS, -(-n // CELL))) if sample else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1)
                yield pa.record_batch([*batch.columns, pa.array(_cell_of(_project(got, axes), nodes))], names=["vid", "least", "embedding", "cell"])

    kind = points.schema["embedding"].dataType.simpleString()
    placed = points.select(F.col("key").alias("vid"), "least", "embedding").mapInArrow(place, f"vid long, least long, embedding {kind}, cell long")
    placed = settled(placed, "placed")
    at_home = placed.join(asking.select(F.col("qid").alias("vid")).distinct(), "vid", "left_semi").withColumn("reach", F.lit(4.0))
    first = settled(_blocked(placed, at_home, axes, k + 1, bound), "found")

    out, made = first, [placed, first]
    if nodes:
        reach = _top(first, k + 1).groupBy("qid").agg(F.count("*").alias("c"), F.min("score").alias("s"))
        reach = reach.select(F.col("qid").alias("vid"), F.when(F.col("c") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).otherwise(F.lit(4.0)).alias("reach"))
        again = at_home.select("vid", "embedding", "cell").join(reach, "vid")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = _project(np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1), axes)
                    far, home = batch.column(3).to_numpy(), batch.column(2).to_numpy()
                    cells = [[int(c) for c in np.flatnonzero(_cell_gaps(x, nodes) <= bound * r + 1e-9) if c != h] for x, r, h in zip(p, far, home)]
                    yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(cells, pa.list_(pa.int64()))], names=["vid", "embedding", "reach", "cells"])

        sent = again.select("vid", "embedding", "cell", "reach").mapInArrow(spread, f"vid long, embedding {kind}, reach double, cells array<long>")
        sent = settled(sent.select("vid", "embedding", "reach", F.explode("cells").alias("cell")), "sent")
        out = first.union(_blocked(placed, sent, axes, k + 1, bound))
        made.append(sent)
    best = settled(_top(out, k + 1), "best")
    discard(*made)
    best = best.join(points.select(F.col("key").alias("vid"), "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = asking.join(best, "qid").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    answers = answers.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")
