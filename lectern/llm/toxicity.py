"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct words (lower case) and their beginnings of four, five and six
characters, so that one stem counts under all its endings; each is hashed to a bucket. All buckets
of the labelled sample are the model's inputs. Those whose counts depend on the label are learnt at
the full scale, the others, which may count in pairs only, at a smaller one that grows with their
frequency, so that the penalty keeps rare ones' noise down. The machine learns a weight for each, and
a vector whose inner products are the weights of pairs, such as an insult with the mention of a
group, which no sum of single weights can express. Scoring sends only the texts to Python workers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_labels

WORD = re.compile(r"\w+")
BUCKETS = 1 << 20
STEMS = (4, 5, 6)
#: Words whose buckets a worker remembers; beyond that it starts afresh.
REMEMBERED = 100_000
#: The least scale of an input; entries (inputs of rows) that are summed together; and rows whose terms a worker holds at a time.
WEAK, ENTRIES, PART = 0.02, 500_000, 128
ZERO = np.zeros(1, np.int32)


def _buckets(word: str) -> tuple[int, ...]:
    terms = [b"w " + word.encode("utf-8", "surrogatepass")]
    terms += [b"s " + word[:n].encode("utf-8", "surrogatepass") for n in STEMS if len(word) >= n]
    return tuple(xxhash.xxh64_intdigest(t) % BUCKETS for t in terms)


class _Terms:
    """The distinct buckets of a text, or the model's inputs among them."""

    def __init__(self, inputs: np.ndarray | None = None):
        self.inputs, self.known = inputs, {}

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        known, inputs = self.known, self.inputs
        for word in set(WORD.findall((text or "").lower())):
            got = known.get(word)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = _buckets(word)
                if inputs is not None:
                    got = tuple(i for b in got if (i := int(inputs[b])))
                known[word] = got
            if got:
                out.update(got)
        return out


def _packed(buckets: set[int]) -> bytes:
    """A set of buckets as the gaps between them, all low bytes before the higher ones, compressed: a third of their size."""
    gaps = np.diff(np.array(sorted(buckets), np.int32), prepend=np.int32(0))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)


def _find_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, number of buckets, packed buckets, toxic)."""
    terms = _Terms()
    for batch in batches:
        n, found = [], []
        for text in batch.column(1):
            got = terms(text.as_py())
            n.append(len(got))
            found.append(_packed(got))
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int32()), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "n", "buckets", "toxic"])


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of rows with about ``ENTRIES`` inputs; a longer row makes one of its own."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - sizes[low] + ENTRIES, "right")))
        yield low, high
        low = high


def _in_order(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, number of each row's, labels) of collected rows, ordered by doc_id and buckets, whatever the order in which they came."""
    ids, n, y = (found.column(k).to_numpy() for k in (0, 1, 3))
    views = [x.as_buffer() for x in found.column(2)]
    known, times = np.unique(ids, return_counts=True)
    again = set(known[times > 1].tolist())
    order = sorted(range(len(ids)), key=lambda i: (ids[i], views[i].to_pybytes() if ids[i] in again else b""))
    flat, at = np.empty(int(n.sum()), np.int32), 0
    for i in order:
        flat[at : at + n[i]] = _unpacked(views[i])
        at += n[i]
    return flat, n[order].astype(np.int64), y[order].astype(float)


class FactorizationMachine:
    """Logistic second-order factorization machine over sets of inputs numbered from 1; input 0 is the constant.

    Rows are given flat: the inputs of all rows one after another, and the number of each row's.
    """

    def __init__(self, weights: np.ndarray, factors: np.ndarray):
        self.weights, self.factors = weights, factors

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of all rows, ``ENTRIES`` inputs at a time."""
        out, ends = np.zeros(len(sizes)), np.cumsum(sizes)
        for low, high in _runs(sizes):
            at, size = flat[ends[low] - sizes[low] : ends[high - 1]], sizes[low:high]
            some = np.flatnonzero(size)
            z = np.full(high - low, float(self.weights[0]))
            if len(some):
                starts = (np.cumsum(size) - size)[some]
                v = self.factors[at]
                sums = np.add.reduceat(v, starts, axis=0)
                z[some] += np.add.reduceat(self.weights[at], starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((v**2).sum(1), starts))
            out[low:high] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out

    @classmethod
    def fit(cls, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, scale: np.ndarray, rank: int = 4, passes: int = 10, batch: int = 64, rate: float = 0.1, decay: float = 1e-4):
        """AdaGrad over shuffled batches on the mean log loss with an L2 penalty; the same rows give the same model.

        ``scale`` (of input 0 and all others) multiplies what is learnt for an input, which slows it and
        makes it cost more by the penalty.
        """
        rng = np.random.default_rng(11)
        scale = scale.astype(np.float32)
        weights = np.zeros(len(scale), np.float32)
        factors = rng.normal(0, 0.05, (rank, len(scale))).astype(np.float32)
        factors[:, 0] = 0
        base = np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 1 - 1e-4)
        weights[0] = np.log(base / (1 - base)) / scale[0]
        seen_w, seen_v = np.full_like(weights, 1e-8), np.full_like(factors, 1e-8)
        starts = np.cumsum(sizes) - sizes
        for _ in range(passes):
            order = rng.permutation(len(sizes))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                # The constant, input 0, comes first in every row; its vector stays zero.
                at = np.concatenate([x for r in rows for x in (ZERO, flat[starts[r] : starts[r] + sizes[r]])])
                size = sizes[rows] + 1
                begin, row = np.cumsum(size) - size, np.repeat(np.arange(len(rows)), size)
                used, place = np.unique(at, return_inverse=True)
                own, free = scale[used], used > 0
                v = factors[:, used] * own
                z = np.add.reduceat((weights[used] * own - 0.5 * (v**2).sum(0))[place], begin)
                sums = np.stack([np.add.reduceat(x[place], begin) for x in v])
                z = z + 0.5 * (sums**2).sum(0)
                error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
                plain = np.bincount(place, error[row], len(used))
                step = (plain * own + decay * weights[used] * free).astype(np.float32)
                seen_w[used] += step * step
                weights[used] -= rate * step / np.sqrt(seen_w[used])
                for f in range(rank):
                    step = ((np.bincount(place, (error * sums[f])[row], len(used)) - v[f] * plain) * own + decay * factors[f, used]) * free
                    step = step.astype(np.float32)
                    seen_v[f, used] += step * step
                    factors[f, used] -= rate * step / np.sqrt(seen_v[f, used])
        return cls(weights * scale, np.ascontiguousarray((factors * scale).T))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def input_scales(docs: np.ndarray, toxic: np.ndarray, n: int, t: float, least_g2: float) -> np.ndarray:
    """The scale of inputs that occur in ``docs`` of n rows, ``toxic`` of them among the t toxic ones.

    An input with a link of its own with the label (likelihood ratio of at least ``least_g2``) has 1,
    any other half its share of the rows, as rare ones are mostly noise, but ``WEAK`` at least.
    """
    d, a = docs.astype(float), toxic.astype(float)
    g2 = np.zeros(len(d))
    for x, y in ((a, d * t / n), (d - a, d * (n - t) / n), (t - a, (n - d) * t / n), (n - t - d + a, (n - d) * (n - t) / n)):
        held = x > 0
        g2[held] += 2 * x[held] * np.log(x[held] / y[held])
    return np.where((g2 >= least_g2) & (d >= 3), 1.0, np.clip(0.5 * d / n, WEAK, 1.0))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, least_g2: float = 15.0):
    """(input by bucket, 0 for none; model) from labelled rows that are not held out.

    At most ``max_rows`` labelled rows train the model, picked by a hash of their ids (all, where
    there are fewer); that bounds the join's broadcast side and what reaches the driver. All their
    buckets are inputs, at the scales of ``input_scales``.
    """
    rows = bounded_labels(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), max_rows, F.col("toxic").isin(0, 1) & ~held_out())
    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = totals["n"] or 0, totals["t"] or 0
    flat, sizes, y = np.zeros(0, np.int32), np.zeros(0, np.int64), np.array([1.0] * t + [0.0] * (n - t if t < n else t))
    if 0 < t < n:
        train = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
        if docs.select("doc_id").join(F.broadcast(rows), "doc_id").count() > n:
            # An id that repeats trains with its first text, so that the driver gets at most ``max_rows`` rows.
            train = train.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        found = train.select("doc_id", "text", "toxic").mapInArrow(_find_buckets, "doc_id long, n int, buckets binary, toxic int").toArrow()
        if found.num_rows:
            flat, sizes, y = _in_order(found)
        del found
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    parts = [(i, j, flat[sizes[:i].sum() : sizes[:j].sum()]) for i, j in _runs(sizes)]  # views; numpy would index by numbers twice the size
    for i, j, part in parts:
        label = np.repeat(y[i:j] > 0, sizes[i:j])
        seen += np.bincount(part, minlength=BUCKETS)
        toxic += np.bincount(part[label], minlength=BUCKETS)
    used = np.flatnonzero(seen)
    used = used[np.argsort(-seen[used], kind="stable")]  # what is looked up most stands together
    inputs = np.zeros(BUCKETS, np.int32)
    inputs[used] = np.arange(1, len(used) + 1)
    for _, _, part in parts:
        part[:] = inputs[part]
    scale = np.ones(len(used) + 1)
    if len(used):
        scale[1:] = input_scales(seen[used], toxic[used], len(y), y.sum(), least_g2)
    return inputs, FactorizationMachine.fit(flat, sizes, y, scale)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """All rows of ``docs`` with their columns, and ``toxicity``, a score from 0 to 1 (higher: more likely toxic).

    The model sees the text alone. Rows repeat as they come; a null or empty text has no terms and
    gets the score of the constant, near the share of toxic rows; without labels of both kinds every
    row gets 0.0001, or 0.5 if all labels are toxic, as they tell no text from another. An empty table gives no rows. A column
    named toxicity is replaced; other columns may have any name.
    """
    inputs, model = fit(docs, labels, **options)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = _Terms(inputs)
        for batch in batches:
            out = []
            for i in range(0, len(batch), PART):
                found = [terms(text.as_py()) for text in batch[i : i + PART]]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                out.append(model.scores(np.fromiter((x for r in found for x in r), np.int64, int(sizes.sum())), sizes))
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn("toxicity", score(F.col("text")))
