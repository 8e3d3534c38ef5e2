"""Document rates that mix domains to target weights, in DataFrame operations alone.

A multinomial naive Bayes classifier over hashed words, learnt from a labelled table, gives every
document a posterior over the domains: its soft membership. Rates r >= 0 are then fitted so that the
expected token totals, sum over documents of rate * tokens * posterior, come nearest to the targets
in least squares. The gradient of a document depends on the others through one residual a domain
alone, so that a document's rate follows from the list of steps so far. Nothing but sums by domain,
and their matrix, reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_labels, discard, settled

BUCKETS = 1 << 14
#: Target weights of the production query: language and quality of the labelled rows.
TARGETS = {
    "en/1": 0.50, "en/0": 0.04, "fr/1": 0.15, "fr/0": 0.01, "de/1": 0.15, "de/0": 0.01, "es/1": 0.13, "es/0": 0.01,
}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _words_of(docs: DataFrame, *more: str) -> DataFrame:
    """One row a word, and one with a null word for a text without any."""
    return docs.select(*more, F.explode_outer(_words(F.col("text"))).alias("word")).select(*more, _bucket(F.col("word")).alias("bucket"), F.col("word").isNotNull().cast("int").alias("one"))


def domain_weights(docs: DataFrame, labels: DataFrame, domains: list[str], max_rows: int) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...): log probabilities of a word's bucket in each domain; and the log priors.

    The table has one row a bucket, 16,384, whatever the corpus. Training rows are at most
    ``max_rows`` labelled documents, picked by a hash of their ids.
    """
    rows = bounded_labels(labels.select("doc_id", F.col("quality").cast("string").alias("quality")), max_rows, F.col("quality").isNotNull())
    train = docs.join(F.broadcast(rows), "doc_id").withColumn("domain", F.concat_ws("/", "lang", "quality")).where(F.col("domain").isin(domains))
    train = train.select("domain", "text")
    sizes = {r["domain"]: r["n"] for r in train.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = _words_of(train, "domain").where("one = 1").groupBy("bucket", "domain").agg(F.count("*").alias("c"))
    table = settled(counts.groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("c"))), F.lit(0)).alias(f"c{i}") for i, d in enumerate(domains)]), "counts")
    totals = table.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(len(domains))]).first()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    # A tenth of a count for words that a domain hasn't shown.
    weight = [F.log((F.coalesce(f"c{i}", F.lit(0)) + F.lit(0.1)) / F.lit(float(totals[i]) + 0.1 * BUCKETS)).alias(f"w{i}") for i in range(len(domains))]
    n = sum(sizes.values())
    weights = settled(every.join(table, "bucket", "left").select("bucket", *weight), "weights")
    discard(table)
    return weights, [float(np.log((sizes.get(d, 0) + 1) / (n + len(domains)))) for d in domains]


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], evidence: float = 6.0, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, version, tokens, p) for distinct documents, as a settled table; p has the domains' probabilities.

    A text's mean log likelihood a word counts as ``evidence`` words, however long the text is, so
    that memberships stay soft.
    """
    weights, priors = domain_weights(docs, labels, domains, max_rows)
    k = range(len(domains))
    rows = _words_of(docs.withColumn("version", F.xxhash64("text")), "doc_id", "version").join(F.broadcast(weights), "bucket", "left")
    sums = rows.groupBy("doc_id", "version").agg(F.sum("one").alias("tokens"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in k])
    logits = F.array(*[F.lit(priors[i]) + F.col(f"s{i}") * F.lit(evidence) / F.greatest("tokens", F.lit(1)) for i in k])
    sums = sums.select("doc_id", "version", "tokens", logits.alias("z")).select("doc_id", "version", "tokens", F.transform("z", lambda z: F.exp(z - F.array_max("z"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    out = settled(sums.select("doc_id", "version", "tokens", F.transform("e", lambda x: x / total).alias("p")), "members")
    discard(weights)
    return out


def _dot(x: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i, v in enumerate(x):
        out = out + F.col("p")[i] * F.lit(float(v))
    return out


def _projected(rate: Column, most: float | None) -> Column:
    """A rate within 0 and ``most``."""
    rate = F.greatest(F.lit(0.0), rate)
    return rate if most is None else F.least(F.lit(float(most)), rate)


def _look(members: DataFrame, rate: Column, g: np.ndarray, most: float | None, every: float) -> tuple[np.ndarray, float, np.ndarray]:
    """One pass, in shares of all tokens: token totals by domain of the rates after the step g, their sum of half squares, and the matrix of the free ones' posteriors."""
    k = range(len(g))
    p = [F.col("p")[i] for i in k]
    after = members.select("tokens", "p", (rate - _dot(g)).alias("u")).select("tokens", "p", "u", _projected(F.col("u"), most).alias("r"))
    after = after.select("tokens", "p", (F.col("tokens") * F.col("r")).alias("m"), (F.col("r") * (F.col("u") - F.col("r") / 2)).alias("h"), (F.col("u") == F.col("r")).cast("double").alias("free"))
    sums = [F.sum(F.col("m") * p[i]) for i in k] + [F.sum(F.col("tokens") * F.col("h"))] + [F.sum(F.col("free") * F.col("tokens") * p[i] * p[j]) for i in k for j in range(i + 1)]
    got = np.array(after.agg(*sums).first(), float) / every
    matrix = np.zeros((len(g), len(g)))
    matrix[np.tril_indices(len(g))] = got[len(g) + 1 :]
    return got[: len(g)], got[len(g)], np.tril(matrix) + np.tril(matrix, -1).T


def fit_rates(
    members: DataFrame, targets: list[float], budget: float = 1.25, most_rate: float | None = None, length: float = 1e5, most_steps: int = 30, near: float = 1e-6
) -> tuple[DataFrame, list[float], list[float]]:
    """(``members`` with ``rate``, expected token totals, wanted ones) by projected-gradient least squares.

    Targets are shares of ``budget`` times all tokens. Rates start at 1 and minimize the sum of squared
    differences between expected and wanted totals over all rates of at least 0 (and at most
    ``most_rate``, if given). A document's gradient, over its tokens, is its posterior times the
    residuals. Steps are implicit: a rate moves against the gradient at the step's end and is projected,
    which allows for any length. What the documents have in common at a step's end is one number a
    domain; Newton's method finds these from sums over all documents, one pass over ``members`` each.
    ``length`` is in units of one over the largest curvature. It ends when no residual is over ``near``
    of all tokens, when a step has not moved one by a tenth of that, or after ``most_steps``.
    """
    k = len(targets)
    first = members.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()
    every = float(first[0])
    share = np.array(targets, float) / sum(targets) * budget
    rate = F.lit(1.0)
    if not every:
        return members.withColumn("rate", rate), [0.0] * k, [0.0] * k
    sums, half, matrix = _look(members, rate, np.zeros(k), None, every)
    length /= np.linalg.eigvalsh(matrix).max()
    if most_rate is not None:
        rate = _projected(rate, most_rate)
        sums, half, matrix = _look(members, rate, np.zeros(k), most_rate, every)
    for _ in range(most_steps):
        if np.abs(sums - share).max() < near:
            break
        g, before = np.zeros(k), sums
        for _ in range(100):
            # Of the convex function whose minimum is the step: its gradient, and Newton's way down.
            slope = g / length + share - sums
            if np.abs(slope).max() < 1e-3 * near:
                break
            way, size = np.linalg.solve(matrix + np.eye(k) * (1 / length + 1e-12), slope), 1.0
            value = g @ g / (2 * length) + share @ g + half
            while True:
                there = g - size * way
                sums, half, matrix = _look(members, rate, there, most_rate, every)
                if there @ there / (2 * length) + share @ there + half <= value - 1e-4 * size * (slope @ way) + 1e-15 or size < 1e-6:
                    break
                size /= 2
            g = there
        rate = _projected(rate - _dot(g), most_rate)
        if np.abs(sums - before).max() < 0.1 * near:
            break
        # The next step starts where this one ended: with nothing taken off the new rates.
        sums, half, matrix = _look(members, rate, np.zeros(k), most_rate, every)
    return members.withColumn("rate", rate), (sums * every).tolist(), (share * every).tolist()


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.25, most_rate: float | None = None, **options) -> DataFrame:
    """(doc_id, version, tokens, domain, p, rate, wanted, expected) for every distinct document of ``docs`` (doc_id, text, lang).

    A domain is language/quality of a labelled row; targets are weights by domain. tokens counts
    words parted by white space; domain is the likeliest (the first of equals); wanted and expected
    are that domain's token totals, as the targets ask and as the rates give. version, a hash of
    the text, tells texts of one doc_id apart. Rows that repeat doc_id and text are one document,
    with the tokens of all.

    Cases: a null or empty text has 0 tokens and the prior as its posterior. A domain that no
    labelled row has keeps a small prior and even word weights. Without labels all posteriors are
    even. Targets that no nonnegative rates reach are met as nearly as least squares can; documents
    with equal posteriors have equal rates. A null doc_id is an id like others. An empty table gives
    no rows. Other columns are ignored.
    """
    targets = targets or TARGETS
    domains = list(targets)
    base = docs.select("doc_id", "text", "lang")
    members = posteriors(base, labels, domains, **options)
    rows, expected, wanted = fit_rates(members, list(targets.values()), budget, most_rate)
    at = F.array_position("p", F.array_max("p")).cast("int")
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), at)
    return rows.select("doc_id", "version", "tokens", of(domains, "string").alias("domain"), "p", "rate", of(wanted, "double").alias("wanted"), of(expected, "double").alias("expected"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.25, **options) -> DataFrame:
    """``docs`` with each row as often as its rate says: rounded up or down by a hash of doc_id and text, in expectation exact."""
    rates = mixing_rates(docs, labels, targets, budget, **options)
    part = F.pmod(F.xxhash64("doc_id", "version", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = rates.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.floor(F.col("rate") + part).cast("int").alias("__copies"))
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    rows = rows.join(copies.where("__copies > 0").hint("merge"), rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__version")))
    return rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
