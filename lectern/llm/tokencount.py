"""Exact token totals for every context limit from a histogram of encoded lengths.

Documents are encoded once, in the tasks that read them, and only their lengths go on. The histogram
has one row a distinct length; sums over its tail, made in two levels so that no task holds it all,
answer totals, quantiles and truncated totals for any limit without another look at the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of one block of the two-level sums.
BLOCK = 1024
_MADE: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoder(ranks: str = RANKS, pattern: str = PATTERN) -> tiktoken.Encoding:
    if (ranks, pattern) not in _MADE:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _MADE[ranks, pattern] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _MADE[ranks, pattern]


def encoded_lengths(docs: DataFrame, text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """One column, n_tokens, for every row; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            n = [len(own.encode_ordinary(x.as_py() or "")) for x in batch.column(0)]
            yield pa.record_batch([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each distinct length L: docs of it, docs and tokens at least that long, and totals at the limit L.

    docs_from and tokens_from sum the lengths >= L; truncated is the sum of min(length, L) over all
    documents; cut is the number of documents longer than L; share is the part of documents of at most L.
    """
    rows = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    sums = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    tail = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(sums, "block").select(
        "n_tokens", "docs", "tokens", "all_docs", "all_tokens",
        (F.sum("docs").over(tail) + F.col("d")).alias("docs_from"), (F.sum("tokens").over(tail) + F.col("t")).alias("tokens_from"),
    )
    cut = F.col("docs_from") - F.col("docs")
    shorter = F.col("all_tokens") - F.col("tokens_from") + F.col("tokens")
    return out.select(
        "n_tokens", "docs", "docs_from", "tokens_from", cut.alias("cut"), (shorter + F.col("n_tokens") * cut).alias("truncated"),
        ((F.col("all_docs") - cut) / F.col("all_docs")).alias("share"),
    )


def token_length_table(docs: DataFrame, text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``suffix_sums`` of the documents' encoded lengths.

    Null and empty texts count as length 0; repeated rows count each; an empty table gives no rows;
    other columns are ignored. Texts are encoded whole.
    """
    # The sums read the histogram twice: it is written, so that documents are encoded once.
    return suffix_sums(settled(histogram(encoded_lengths(docs, text_col, ranks)), "lengths"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, total) for any limits, from ``suffix_sums``: the sum of min(length, limit); no rows without documents.

    One row answers a limit: of the lengths up to it the greatest, whose ``truncated`` grows by one token a step for each document
    that is longer. Limits under the least length cost each document the limit. Limits and lengths are put in one order in blocks of
    lengths; a block without a length of its own up to a limit looks at the last of those before.
    """
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "limit long")
    answer = F.struct("n_tokens", "truncated", "cut")
    rows = sums.select("n_tokens", F.floor(F.col("n_tokens") / BLOCK).alias("block"), answer.alias("own"))
    last = rows.groupBy("block").agg(F.max("own").alias("last"))  # a row per 1,024 lengths
    wanted = asked.withColumn("block", F.floor(F.col("limit") / BLOCK))
    inside = wanted.join(rows, "block").where(F.col("n_tokens") <= F.col("limit")).groupBy("limit").agg(F.max("own").alias("inside"))
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = last.unionByName(wanted.select("block", F.lit(None).cast(last.schema["last"].dataType).alias("last")).distinct()).groupBy("block").agg(F.max("last").alias("last"))
    before = blocks.select("block", F.last("last", ignorenulls=True).over(order).alias("before"))
    every = sums.agg(F.max("docs_from").alias("all"))
    found = wanted.join(before, "block").join(inside, "limit", "left").join(F.broadcast(every), F.lit(True)).where("all IS NOT NULL")
    at = F.coalesce("inside", "before")
    total = F.when(at.isNull(), F.col("all") * F.col("limit")).otherwise(at["truncated"] + at["cut"] * (F.col("limit") - at["n_tokens"]))
    return found.select("limit", total.alias("total"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(float(x),) for x in shares], "asked double"))
    hit = sums.select("n_tokens", "share").join(asked, F.col("share") >= F.col("asked"))
    return hit.groupBy(F.col("asked").alias("share")).agg(F.min("n_tokens").alias("n_tokens"))
