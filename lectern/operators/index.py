"""Search index: tables of postings, frequencies and statistics, stored and read again; catalog counts and histograms."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize
from ..sources.shared import shared_dir, spread

FORMAT = 3
#: Characters of a run of texts whose terms a task counts and orders at once.
RUN = 1 << 22
#: Bytes of lower-case text: those of tokens stay, all others become spaces.
SIGNS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789-'" else 32 for c in range(256))


class Index(NamedTuple):
    """postings (term, id, dl, tf) in the order of terms, frequencies (term, df, idf) and statistics (one row: version, records, tokens, mean)."""

    postings: DataFrame
    frequencies: DataFrame
    statistics: DataFrame
    id_col: str


def runs_of(texts: pa.Array, most: int = RUN) -> Iterator[tuple[int, list[str | None]]]:
    """(place, texts) of slices of about ``most`` bytes, so that a task holds the parts of a few texts at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(sizes):
        held = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, held + most, "right")))
        yield start, texts.slice(start, end - start).to_pylist()
        start = end


def counted(parts: list[list[bytes]], least: int = 0, most: int = 1 << 30) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in order, each entry's term, its row, its count, rows' sizes) of rows of parts of ``least`` to ``most`` bytes; entries by term, then row."""
    known = pa.array([t for part in parts for t in part], pa.binary()).dictionary_encode()
    rank = np.empty(len(known.dictionary), np.int64)
    order = pc.sort_indices(known.dictionary).to_numpy()
    rank[order] = np.arange(len(order))
    sizes = pc.binary_length(known.dictionary).to_numpy()
    codes, rows = known.indices.to_numpy(), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    kept = ((sizes >= least) & (sizes <= most))[codes]
    codes, rows = codes[kept], rows[kept]
    entries, counts = np.unique(rank[codes] * max(len(parts), 1) + rows, return_counts=True)
    terms, at = np.divmod(entries, max(len(parts), 1))
    return known.dictionary.take(pa.array(order)).cast(pa.string()), terms, at, counts, np.bincount(rows, minlength=len(parts))


def token_counts(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``counted`` of the tokens that ``functions.text.tokenize`` gives: what is lower-case and no token's character parts them."""
    return counted([(t or "").lower().encode().translate(SIGNS).split() for t in texts], 2, 39)


def postings(chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, dl, term, tf), counted where the texts are read, in runs in the order of terms; nothing is shuffled or sorted beyond a run."""
    rows = chunks.select(id_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs_of(batch.column(1)):
                terms, term, at, n, dl = token_counts(texts)
                ids = batch.column(0).take(pa.array(first + at))
                columns = [ids, pa.array(dl[at], pa.int32()), terms.take(pa.array(term)), pa.array(n, pa.int64())]
                yield pa.record_batch(columns, names=[id_col, "dl", "term", "tf"])

    kinds = T.StructType([rows.schema[0], T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(run, kinds)


def document_counts(texts: DataFrame) -> DataFrame:
    """(term, df) of a column ``text``: each run's counts are summed, and only terms are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in runs_of(batch.column(0)):
                terms, term, _, _, _ = token_counts(rows)
                df = np.bincount(term, minlength=len(terms))
                yield pa.record_batch([terms.filter(pa.array(df > 0)), pa.array(df[df > 0], pa.int64())], names=["term", "df"])

    return texts.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weighed(counts: DataFrame, records: Column) -> DataFrame:
    """(term, df, idf) of (term, df): idf is ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return counts.select("term", "df", F.log(1 + (records - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def frequencies(posts: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf) from postings and a row with ``records``: idf is ln(1 + (N - df + 0.5) / (df + 0.5))."""
    counts = posts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total.select("records")), F.lit(True))
    return weighed(counts, F.col("records"))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: documents, tokens and the mean length, rounded half up; 0 for an empty table."""
    rows = chunks.select(F.size(tokenize(F.col("text"))).cast("long").alias("n"))
    return rows.agg(
        F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.floor(F.avg("n") + 0.5), F.lit(0)).cast("long").alias("mean_tokens")
    )


def write_index(chunks: DataFrame, path: str, id_col: str = "chunk_id") -> Index:
    """Build the index of ``chunks`` (id, text) in a folder, and open it.

    Postings are ranged by term and id, so that a frequent term spans several files and a search for a
    few terms reads few row groups. Chunks without tokens have no postings, but count as records.
    """
    spark = chunks.sparkSession
    sizes = spread(chunks.select(id_col, "text"))
    posts = postings(sizes, id_col).select("term", id_col, "dl", "tf")
    posts.repartitionByRange("term", id_col).sortWithinPartitions("term", id_col).write.mode("overwrite").parquet(f"{path}/postings")
    posts = spark.read.parquet(f"{path}/postings")
    total = chunks.agg(F.count("*").alias("records")).join(posts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")), F.lit(True))
    total = total.select(F.lit(FORMAT).alias("version"), F.current_timestamp().alias("built_at"), "records", "tokens", (F.col("tokens") / F.greatest("records", F.lit(1))).alias("mean"))
    total.write.mode("overwrite").parquet(f"{path}/statistics")
    frequencies(posts, spark.read.parquet(f"{path}/statistics")).write.mode("overwrite").parquet(f"{path}/frequencies")
    return read_index(spark, path, id_col)


def read_index(spark: SparkSession, path: str, id_col: str = "chunk_id") -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "frequencies", "statistics")), id_col)


_STORED: dict[tuple, str] = {}


def stored_index(chunks: DataFrame, source: str, id_col: str = "chunk_id") -> Index:
    """The index of ``chunks``, which come from the table file ``source``: built on first use of the session and opened after that.

    The table's files, with their sizes and times, are part of the key: a table that has changed is indexed anew.
    """
    spark = chunks.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)))
    key = (spark.sparkContext.applicationId, id_col, now)
    if key not in _STORED:
        place = f"{shared_dir(spark)}/lectern/index-{uuid.uuid4().hex}"
        write_index(chunks, place, id_col)
        _STORED[key] = place
    return read_index(spark, _STORED[key], id_col)


def category_totals(docs: DataFrame, category: str) -> DataFrame:
    """Documents and words a category, null words counting 0."""
    return docs.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("records"), F.sum(F.coalesce("words", F.lit(0))).cast("long").alias("words"))


def histogram(docs: DataFrame, array_col: str) -> DataFrame:
    """(name, n) of the values in an array column; each document counts a value as often as it has it."""
    return docs.select(F.explode(array_col).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
