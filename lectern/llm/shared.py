"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs the rerun of a few tasks, not of all that came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``settled`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/lectern/" in folder.toString():
                folder.getFileSystem(conf).delete(folder, True)


def bounded_labels(labels: DataFrame, bound: int, keep=None) -> DataFrame:
    """At most ``bound`` labelled rows, picked by a hash of ``doc_id``; all of them where there are fewer.

    ``keep`` is an optional condition on the rows. Rows that repeat a doc_id count once (the largest
    label wins). The result has at most ``bound`` rows whatever the size of ``labels``, so that it may
    be broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    others = [c for c in labels.columns if c != "doc_id"]
    rows = rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in others])
    n = rows.count()
    if n > bound:
        # A first cut by hash leaves a little more than the bound; the limit below makes it exact.
        share = min(1.0, 1.2 * bound / n)
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return rows


FILTER_BITS = 25


def filter_bit(col: str):
    """The bit of an id in the bitmap of ``id_bitmap``."""
    return F.xxhash64(col).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def bitmap_table(ids: DataFrame, col: str) -> DataFrame:
    """(word, mask) of a bitmap of hashed ids: at most 2**19 rows, whatever the number of ids.

    It lets a scan skip nearly all rows that a later join would drop; that join stays exact. With
    more ids than bits it no longer helps, and does no harm.
    """
    words = ids.select(filter_bit(col).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
    return words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))


def id_bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """``bitmap_table`` as an array of 4 MB."""
    found = bitmap_table(ids, col).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 6] >> (bits & 63)) & 1 == 1
