"""Means and deviations that merge: a new run changes them without another look at the scores before it.

A row of moments has the number, mean, sum of squared deviations, least and greatest of some values. Rows of one key merge
in any order: deviations are taken from the merged mean, never as a difference of sums of squares, which would cancel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORM = ("n", "mean", "m2", "low", "high")


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, m2, low, high) of the values of each key; nulls count for nothing, a key of nulls has no row."""
    x = F.col(value).cast("double")
    found = rows.where(x.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("v"), F.min(x).alias("low"), F.max(x).alias("high"))
    return found.select(*by, "n", "mean", (F.col("v") * F.col("n")).alias("m2"), "low", "high")


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """One row a key from any number of them, by two sums: the mean first, then what lies around it."""
    means = parts.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum("n").alias("__n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__mean"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = parts.select(*by, *FORM).join(means, same)
    off = F.col("mean") - F.col("__mean")
    return both.groupBy(*by).agg(
        F.first("__n").alias("n"), F.first("__mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows of moments with sigma (sample deviation, 0 for a single value) and spread."""
    sigma = F.when(F.col("n") > 1, F.sqrt(F.greatest("m2", F.lit(0.0)) / (F.col("n") - 1))).otherwise(0.0)
    return rows.withColumns({"sigma": sigma, "spread": F.col("high") - F.col("low")})


def moment_batches(stream: DataFrame, path: str, by: list[str], value: str, checkpoint: str):
    """Keep the moments of a stream's values: each batch writes its own rows, so that one which runs again writes the same; ``stored_moments`` merges them."""

    def put(batch: DataFrame, number: int) -> None:
        moments(batch, by, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def stored_moments(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    return merged(spark.read.parquet(path).drop("batch"), by)
