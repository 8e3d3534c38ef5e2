"""A store of pages: texts by their hash, urls by batch, so that a second run reads only what is new.

A batch of pages writes the texts that the store lacks and a row for each of its urls, both under the batch's number: a batch that
runs again writes the same. Of a url the row of the last batch counts. Equal pages of many urls are stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URLS, TEXTS = "url string, hash string, changed boolean", "hash string, html string"


class PageStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, name: str, form: str, before: int | None = None) -> DataFrame:
        """A table of the store, of the batches before a number if one is given."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        form = form + ", batch int"
        if not files.exists(place):
            return self.spark.createDataFrame([], form)
        rows = self.spark.read.schema(form).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def urls(self, before: int | None = None) -> DataFrame:
        """(url, hash, changed, batch): the last row of each url; ``changed`` tells whether its page was another than before."""
        return self._rows("urls", URLS, before).groupBy("url").agg(F.max_by(F.struct("hash", "changed", "batch"), "batch").alias("r")).select("url", "r.*")

    def missing(self, urls: DataFrame) -> DataFrame:
        """The different urls (column url) that the store has no page of: what is to be read."""
        return urls.select("url").where("url IS NOT NULL").distinct().join(self.urls(), "url", "left_anti")

    def put(self, pages: DataFrame, batch: int) -> None:
        """Store pages (url, html) as a batch; of rows that repeat a url the one with the greatest hash counts, rows without a url or html are no pages."""
        rows = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.sha2("html", 256).alias("hash"), "html")
        # Of a url one hash is chosen before any text is shuffled, and of a hash one text.
        chosen = rows.groupBy("url").agg(F.max("hash").alias("hash"))
        known = self.urls(batch).select("url", F.col("hash").alias("__was"))
        out = chosen.join(known, "url", "left").select("url", "hash", (~F.col("hash").eqNullSafe(F.col("__was"))).alias("changed"))
        out.write.mode("overwrite").parquet(f"{self.path}/urls/batch={batch}")
        wanted = self.spark.read.schema(URLS).parquet(f"{self.path}/urls/batch={batch}").select("hash").distinct()
        new = wanted.join(self._rows("texts", TEXTS, batch).select("hash"), "hash", "left_anti")
        texts = rows.select("hash", "html").join(new, "hash", "left_semi").dropDuplicates(["hash"])
        texts.write.mode("overwrite").parquet(f"{self.path}/texts/batch={batch}")

    def pages(self) -> DataFrame:
        """(url, html) as of the last batch."""
        texts = self._rows("texts", TEXTS).select("hash", "html")
        return self.urls().select("url", "hash").join(texts, "hash").select("url", "html")
