"""Sources and sinks: tables of a folder, sitemaps, pages, JSON documents, JSON lines, logs, CSV and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = (
    "url string, category string, slug string, type string, title string, description string, "
    "authors array<struct<name:string,slug:string,role:string>>, topics array<string>, publishedAt string, "
    "series struct<title:string,slug:string,totalParts:int,currentIndex:int,parts:array<struct<slug:string,title:string>>>, "
    "body string, text string, wordCount int, scrapedAt string"
)
SOURCE_LINE = "marker int, url string, title string, category string, section string, snippet string, source string, chunk_id string, chunk_text string"
ITEM = (
    "id string, track string, version int, question string, claim_type string, numeric_target struct<value:double,unit:string,tolerance:struct<rtol:double,atol:double>>, "
    "accepted_phrasings array<string>, hedge_terms array<string>, expected_citation struct<url:string,title:string,section:string>, "
    "expected_citations array<struct<url:string,title:string>>, source_passage string, expected_behavior string, required_elements array<string>, tier string, held_out boolean"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sitemap_urls(texts: DataFrame, col: str = "value") -> DataFrame:
    """Distinct urls of all <loc> elements, with the first place of each."""
    found = texts.select(F.posexplode(F.regexp_extract_all(F.col(col), F.lit("<loc>([^<]+)</loc>"), 1)).alias("place", "url"))
    return found.groupBy("url").agg(F.min("place").alias("place"))


def read_documents(spark: SparkSession, path: str, least_chars: int = 80) -> DataFrame:
    """Documents of a folder of JSON files, without those whose names start with an underscore; broken or short ones are left out."""
    schema = T._parse_datatype_string(DOCUMENT).add("_broken", "string")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "[!_]*.json").json(path)
    return rows.where(F.col("_broken").isNull() & (F.length("text") > least_chars)).drop("_broken")


def read_items(spark: SparkSession, path: str, tier: str = "all", with_held_out: bool = False) -> DataFrame:
    """Benchmark items of a tier; held-out ones only on request, before the tier counts."""
    rows = spark.read.schema(ITEM).option("multiLine", True).option("recursiveFileLookup", True).json(path).where(F.col("id").isNotNull())
    rows = rows.where(F.lit(with_held_out) | ~F.coalesce("held_out", F.lit(False)))
    return rows.where(tier_matches(F.coalesce("tier", F.lit("smoke")), tier))


def tier_matches(tier, wanted: str):
    return {"all": F.lit(True), "extended": tier.isin("smoke", "extended"), "smoke": tier == "smoke"}[wanted]


def read_source_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered sources from JSON lines; blank and broken lines, and those without a number, a chunk, a url or a title, are left out."""
    rows = spark.read.schema(SOURCE_LINE).option("mode", "DROPMALFORMED").json(path)
    return rows.where("marker IS NOT NULL AND chunk_id IS NOT NULL AND url IS NOT NULL AND title IS NOT NULL")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Scores of exported logs, one folder a run and one file a track; of two files of a track the last by name counts."""
    rows = spark.read.option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.withColumn("run", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    last = rows.groupBy("run", "track").agg(F.max("file").alias("file"))
    return rows.join(last, ["run", "track", "file"], "left_semi")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as JSON, and beside them the manifest without their texts, both in the order of urls over all files; what was there before goes."""
    docs = docs.repartitionByRange("url").sortWithinPartitions("url")
    docs.write.mode("overwrite").json(f"{path}/documents")
    manifest = docs.select("url", "category", "type", "title", F.transform("authors", lambda a: a["name"]).alias("authors"), "publishedAt", "wordCount")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def append_source_lines(fresh: DataFrame, path: str) -> None:
    fresh.write.mode("append").json(path)


def write_labelling_sheet(rows: DataFrame, path: str) -> None:
    """CSV with empty columns for a grader's label and notes."""
    rows.withColumns({"gold_label": F.lit(""), "notes": F.lit("")}).write.mode("overwrite").option("header", True).csv(path)


def read_labelling_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", now=None) -> DataFrame:
    """``table`` with ``changes`` put in by key: the newest row of each key stays, changes before old rows of the same time."""
    from pyspark.sql import Window

    now = F.current_timestamp() if now is None else now
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumns({"updated_at": now, "__new": F.lit(1)}))
    w = Window.partitionBy(key).orderBy(F.desc("updated_at"), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")
