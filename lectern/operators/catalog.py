"""Public catalog of documents, and suggestions while a title is typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog(docs: DataFrame) -> DataFrame:
    """One row a url that is no single page, without texts; the first chunk of a url stands for it."""
    first = docs.where("category <> 'pages'").groupBy("url").agg(F.min_by(F.struct("title", "authors", "topics", "category"), "ordinal").alias("d"))
    return first.select("url", "d.title", "d.authors", "d.topics", "d.category")


def suggestion_score(typed: str, title: Column, authors: Column, topics: Column) -> Column:
    """6 for a title that starts with what is typed, 3 for one that has it, 2 for each author and 1 for each topic that has it."""
    q = typed.strip().lower()
    has = lambda x: F.lower(x).contains(q)
    at_title = F.when(F.lower(title).startswith(q), 6).when(has(title), 3).otherwise(0)
    return at_title + 2 * F.size(F.filter(authors, has)) + F.size(F.filter(topics, has))


def suggestions(docs: DataFrame, typed: str, mentioned: DataFrame | None = None, k: int = 8) -> DataFrame:
    """The best ``k`` documents (id, title, authors, topics) for what is typed, without those already mentioned."""
    pool = docs if mentioned is None else docs.join(mentioned, "id", "left_anti")
    scored = pool.select("id", "title", suggestion_score(typed, F.col("title"), F.col("authors"), F.col("topics")).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "id").limit(k)


def prompt_lines(docs: DataFrame) -> DataFrame:
    """(category, lines): a category's entries, newest first, as one text a category; for catalogs that fit into a prompt, as a category's text is made in one row."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("url"), F.lit(")"))
    entry = F.struct((-F.unix_date("published")).alias("o"), F.col("id"), line.alias("line"))
    return docs.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.line), "\n").alias("lines"))


def latest_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the latest; for tables that are upserted."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
