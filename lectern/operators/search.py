"""Ranked search over chunks: BM25, bonuses, penalties, a cap a source, and numbered results.

Queries come as a table, and all of them are answered by one plan over a stored index: postings of
asked terms are read, joined with their frequencies and summed. Texts are read for the few chunks
that hit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PERSON_TERMS, looks_like_references, query_terms
from ..functions.values import rounded
from ..sources.shared import shared_dir
from .index import Index, write_index

K1, B = 1.4, 0.75
#: Distinct terms of all queries that are sent along with a plan; more of them are joined.
FEW = 2000
TITLE_BONUS, REFERENCE_FACTOR, PEOPLE_FACTOR, PER_URL = 0.6, 0.4, 1.7, 2


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, terms) of queries (query_id, query) that have terms."""
    return queries.select("query_id", query_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of chunks with a term of the query, from a stored index; chunks without tokens have no score."""
    asked = asked_terms(queries).select("query_id", F.explode("terms").alias("term"))
    posts, few = index.postings, [r["term"] for r in asked.select("term").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        posts = posts.where(F.col("term").isin(few))  # read from the row groups that have them
    # Of terms and frequencies, what is asked; the stated queries are the small side.
    asked = asked.join(index.frequencies.select("term", "idf"), "term")
    hits = posts.join(asked, "term").join(F.broadcast(index.statistics.select("mean")), F.lit(True))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return hits.groupBy("query_id", index.id_col).agg(F.sum(weight).alias("score"))


def title_bonus(terms: Column, *fields: Column) -> Column:
    """A bonus for each term that occurs, even within a word, in the joined fields."""
    hay = F.lower(F.concat_ws(" ", *fields))
    return F.size(F.filter(terms, lambda t: hay.contains(t))) * F.lit(TITLE_BONUS)


def head_hits(about: DataFrame, words: DataFrame, id_col: str) -> DataFrame:
    """(id, term) of heads (column hay) that contain one of the distinct terms, even within a word.

    Few terms are tried on every head. More of them are joined on their first two characters, which a
    head that contains a term has among its pairs of characters; the test for the term follows.
    """
    terms = words.select("term").distinct()
    if terms.limit(FEW + 1).count() <= FEW:
        return about.join(F.broadcast(terms), F.col("hay").contains(F.col("term"))).select(id_col, "term")
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("hay") - 1), lambda i: F.substring(F.col("hay"), i, F.lit(2))))
    heads = about.where(F.length("hay") > 1).select(id_col, "hay", F.explode(pairs).alias("pair"))
    return heads.join(terms.withColumn("pair", F.substring("term", 1, 2)), "pair").where(F.col("hay").contains(F.col("term"))).select(id_col, "term")


def ranked(chunks: DataFrame, index: Index, queries: DataFrame, k: int = 12) -> DataFrame:
    """(query_id, rank, id, url, score) of each query's best chunks, at most two a url.

    ``index`` is that of ``chunks``, which has id, ordinal, url, title, authors, topics, section, category and text. Scores sum
    BM25 and bonuses; reference lists keep 0.4 of theirs; people gain by 1.7 when the query asks for
    people. Ties go to chunks with a BM25 score, then to the smaller ordinal.
    """
    id_col = index.id_col
    base = bm25(index, queries)
    terms = asked_terms(queries)
    heads = chunks.select(id_col, F.lower(F.concat_ws(" ", "title", F.concat_ws(" ", "authors"), F.concat_ws(" ", "topics"), "section")).alias("hay"))
    words = terms.select("query_id", F.explode("terms").alias("term"))
    bonus = head_hits(heads, words, id_col).join(words, "term").groupBy("query_id", id_col).agg((F.count("*") * F.lit(TITLE_BONUS)).alias("bonus"))
    found = base.join(bonus, ["query_id", id_col], "full")
    about = chunks.select(id_col, "ordinal", "url", "category", "text", "section")
    both = found.join(about, id_col).withColumn("is_list", looks_like_references(F.col("text"), F.col("section"))).drop("text", "section").join(terms, "query_id")
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))
    score = F.when(F.col("is_list"), score * REFERENCE_FACTOR).otherwise(score)
    asks_people = F.arrays_overlap("terms", F.array(*[F.lit(t) for t in PERSON_TERMS]))
    score = F.when(asks_people & (F.col("category") == "people"), score * PEOPLE_FACTOR).otherwise(score)
    scored = both.select("query_id", id_col, "url", "ordinal", F.col("score").isNotNull().alias("hit"), rounded(score).alias("score")).where("score > 0")
    order = [F.desc("score"), F.desc("hit"), F.asc("ordinal")]
    capped = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy(*order))).where(F.col("n") <= PER_URL)
    ranks = capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranks.select("query_id", "rank", id_col, "url", "score")


def formatted_results(results: DataFrame) -> DataFrame:
    """(query_id, block): the results of a query (marker, title, authors, url, text, query) as one text."""
    head = F.concat_ws(
        " · ", F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] "), F.col("title")), F.concat(F.lit("Authors: "), F.col("authors")),
        F.concat(F.lit("Section: "), F.col("section")), F.concat(F.lit("URL: "), F.col("url")),
    )
    item = F.struct("marker", F.concat(head, F.lit("\n\n"), F.col("text")).alias("block"))
    parts = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.block)
    made = results.groupBy("query_id", "query").agg(F.array_join(parts, "\n\n---\n\n").alias("body"))
    return made.select("query_id", F.concat(F.lit('# Search results for: "'), F.col("query"), F.lit('"\n\n'), F.col("body")).alias("block"))


def clamped_k(k: Column, default: int = 6, most: int = 10) -> Column:
    """A result count from text: the default for 0 or no number, then 1 to ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(F.nullif(k.try_cast("int"), F.lit(0)), F.lit(default))))


class Searcher:
    """Search, lookups and statistics over a table of chunks."""

    def __init__(self, chunks: DataFrame, index: Index | None = None, id_col: str = "chunk_id"):
        """Without an index one is built in the shared folder at the first search."""
        self.chunks, self.index, self.id_col = chunks, index, id_col

    def search(self, query: str, k: int = 12) -> DataFrame:
        return self.search_all(self.chunks.sparkSession.createDataFrame([(0, query)], "query_id long, query string"), k)

    def search_all(self, queries: DataFrame, k: int = 12) -> DataFrame:
        if self.index is None:
            self.index = write_index(self.chunks, f"{shared_dir(self.chunks.sparkSession)}/lectern/index-{uuid.uuid4().hex}", self.id_col)
        return ranked(self.chunks, self.index, queries, k)

    def get_chunk(self, chunk_id) -> DataFrame:
        return self.chunks.where(F.col(self.id_col) == chunk_id)

    def chunks_for_url(self, url: str) -> DataFrame:
        return self.chunks.where(F.col("url") == url).orderBy("ordinal")

    def catalog(self) -> DataFrame:
        from .catalog import catalog

        return catalog(self.chunks)

    def corpus_stats(self) -> DataFrame:
        from .index import statistics

        return statistics(self.chunks)
