"""Queries over the search index and ranked search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, query_terms, tokenize, word_count
from ..functions.values import rounded
from ..operators import catalog as cat
from ..operators import index, search
from ..operators.segments import Segments, stored_segments
from ..sources.shared import shared_dir, spread
from ..sources.tables import read_table
from .registry import query, rounded_sql, tokens_sql

QUESTION = "who was the eren attion that only thing ering from"
#: Stated queries of the full ranking.
QUESTIONS = ((1, QUESTION), (2, "src3 research ering author people"), (3, "thing and ertion src7"), (4, "the of"))
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def asked(spark: SparkSession, questions=QUESTIONS) -> DataFrame:
    return spark.createDataFrame(list(questions), "query_id long, query string")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of sources, with heads made of their first words and ids."""
    docs = read_table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 7 == 0, "people").when(F.col("doc_id") % 7 == 1, "pages").otherwise("research")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ordinal"), F.col("source").alias("url"),
        F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("title"), F.array("lang").alias("authors"), F.array("source").alias("topics"),
        F.when(F.col("doc_id") % 11 == 0, "References").alias("section"), kind.alias("category"), "text",
    )


def corpus(spark: SparkSession, sf_dir: str, id_col: str = "doc_id") -> Segments:
    """The stored index of the documents as chunks; their ids are the documents'."""
    found = stored_segments(chunk_table(spark, sf_dir), f"{sf_dir}/documents.parquet")
    return Segments(spark, found.path, id_col)


CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS chunk_id, doc_id AS ordinal, source AS url, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS title, lang AS author, source AS topic,
    CASE WHEN doc_id % 11 = 0 THEN 'References' END AS section, CASE doc_id % 7 WHEN 0 THEN 'people' WHEN 1 THEN 'pages' ELSE 'research' END AS category, text
  FROM documents)"""


def bm25_sql(terms: str) -> str:
    """CTEs up to ``score`` (query_id, doc_id, score), from CTE ``q`` (query_id, term)."""
    return f"""{terms},
tok AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents),
stats AS (SELECT count(*) AS total, sum(len(tokens)) / greatest(count(*), 1) AS mean FROM tok),
posts AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
score AS (
  SELECT q.query_id, p.doc_id, sum(ln(1 + (s.total - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.4 / (p.tf + 1.4 * (0.25 + 0.75 * p.dl / s.mean))) AS score
  FROM q JOIN posts p ON q.term = p.term JOIN freq f ON f.term = q.term CROSS JOIN stats s GROUP BY 1, 2)"""


def terms_sql(source: str) -> str:
    return f"""asked AS ({source}),
q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM asked) WHERE NOT list_contains({STOP_SQL}, term))"""


VALUES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") AS v(query_id, query)"


@query(f"""WITH {bm25_sql(terms_sql(f"SELECT 1 AS query_id, '{QUESTION}' AS query"))}
SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM (SELECT doc_id, {rounded_sql('score')} AS score FROM score) ORDER BY score DESC, doc_id LIMIT 10""")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).top(asked(spark, [(1, QUESTION)]), 10).select("rank", "doc_id", "score")


@query(f"""WITH {bm25_sql(terms_sql('SELECT item_id AS query_id, text AS query FROM benchmark'))}
SELECT query_id, doc_id, CAST(rank AS INT) AS rank, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, {rounded_sql('score')} AS score FROM score))
WHERE rank <= 5""")
def search_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return corpus(spark, sf_dir).top(questions, 5).select("query_id", "doc_id", "rank", "score")


UPDATED_SQL = """documents AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'only new words of ' || lang || ' thing ' || text ELSE text END AS text FROM main.documents WHERE doc_id % 17 <> 5)"""


@query(f"""WITH {UPDATED_SQL}, {bm25_sql(terms_sql(VALUES_SQL))}
SELECT query_id, doc_id, CAST(rank AS INT) AS rank, score FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, {rounded_sql('score')} AS score FROM score))
WHERE rank <= 10""")
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments, a tenth of the documents replaced and a seventeenth dropped, segments merged: ranks are those of the table as it then is."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    made = Segments(spark, f"{shared_dir(spark)}/lectern/updates-{uuid.uuid4().hex}", "doc_id")
    for part in range(3):
        made.add(docs.where(F.pmod("doc_id", F.lit(3)) == part))
    made.replace(docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("only new words of "), "lang", F.lit(" thing "), "text")))
    made.drop(docs.where("doc_id % 17 = 5").select("doc_id"))
    made.merge(factor=3)
    return made.top(asked(spark), 10).select("query_id", "doc_id", "rank", "score")


@query(f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents)
SELECT (SELECT count(*) FROM documents) AS records, (SELECT CAST(coalesce(sum(len(tokens)), 0) AS BIGINT) FROM t) AS tokens, (SELECT count(DISTINCT term) FROM (SELECT unnest(tokens) AS term FROM t)) AS terms,
  (SELECT CAST(coalesce(sum(len(list_distinct(tokens))), 0) AS BIGINT) FROM t) AS postings""")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built anew, and what it has."""
    made = Segments(spark, f"{shared_dir(spark)}/lectern/build-{uuid.uuid4().hex}")
    made.add(chunk_table(spark, sf_dir))
    n, tokens = made.statistics()
    sums = made.frequencies().agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return sums.select(F.lit(n).cast("long").alias("records"), F.lit(tokens).cast("long").alias("tokens"), "terms", "postings")


@query(f"""WITH {CHUNKS_SQL}, heads AS (SELECT chunk_id, lower(concat_ws(' ', title, author, topic, section)) AS hay FROM chunks),
words AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM benchmark)
SELECT term, count(*) AS n, min(chunk_id) AS first FROM words JOIN heads ON contains(hay, term) GROUP BY term""")
def head_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each word of the benchmark, the heads that have it, even within a word."""
    of = corpus(spark, sf_dir, "chunk_id")
    words = read_table(spark, sf_dir, "benchmark").select(F.explode(tokenize(F.col("text"))).alias("term")).distinct()
    about = of._every("documents", of.segments()).select("segment", "ord", "id")
    return of.head_hits(words).join(about, ["segment", "ord"]).groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"""WITH {CHUNKS_SQL}, heads AS (SELECT chunk_id, lower(concat_ws(' ', title, author, topic, section)) AS hay FROM chunks),
typed AS (SELECT item_id AS text_id, lower(trim(substr(text, 1 + item_id % 5, 3 + item_id % 3))) AS term FROM benchmark),
hits AS (SELECT text_id, chunk_id, CASE WHEN starts_with(hay, term) THEN 2 ELSE 1 END AS score FROM typed JOIN heads ON contains(hay, term) WHERE term <> ''),
ranks AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, chunk_id) AS rank FROM hits)
SELECT text_id, CAST(rank AS INT) AS rank, chunk_id, CAST(score AS INT) AS score FROM ranks WHERE rank <= 8""")
def autocomplete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads for many typed texts at once."""
    typed = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("text_id"), F.substring(F.col("text"), (F.col("item_id") % 5 + 1).cast("int"), (F.col("item_id") % 3 + 3).cast("int")).alias("typed")
    )
    return corpus(spark, sf_dir, "chunk_id").complete(typed, 8)


RANKED_SQL = f"""{bm25_sql(terms_sql(VALUES_SQL))},
{CHUNKS_SQL},
heads AS (SELECT chunk_id, lower(concat_ws(' ', title, author, topic, section)) AS hay FROM chunks),
bonus AS (SELECT q.query_id, h.chunk_id, count(*) * 0.6::DOUBLE AS bonus FROM heads h JOIN q ON contains(h.hay, q.term) GROUP BY 1, 2),
people AS (SELECT DISTINCT query_id FROM q WHERE term IN ('researcher','researchers','fellow','fellows','team','people','staff','author','authors','scholar','scholars','director','leadership','founder','founders')),
base AS (SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.doc_id, b.chunk_id) AS chunk_id, s.score AS bm, coalesce(s.score, 0) + coalesce(b.bonus, 0) AS x
  FROM score s FULL JOIN bonus b ON s.query_id = b.query_id AND s.doc_id = b.chunk_id),
adjusted AS (
  SELECT b.query_id, b.chunk_id, c.url, c.ordinal, b.bm IS NOT NULL AS hit,
    b.x * CASE WHEN c.section = 'References' OR len(regexp_extract_all(c.text, '\\[\\^[\\w-]+\\]')) >= 3 OR len(regexp_extract_all(c.text, 'https?://\\S+')) >= 4
      OR len(regexp_extract_all(lower(c.text), 'arxiv|doi|forum\\.effectivealtruism|lesswrong')) >= 3 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN c.category = 'people' AND b.query_id IN (SELECT query_id FROM people) THEN 1.7::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM base b JOIN chunks c ON b.chunk_id = c.chunk_id),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY score DESC, hit DESC, ordinal) AS n FROM (SELECT query_id, chunk_id, url, ordinal, hit, {rounded_sql('score')} AS score FROM adjusted)),
ranks AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit DESC, ordinal) AS INT) AS rank, chunk_id, url, score FROM capped WHERE n <= 2 AND score > 0)"""


@query(f"WITH {RANKED_SQL} SELECT query_id, rank, chunk_id, url, score FROM ranks WHERE rank <= 12")
def bm25_full_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, "chunk_id").ranked(asked(spark), 12)


@query(f"""WITH {RANKED_SQL}
SELECT query_id, '# Search results for: "' || query || '"' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS block FROM (
  SELECT r.query_id, a.query, r.rank, '[' || r.rank || '] ' || c.title || ' · Authors: ' || c.author || coalesce(' · Section: ' || c.section, '') || ' · URL: ' || c.url || chr(10) || chr(10) || c.text AS block
  FROM ranks r JOIN chunks c ON r.chunk_id = c.chunk_id JOIN asked a ON a.query_id = r.query_id WHERE r.rank <= 6) GROUP BY query_id, query""")
def search_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_table(spark, sf_dir)
    found = corpus(spark, sf_dir, "chunk_id").ranked(asked(spark), 6).select("query_id", F.col("rank").alias("marker"), "chunk_id")
    # Six rows a stated query are found: they go to the texts, and no text is shuffled.
    rows = chunks.select("chunk_id", "title", F.array_join("authors", ", ").alias("authors"), "section", "url", "text").join(F.broadcast(found), "chunk_id").join(asked(spark), "query_id")
    return search.formatted_results(rows)


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({tokens_sql('text')})) AS term FROM documents), n AS (SELECT count(*) AS total FROM documents)
SELECT term, count(*) AS df, {rounded_sql('ln(1 + (any_value(total) - count(*) + 0.5) / (count(*) + 0.5))')} AS idf FROM t CROSS JOIN n GROUP BY term""")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies need no index: they are counted where the texts are read."""
    docs = read_table(spark, sf_dir, "documents")
    return index.weighed(index.document_counts(spread(docs.select("text"))), F.lit(docs.count())).withColumn("idf", rounded(F.col("idf")))


@query(f"SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS INT) AS dl, unnest(t) AS term FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)) GROUP BY ALL")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


@query(f"SELECT count(*) AS records, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens, CAST(coalesce(floor(avg(n) + 0.5), 0) AS BIGINT) AS mean_tokens FROM (SELECT len({tokens_sql('text')}) AS n FROM documents)")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(spread(read_table(spark, sf_dir, "documents").select("text")))


@query(r"SELECT lang AS category, count(*) AS records, CAST(sum(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM documents GROUP BY lang")
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.category_totals(read_table(spark, sf_dir, "documents").select("lang", word_count(F.col("text")).alias("words")), "lang")


@query("SELECT name, count(*) AS n FROM (SELECT unnest([source, lang]) AS name FROM documents) GROUP BY name")
def topic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.histogram(read_table(spark, sf_dir, "documents").select(F.array("source", "lang").alias("topics")), "topics")


@query("SELECT lang AS name, count(*) AS n FROM documents WHERE doc_id % 7 NOT IN (0, 1) GROUP BY lang")
def author_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.histogram(chunk_table(spark, sf_dir).where("category = 'research'"), "authors")


@query(f"""WITH {CHUNKS_SQL}
SELECT url, title, [author] AS authors, [topic] AS topics, category FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS n FROM chunks WHERE category <> 'pages') WHERE n = 1""")
def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.Searcher(chunk_table(spark, sf_dir)).catalog()


@query("""SELECT o_orderpriority AS category, string_agg('- ' || o_orderstatus || ' (' || o_orderkey || ')', chr(10) ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS lines FROM orders GROUP BY 1""")
def prompt_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    entries = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("title"), F.col("o_orderkey").cast("string").alias("url"),
        F.to_date("o_orderdate").alias("published"),
    )
    return cat.prompt_lines(entries)


@query("SELECT doc_id AS chunk_id, source AS url, text FROM documents WHERE source = 'src3'")
def chunks_for_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.Searcher(chunk_table(spark, sf_dir)).chunks_for_url("src3").select("chunk_id", "url", "text")


@query("SELECT doc_id AS chunk_id, source AS url, text FROM documents WHERE doc_id = 42")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.Searcher(chunk_table(spark, sf_dir)).get_chunk(42).select("chunk_id", "url", "text")


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, CAST(len(list_distinct(list_filter({tokens_sql('text')}, lambda x: NOT list_contains({STOP_SQL}, x)))) AS INT) AS n FROM documents")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(query_terms(F.col("text"))).alias("n"))


@query(f"""WITH {CHUNKS_SQL}, s AS (SELECT chunk_id AS id, title, CASE WHEN starts_with(lower(title), 'th') THEN 6 WHEN contains(lower(title), 'th') THEN 3 ELSE 0 END
  + 2 * CAST(contains(author, 'th') AS INT) + CAST(contains(topic, 'th') AS INT) AS score FROM chunks WHERE chunk_id NOT IN (SELECT doc_id FROM labels))
SELECT id, title, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 8""")
def mention_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunk_table(spark, sf_dir).withColumnRenamed("chunk_id", "id")
    return cat.suggestions(docs, "th", read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct())


@query("SELECT doc_id, k, CAST(least(10, greatest(1, coalesce(nullif(TRY_CAST(k AS INT), 0), 6))) AS INT) AS used FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE CAST(n_chars % 15 AS VARCHAR) END AS k FROM documents)")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    k = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise((F.col("n_chars") % 15).cast("string"))
    return docs.select("doc_id", k.alias("k"), search.clamped_k(k).alias("used"))
