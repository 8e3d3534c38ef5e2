"""Queries over pages and chunking. Embedded JSON is put round the pages' own words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, ingest
from ..sources.pages import PageStore
from ..sources.shared import shared_dir, spread
from ..sources.tables import read_table
from ..streaming.jobs import tumbling
from .registry import TRIMMED, query, tokens_sql


DECODED = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&')"
HEAD_SQL, TITLE_SQL = (DECODED.format(f"regexp_extract(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1)") for tag in ("h1", "title"))


@query(f"SELECT page_id, {TITLE_SQL} AS title, '' AS description, {HEAD_SQL} AS heading FROM pages")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", ingest.page_meta(F.col("html")).alias("m")).select("page_id", "m.*")


@query("""SELECT url || '#' || page_id AS url, CASE WHEN page_id % 5 = 0 THEN 2 WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS batch, page_id % 5 <> 0 OR page_id % 2 = 0 AS changed,
  CAST(length(html) + CASE WHEN page_id % 10 = 0 THEN 4 ELSE 0 END AS BIGINT) AS n_chars FROM pages WHERE url IS NOT NULL AND html IS NOT NULL""")
def page_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site is read in two runs, the second of what the first lacks, and a fifth of it is read anew, half of that changed."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html")
    store = PageStore(spark, f"{shared_dir(spark)}/lectern/pages-{uuid.uuid4().hex}")
    store.put(pages.where("page_id % 3 <> 0"), 0)
    store.put(pages.join(store.missing(pages.select("url")), "url", "left_semi"), 1)
    store.put(pages.where("page_id % 5 = 0").withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit(" new"))).otherwise(F.col("html"))), 2)
    return store.urls().join(store.pages(), "url").select("url", "batch", "changed", F.length("html").cast("long").alias("n_chars"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a data script made of their own title, heading and url; every fifth one's is broken, every seventh has none."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"(?s)<title[^>]*>(.*?)</title>", 1).alias("t"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("h"))
    i = F.col("page_id")
    named = lambda name, slug: F.struct(name.alias("name"), slug.alias("slug"))
    part = lambda k: F.struct(F.concat(F.lit(f"part-{k}-"), i).alias("slug"), F.when((i + k) % 4 != 0, F.col("h")).alias("title"), (i % 3 == k).alias("isCurrent"))
    page = F.struct(
        F.col("t").alias("title"), F.concat(F.lit("## "), "h").alias("body"), F.lit("2024-05-06T07:08:09Z").alias("publishedAt"),
        F.array(named(F.concat(F.lit(" Ann "), i % 9), F.lit("ann")), named(F.lit("  "), F.lit("x")), named(F.when(i % 2 == 0, "Bo"), F.lit(None).cast("string"))).alias("authors"),
        F.array(F.lit(" b "), F.lit("a"), F.lit("b"), F.lit("")).alias("topics"),
        F.array(F.struct(F.lit(" one ").alias("body"), F.lit("").alias("intro"), F.col("t").alias("text")), F.struct(F.lit(None).cast("string").alias("body"), F.lit("in").alias("intro"), F.lit(None).cast("string").alias("text"))).alias("sections"),
        F.when(i % 2 == 0, F.struct(F.lit("Series").alias("name"), F.array(part(0), part(1), part(2)).alias("parts"), F.struct((i % 3 + 1).cast("int").alias("currentIndex")).alias("nav"))).alias("series"),
    )
    data = F.to_json(F.struct(F.struct(F.struct(page.alias("page")).alias("pageProps")).alias("props")))
    data = F.when(i % 5 == 0, F.substring(data, 1, 40)).otherwise(data)
    script = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script></html>"))
    return pages.select("page_id", "url", F.when(i % 7 == 0, F.lit("<html></html>")).otherwise(script).alias("html"), "t", "h")


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0)
SELECT page_id, url, trim(t) AS title, CASE WHEN page_id % 2 = 0 THEN ['Ann ' || page_id % 9, 'Bo'] ELSE ['Ann ' || page_id % 9] END AS authors, ['b', 'a'] AS topics, '2024-05-06' AS published,
  CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 3 AS INT) END AS current,
  CASE WHEN page_id % 2 = 0 THEN CAST(3 - ((page_id % 4 = 0)::INT + ((page_id + 1) % 4 = 0)::INT + ((page_id + 2) % 4 = 0)::INT) AS INT) END AS parts,
  rtrim('## ' || h) || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || trim(t) || chr(10) || chr(10) || 'in' AS body FROM p""")
def cms_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ingest.records(site_pages(spark, sf_dir))
    return made.select("page_id", "url", "title", F.transform("authors", lambda a: a["name"]).alias("authors"), "topics", F.col("publishedAt").alias("published"), F.col("series.currentIndex").alias("current"), F.col("series.totalParts").alias("parts"), "body")


PLAIN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'),
  '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\[\^[^\]]+\]', '', 'g'), '[#>*_~]', ' ', 'g'), '\s+', ' ', 'g'))"""
# A paragraph a step, of all documents at once. ``c`` is the chunk that a paragraph joins; what ends a chunk, before the paragraph (b) or with it (a), gives that chunk's section and source.
CHUNKER_SQL = rf"""WITH RECURSIVE e AS (SELECT doc_id, text, '# ' || source || chr(10) || '## ' || lang || chr(10) || text AS body FROM documents),
d AS (SELECT doc_id, CASE WHEN length(body) > 50 THEN body ELSE text END AS body FROM e),
l AS (SELECT doc_id, contains(body, '**Abstract.**') AS has, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM d),
w AS (
  SELECT doc_id, ps, 0 AS i, 0 AS c, 0 AS chars, NULL::VARCHAR AS section, false AS titled, CASE WHEN has THEN 'abstract' ELSE 'body' END AS source,
    '' AS p, 0 AS bc, NULL::VARCHAR AS bsection, '' AS bsource, false AS b, false AS a, 0 AS pc FROM l
  UNION ALL
  SELECT doc_id, ps, i, CASE WHEN NOT heading AND held + length(p) >= 800 THEN c2 + 1 ELSE c2 END, CASE WHEN NOT heading AND held + length(p) >= 800 THEN 0 ELSE held + length(p) END,
    section2, titled OR heading, CASE WHEN heading AND titled THEN 'body' ELSE source END, p, c, section2, source, b, NOT heading AND held + length(p) >= 800, c2
  FROM (SELECT *, CASE WHEN b THEN c + 1 ELSE c END AS c2, CASE WHEN b THEN 0 ELSE chars END AS held FROM (
    SELECT doc_id, ps, i + 1 AS i, c, chars, titled, source, ps[i + 1] AS p, regexp_matches(ps[i + 1], '^#{{1,6}}[^\S\n]+\S.*$') AS heading,
      CASE WHEN regexp_matches(ps[i + 1], '^#{{2,3}}[^\S\n]+\S.*$') THEN regexp_replace(ps[i + 1], '^#+\s+', '') ELSE section END AS section2,
      chars > 0 AND (regexp_matches(ps[i + 1], '^#{{1,6}}[^\S\n]+\S.*$') OR chars + length(ps[i + 1]) > 1400) AS b
    FROM w WHERE i < len(ps)))),
ends AS (
  SELECT doc_id, bc AS c, bsection AS section, bsource AS source FROM w WHERE b
  UNION ALL SELECT doc_id, pc, section, source FROM w WHERE a
  UNION ALL SELECT doc_id, c, section, source FROM w WHERE i = len(ps) AND chars > 0),
t AS (SELECT doc_id, pc AS c, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM w WHERE i > 0 GROUP BY doc_id, pc)
SELECT doc_id, CAST(c AS INT) AS ordinal, section, source, text, {tokens_sql(PLAIN_SQL.format('text'))} AS tokens FROM t JOIN ends USING (doc_id, c)"""


@query(CHUNKER_SQL)
def chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents along their lines, under two headings."""
    docs = spread(read_table(spark, sf_dir, "documents").withColumn("body", F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text")))
    return chunking.chunk_documents(docs, "doc_id", separator=r"\n")


@query("SELECT doc_id, sum(len) AS chars FROM (SELECT doc_id, length(unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS len FROM documents) GROUP BY doc_id")
def chunked_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document's chunks without their joints: none are lost, none are doubled; a text without any has none."""
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("body", F.col("text"))
    chunks = chunking.chunk_documents(docs, "doc_id", separator=r"\n", blanks=TRIMMED, outer=True)
    return chunks.groupBy("doc_id").agg(F.sum(F.coalesce(F.length(F.replace("text", F.lit("\n\n"), F.lit(""))), F.lit(0))).alias("chars"))


@query("SELECT event_type, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total, date_trunc('day', ts) AS day FROM events GROUP BY event_type, date_trunc('day', ts)")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day, as the streaming job keeps them."""
    w = tumbling(read_table(spark, sf_dir, "events"), "1 day")
    return w.select("event_type", "n", (F.floor(F.col("total") * 1e4 + 0.5) / 1e4).alias("total"), F.col("window.start").alias("day"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")
