"""Queries over text, markdown, url and value macros. Markdown, marks and fences are put round the documents' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls, values
from ..sources.tables import read_table, sitemap_urls
from .registry import query, rounded_sql


def docs_with(spark: SparkSession, sf_dir: str, made: str) -> DataFrame:
    """(doc_id, x): ``made`` is an expression that Spark and DuckDB read alike."""
    return read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{made} AS x")


MARKDOWN = """concat('## ', lang, chr(10), chr(10), '> ', text, ' [label](http://a.b/c) ![pic](p.png) `code` ', '[^', CAST(doc_id % 9 AS VARCHAR(9)), '] **bold** ', chr(10), '```', chr(10), source, chr(10), '```', chr(10), '~end~ #')"""
PROSE = """concat(text, ' [', CAST(doc_id % 5 + 1 AS VARCHAR(9)), ']. Next ', lang, ' [', CAST(doc_id % 3 + 1 AS VARCHAR(9)), ', ', CAST(doc_id % 4 + 2 AS VARCHAR(9)), ']. Last [9] [9]! No mark? ')"""


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?s)```.*?```', ' ', 'g'), '`[^`\n]+`', ' ', 'g'),
  '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\[\^[^\]]+\]', '', 'g'), '[#>*_~]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM (SELECT doc_id, {MARKDOWN} AS x FROM documents)""")
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, MARKDOWN).select("doc_id", tx.strip_markdown(F.col("x")).alias("plain"))


CMS = """concat('  :inline-graphic{a=1}', text, chr(13), chr(10), '   ', chr(10), chr(10), chr(10), chr(10), lang, ':inline-quote{b}', chr(10))"""


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(x, ':inline-(?:graphic|quote)\{{[^}}]*\}}', '', 'g'), '(?m)^[ \t]+$', '', 'g'), chr(13) || chr(10), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean
FROM (SELECT doc_id, {CMS} AS x FROM documents)""")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, CMS).select("doc_id", tx.clean_markdown(F.col("x")).alias("clean"))


def preview_sql(x: str) -> str:
    """The steps of a preview for an engine without back-references: both kinds of marks are spelt out."""
    both = {r"(\*\*|__)(.*?)\1": (r"\*\*(.*?)\*\*|__(.*?)__", r"\1\2"), r"(\*|_)(.*?)\1": (r"\*(.*?)\*|_(.*?)_", r"\1\2")}
    for pattern, put in tx.PREVIEW:
        pattern, put = both.get(pattern, (pattern, put.replace("$", "\\")))
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return rf"coalesce(trim(regexp_replace({x}, '\s+', ' ', 'g')), '')"


LISTED = """concat('- ', lang, chr(10), '1. __', source, '__ and *', lang, '* ~~old~~ a', chr(92), '*b', chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '> ', text, chr(10), '***', chr(10), '## ', source, ' ![cut](http')"""


@query(f"SELECT doc_id, {preview_sql('x')} AS preview, {preview_sql('y')} AS listed FROM (SELECT doc_id, {MARKDOWN} AS x, {LISTED} AS y FROM documents)")
def clean_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{MARKDOWN} AS x", f"{LISTED} AS y")
    return made.select("doc_id", tx.clean_snippet(F.col("x")).alias("preview"), tx.clean_snippet(F.col("y")).alias("listed"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents), w AS (SELECT doc_id, x, substr(x, 1, 360) AS w FROM f),
c AS (SELECT doc_id, x, w, CASE WHEN instr(reverse(w), ' .') > 0 THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END AS last FROM w)
SELECT doc_id, CASE WHEN length(x) <= 280 THEN x WHEN last > 200 AND last < 360 THEN substr(w, 1, last + 1) ELSE rtrim(substr(x, 1, 280)) || '…' END AS snippet FROM c""")
def snippet_280(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(rf"""SELECT doc_id, list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s) <> '') AS sentences FROM (SELECT doc_id, {PROSE} AS x FROM documents)""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, PROSE).select("doc_id", tx.sentences(F.col("x")).alias("sentences"))


@query(rf"""SELECT doc_id, list_transform(flatten(list_transform(regexp_extract_all(x, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split_regex(g, '\s*,\s*'))), lambda v: CAST(v AS INT)) AS markers FROM (SELECT doc_id, {PROSE} AS x FROM documents)""")
def marker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, PROSE).select("doc_id", tx.markers_in(F.col("x")).alias("markers"))


@query(rf"""SELECT doc_id, trim(regexp_replace(x, '\s*\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g')) AS bare FROM (SELECT doc_id, {PROSE} AS x FROM documents)""")
def marker_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, PROSE).select("doc_id", tx.strip_markers(F.col("x")).alias("bare"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS INT) AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tx.iso_date(made).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%b %Y') END AS shown FROM orders")
def month_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tx.month_year(made).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 199) || '...' END AS short FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 200).alias("short"))


FENCED = """CASE WHEN doc_id % 3 = 0 THEN concat('```json', chr(10), text, chr(10), '```') WHEN doc_id % 3 = 1 THEN concat('``` ', text, '```') ELSE text END"""


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(trim(x), '^```[A-Za-z]*\s*\n?', ''), '\n?\s*```$', '')) AS bare FROM (SELECT doc_id, {FENCED} AS x FROM documents)")
def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, FENCED).select("doc_id", tx.strip_code_fence(F.col("x")).alias("bare"))


COMMAND = """CASE WHEN doc_id % 2 = 0 THEN concat('bench search "', source, ' ', lang, '" --k 5') ELSE concat('bench search ', source, ' --k 5') END"""


@query(rf"SELECT doc_id, coalesce(nullif(regexp_extract(x, 'search\s+\"([^\"]*)\"', 1), ''), nullif(regexp_extract(x, 'search\s+([^\s\"-]\S*)', 1), '')) AS asked FROM (SELECT doc_id, {COMMAND} AS x FROM documents)")
def command_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search words of a shell command, quoted or bare."""
    x = F.col("x")
    quoted, bare = F.regexp_extract(x, r'search\s+"([^"]*)"', 1), F.regexp_extract(x, r'search\s+([^\s"-]\S*)', 1)
    return docs_with(spark, sf_dir, COMMAND).select("doc_id", F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit(""))).alias("asked"))


PERCENT = """concat('About ', CAST(doc_id % 97 AS VARCHAR(9)), '% of ', text, ' and 12% more')"""


@query(f"""WITH m AS (SELECT doc_id, text, doc_id % 97 AS v, CAST((doc_id % 97 + 37) % 95 AS BIGINT) AS m FROM documents), n AS (SELECT doc_id, text, CASE WHEN m = v THEN m + 7 ELSE m END AS m FROM m)
SELECT doc_id, 'About ' || CASE WHEN m = 0 THEN 13 ELSE m END || '% of ' || text || ' and 12% more' AS changed FROM n""")
def mutate_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, PERCENT).select("doc_id", tx.percent_shifted(F.col("x")).alias("changed"))


@query("SELECT doc_id, rtrim(text) || ' A later survey of 4,000 experts confirmed this.' AS changed FROM documents")
def mutate_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.rtrim("text"), F.lit(" A later survey of 4,000 experts confirmed this.")).alias("changed"))


# Urls

HOSTS = ["tionsh.example.net", "blog.tionble.example.com", "m.tiontion.example.com", "therha.example.com"]
SITE = """concat(regexp_extract(url, '^[a-z]+://[^/?#]*', 0), CASE page_id % 8 WHEN 0 THEN '/' WHEN 1 THEN '/research/' WHEN 2 THEN '/research' WHEN 3 THEN '/people/ann-lee/' WHEN 4 THEN '/donate' WHEN 5 THEN '/research/a/b?x=1' WHEN 6 THEN '/about#top' ELSE '' END)"""
HOST_SQL = "regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)"
PATH_SQL = "regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
OURS = "[" + ", ".join(f"'{h}'" for h in HOSTS) + "]"


def site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").selectExpr("page_id", f"{SITE} AS u", "url")


@query(f"""SELECT page_id, u, CASE WHEN NOT list_contains({OURS}, h) THEN NULL WHEN starts_with(p, '/research/') THEN 'research' WHEN starts_with(p, '/people/') THEN 'people' WHEN p IN ('/donate') THEN NULL
  WHEN p IN ('/', '', '/about', '/careers', '/research') THEN 'pages' END AS category FROM (SELECT page_id, u, {HOST_SQL} AS h, {PATH_SQL} AS p FROM (SELECT page_id, {SITE} AS u FROM pages))""")
def url_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_urls(spark, sf_dir).select("page_id", "u", urls.category(F.col("u"), HOSTS).alias("category"))


@query(f"""SELECT page_id, CASE WHEN b = '' THEN 'home' ELSE replace(b, '/', '__') END AS slug FROM (SELECT page_id, regexp_replace({PATH_SQL}, '^/+|/+$', '', 'g') AS b FROM (SELECT page_id, {SITE} AS u FROM pages))""")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_urls(spark, sf_dir).select("page_id", urls.slug(F.col("u")).alias("slug"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '/+$', ''), '#.*$', ''), '/+$', '') AS key FROM pages")
def url_canon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", urls.lookup_key(F.col("url")).alias("key"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')) AS key FROM pages")
def url_canon_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", urls.recall_key(F.col("url")).alias("key"))


@query(f"""WITH p AS (SELECT page_id, {HOST_SQL} AS h, list_filter(string_split({PATH_SQL}, '/'), lambda s: s <> '') AS s FROM (SELECT page_id, {SITE} AS u FROM pages)),
k AS (SELECT page_id, CASE WHEN NOT list_contains({OURS}, h) THEN NULL WHEN len(s) = 0 THEN 'pages' WHEN s[1] IN ('research', 'people') AND len(s) > 1 THEN s[1] WHEN len(s) = 1 THEN 'pages' END AS category,
  CASE WHEN len(s) = 0 THEN 'index' WHEN s[1] IN ('research', 'people') AND len(s) > 1 THEN s[2] WHEN len(s) = 1 THEN s[1] END AS name FROM p)
SELECT page_id, category, CASE WHEN category IS NOT NULL THEN '/article/' || category || '/' || name END AS path FROM k""")
def url_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = site_urls(spark, sf_dir).select("page_id", urls.route(F.col("u"), HOSTS).alias("r"))
    return made.select("page_id", "r.category", "r.path")


@query(r"""WITH f AS (SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) >= 8 THEN '?cite=' || replace(replace(replace(replace(replace(url_encode(x), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') END AS cite FROM f""")
def cite_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", urls.cite_parameter(F.col("text")).alias("cite"))


@query("SELECT url, count(*) AS n FROM pages GROUP BY url")
def sitemap_urls_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each url of a sitemap that is made of the pages' urls, one line a page."""
    lines = read_table(spark, sf_dir, "pages").select(F.col("url").alias("u"), F.concat(F.lit("<url><loc>"), F.col("url"), F.lit("</loc></url>")).alias("value"))
    return sitemap_urls(lines).join(lines.groupBy(F.col("u").alias("url")).agg(F.count("*").alias("n")), "url").select("url", "n")


# Values


LOOSE = """CASE doc_id % 4 WHEN 0 THEN concat('{"score": ', CAST(doc_id AS VARCHAR(20)), '}') WHEN 1 THEN concat('```json', chr(10), '{"score": 0.5}', chr(10), '```') WHEN 2 THEN concat('Sure. {"score": 7, "why": "', lang, '"} Bye') ELSE text END"""


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '0.5' WHEN 2 THEN '7' END AS score FROM documents""")
def json_loose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_with(spark, sf_dir, LOOSE).select("doc_id", F.get_json_object(values.loose_json(F.col("x")), "$.score").alias("score"))


NUMBERS = """CASE WHEN doc_id % 5 = 0 THEN lang WHEN doc_id % 5 = 1 THEN CAST(doc_id % 13 / 12.0 AS VARCHAR(30)) ELSE CAST(doc_id % 9 - 2 AS VARCHAR(9)) END"""


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN value BETWEEN 0 AND 1 THEN value END AS confidence FROM events")
def confidence_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return read_table(spark, sf_dir, "events").select("event_id", values.confidence(made).alias("confidence"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN props ELSE event_type END AS message FROM events""")
def error_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.to_json(F.struct(F.struct(F.col("event_type").alias("message")).alias("error")))
    nested = F.to_json(F.struct(F.struct(plain.alias("message")).alias("error")))
    made = F.when(F.col("event_id") % 3 == 0, plain).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(nested)
    return read_table(spark, sf_dir, "events").select("event_id", values.inner_error(made).alias("message"))


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE {rounded_sql('value', 4)} END AS x FROM events")
def finite_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("event_id") % 8 == 0, float("nan")).when(F.col("event_id") % 4 == 0, float("inf")).otherwise(F.col("value"))
    return read_table(spark, sf_dir, "events").select("event_id", values.finite_rounded(made).alias("x"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x FROM events")
def safe_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return read_table(spark, sf_dir, "events").select("event_id", values.safe_float(made).alias("x"))


@query("""SELECT user_id, greatest(0::DOUBLE, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) AS seconds FROM events GROUP BY user_id""")
def wall_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("user_id", values.wall_seconds(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("seconds"))


@query("""WITH x AS (SELECT event_id, ts, epoch_us(TIMESTAMP '2024-01-30 12:00:00') / 1e6 - epoch_us(ts) / 1e6 AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600 + 0.5) AS BIGINT) || 'h ago'
  WHEN s < 2592000 THEN CAST(floor(s / 86400 + 0.5) AS BIGINT) || 'd ago' ELSE day(ts) || ' ' || strftime(ts, '%b') END AS age FROM x""")
def chat_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return read_table(spark, sf_dir, "events").select("event_id", values.age_text(F.col("ts").cast("timestamp"), now).alias("age"))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE least(5, greatest(1, CASE WHEN n_chars % 14 / 2.0 - floor(n_chars % 14 / 2.0) = 0.5 AND CAST(floor(n_chars % 14 / 2.0) AS BIGINT) % 2 = 0 THEN floor(n_chars % 14 / 2.0) ELSE floor(n_chars % 14 / 2.0 + 0.5) END)) END AS INT) AS grade FROM documents")
def open_research_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise((F.col("n_chars") % 14 / 2).cast("string"))
    return read_table(spark, sf_dir, "documents").select("doc_id", values.clamped_grade(made).alias("grade"))
