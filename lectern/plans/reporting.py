"""Queries over reports, sessions' source lines, page records, checked citations and other small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.values import rounded
from ..operators import chunking, citations, fuzzy, ingest, reports, scoring, sessions
from ..sources.shared import spread
from ..sources.tables import read_table
from .analysis import TRACKS, tracks_of
from .citing import CITED_SQL, answers, sources
from .registry import TRIMMED, query, rounded_sql

# Reports

MEAN = "coalesce(mean, 0)"


def places_sql(x: str) -> str:
    return f"(CAST(floor(floor(({x}) * 1000 + 0.5) / 1000) AS BIGINT) || '.' || lpad(CAST(CAST(floor(({x}) * 1000 + 0.5) AS BIGINT) % 1000 AS VARCHAR), 3, '0'))"


def colour_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0.85 THEN 'ok' WHEN {x} >= 0.6 THEN 'warn' ELSE 'bad' END"


RUNS_SQL = f"""{TRACKS}, v AS (SELECT run, track, n, {rounded_sql('mean', 9)} AS mean FROM t),
w AS (SELECT run, CAST(sum(n) AS BIGINT) AS items, coalesce({rounded_sql('sum(mean * n) / nullif(sum(n), 0)', 9)}, 0) AS overall FROM v GROUP BY run)"""


def steady_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with means that are rounded, so that sums in another order print alike."""
    return tracks_of(spark, sf_dir).select("run", "track", "n", rounded(F.col("mean"), 9).alias("mean"))


@query(f"""WITH {RUNS_SQL}, l AS (SELECT run, string_agg('| ' || track || ' | ' || n || ' | **' || {places_sql(MEAN)} || '** |', chr(10) ORDER BY track) AS lines FROM v GROUP BY run)
SELECT run, '# Benchmark' || chr(10) || chr(10) || '**Total items**: ' || items || '  **Overall composite (n-weighted)**: **' || {places_sql('overall')} || '**' || chr(10) || chr(10) || '## Per-track summary' || chr(10) || chr(10)
  || '| Track | n | Composite |' || chr(10) || '|---|---:|---:|' || chr(10) || lines || chr(10) AS page FROM w JOIN l USING (run)""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.markdown_report(steady_tracks(spark, sf_dir), "Benchmark")


ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH {RUNS_SQL}, e AS (SELECT run, '<' || track || ' & ''co"' AS track, n, mean FROM v),
l AS (SELECT run, string_agg('<tr><td>' || {ESCAPED.format('track')} || '</td><td>' || n || '</td><td class=''' || {colour_sql(MEAN)} || '''>' || {places_sql(MEAN)} || '</td></tr>', '' ORDER BY track) AS lines FROM e GROUP BY run)
SELECT run, '<!doctype html><html><head><meta charset=''utf-8''><title>Benchmark</title></head><body><h1>Benchmark</h1><p>Run ' || run || ', items ' || items || ', overall <span class=''' || {colour_sql('overall')} || '''>' || {places_sql('overall')}
  || '</span></p><table>' || lines || '</table></body></html>' AS page FROM w JOIN l USING (run)""")
def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track names get signs that must be escaped."""
    return reports.html_report(steady_tracks(spark, sf_dir).withColumn("track", F.concat(F.lit("<"), "track", F.lit(" & 'co\""))), "Benchmark")


@query("""SELECT '{"key":' || o_orderkey || ',"track":"' || o_orderpriority || '","lines":' || o_orderkey % 7 || ',"share":null}' AS line FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT '{"key":' || o_orderkey || ',"track":"' || o_orderpriority || '","lines":' || o_orderkey % 7 || ',"share":0.5}' FROM orders WHERE o_orderkey % 3 <> 0""")
def dashboard_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are none become null."""
    key = F.col("o_orderkey")
    share = F.when(key % 6 == 0, F.lit(float("nan"))).when(key % 3 == 0, F.lit(float("-inf"))).otherwise(F.lit(0.5))
    rows = read_table(spark, sf_dir, "orders").select(key.alias("key"), F.col("o_orderpriority").alias("track"), (key % 7).alias("lines"), share.alias("share"))
    return reports.dashboard_rows(rows, "share")


@query("SELECT o_orderpriority AS track, max(strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderkey || '.eval') AS name FROM orders GROUP BY 1")
def latest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".eval"))
    return reports.latest_logs(read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("track"), name.alias("name")), "track")


# Sessions

CARD = "marker int, chunk_id string, title string"


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a turn: of four, one blank, one broken, one without a marker and one whole."""
    c = read_table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    whole = F.to_json(F.struct((F.col("conv_id") % 5 - F.col("turn")).cast("int").alias("marker"), F.concat(F.lit("c"), (F.col("turn") % 3).cast("string")).alias("chunk_id"), F.col("role").alias("title")))
    bare = F.to_json(F.struct(F.concat(F.lit("c"), (F.col("turn") % 3).cast("string")).alias("chunk_id"), F.col("role").alias("title")))
    return c.select("conv_id", F.col("turn").alias("line_no"), F.when(k == 1, "  ").when(k == 2, F.concat(F.lit('{"marker": '), "role")).when(k == 3, bare).otherwise(whole).alias("line"))


@query("""WITH j AS (SELECT conv_id, turn AS line_no, CASE WHEN turn % 4 = 3 THEN 0 ELSE CAST(conv_id % 5 - turn AS INT) END AS marker, 'c' || (turn % 3) AS chunk_id, role AS title FROM conversations WHERE turn % 4 NOT IN (1, 2))
SELECT conv_id, line_no, marker, chunk_id, title, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY marker, line_no) - 1 AS INT) AS place FROM j""")
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.source_lines(session_rows(spark, sf_dir), CARD, "conv_id")


@query("""WITH j AS (SELECT conv_id, turn AS line_no, CASE WHEN turn % 4 = 3 THEN 0 ELSE CAST(conv_id % 5 - turn AS INT) END AS marker, 'c' || (turn % 3) AS chunk_id FROM conversations WHERE turn % 4 NOT IN (1, 2))
SELECT conv_id, chunk_id, arg_max(marker, line_no) AS marker, max(max(marker)) OVER (PARTITION BY conv_id) AS last FROM j GROUP BY conv_id, chunk_id""")
def session_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.known_markers(sessions.source_lines(session_rows(spark, sf_dir), CARD, "conv_id"), "conv_id")


@query("""SELECT doc_id, CAST(doc_id % 9 AS INT) AS marker, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [lang] END AS authors, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS snippet,
  CASE doc_id % 5 WHEN 0 THEN 'abstract' WHEN 1 THEN 'body' END AS source FROM documents""")
def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = read_table(spark, sf_dir, "documents").select(
        i, (i % 9).cast("int").alias("marker"), F.when(i % 3 != 0, F.array("lang")).alias("authors"), F.when(i % 4 != 0, F.col("source")).alias("snippet"),
        F.when(i % 5 == 0, "abstract").when(i % 5 == 1, "body").when(i % 5 == 2, "other").alias("source"), F.lit("x").alias("chunk_id"), F.col("text").alias("chunk_text"),
    )
    return sessions.source_cards(rows)


@query("""WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user' DESC, turn DESC, text DESC) AS k FROM conversations) SELECT conv_id, text AS asked FROM r WHERE k = 1""")
def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.asked_last(read_table(spark, sf_dir, "conversations"))


@query("""SELECT doc_id, 0 AS message, 1 AS block, CASE doc_id % 4 WHEN 0 THEN source || ' ' || lang WHEN 1 THEN lang ELSE source END AS asked FROM documents WHERE doc_id % 4 < 3
UNION ALL SELECT doc_id, 2, 0, 'again' FROM documents""")
def message_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a text block, a tool block that searches (quoted in two ways, bare, or another script's), a plain message and one more search."""
    i = F.col("doc_id")
    command = F.when(i % 4 == 0, F.concat(F.lit('bash tools/search.sh "'), "source", F.lit(" "), "lang", F.lit('" --k 3'))).when(i % 4 == 1, F.concat(F.lit("bash ./search.sh '"), "lang", F.lit("'")))
    command = command.when(i % 4 == 2, F.concat(F.lit("cd x && bash search.sh "), "source", F.lit(" -v"))).otherwise("bash other.sh x")
    block = lambda kind, what: F.struct(F.lit(kind).alias("type"), F.struct(what.alias("command")).alias("input"))
    first = F.to_json(F.struct(F.array(block("text", F.lit("bash search.sh no")), block("tool_use", command)).alias("content")))
    last = F.to_json(F.struct(F.array(block("tool_use", F.lit("bash search.sh again"))).alias("content")))
    rows = read_table(spark, sf_dir, "documents").select(i, F.concat(F.lit("["), first, F.lit(',{"content":"bash search.sh plain"},'), last, F.lit("]")).alias("messages"))
    return sessions.message_queries(rows, "doc_id")


# Pages and chunks

@query(r"""WITH p AS (SELECT page_id, url, 'Page ' || page_id AS t FROM pages WHERE page_id % 5 <> 0),
b AS (SELECT page_id, url, t, CASE WHEN page_id % 3 = 0 THEN '' ELSE '# ' || t || chr(10) || chr(10) END || 'Some **bold** words of ' || page_id || chr(10) || chr(10) || 'in' AS body FROM p)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'slug-' || page_id ELSE NULL END AS own_slug, CASE WHEN page_id % 3 = 0 THEN 'Shown & "told" ' || page_id ELSE t END AS title,
  CASE WHEN page_id % 4 = 0 THEN 'A d' || chr(233) || 'scription <of> ' || page_id ELSE CASE WHEN page_id % 3 = 0 THEN '' ELSE t || ' ' END || 'Some bold words of ' || page_id || ' in' END AS description, body,
  CASE WHEN page_id % 3 = 0 THEN 0 ELSE 2 END + 6 AS words FROM b""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with fields, titles and descriptions in meta tags of several spellings; every fifth page's data have no fields."""
    i = F.col("page_id")
    title = F.concat(F.lit("Page "), i.cast("string"))
    sections = F.array(F.struct(F.concat(F.lit(" Some **bold** words of "), i.cast("string")).alias("body"), F.lit("in").alias("intro"), F.lit(None).cast("string").alias("text")))
    fields = F.struct(F.when(i % 3 != 0, title).alias("title"), F.when(i % 2 == 0, F.concat(F.lit("slug-"), i.cast("string"))).alias("slug"), sections.alias("sections"))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(F.when(i % 5 != 0, fields).alias("fields")).alias("page")).alias("pageProps")).alias("props")))
    shown = F.concat(F.lit("<META content='Shown &amp; &quot;told&quot; "), i.cast("string"), F.lit("' data-x=\"content=1\" property='og:title'>"))
    described = F.when(i % 4 == 0, F.concat(F.lit('<meta name="x" property="og:description"\n content="A d&#233;scription &lt;of&#x3e; '), i.cast("string"), F.lit('"/>'))).otherwise("")
    html = F.concat(F.lit("<html><head>"), shown, described, F.lit('</head><script id="__NEXT_DATA__">'), data, F.lit("</script></html>"))
    made = ingest.page_records(read_table(spark, sf_dir, "pages").select(i, "url", html.alias("html")))
    return made.select("page_id", F.when(F.col("slug").startswith("slug-"), F.col("slug")).alias("own_slug"), "title", "description", "body", F.col("wordCount").alias("words"))


@query("SELECT doc_id, sum(len) AS chars FROM (SELECT doc_id, length(unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS len FROM documents) GROUP BY doc_id")
def chunk_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL: its chunks hold all characters of the documents' lines; a text without any has none."""
    spark.udtf.register("chunks", chunking.Chunks)
    spread(read_table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")).createOrReplaceTempView("chunked_documents")
    return spark.sql(rf"""SELECT doc_id, sum(coalesce(length(replace(c.text, '\n\n', '')), 0)) AS chars
FROM chunked_documents, LATERAL chunks(chunked_documents.text, '\\n', '{TRIMMED}', true) AS c GROUP BY doc_id""")


ABSTRACTS = """CASE doc_id % 5 WHEN 0 THEN '  # ' || source || chr(10) || chr(10) || 'short' WHEN 1 THEN '# ' || source || chr(10) || text WHEN 2 THEN substr(text, 1, 100) || ' **Abstract.** ' || text WHEN 3 THEN substr(text, 1, 200) || '**Abstract.**' ELSE text END"""


@query(rf"""WITH x AS (SELECT doc_id, {ABSTRACTS} AS x FROM documents), b AS (SELECT doc_id, x, regexp_replace(x, '^\s+|\s+$', '', 'g') AS b FROM x)
SELECT doc_id, contains(substr(x, 1, 150), '**Abstract.**') OR (regexp_matches(b, '^#\s+\S') AND length(regexp_replace(regexp_replace(b, '^#\s+[^\n]*\n+', ''), '^\s+|\s+$', '', 'g')) < 40) AS abstract FROM b""")
def abstract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{ABSTRACTS.replace('chr(10)', 'char(10)')} AS x").select("doc_id", tx.likely_abstract(F.col("x")).alias("abstract"))


# Citations and scores


@query(f"""WITH {CITED_SQL}, told AS (SELECT output_id, i, CASE (output_id + i) % 3 WHEN 0 THEN 'real_but_unsupportive' ELSE 'valid' END AS verdict FROM (SELECT DISTINCT output_id, unnest([0, 1, 2, 50]) AS i FROM cited))
SELECT c.output_id, CAST(c.idx AS INT) AS idx, c.url, c.title, 'why ' || c.idx AS rationale FROM cited c JOIN told k ON k.output_id = c.output_id AND k.i = c.idx WHERE k.verdict = 'real_but_unsupportive'""")
def unsupportive_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by position: of the first three places and of one that no answer has."""
    made = citations.extract_citations(answers(spark, sf_dir), sources(spark, sf_dir))
    i = F.col("citation_index")
    told = made.select("output_id").distinct().withColumn("citation_index", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 50)])))
    told = told.select("output_id", "citation_index", F.when((F.col("output_id") + i) % 3 == 0, "real_but_unsupportive").otherwise("valid").alias("verdict"), F.concat(F.lit("why "), i.cast("string")).alias("rationale"))
    return citations.checked_citations(made, told).select("output_id", "idx", "url", "title", "rationale")


@query("SELECT doc_id, '[Source ' || doc_id % 9 || '] ' || CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END || ' (' || source || ')' || chr(10) || text AS block FROM documents")
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return read_table(spark, sf_dir, "documents").select("doc_id", citations.evidence_block(F.col("doc_id") % 9, title, F.col("source"), F.col("text")).alias("block"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN doc_id % 5 <> 0 THEN CASE WHEN starts_with(text, 'T') THEN 1.0::DOUBLE WHEN contains(text, 'th') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS score FROM documents""")
def correctness_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric items need a target, verbal ones phrasings; scores come from the texts."""
    i, text = F.col("doc_id"), F.col("text")
    numeric = F.when(text.rlike("[0-9]"), 1.0).otherwise(0.0)
    verdict = F.when(text.startswith("T"), "MATCH").when(text.contains("th"), "PARTIAL").otherwise("MISS")
    kind, target = F.when(i % 3 == 0, "numeric").otherwise("verbal"), F.when(i % 2 == 0, F.lit(0.5))
    phrasings = F.when(i % 5 != 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    return read_table(spark, sf_dir, "documents").select("doc_id", scoring.correctness(kind, target, numeric, phrasings, verdict).alias("score"))


BARE = r"regexp_replace(html, '<[^>]*>', ' ', 'g')"


@query(rf"""WITH c AS (SELECT page_id, url, {BARE} AS t FROM pages),
k AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://other.example/' || page_id ELSE url END AS cited, CASE page_id % 5 WHEN 0 THEN 'no page holds this sentence, of words that none has' WHEN 1 THEN ' ' ELSE substr(t, 60, 120) END AS passage,
  CASE WHEN page_id % 11 = 0 THEN '' ELSE 'claim' END AS claim, CASE page_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'partially' ELSE 'no' END AS judged FROM c),
d AS (SELECT *, cited <> '' AND page_id % 7 <> 1 AS known, trim(passage) <> '' AS has FROM k)
SELECT page_id AS item_id, CASE WHEN NOT known OR (has AND page_id % 5 = 0) THEN 'fabricated' WHEN claim = '' THEN 'partial' WHEN judged = 'SUPPORTED' THEN 'valid' WHEN judged = 'partially' THEN 'partial' ELSE 'real_but_unsupportive' END AS verdict,
  known AND NOT (has AND page_id % 5 = 0) AS found, CASE WHEN known AND has AND page_id % 5 <> 0 THEN 1.0::DOUBLE END AS score FROM d""")
def citation_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of pages, checked against the pages: own passages, ones that no page has, none, unknown urls and none."""
    i = F.col("page_id")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    cited = F.when(i % 7 == 0, "").when(i % 7 == 1, F.concat(F.lit("https://other.example/"), i.cast("string"))).otherwise(F.col("url"))
    passage = F.when(i % 5 == 0, "no page holds this sentence, of words that none has").when(i % 5 == 1, " ").otherwise(F.substring("text", 60, 120))
    judged = F.when(i % 3 == 0, "SUPPORTED").when(i % 3 == 1, "partially").otherwise("no")
    asked = pages.select(i.alias("item_id"), cited.alias("url"), passage.alias("passage"), F.when(i % 11 == 0, "").otherwise("claim").alias("claim"), judged.alias("judged"))
    return fuzzy.check_citations(asked, pages.select("url", "text")).withColumn("score", rounded(F.col("score")))
