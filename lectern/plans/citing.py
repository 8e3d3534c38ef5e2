"""Queries over citations and passages. Answers and sources are made of the documents' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.values import rounded
from ..operators import citations as cit
from ..operators import fuzzy
from ..sources.shared import spread
from ..sources.tables import read_table
from .registry import query, rounded_sql
from .texts import PROSE

SENTENCES_SQL = r"list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: trim(s) <> '')"
WALK_SQL = rf"""a AS (SELECT doc_id AS output_id, {PROSE} AS x FROM documents),
p AS (SELECT output_id, i AS s, ss[i] AS sentence FROM (SELECT output_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT output_id, {SENTENCES_SQL} AS ss FROM a))),
q AS (SELECT output_id, s, trim(regexp_replace(sentence, '\s*\[(\d+(?:\s*,\s*\d+)*)\]', '', 'g')) AS claim,
  flatten(list_transform(regexp_extract_all(sentence, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split_regex(g, '\s*,\s*'))) AS ms FROM p),
k AS (SELECT output_id, s, claim, j AS m, CAST(ms[j] AS INT) AS marker FROM (SELECT output_id, s, claim, ms, unnest(range(1, len(ms) + 1)) AS j FROM q WHERE claim <> '')),
walk AS (SELECT output_id, row_number() OVER (PARTITION BY output_id ORDER BY s, m) - 1 AS place, claim, marker FROM k)"""
SOURCES_SQL = """src AS (SELECT doc_id AS output_id, m AS marker, 'https://' || source || '.example/' || m AS url, lang || ' ' || m AS title, substr(text, 1, 40) AS snippet,
  CASE WHEN m % 2 = 0 THEN substr(text, 1, 80) ELSE '' END AS chunk_text FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS m FROM documents) WHERE m <> doc_id % 6)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").selectExpr("doc_id AS output_id", f"{PROSE} AS answer"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources a document, one of which is missing, and each twice: the later one counts."""
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.withColumn("marker", F.explode(F.sequence(F.lit(1), F.lit(5)))).where(F.col("marker") != F.col("doc_id") % 6).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return rows.select(
        F.col("doc_id").alias("output_id"), "marker", "seq", F.concat(F.lit("https://"), "source", F.lit(".example/"), "marker").alias("url"),
        F.when(F.col("seq") == 1, F.concat_ws(" ", "lang", "marker")).otherwise("old").alias("title"), F.substring("text", 1, 40).alias("snippet"),
        F.when(F.col("marker") % 2 == 0, F.substring("text", 1, 80)).otherwise("").alias("chunk_text"),
    )


@query(f"WITH {WALK_SQL} SELECT output_id, CAST(place AS INT) AS place, claim, marker FROM walk")
def marker_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cit.marker_walk(answers(spark, sf_dir))


CITED_SQL = f"""{WALK_SQL},
{SOURCES_SQL},
first AS (SELECT output_id, claim, marker, min(place) AS place FROM walk GROUP BY ALL),
cited AS (SELECT f.output_id, row_number() OVER (PARTITION BY f.output_id ORDER BY place) - 1 AS idx, f.marker, s.url, s.title, coalesce(nullif(s.chunk_text, ''), s.snippet) AS passage, f.claim
  FROM first f JOIN src s ON f.output_id = s.output_id AND f.marker = s.marker)"""


@query(f"WITH {CITED_SQL} SELECT output_id, CAST(idx AS INT) AS idx, marker, url, title, passage, claim FROM cited")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cit.extract_citations(answers(spark, sf_dir), sources(spark, sf_dir))


@query(rf"""WITH a AS (SELECT doc_id AS output_id, {PROSE} AS x FROM documents), {SOURCES_SQL},
m AS (SELECT output_id, CAST(unnest(list_distinct(regexp_extract_all(x, '\[(\d+)\]', 1))) AS INT) AS marker FROM a)
SELECT m.output_id, m.marker, s.url, coalesce(s.chunk_text, s.snippet) AS passage FROM m JOIN src s ON m.output_id = s.output_id AND m.marker = s.marker""")
def citation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cit.fallback_citations(answers(spark, sf_dir), sources(spark, sf_dir))


@query(f"""WITH {CITED_SQL} SELECT output_id, CAST(idx AS INT) AS idx, CASE WHEN idx = 0 AND output_id % 2 = 0 THEN 'refined ' || output_id ELSE claim END AS claim FROM cited""")
def claim_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined claims for the first citation; those of odd outputs don't fit the count of citations and change nothing."""
    made = cit.extract_citations(answers(spark, sf_dir), sources(spark, sf_dir))
    counts = made.groupBy("output_id").agg(F.count("*").alias("have"))
    told = counts.select(
        "output_id", F.lit(0).alias("idx"), F.concat(F.lit(" refined "), "output_id").alias("supports"), F.lit(0).alias("ord"), (F.col("have") + F.col("output_id") % 2).alias("walked")
    )
    blank = counts.select("output_id", F.lit(1).alias("idx"), F.lit("  ").alias("supports"), F.lit(0).alias("ord"), F.col("have").alias("walked"))
    return cit.refined_claims(made, told.union(blank)).select("output_id", "idx", "claim")


@query(rf"""WITH a AS (SELECT doc_id AS output_id, {PROSE} AS x FROM documents),
m AS (SELECT output_id, flatten(list_transform(regexp_extract_all(x, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split_regex(g, '\s*,\s*'))) AS ms FROM a),
k AS (SELECT output_id, CAST(ms[j] AS INT) AS marker, min(j) AS place FROM (SELECT output_id, ms, unnest(range(1, len(ms) + 1)) AS j FROM m) GROUP BY 1, 2)
SELECT output_id, marker, CAST(row_number() OVER (PARTITION BY output_id ORDER BY place) AS INT) AS shown FROM k""")
def display_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cit.display_numbers(answers(spark, sf_dir))


@query(rf"""WITH a AS (SELECT doc_id AS output_id, {PROSE} AS x FROM documents), {SOURCES_SQL},
m AS (SELECT DISTINCT output_id, CAST(unnest(flatten(list_transform(regexp_extract_all(x, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split_regex(g, '\s*,\s*')))) AS INT) AS marker FROM a)
SELECT s.output_id, s.marker, s.url FROM src s JOIN m ON s.output_id = m.output_id AND s.marker = m.marker""")
def cited_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cit.cited_only(cit.last_sources(sources(spark, sf_dir)), answers(spark, sf_dir)).select("output_id", "marker", "url")


@query("SELECT b.item_id AS passage_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return cit.exact_passages(passages, read_table(spark, sf_dir, "documents"))


@query("SELECT b.item_id, min(d.doc_id) AS doc_id, count(d.doc_id) AS found, count(d.doc_id) > 0 AS verified FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def item_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the documents that hold their passage word for word."""
    items = read_table(spark, sf_dir, "benchmark")
    hits = cit.exact_passages(items.select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")), read_table(spark, sf_dir, "documents"))
    hits = hits.groupBy(F.col("passage_id").alias("item_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("found"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", "doc_id", F.coalesce("found", F.lit(0)).alias("found"), F.col("found").isNotNull().alias("verified"))


@query()
def item_verify_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages cut from pages' text with words left out, each against the page it cites, at 0.65; without SQL, tests align by brute force."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    kind = F.col("page_id") % 4
    url = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat("url", F.lit("#part"))).when(kind == 2, F.concat(F.lit("https://other.example/"), "page_id")).otherwise(F.concat("url", F.lit("/")))
    worn = F.array_join(F.filter(F.split(F.substring("text", 50, 200), " "), lambda w, i: i % 9 != 4), " ")
    passage = F.when(F.col("page_id") % 5 == 0, F.lit("no page holds this sentence, of words that none has")).otherwise(worn)
    checked = fuzzy.verify_passages(pages.select(F.col("page_id").alias("item_id"), url.alias("url"), passage.alias("passage")), pages.select("url", "text"), 0.65)
    return checked.withColumn("score", rounded(F.col("score")))


@query()
def passage_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages with words left out, in documents; without SQL, tests align by brute force."""
    items = read_table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    worn = F.array_join(F.filter(words, lambda w, i: i % 9 != 4), " ")
    scored = fuzzy.fuzzy_passages(items.select(F.col("item_id").alias("passage_id"), worn.alias("passage")), read_table(spark, sf_dir, "documents"))
    return scored.withColumn("score", rounded(F.col("score")))


@query()
def passage_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.best_records(passage_fuzzy(spark, sf_dir))


@query(f"""WITH c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '#part' WHEN 2 THEN 'https://other.example/' || page_id ELSE ' ' || url || '/' END AS url FROM pages),
k AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(trim(url), '/+$', ''), '#.*$', ''), '/+$', '') AS key FROM c), u AS (SELECT DISTINCT url FROM pages)
SELECT k.page_id, coalesce(a.url, b.url) AS record_url FROM k LEFT JOIN u a ON k.url = a.url LEFT JOIN u b ON k.key = b.url""")
def corpus_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    url = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat("url", F.lit("#part"))).when(kind == 2, F.concat(F.lit("https://other.example/"), "page_id")).otherwise(F.concat(F.lit(" "), "url", F.lit("/")))
    return cit.corpus_lookup(pages.select("page_id", url.alias("url")), pages).select("page_id", "record_url")


CHECK_SQL = """chk AS (SELECT doc_id, doc_id % 10 AS output_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS url, doc_id % 7 <> 0 AS known, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS passage,
  doc_id % 3 <> 0 AS in_cited, doc_id % 2 = 0 AS elsewhere, CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS claim, CASE n_chars % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'partially' ELSE 'UNSUPPORTIVE' END AS judged FROM documents),
ver AS (SELECT doc_id, output_id, CASE WHEN trim(url) = '' OR NOT known OR (trim(passage) <> '' AND NOT in_cited) THEN 'fabricated' WHEN claim = '' THEN 'partial'
    WHEN starts_with(upper(judged), 'SUPPORT') THEN 'valid' WHEN starts_with(upper(judged), 'PARTIAL') THEN 'partial' ELSE 'real_but_unsupportive' END AS verdict,
  CASE WHEN trim(url) = '' OR NOT known THEN false WHEN trim(passage) <> '' AND NOT in_cited THEN elsewhere ELSE true END AS found FROM chk)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    judged = F.when(F.col("n_chars") % 3 == 0, "SUPPORTED").when(F.col("n_chars") % 3 == 1, "partially").otherwise("UNSUPPORTIVE")
    verdict = cit.verdict_of(
        F.when(d % 11 == 0, "").otherwise(F.col("source")), d % 7 != 0, F.when(d % 5 == 0, " ").otherwise(F.col("text")), d % 3 != 0, d % 2 == 0, F.when(d % 13 == 0, "").otherwise(F.col("lang")), judged
    )
    return read_table(spark, sf_dir, "documents").select("doc_id", (d % 10).alias("output_id"), verdict.alias("v")).select("doc_id", "output_id", "v.verdict", "v.found")


@query(f"WITH {CHECK_SQL} SELECT doc_id, output_id, verdict, found FROM ver")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir)


@query(f"""WITH {CHECK_SQL}, o AS (SELECT DISTINCT CAST(label AS BIGINT) AS output_id FROM embeddings UNION SELECT 99)
SELECT o.output_id, count(doc_id) AS n, count(*) FILTER (WHERE verdict = 'valid') AS valid, count(*) FILTER (WHERE verdict = 'partial') AS partial, count(*) FILTER (WHERE verdict = 'real_but_unsupportive') AS unsupportive,
  count(*) FILTER (WHERE verdict = 'fabricated') AS fabricated, CASE WHEN count(doc_id) = 0 THEN 1.0::DOUBLE ELSE {rounded_sql("count(*) FILTER (WHERE verdict = 'valid') / count(doc_id)::DOUBLE")} END AS score
FROM o LEFT JOIN ver v ON o.output_id = v.output_id GROUP BY o.output_id""")
def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("output_id")).distinct()
    outputs = outputs.union(outputs.agg(F.lit(99).cast("long")))
    return cit.faithfulness(checks(spark, sf_dir), outputs).withColumn("score", rounded(F.col("score")))


@query("""WITH x AS (SELECT doc_id, text, substr(text, 1 + n_chars // 2, 50) AS s FROM documents), p AS (SELECT doc_id, text, s, instr(text, s) AS i FROM x)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, CAST(least(greatest(i - 1 + length(s) // 2 - 200, 0), length(text) - 400) AS BIGINT) + 1, 400) END AS window FROM p""")
def evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    piece = F.substring(F.col("text"), (F.floor(F.col("n_chars") / 2) + 1).cast("int"), F.lit(50))
    return docs.select("doc_id", cit.doc_window(F.col("text"), piece, 400).alias("window"))


@query("""WITH b AS (SELECT source AS output_id, doc_id AS ord, n_chars AS len, sum(n_chars) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT output_id, ord, CAST(CASE WHEN total <= 48000 THEN len WHEN 48000 - 64 * n <= 0 THEN 0 ELSE least(len, greatest(200, floor(len / total::DOUBLE * (48000 - 64 * n)))) END AS BIGINT) AS taken FROM b""")
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = read_table(spark, sf_dir, "documents").select(F.col("source").alias("output_id"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("len"))
    return cit.packed_lengths(blocks, 48_000).select("output_id", "ord", "taken")


@query("SELECT source AS output_id, lang AS url, min(doc_id) AS idx, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select(F.col("source").alias("output_id"), F.col("lang").alias("url"), F.col("doc_id").alias("idx"), "n_chars")
    return cit.first_by_url(rows)


RECALL = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''))"


@query(f"""WITH e AS (SELECT page_id % 50 AS output_id, {RECALL} AS key FROM pages), c AS (SELECT DISTINCT output_id, key FROM e JOIN (SELECT page_id, {RECALL} AS k FROM pages WHERE page_id % 3 = 0) x ON x.k = e.key AND x.page_id % 50 = e.output_id)
SELECT e.output_id, {rounded_sql('count(c.key) / count(*)::DOUBLE')} AS score, coalesce(list_sort(list(e.key) FILTER (WHERE c.key IS NULL)), []) AS missing FROM e LEFT JOIN c ON e.output_id = c.output_id AND e.key = c.key GROUP BY e.output_id""")
def citation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the urls that a group of pages stands for, those that its cited third has, other spelling aside."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 50).alias("output_id"), urls.recall_key(F.col("url")).alias("key"))
    out = cit.recall(pages.select("output_id", "key", F.col("page_id").alias("ord")), pages.where("page_id % 3 = 0").select("output_id", "key"))
    return out.withColumn("score", rounded(F.col("score")))
