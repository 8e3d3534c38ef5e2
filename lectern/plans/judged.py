"""Queries over replayed judges and reports. Replies are made of the documents' and labels' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions.values import rounded
from ..operators import judging, scoring
from ..operators.citations import last_sources
from ..sources.tables import read_table
from .analysis import S, TRACKS, rounded_columns, scores, tracks_of
from .citing import SOURCES_SQL, sources
from .registry import query, rounded_sql
from .texts import PROSE


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rubric reply a label row: JSON, fenced JSON, JSON within prose, or no JSON."""
    d = F.col("doc_id")
    result = lambda i, v: F.struct(F.lit(i).alias("element_index"), v.alias("verdict"), F.concat(F.lit(f"why {i} "), d).alias("rationale"))
    results = F.array(result(0, F.lit(" present")), result(2, F.when(d % 2 == 0, "PARTIAL").otherwise("odd")), result(9, F.lit("PRESENT")), result(0, F.when(d % 3 == 0, "PARTIAL").otherwise("PRESENT")))
    data = F.to_json(F.struct(results.alias("results")))
    reply = F.when(d % 4 == 0, data).when(d % 4 == 1, F.concat(F.lit("```json\n"), data, F.lit("\n```"))).when(d % 4 == 2, F.concat(F.lit("Here: "), data, F.lit(" done"))).otherwise("no reply")
    return read_table(spark, sf_dir, "labels").select("doc_id", reply.alias("reply"))


@query("""SELECT doc_id, CAST(idx AS INT) AS idx, CASE WHEN doc_id % 4 = 3 THEN 'MISSING' WHEN idx = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'PARTIAL' ELSE 'PRESENT' END WHEN idx = 2 AND doc_id % 2 = 0 THEN 'PARTIAL' ELSE 'MISSING' END AS verdict,
  CASE WHEN doc_id % 4 = 3 OR idx = 1 THEN '' ELSE 'why ' || idx || ' ' || doc_id END AS rationale FROM (SELECT doc_id, unnest([0, 1, 2]) AS idx FROM labels)""")
def element_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = replies(spark, sf_dir)
    elements = told.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx")).withColumn("element", F.concat(F.lit("e"), "idx"))
    return judging.aligned_elements(elements, told, ["doc_id"]).select("doc_id", "idx", "verdict", "rationale")


@query("SELECT doc_id, sha256('support' || chr(1) || text) AS request_key, p AS pass, CASE WHEN doc_id % 5 <> 0 THEN 'reply ' || p END AS reply FROM (SELECT doc_id, text, unnest([0, 1]) AS p FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text))")
def judge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of two passes over distinct texts, with replies to four fifths of them."""
    docs = read_table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    asked = judging.requests(docs, "support", F.col("text"), 2)
    given = asked.where("doc_id % 5 <> 0").select("request_key", "pass", F.concat(F.lit("reply "), "pass").alias("text"))
    return judging.replayed(asked, given).select("doc_id", "request_key", "pass", "reply")


@query("""SELECT doc_id AS output_id, CASE doc_id % 3 WHEN 0 THEN 'says ' || lang WHEN 1 THEN text ELSE 'says ' || lang END AS answer, CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE END AS confidence, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS n FROM documents""")
def extract_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    cite = lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title"))
    data = F.to_json(F.struct(F.concat(F.lit("says "), "lang").alias("final_answer"), F.when(d % 3 == 0, 0.25).otherwise(7.0).alias("confidence"), F.array(cite(F.col("source")), cite(F.lit(None).cast("string"))).alias("citations")))
    rows = read_table(spark, sf_dir, "documents").select(d.alias("output_id"), F.when(d % 3 == 1, F.col("text")).otherwise(data).alias("reply"))
    return judging.extracted_outputs(rows).select("output_id", "answer", "confidence", F.size("citations").alias("n"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS unsupported FROM documents")
def support_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    data = F.to_json(F.struct(F.when(d % 3 == 1, F.array("lang", "source")).otherwise(F.array("lang")).alias("unsupported_claims")))
    reply = F.when(d % 3 == 0, F.lit("cannot say")).otherwise(F.concat(F.lit("Result: "), data))
    return read_table(spark, sf_dir, "documents").select("doc_id", judging.unsupported_claims(reply).alias("unsupported"))


@query(rf"""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN printf('%.2f', l_discount) || ' (' || printf('%.0f', l_discount * 100) || '%)' WHEN 1 THEN printf('%.2f', l_discount) || 'x' WHEN 2 THEN printf('%.2f', l_discount) ELSE printf('%.2f', l_discount) || ' years' END AS target,
  CASE WHEN l_linenumber % 2 = 0 AND l_discount > 0 THEN '±10% and ±' || printf('%.2f', l_discount) WHEN l_linenumber % 2 = 0 THEN '±10%' WHEN l_discount > 0 THEN '±' || printf('%.2f', l_discount) ELSE 'exact' END AS tolerance FROM lineitem""")
def judge_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    unit = F.when(n % 4 == 0, "probability").when(n % 4 == 1, "x").when(n % 4 == 3, "years")
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", judging.target_rendered(F.col("l_discount"), unit).alias("target"), judging.tolerance_rendered(F.when(n % 2 == 0, 0.1).otherwise(0.0), F.col("l_discount")).alias("tolerance")
    )


@query(f"""WITH {SOURCES_SQL} SELECT output_id, string_agg('[' || marker || '] ' || title || ' — ' || url, chr(10) ORDER BY marker) AS listing FROM src GROUP BY output_id""")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.source_list(last_sources(sources(spark, sf_dir)))


@query(rf"""WITH a AS (SELECT doc_id, {PROSE} AS x FROM documents)
SELECT doc_id, len(regexp_extract_all(x, '\[(\d+(?:\s*,\s*\d+)*)\]')) + 1 AS parts, regexp_replace(x, '\[\d+(?:\s*,\s*\d+)*\]', '', 'g') AS prose, list_filter(regexp_extract_all(x, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda m: m <> '') AS marks FROM a""")
def citation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PROSE} AS x").select("doc_id", judging.citation_parts(F.col("x")).alias("p"))
    return made.select("doc_id", F.size("p").cast("long").alias("parts"), F.array_join("p.text", "").alias("prose"), F.filter("p.marks", lambda m: m.isNotNull()).alias("marks"))


#: Replies that begin with what their texts hold: a verdict in small or capital letters, after blank lines, within a longer word, or none.
SAID = """CASE WHEN contains(text, 'tion') AND contains(text, 'the') THEN concat(chr(10), ' match: ', text) WHEN contains(text, 'que') THEN concat('PARTIAL', chr(10), 'MATCH ', text) WHEN contains(text, 'sch') THEN concat('Matching ', text) ELSE text END"""


@query(rf"""WITH r AS (SELECT doc_id, upper(regexp_extract(x, '^\s*(\S[^\n]*)', 1)) AS head, phrasings FROM (SELECT doc_id, {SAID} AS x, length(text) > 200 AS phrasings FROM documents))
SELECT doc_id, CASE WHEN NOT phrasings THEN 'MISS' WHEN regexp_matches(head, '^MATCH\b') THEN 'MATCH' WHEN regexp_matches(head, '^PARTIAL\b') THEN 'PARTIAL' ELSE 'MISS' END AS verdict FROM r""")
def verbal_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by the word they begin with; without accepted phrasings (here, for short texts) an answer misses."""
    made = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SAID.replace('chr(10)', 'char(10)')} AS reply", "length(text) > 200 AS phrasings")
    said = scoring.head_verdict(F.col("reply"), ("MATCH", "PARTIAL", "MISS"), "MISS")
    return made.select("doc_id", F.when(~F.col("phrasings"), "MISS").otherwise(said).alias("verdict"))


@query("SELECT doc_id AS output_id, v AS variant, CASE v WHEN 'faithful' THEN text ELSE rtrim(text) || ' A later survey confirmed this.' END AS answer FROM (SELECT doc_id, text, unnest(['faithful', 'hallucinated']) AS v FROM documents)")
def probe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "output_id")
    return judging.probe_pairs(docs, F.col("text"), F.concat(F.rtrim("text"), F.lit(" A later survey confirmed this.")))


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of forty documents by a seeded hash, which is this engine's own."""
    return judging.seeded_sample(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", 40, seed=7)


@query()
def text_fragment_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to a place in a page's own text; without SQL, as patterns refer to their own groups."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("https://example.org/"), "source", judging.text_fragment(tx.snippet(F.col("text")))).alias("link"))


@query(f"WITH {S} SELECT run, track, item, ord, composite, substr('track ' || track || ' item ' || item || ' of ' || version || ' ' || mode, 1, 24) AS explanation FROM s WHERE run = 'r199603'")
def run_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).where("run = 'r199603'")
    said = F.concat(F.lit("track "), "track", F.lit(" item "), "item", F.lit(" of "), "version", F.lit(" "), "mode")
    return rows.select("run", "track", "item", "ord", "composite", F.substring(said, 1, 24).alias("explanation"))


@query(f"WITH {TRACKS} SELECT run, track, n, {rounded_sql('mean')} AS mean FROM t WHERE run = 'r199703'")
def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(tracks_of(spark, sf_dir).where("run = 'r199703'"), "mean").select("run", "track", "n", "mean")


@query(f"""WITH {TRACKS} SELECT run, track, kind, {rounded_sql('v')} AS value FROM (SELECT run, track, 'mean' AS kind, mean AS v FROM t UNION ALL SELECT run, track, 'valid', valid_rate FROM t UNION ALL SELECT run, track, 'fabricated', fabricated_rate FROM t)""")
def series_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks_of(spark, sf_dir).select("run", "track", "mean", F.col("valid_rate").alias("valid"), F.col("fabricated_rate").alias("fabricated"))
    return t.unpivot(["run", "track"], ["mean", "valid", "fabricated"], "kind", "value").withColumn("value", rounded(F.col("value")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.0::DOUBLE ELSE n_chars::DOUBLE END AS score FROM documents")
def scalar_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("n_chars").cast("string"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(made.try_cast("double"), F.lit(0.0)).alias("score"))


@query(f"""WITH {TRACKS}, k AS (SELECT track, sum(mean * n) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n FROM t WHERE n > 0 GROUP BY track)
SELECT track, CASE track WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END AS place, CASE WHEN mean >= 0.5 THEN 'above half over ' ELSE 'below half over ' END || n || ' items' AS highlight FROM k""")
def kpi_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a track in the report's fixed order, unknown tracks last."""
    k = tracks_of(spark, sf_dir).where("n > 0").groupBy("track").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    at = F.array_position(F.array(*[F.lit(t) for t in ("1-URGENT", "2-HIGH", "3-MEDIUM")]), F.col("track"))
    said = F.concat(F.when(F.col("mean") >= 0.5, "above half over ").otherwise("below half over "), F.col("n").cast("string"), F.lit(" items"))
    return k.select("track", F.when(at > 0, (at - 1).cast("int")).otherwise(99).alias("place"), said.alias("highlight"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))


@query(f"""SELECT label, count(*) AS n, {rounded_sql('avg(list_dot_product(embedding, embedding))', 4)} AS square FROM embeddings GROUP BY label""")
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return read_table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(square), 4).alias("square"))
