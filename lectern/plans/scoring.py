"""Queries over scorers and votes. Answers, replies and parts are made of the documents' and labels' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import rounded
from ..operators import scoring
from ..sources.shared import spread
from ..sources.tables import read_table, tier_matches
from .registry import query, rounded_sql

ANSWER = """concat(CASE doc_id % 6 WHEN 0 THEN concat('Around ', CAST(n_chars % 100 AS VARCHAR(9)), '% say ') WHEN 1 THEN concat('roughly ', CAST(n_chars % 9 + 1 AS VARCHAR(9)), 'x more ') WHEN 2 THEN 'half of them ' WHEN 3 THEN '1,250,000 of 3 million ' WHEN 4 THEN concat('-', CAST(n_chars % 7 AS VARCHAR(9)), '.5 fold ') ELSE '' END, lang)"""
UNIT = """CASE doc_id % 3 WHEN 0 THEN 'probability' WHEN 1 THEN 'x' END"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars", "text", f"{ANSWER} AS answer", f"{UNIT} AS unit")


#: By hand, what the first number of ANSWER is under each unit.
NUMERIC = """n AS (SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN (n_chars % 100) / 100.0::DOUBLE WHEN 1 THEN n_chars % 9 + 1 WHEN 2 THEN NULL WHEN 3 THEN 1250000 WHEN 4 THEN -(n_chars % 7) - 0.5::DOUBLE END AS x FROM documents)"""


@query(f"WITH {NUMERIC} SELECT doc_id, CASE WHEN x IS NULL THEN NULL ELSE {rounded_sql('x')} END AS x FROM n")
def numeric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", rounded(scoring.first_number(F.col("answer"), F.col("unit"))).alias("x"))


@query(f"WITH {NUMERIC} SELECT doc_id, coalesce(abs(x - 0.5) <= greatest(0.1::DOUBLE * 0.5, 0.05::DOUBLE), false) AS close FROM n")
def numeric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.first_number(F.col("answer"), F.col("unit"))
    return answers(spark, sf_dir).select("doc_id", scoring.within(x, F.lit(0.5), F.lit(0.1), F.lit(0.05)).alias("close"))


HEDGED = """concat(text, CASE doc_id % 5 WHEN 0 THEN ' perhaps.' WHEN 1 THEN ' it is very likely so' WHEN 2 THEN ' ~5' WHEN 3 THEN ' at least' ELSE '' END)"""


@query(f"""WITH h AS (SELECT doc_id, lower({HEDGED}) AS x FROM documents)
SELECT doc_id, list_filter(['~', 'might', 'highly likely'], lambda w: CASE w
  WHEN '~' THEN NOT (contains(x, '~') OR regexp_matches(x, '\\b(around|approximately|roughly|about|circa)\\b'))
  WHEN 'might' THEN NOT regexp_matches(x, '\\b(might|may|could|possibly|perhaps)\\b') ELSE NOT regexp_matches(x, '\\b(highly likely|very likely)\\b') END) AS missing FROM h""")
def hedge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{HEDGED} AS x"))
    return docs.select("doc_id", scoring.missing_hedges(F.col("x"), F.array(F.lit("~"), F.lit("might"), F.lit("highly likely"))).alias("missing"))


def votes(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """Three passes of votes on each label row's document."""
    labels = read_table(spark, sf_dir, "labels")
    rows = labels.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pass"))
    pick = F.pmod(F.col("doc_id") * (F.col("pass") + 2) + F.floor(F.col("doc_id") / 7) * F.col("pass"), F.lit(4))
    verdict = F.when(pick == 3, "BANANA")
    for i, v in enumerate(names):
        verdict = verdict.when(pick == i, v)
    return rows.select("doc_id", "pass", verdict.alias("verdict"), F.concat(F.lit("pass "), F.col("pass")).alias("rationale"))


def votes_sql(names: list[str]) -> str:
    a, b, c = names
    return f"""v AS (SELECT doc_id, p, ['{a}', '{b}', '{c}', 'BANANA'][1 + (doc_id * (p + 2) + doc_id // 7 * p) % 4] AS verdict FROM (SELECT doc_id, unnest([0, 1, 2]) AS p FROM labels)),
c AS (SELECT doc_id, count(*) AS n, avg(CASE verdict WHEN '{a}' THEN 1.0::DOUBLE WHEN '{b}' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS mean,
  count(*) FILTER (WHERE verdict = '{a}') AS a, count(*) FILTER (WHERE verdict = '{b}') AS b, count(*) FILTER (WHERE verdict = '{c}') AS c FROM v WHERE verdict <> 'BANANA' GROUP BY doc_id),
m AS (SELECT doc_id, n, CASE WHEN a > b AND a > c THEN '{a}' WHEN b > a AND b > c THEN '{b}' WHEN c > a AND c > b THEN '{c}'
  WHEN abs(mean - 1) <= abs(mean - 0.5) AND abs(mean - 1) <= abs(mean) THEN '{a}' WHEN abs(mean - 0.5) <= abs(mean) THEN '{b}' ELSE '{c}' END AS verdict FROM c)"""


@query(f"WITH {votes_sql(list(scoring.RUBRIC))} SELECT doc_id, verdict, n FROM m")
def rubric_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.majority(votes(spark, sf_dir, list(scoring.RUBRIC)), ["doc_id"], scoring.RUBRIC)


@query(f"WITH {votes_sql(list(scoring.INTEGRATION))} SELECT doc_id, verdict, n FROM m")
def integration_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.majority(votes(spark, sf_dir, list(scoring.INTEGRATION)), ["doc_id"], scoring.INTEGRATION)


@query(f"""WITH {votes_sql(list(scoring.RUBRIC))}
SELECT m.doc_id, any_value(m.verdict) AS verdict, coalesce(arg_min('pass ' || v.p, v.p) FILTER (WHERE v.verdict = m.verdict), arg_min('pass ' || v.p, v.p)) AS rationale FROM m JOIN v ON m.doc_id = v.doc_id GROUP BY m.doc_id""")
def merged_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = votes(spark, sf_dir, list(scoring.RUBRIC))
    return scoring.with_rationale(rows, scoring.majority(rows, ["doc_id"], scoring.RUBRIC), ["doc_id"])


@query(f"""WITH {votes_sql(list(scoring.RUBRIC))}, g AS (SELECT m.verdict, l.quality FROM m JOIN labels l ON m.doc_id = l.doc_id)
SELECT quality, {rounded_sql("count(*) FILTER (WHERE verdict = 'PRESENT') / count(*)::DOUBLE")} AS present,
  {rounded_sql("(count(*) FILTER (WHERE verdict = 'PRESENT') + 0.5 * count(*) FILTER (WHERE verdict = 'PARTIAL')) / count(*)::DOUBLE")} AS at_least_partial FROM g GROUP BY quality""")
def rubric_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = scoring.majority(votes(spark, sf_dir, list(scoring.RUBRIC)), ["doc_id"], scoring.RUBRIC).join(read_table(spark, sf_dir, "labels"), "doc_id")
    out = scoring.rubric_fractions(merged, "quality")
    return out.select("quality", rounded(F.col("present")).alias("present"), rounded(F.col("at_least_partial")).alias("at_least_partial"))


@query(f"""WITH {votes_sql(list(scoring.RUBRIC))}, k AS (SELECT doc_id, verdict, count(*) AS c, min(p) AS o FROM v GROUP BY doc_id, verdict)
SELECT doc_id, arg_min(verdict, o - 10 * c) AS majority, CASE WHEN count(*) = 1 THEN min(verdict) ELSE 'DISAGREE' END AS all_agree, arg_min(verdict, o) AS first FROM k GROUP BY doc_id""")
def judge_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ensemble(votes(spark, sf_dir, list(scoring.RUBRIC)).select("doc_id", F.col("verdict").alias("text"), F.col("pass").alias("ord")), "doc_id")


REPLY = """CASE doc_id % 5 WHEN 0 THEN concat(' correct. ', lang) WHEN 1 THEN 'PARTIAL match' WHEN 2 THEN 'INCORRECT' WHEN 3 THEN concat('Correctly, ', lang) ELSE text END"""


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'PARTIAL' ELSE 'INCORRECT' END AS verdict, CASE doc_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def numeric_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{REPLY} AS reply")
    verdict = scoring.head_verdict(F.col("reply"), ("INCORRECT", "CORRECT", "PARTIAL"), "INCORRECT")
    return made.select("doc_id", verdict.alias("verdict")).withColumn("score", F.when(F.col("verdict") == "CORRECT", 1.0).when(F.col("verdict") == "PARTIAL", 0.5).otherwise(0.0))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE WHEN doc_id % 4 = 1 THEN 0.5::DOUBLE WHEN n_chars % 4 = 0 THEN 1.0::DOUBLE
  ELSE floor(greatest(0.1::DOUBLE, 1 - (n_chars % 4) / greatest(1, least(20, n_chars // 150))::DOUBLE) * 1000 + 0.5) / 1000 END AS score FROM documents""")
def answer_support_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    answer = F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("text"))
    return docs.select("doc_id", scoring.answer_support(answer, (F.col("doc_id") % 4 != 1).cast("int"), F.col("n_chars") % 4).alias("score"))


#: Replies of a gate judge: a label that follows from the text, spelt in several ways, or the text itself.
GATED = """CASE WHEN contains(text, 'que') THEN 'Refuse' WHEN contains(text, 'sch') THEN concat(' SPLIT ', chr(10)) WHEN contains(text, 'ción') THEN 'caveat' ELSE text END"""


@query(rf"""WITH r AS (SELECT doc_id, lower(regexp_replace({GATED}, '^\s+|\s+$', '', 'g')) AS w, lang FROM documents), l AS (SELECT doc_id, lang, CASE WHEN w IN ('ground', 'refuse', 'split', 'caveat') THEN w ELSE 'ground' END AS label FROM r)
SELECT doc_id, label, label = CASE lang WHEN 'fr' THEN 'refuse' WHEN 'de' THEN 'split' WHEN 'es' THEN 'caveat' ELSE 'ground' END AS matched FROM l""")
def gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour labels of replies, anything else counts as ground; what is expected follows from the language."""
    lang = F.col("lang")
    made = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", f"{GATED.replace('chr(10)', 'char(10)')} AS reply")
    word = F.lower(F.regexp_replace("reply", r"^\s+|\s+$", ""))
    label = F.when(word.isin("ground", "refuse", "split", "caveat"), word).otherwise("ground")
    wanted = F.when(lang == "fr", "refuse").when(lang == "de", "split").when(lang == "es", "caveat").otherwise("ground")
    return made.select("doc_id", label.alias("label"), (label == wanted).alias("matched"))


PARTS = ("correctness", "hedge", "verbal", "rubric", "recall", "integration", "cite", "support", "behaviour")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return labels.select("doc_id", *[((F.col("doc_id") * (i + 3) + F.col("quality")) % 5 / 4).alias(p) for i, p in enumerate(PARTS)])


def _composite(track: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parts(spark, sf_dir).select("doc_id", rounded(scoring.composite(track)).alias("score"))

    run.__name__ = f"composite_{track}"
    total = " + ".join(f"((doc_id * {PARTS.index(p) + 3} + quality) % 5) / 4.0::DOUBLE * {w}::DOUBLE" for p, w in scoring.COMPOSITES[track].items())
    return query(f"SELECT doc_id, {rounded_sql(total)} AS score FROM labels")(run)


for _track in scoring.COMPOSITES:
    _composite(_track)


@query("SELECT item_id, tier FROM (SELECT item_id, CASE WHEN length(text) % 2 = 0 THEN 'smoke' WHEN starts_with(text, 'T') THEN NULL ELSE 'extended' END AS tier, contains(text, 'qu') AS held_out FROM benchmark) WHERE NOT held_out AND coalesce(tier, 'smoke') = 'smoke'")
def item_tier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the smoke tier (which is that of items without one) that are not held out."""
    text = F.col("text")
    tier = F.when(F.length(text) % 2 == 0, "smoke").when(text.startswith("T"), F.lit(None).cast("string")).otherwise("extended")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", tier.alias("tier"), text.contains("qu").alias("held_out"))
    return items.where(~F.col("held_out")).where(tier_matches(F.coalesce("tier", F.lit("smoke")), "smoke")).select("item_id", "tier")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'phrase ' || quality WHEN 1 THEN toxic || ' x' ELSE '' END AS target FROM labels")
def item_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    phrasings = F.when(d % 3 == 0, F.array(F.concat(F.lit("phrase "), F.col("quality").cast("string")), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    value, unit = F.when(d % 3 == 1, F.col("toxic")), F.when(d % 3 == 1, "x")
    return read_table(spark, sf_dir, "labels").select("doc_id", scoring.target_text(phrasings, value, unit).alias("target"))
