"""Queries over benchmark runs. Runs are months of orders, tracks their priorities, items parts of their lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import finite_rounded, percent_text, rounded, run_name_parts, score_band
from ..operators import moments, runs
from ..sources.logs import first_log, read_logs, run_order, track_scores, write_logs
from ..sources.shared import shared_dir
from ..sources.tables import read_table
from .registry import query, rounded_sql

INACTIVE = ("4-NOT SPECIFIED",)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order line: (run, track, item, composite, n, valid, fabricated, unsupportive, ts, version, mode)."""
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_quantity", "l_returnflag").join(
        orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    q = F.col("l_quantity").cast("long")
    return rows.select(
        F.date_format("o_orderdate", "'r'yyyyMM").alias("run"), F.col("o_orderpriority").alias("track"), (F.col("l_partkey") % 20).alias("item"),
        F.when(F.col("l_linenumber") != 7, F.least(F.lit(1.0), rounded(F.col("l_discount") * 10, 6))).alias("composite"),
        q.alias("n"), F.floor(q * 3 / 5).alias("valid"), F.floor(q / 10).alias("fabricated"), F.floor(q / 5).alias("unsupportive"),
        F.col("o_orderdate").alias("ts"), F.date_format("o_orderdate", "yyyy").alias("version"), F.col("l_returnflag").alias("mode"), F.col("l_orderkey").alias("ord"),
    )


S = f"""s AS (
  SELECT strftime(o_orderdate, 'r%Y%m') AS run, o_orderpriority AS track, l_partkey % 20 AS item,
    CASE WHEN l_linenumber <> 7 THEN least(1.0::DOUBLE, {rounded_sql('l_discount * 10')}) END AS composite,
    CAST(floor(l_quantity) AS BIGINT) AS n, CAST(floor(CAST(floor(l_quantity) AS BIGINT) * 3 / 5.0) AS BIGINT) AS valid, CAST(floor(floor(l_quantity) / 10.0) AS BIGINT) AS fabricated,
    CAST(floor(floor(l_quantity) / 5.0) AS BIGINT) AS unsupportive,
    o_orderdate AS ts, strftime(o_orderdate, '%Y') AS version, l_returnflag AS mode, l_orderkey AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TRACKS = S + """,
t AS (SELECT run, track, count(composite) AS n, avg(composite) AS mean, sum(valid) / nullif(sum(n), 0)::DOUBLE AS valid_rate, sum(fabricated) / nullif(sum(n), 0)::DOUBLE AS fabricated_rate FROM s GROUP BY run, track)"""
OVERALL = TRACKS + """,
o AS (SELECT run, sum(mean * n) / sum(n) AS overall, CAST(sum(n) AS BIGINT) AS n FROM t WHERE n > 0 GROUP BY run),
r AS (SELECT run, array_to_string(list_sort(list_distinct(list(version))), '/') AS versions, min(ts) AS started, array_to_string(list_sort(list_distinct(list(mode))), '/') AS modes FROM s GROUP BY run)"""


def tracks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.track_summary(scores(spark, sf_dir))


def rounded_columns(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


@query(f"WITH {TRACKS} SELECT run, track, n, {rounded_sql('mean')} AS mean, {rounded_sql('valid_rate')} AS valid_rate, {rounded_sql('fabricated_rate')} AS fabricated_rate FROM t")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(tracks_of(spark, sf_dir), "mean", "valid_rate", "fabricated_rate")


@query(f"WITH {S} SELECT run, track, {rounded_sql('avg(coalesce(composite, 0))')} AS mean, count(*) AS n FROM s GROUP BY run, track")
def report_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(runs.report_mean(scores(spark, sf_dir)), "mean")


@query(f"WITH {OVERALL} SELECT run, {rounded_sql('overall')} AS overall, n FROM o")
def run_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(runs.overall(tracks_of(spark, sf_dir)), "overall")


@query(f"WITH {TRACKS} SELECT run, {rounded_sql('sum(mean * n) / sum(n)')} AS overall, CAST(sum(n) AS BIGINT) AS n FROM t WHERE n > 0 AND track <> '4-NOT SPECIFIED' GROUP BY run")
def run_overall_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(runs.overall(tracks_of(spark, sf_dir), INACTIVE), "overall")


@query(f"WITH {OVERALL} SELECT run, versions, started, modes FROM r")
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_list(scores(spark, sf_dir))


@query(f"WITH {OVERALL} SELECT run, CAST(row_number() OVER (ORDER BY started, run) - 1 AS INT) AS idx, coalesce(lag(versions) OVER (ORDER BY started, run) <> versions, false) AS version_changed FROM r")
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_positions(runs.run_list(scores(spark, sf_dir))).select("run", "idx", "version_changed")


@query(f"""WITH {S}, a AS (SELECT * FROM s WHERE run = 'r199603'), b AS (SELECT * FROM s WHERE run = 'r199703'),
ma AS (SELECT track, avg(composite) AS x FROM a GROUP BY track), mb AS (SELECT track, avg(composite) AS y FROM b GROUP BY track),
c AS (SELECT i.track, count(*) AS common FROM (SELECT DISTINCT track, item FROM a WHERE composite IS NOT NULL) i JOIN (SELECT DISTINCT track, item FROM b WHERE composite IS NOT NULL) j ON i.track = j.track AND i.item = j.item GROUP BY i.track)
SELECT coalesce(ma.track, mb.track) AS track, {rounded_sql('x')} AS mean_a, {rounded_sql('y')} AS mean_b, {rounded_sql('y - x')} AS delta, coalesce(common, 0) AS common
FROM ma FULL JOIN mb ON ma.track = mb.track LEFT JOIN c ON c.track = coalesce(ma.track, mb.track)""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rounded_columns(runs.compare(rows.where("run = 'r199603'"), rows.where("run = 'r199703'")), "mean_a", "mean_b", "delta")


@query(f"""WITH {S}, i AS (SELECT track, item, avg(composite) FILTER (WHERE run = 'r199603') AS a, avg(composite) FILTER (WHERE run = 'r199703') AS b FROM s GROUP BY track, item)
SELECT track, item, {rounded_sql('a')} AS a, {rounded_sql('b')} AS b, {rounded_sql('b - a')} AS delta FROM i WHERE abs(b - a) >= 0.005""")
def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rounded_columns(runs.item_deltas(rows.where("run = 'r199603'"), rows.where("run = 'r199703'")), "a", "b", "delta").select("track", "item", "a", "b", "delta")


@query(f"""WITH {OVERALL}, l AS (SELECT run, row_number() OVER (ORDER BY started DESC, run DESC) AS back FROM r)
SELECT track, {rounded_sql('max(mean) FILTER (WHERE back = 1)')} AS latest, {rounded_sql('max(mean) FILTER (WHERE back = 2)')} AS previous,
  {rounded_sql('max(mean) FILTER (WHERE back = 1) - max(mean) FILTER (WHERE back = 2)')} AS delta FROM t JOIN l ON t.run = l.run WHERE back <= 2 GROUP BY track""")
def track_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rounded_columns(runs.track_deltas(runs.track_summary(rows), runs.run_list(rows)), "latest", "previous", "delta")


@query(f"""WITH {TRACKS} SELECT track, {rounded_sql('avg(mean)')} AS mean_of_means, {rounded_sql('stddev_samp(mean)')} AS sigma, {rounded_sql('max(mean) - min(mean)')} AS spread, count(*) AS runs
FROM t WHERE mean IS NOT NULL GROUP BY track HAVING count(*) >= 2""")
def run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(runs.variance(tracks_of(spark, sf_dir)), "mean_of_means", "sigma", "spread")


@query(f"""WITH {S} SELECT track, item, {rounded_sql('avg(composite)')} AS mean, {rounded_sql('coalesce(stddev_samp(composite), 0)')} AS sigma, {rounded_sql('max(composite) - min(composite)')} AS spread, count(composite) AS n
FROM s GROUP BY track, item HAVING count(composite) >= 2""")
def noisy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(runs.noisy_items(scores(spark, sf_dir)), "mean", "sigma", "spread")


@query(f"WITH {S} SELECT mode, {rounded_sql('avg(composite)')} AS mean, {rounded_sql('stddev_pop(composite)')} AS sigma, {rounded_sql('max(composite) - min(composite)')} AS spread FROM s GROUP BY mode")
def probe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(runs.probe_stats(scores(spark, sf_dir), "mode", "composite"), "mean", "sigma", "spread")


@query(f"""WITH {OVERALL} SELECT versions, {rounded_sql('min(overall)')} AS low, {rounded_sql('max(overall)')} AS high, {rounded_sql('avg(overall)')} AS mean, count(*) AS runs, arg_min(r.run, started) AS first_run
FROM r JOIN o ON r.run = o.run GROUP BY versions""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rounded_columns(runs.timeline(runs.run_list(rows).join(runs.overall(runs.track_summary(rows)), "run")), "low", "high", "mean")


@query(f"""WITH {TRACKS} SELECT run, track, {rounded_sql('mean')} AS mean, {rounded_sql('max(mean) OVER (PARTITION BY track)')} AS best, abs(mean - max(mean) OVER (PARTITION BY track)) < 1e-4 AS is_best FROM t""")
def best_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.with_best(tracks_of(spark, sf_dir).select("run", "track", "mean"), ["track"], "mean", 1e-4)
    return rounded_columns(rows, "mean", "best")


YEARS = [f"r{y}{m:02d}" for y in (1996, 1997) for m in range(1, 13)]


@query(f"WITH {S} SELECT track, item, " + ", ".join(rounded_sql(f"avg(composite) FILTER (WHERE run = '{r}')") + f" AS {r}" for r in YEARS) + " FROM s GROUP BY track, item")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(runs.heatmap(scores(spark, sf_dir), YEARS), *YEARS)


@query(f"""WITH {S}, x AS (SELECT track, max(composite) AS best, avg(composite) AS mean, min(composite) AS worst FROM s GROUP BY track)
SELECT track, kind, value FROM (SELECT track, 'best' AS kind, best AS value FROM x UNION ALL SELECT track, 'mean', {rounded_sql('mean')} FROM x UNION ALL SELECT track, 'worst', worst FROM x)""")
def unpivot_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scores(spark, sf_dir).groupBy("track").agg(F.max("composite").alias("best"), rounded(F.avg("composite")).alias("mean"), F.min("composite").alias("worst"))
    return x.unpivot(["track"], ["best", "mean", "worst"], "kind", "value")


@query(f"WITH {S} SELECT run, track, {rounded_sql('avg(composite)')} AS mean FROM s WHERE item = 7 GROUP BY run, track")
def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("item = 7").groupBy("run", "track").agg(rounded(F.avg("composite")).alias("mean"))


@query(f"""WITH {S}, x AS (SELECT run, track, item, ord FROM s),
y AS (SELECT run, track, '"' || track || '": [' || string_agg('"' || item || '"', ', ' ORDER BY ord, item) || ']' AS body FROM x GROUP BY run, track)
SELECT run, substr(sha1('{{' || string_agg(body, ', ' ORDER BY track) || '}}'), 1, 8) AS hash FROM y GROUP BY run""")
def item_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.fingerprint(scores(spark, sf_dir))


@query("SELECT label, CAST(n AS INT) AS n, v AS median FROM (SELECT label, count(*) OVER (PARTITION BY label) AS n, v, row_number() OVER (PARTITION BY label ORDER BY v) AS r FROM (SELECT label, vec_id AS v FROM embeddings)) WHERE r = n // 2 + 1")
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.upper_medians(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query("""WITH x AS (SELECT avg(CASE WHEN toxic = 0 THEN 1.0::DOUBLE - quality * 0.1::DOUBLE END) AS faithful, avg(CASE WHEN toxic = 1 THEN 0.2::DOUBLE + quality * 0.3::DOUBLE END) AS hallucinated FROM labels)
SELECT floor(faithful * 1e6 + 0.5) / 1e6 AS faithful, floor(hallucinated * 1e6 + 0.5) / 1e6 AS hallucinated, floor((faithful - hallucinated) * 1e6 + 0.5) / 1e6 AS gap,
  faithful >= 0.85 AND hallucinated <= 0.55 AND faithful - hallucinated >= 0.3 AS passes FROM x""")
def validate_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    rows = labels.select(
        F.when(F.col("toxic") == 0, "faithful").otherwise("hallucinated").alias("variant"),
        F.when(F.col("toxic") == 0, 1.0 - F.col("quality") * 0.1).otherwise(0.2 + F.col("quality") * 0.3).alias("score"),
    )
    return rounded_columns(runs.validation(rows), "faithful", "hallucinated", "gap")


@query("""SELECT quality, count(*) FILTER (WHERE v = 'valid') AS valid, count(*) FILTER (WHERE v = 'partial') AS partial, count(*) FILTER (WHERE v = 'unsupportive') AS unsupportive
FROM (SELECT quality, CASE doc_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'partial' ELSE 'unsupportive' END AS v FROM labels) GROUP BY quality""")
def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    v = F.when(F.col("doc_id") % 3 == 0, "valid").when(F.col("doc_id") % 3 == 1, "partial").otherwise("unsupportive")
    kinds = ["valid", "partial", "unsupportive"]
    return labels.select("quality", v.alias("v")).groupBy("quality").pivot("v", kinds).count().na.fill(0, kinds)


@query("""WITH v AS (SELECT quality AS track, CASE WHEN toxic = 1 THEN 'fabricated' WHEN doc_id % 3 = 0 THEN 'valid' ELSE 'partial' END AS verdict FROM labels)
SELECT coalesce(CAST(track AS VARCHAR), 'all') AS track, verdict, count(*) AS n FROM v GROUP BY GROUPING SETS ((track, verdict), (verdict))""")
def verdict_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "fabricated").when(F.col("doc_id") % 3 == 0, "valid").otherwise("partial")
    rows = labels.select(F.col("quality").alias("track"), verdict.alias("verdict"))
    every = rows.groupBy("track", "verdict").agg(F.count("*").alias("n")).select(F.col("track").cast("string"), "verdict", "n")
    return every.union(every.groupBy("verdict").agg(F.sum("n").alias("n")).select(F.lit("all"), "verdict", "n"))


NAMES_SQL = "names AS (SELECT DISTINCT 'r' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '_' || lower(o_orderstatus) || '_' || year(o_orderdate) AS run FROM orders)"


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "orders")
    return d.select(F.concat(F.lit("r"), F.date_format("o_orderdate", "MM"), F.lit("_"), F.lower("o_orderstatus"), F.lit("_"), F.date_format("o_orderdate", "yyyy")).alias("run")).distinct()


@query(f"WITH {NAMES_SQL} SELECT 'r' || lpad(CAST(max(CAST(regexp_extract(run, '^r([0-9]+)_', 1) AS INT)) + 1 AS VARCHAR), 2, '0') || '_longer_answers_k_8' AS name FROM names")
def next_run_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.next_run_name(run_names(spark, sf_dir), "Longer answers, k=8")


@query(f"""WITH {NAMES_SQL}, h AS (SELECT run, CASE WHEN run = 'r03_f_1996' THEN 1 WHEN ends_with(run, 'r03_f_1996') THEN 2 WHEN contains(run, 'r03_f_1996') THEN 3 END AS kind FROM names),
b AS (SELECT kind, count(*) AS matches, min(run) AS run FROM h WHERE kind IS NOT NULL GROUP BY kind ORDER BY kind LIMIT 1)
SELECT 'r03_f_1996' AS wanted, (SELECT CASE WHEN matches = 1 THEN run END FROM b) AS run, coalesce((SELECT matches FROM b), 0) AS matches""")
def find_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_run(run_names(spark, sf_dir), "r03_f_1996")


@query(f"WITH {NAMES_SQL} SELECT run, CAST(regexp_extract(run, '^r([0-9]+)_', 1) AS INT) AS number, regexp_extract(run, '^r[0-9]+_(.*)$', 1) AS label, '#' || regexp_extract(run, '^r([0-9]+)_', 1) AS short FROM names")
def run_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_names(spark, sf_dir).select("run", run_name_parts(F.col("run")).alias("p")).select("run", "p.*")


@query(f"WITH {TRACKS} SELECT run, track, n, {rounded_sql('mean', 4)} AS mean, CASE WHEN mean >= 0.8 THEN 'best' WHEN mean >= 0.7 THEN 'good' WHEN mean >= 0.6 THEN 'fair' WHEN mean >= 0.45 THEN 'poor' ELSE 'bad' END AS band, CAST(CAST(floor(valid_rate * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS valid FROM t")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks_of(spark, sf_dir)
    return t.select("run", "track", "n", finite_rounded(F.col("mean")).alias("mean"), score_band(F.col("mean")).alias("band"), percent_text(F.col("valid_rate")).alias("valid"))


@query(f"WITH {S} SELECT DISTINCT track FROM s WHERE run IN ('r199603', 'r199703')")
def track_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where(F.col("run").isin("r199603", "r199703")).select("track").distinct()


@query(f"""WITH {OVERALL} SELECT r.run, {rounded_sql('any_value(o.overall)')} AS overall, """ + ", ".join(rounded_sql(f"max(t.mean) FILTER (WHERE t.track = '{x}')") + f" AS {n}" for x, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))) + """
FROM r JOIN o ON r.run = o.run JOIN t ON t.run = r.run GROUP BY r.run, r.started ORDER BY r.started DESC, r.run DESC LIMIT 25""")
def history_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    t = runs.track_summary(rows)
    at = lambda x, n: rounded(F.max(F.when(F.col("track") == x, F.col("mean")))).alias(n)
    wide = t.groupBy("run").agg(at("1-URGENT", "urgent"), at("2-HIGH", "high"), at("5-LOW", "low"))
    every = runs.run_list(rows).join(runs.overall(t).select("run", "overall"), "run").join(wide, "run").orderBy(F.desc("started"), F.desc("run")).limit(25)
    return every.select("run", rounded(F.col("overall")).alias("overall"), "urgent", "high", "low")


@query(f"WITH {S} SELECT track, item, {rounded_sql('avg(composite)')} AS mean, CAST(rank() OVER (PARTITION BY track ORDER BY {rounded_sql('avg(composite)')} NULLS LAST, item) AS INT) AS place FROM s WHERE run = (SELECT max(run) FROM s) GROUP BY track, item")
def item_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    last = rows.join(F.broadcast(rows.agg(F.max("run").alias("run"))), "run", "left_semi").groupBy("track", "item").agg(rounded(F.avg("composite")).alias("mean"))
    return last.withColumn("place", F.rank().over(Window.partitionBy("track").orderBy(F.asc_nulls_last("mean"), "item")))


@query(f"""WITH {S}, x AS (SELECT run, sum(n) AS n, sum(valid) AS valid, sum(fabricated) AS fabricated, sum(unsupportive) AS unsupportive FROM s GROUP BY run)
SELECT run, kind, {rounded_sql('coalesce(v / n::DOUBLE, 0)')} AS share FROM (SELECT run, n, 'valid' AS kind, valid AS v FROM x UNION ALL SELECT run, n, 'fabricated', fabricated FROM x UNION ALL SELECT run, n, 'unsupportive', unsupportive FROM x)""")
def verdict_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["valid", "fabricated", "unsupportive"]
    x = scores(spark, sf_dir).groupBy("run").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in kinds])
    share = F.coalesce(F.col("v") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    return x.unpivot(["run", "n"], kinds, "kind", "v").select("run", "kind", rounded(share).alias("share"))


@query(f"""WITH {S} SELECT track, item, count(composite) AS n, {rounded_sql('avg(composite)')} AS mean, {rounded_sql('coalesce(stddev_samp(composite), 0)')} AS sigma, {rounded_sql('max(composite) - min(composite)')} AS spread
FROM s GROUP BY track, item HAVING count(composite) > 0""")
def merged_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments of each run's scores, merged over runs."""
    parts = moments.moments(scores(spark, sf_dir), ["run", "track", "item"], "composite")
    return rounded_columns(moments.spread(moments.merged(parts, ["track", "item"])).select("track", "item", "n", "mean", "sigma", "spread"), "mean", "sigma", "spread")


@query("""SELECT share, l_returnflag, CAST(n AS BIGINT) AS n, v AS value FROM (SELECT l_returnflag, l_extendedprice AS v, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r FROM lineitem),
  (VALUES (0.25::DOUBLE), (0.9::DOUBLE)) AS q(share) WHERE r = least(floor(n * share), n - 1)""")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of three keys that hold all lines."""
    return runs.quantiles(read_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", [0.25, 0.9])


LOGGED = f"""{S}, lg AS (SELECT run, replace(track, ' ', '-') || CASE WHEN track LIKE '1%' THEN '_synthesis_' ELSE '' END || version || '.eval' AS file, track, version, CASE WHEN count(*) > 40 THEN 'full' ELSE 'smoke' END AS mode, strftime(max(ts), '%Y-%m-%d') AS created,
  item, avg(composite) AS composite, sum(n) AS n, sum(valid) AS valid, sum(fabricated) AS fabricated, sum(unsupportive) AS unsupportive FROM s GROUP BY run, track, version, item)"""


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of all scores, a run a folder and a track a container, written and read again."""
    rows = scores(spark, sf_dir).groupBy("run", "track", "version", "item").agg(
        F.avg("composite").alias("composite"), *[F.sum(c).alias(c) for c in ("n", "valid", "fabricated", "unsupportive")], F.date_format(F.max("ts"), "yyyy-MM-dd").alias("created"), F.count("*").alias("lines"),
    )
    name = F.concat(F.replace("track", F.lit(" "), F.lit("-")), F.when(F.col("track").startswith("1"), "_synthesis_").otherwise(""), "version", F.lit(".eval"))
    rows = rows.select("run", name.alias("file"), "track", "version", F.when(F.col("lines") > 40, "full").otherwise("smoke").alias("mode"), "created", F.col("item").alias("place"), F.concat(F.lit("item-"), F.col("item").cast("string")).alias("sample"), "composite", "n", "valid", "fabricated", "unsupportive")
    # A container has one time and mode: those of its first sample.
    path = f"{shared_dir(spark)}/lectern/logs-{uuid.uuid4().hex}"
    write_logs(rows, path)
    return read_logs(spark, path)


@query(f"""WITH {LOGGED} SELECT run, track, 'item-' || item AS item, {rounded_sql('composite')} AS composite, CAST(n AS BIGINT) AS n, CAST(valid AS BIGINT) AS valid, CAST(fabricated AS BIGINT) AS fabricated, CAST(unsupportive AS BIGINT) AS unsupportive, version FROM lg WHERE composite IS NOT NULL""")
def log_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = track_scores(logged(spark, sf_dir)).select("run", "track", "item", "composite", "n", "valid", "fabricated", "unsupportive", "version")
    return rounded_columns(rows, "composite")


@query(f"""WITH {LOGGED}, f AS (SELECT run, file, arg_min(created, item) AS created, any_value(version) AS version, count(*) AS samples FROM lg GROUP BY run, file)
SELECT CAST(row_number() OVER (ORDER BY min(created), run) - 1 AS INT) AS idx, run, min(created) AS started, string_agg(DISTINCT version, '/' ORDER BY version) AS versions, CAST(sum(samples) AS BIGINT) AS samples FROM f GROUP BY run""")
def log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in the order of their earliest time."""
    return run_order(logged(spark, sf_dir)).select("idx", "run", "started", "versions", "samples")


@query(f"""WITH {LOGGED}, f AS (SELECT run, min(file) AS file FROM lg WHERE file LIKE '%\\_synthesis\\_%' ESCAPE '\\' GROUP BY run)
SELECT lg.run, lg.file, 'item-' || item AS sample, CAST(item AS BIGINT) AS place FROM lg JOIN f ON lg.run = f.run AND lg.file = f.file""")
def log_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each run's first synthesis container."""
    found = first_log(logged(spark, sf_dir))
    return found.select("run", "file", "sample", F.get_json_object("sample_metadata", "$.place").cast("long").alias("place"))
