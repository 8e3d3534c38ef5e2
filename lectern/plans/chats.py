"""Queries over sessions of events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import rounded
from ..operators import framing, numbering
from ..operators import sessions as ses
from ..operators.catalog import latest_of
from ..sources.tables import read_table, upsert
from .registry import query, rounded_sql

E_SQL = """ev AS (SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, event_id, ts, value, props,
  CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'tool_call' WHEN 'signup' THEN 'sources' WHEN 'error' THEN CASE WHEN event_id % 23 = 0 THEN 'error' ELSE 'text' END ELSE CASE WHEN event_id % 19 = 0 THEN 'done' ELSE 'tool_call' END END AS event,
  CAST(event_id % 37 AS INT) AS item FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    t, i = F.col("event_type"), F.col("event_id")
    kind = (
        F.when(t == "view", "text").when(t == "click", "tool_call").when(t == "signup", "sources").when(t == "error", F.when(i % 23 == 0, "error").otherwise("text"))
        .otherwise(F.when(i % 19 == 0, "done").otherwise("tool_call"))
    )
    return ses.numbered(e.select(F.col("user_id").alias("session"), "event_id", "ts", "value", "props", kind.alias("event"), (i % 37).cast("int").alias("item")))


@query(f"WITH {E_SQL}, f AS (SELECT session, item, min(seq) AS first_seq FROM ev GROUP BY 1, 2) SELECT session, item, first_seq, CAST(row_number() OVER (PARTITION BY session ORDER BY first_seq, item) AS INT) AS marker FROM f")
def marker_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.marker_registry(events(spark, sf_dir))


@query(f"""WITH {E_SQL}, f AS (SELECT session, item, min(seq) AS first_seq FROM ev GROUP BY 1, 2), m AS (SELECT session, item, first_seq, row_number() OVER (PARTITION BY session ORDER BY first_seq, item) AS marker FROM f)
SELECT session, item, first_seq, CAST(marker AS INT) AS marker FROM m WHERE first_seq > 10""")
def marker_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering a session in two parts gives what numbering it at once gives."""
    e = events(spark, sf_dir)
    return ses.resumed_markers(e.where("seq > 10"), ses.marker_registry(e.where("seq <= 10")))


@query(f"""WITH {E_SQL} SELECT session, seq, CAST(sum(fresh) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS sources FROM (SELECT session, seq, CASE WHEN row_number() OVER (PARTITION BY session, item ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM ev)""")
def cumulative_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.cumulative_counts(events(spark, sf_dir))


@query(f"""WITH {E_SQL} SELECT session, event AS url, list(item ORDER BY seq) AS markers, coalesce(list(props ORDER BY seq) FILTER (WHERE seq % 3 <> 0), []) AS snippets, arg_min(CAST(event_id AS VARCHAR), seq) AS title FROM ev GROUP BY session, event""")
def sources_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = e.select("session", F.col("event").alias("url"), F.col("item").alias("marker"), F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("props")).alias("snippet"), F.col("event_id").cast("string").alias("title"), "seq")
    return ses.grouped_sources(rows)


@query(f"""WITH {E_SQL}, b AS (SELECT session, min(seq) FILTER (WHERE event IN ('done', 'error')) AS stop FROM ev GROUP BY session), r AS (SELECT e.* FROM ev e JOIN b ON e.session = b.session WHERE stop IS NULL OR seq <= stop),
g AS (SELECT session, coalesce(string_agg(CAST(event_id AS VARCHAR), '' ORDER BY seq) FILTER (WHERE event = 'text'), '') AS answer, arg_max(CAST(event_id AS VARCHAR), seq) FILTER (WHERE event = 'sources') AS sources,
  count(*) FILTER (WHERE event = 'tool_call') AS n_calls, coalesce(max(event) FILTER (WHERE event IN ('done', 'error')), 'open') AS ended FROM r GROUP BY session)
SELECT session, CASE WHEN ended = 'done' THEN answer ELSE answer || ' [cut off]' END AS answer, sources, n_calls, ended FROM g""")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.event_fold(events(spark, sf_dir).select("session", "seq", "event", F.col("event_id").cast("string").alias("payload")))


@query(f"WITH {E_SQL} SELECT session, {rounded_sql('sum(value)', 4)} AS total, count(*) AS events FROM ev GROUP BY session")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.usage_totals(events(spark, sf_dir)).withColumn("total", rounded(F.col("total"), 4))


@query(f"""WITH {E_SQL}, g AS (SELECT session, count(*) FILTER (WHERE event = 'tool_call') AS iterations, arg_max(event, seq) AS stop FROM ev GROUP BY session)
SELECT session, iterations, stop, stop = 'tool_call' OR (iterations >= 30 AND stop <> 'done') AS truncated FROM g""")
def stop_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.stop_reasons(events(spark, sf_dir))


STREAM_SQL = f"""{E_SQL}, st AS (SELECT session, string_agg('event: ' || event || chr(10) || 'data: ' || props || chr(10) || chr(10), '' ORDER BY seq) || 'event: rest' AS s FROM ev GROUP BY session)"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's frames as one text, with an unfinished one at its end."""
    e = events(spark, sf_dir).withColumn("frame", ses.sse_encoded(F.col("event"), F.col("props")))
    return e.groupBy("session").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda x: x.frame), ""), F.lit("event: rest")).alias("s"))


@query(f"WITH {STREAM_SQL} SELECT session, s FROM st")
def sse_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir)


@query(f"WITH {E_SQL} SELECT session, CAST(seq - 1 AS INT) AS ord, event, props AS data FROM ev")
def sse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.sse_frames(streams(spark, sf_dir), "session", "s")


@query(f"WITH {E_SQL} SELECT session, CAST(2 * (seq - 1) AS INT) AS ord, props AS line FROM ev")
def ndjson_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    text = e.groupBy("session").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "props"))), lambda x: F.concat(x.props, F.lit("\n{broken"))), "\n"), F.lit('\n{"rest": 1}')).alias("s"))
    return ses.ndjson_frames(text, "session", "s")


LONG_SQL = """lg AS (SELECT CAST(user_id % 3 AS BIGINT) AS stream, CAST(row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS BIGINT) AS seq, event_id, event_type, props, CAST(event_id % 37 AS INT) AS item FROM events)"""


def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in three sessions, numbered in two levels."""
    e = read_table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("long").alias("stream"), "ts", "event_id", "event_type", "props", (F.col("event_id") % 37).cast("int").alias("item"))
    return numbering.numbered(e, "stream", ["ts", "event_id"])


@query(f"WITH {LONG_SQL} SELECT stream, event_id, seq FROM lg")
def long_session_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_sessions(spark, sf_dir).select("stream", "event_id", "seq")


@query(f"""WITH {LONG_SQL} SELECT stream, event_id, CAST(sum(fresh) OVER (PARTITION BY stream ORDER BY seq) AS BIGINT) AS sources FROM (SELECT stream, event_id, seq, CASE WHEN row_number() OVER (PARTITION BY stream, item ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM lg)""")
def long_session_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.seen_so_far(long_sessions(spark, sf_dir), "stream", "item", ["seq"]).select("stream", "event_id", "sources")


def pieces(spark: SparkSession, sf_dir: str, frame) -> DataFrame:
    """A stream's text in pieces: each frame is cut at some place, and its end comes with the next piece."""
    rows = long_sessions(spark, sf_dir).withColumn("frame", frame)
    cut = (F.col("event_id") % F.length("frame")).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("k"), F.substring(F.col("frame"), F.lit(1), cut).alias("piece")), F.struct(F.lit(1).alias("k"), F.substring(F.col("frame"), cut + 1, F.length("frame")).alias("piece")))
    return rows.select("stream", "seq", F.explode(ends).alias("e")).select("stream", (F.col("seq") * 2 + F.col("e.k")).alias("at"), "e.piece")


@query(f"WITH {LONG_SQL} SELECT stream, CAST(seq - 1 AS INT) AS ord, event_type AS event, props AS data FROM lg")
def sse_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three long streams, in pieces that end anywhere."""
    return framing.sse_frames(pieces(spark, sf_dir, ses.sse_encoded(F.col("event_type"), F.col("props"))), "stream", "at", "piece")


@query(f"WITH {LONG_SQL} SELECT stream, CAST(seq - 1 AS INT) AS ord, props AS line FROM lg")
def ndjson_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.ndjson_lines(pieces(spark, sf_dir, F.concat("props", F.lit("\n"))), "stream", "at", "piece")


@query(f"""WITH {E_SQL} SELECT event, count(*) AS n, {rounded_sql('sum(CASE WHEN event = $$text$$ THEN value ELSE 0 END)', 4)} AS text_value, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50) AS large FROM ev GROUP BY event""".replace("$$", "'"))
def event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    e = events(spark, sf_dir)
    return e.groupBy("event").agg(F.count("*").alias("n"), rounded(F.sum(F.when(F.col("event") == "text", F.col("value")).otherwise(0.0)), 4).alias("text_value"), F.count_if(k > 50).alias("large"))


@query("""SELECT conv_id, count(*) AS turns, arg_max(role, turn) = 'user' AS valid FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id""")
def chat_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.valid_chats(read_table(spark, sf_dir, "conversations"))


@query(r"""SELECT conv_id, substr(trim(regexp_replace(arg_min(text, turn) FILTER (WHERE role = 'user'), '\s+', ' ', 'g')), 1, 80) AS title FROM conversations GROUP BY conv_id""")
def chat_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.chat_titles(read_table(spark, sf_dir, "conversations"))


@query("""WITH r AS (SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS c, turn FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, CASE WHEN max(c) = 1 THEN max(text) ELSE 'Earlier turns:' || chr(10) || chr(10) || string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE n < c)
  || chr(10) || chr(10) || 'Current turn:' || chr(10) || chr(10) || max(text) FILTER (WHERE n = c) END AS prompt FROM r GROUP BY conv_id""")
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.chat_prompts(read_table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, list(turn ORDER BY turn) AS kept FROM conversations GROUP BY conv_id HAVING sum(length(text)) <= 262144 OR count(*) <= 20")
def chat_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.trimmed_transcripts(read_table(spark, sf_dir, "conversations")).where(F.size("kept") > 0)


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's fifty latest rows."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read_table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 50").select("event_id", "user_id", "ts")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7 AND role = 'user'")
def chat_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").where("conv_id = 7 AND role = 'user'").select("conv_id", "turn", "role", "text")


@query("""SELECT user_id AS id, CASE WHEN user_id % 3 = 0 THEN 'changed' ELSE event_type END AS title, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def chat_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows by owner, after a change to a third of the owners."""
    e = read_table(spark, sf_dir, "events")
    base = e.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("title"), F.max("ts").alias("updated_at"))
    changes = base.where("id % 3 = 0").select("id", F.lit("changed").alias("title"))
    return latest_of(upsert(base, changes, "id", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")), "id", "updated_at")


@query("SELECT page_id % 100 AS chat, url, min(page_id) AS ord FROM pages WHERE starts_with(url, 'https://') GROUP BY 1, 2")
def mentions_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ses.valid_mentions(read_table(spark, sf_dir, "pages").select((F.col("page_id") % 100).alias("chat"), "url", F.col("page_id").alias("ord")))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 3 THEN source END AS typed FROM documents")
def mention_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 4
    end = F.when(d == 0, F.concat(F.lit(" @"), "lang")).when(d == 1, F.concat(F.lit("x@"), "lang")).when(d == 2, F.concat(F.lit(" @"), "source", F.lit("\n"))).otherwise(F.concat(F.lit(" @"), "lang", F.lit(" @"), "source"))
    return read_table(spark, sf_dir, "documents").select("doc_id", ses.typed_mention(F.concat("text", end)).alias("typed"))


@query(f"WITH {E_SQL} SELECT session, CASE WHEN max(CASE WHEN event = 'done' THEN 1 ELSE 0 END) = 1 THEN 'done' WHEN max(CASE WHEN event = 'text' THEN 1 ELSE 0 END) = 1 THEN 'writing' WHEN max(CASE WHEN event = 'sources' THEN 1 ELSE 0 END) = 1 THEN 'reading' ELSE 'preflight' END AS stage FROM ev GROUP BY session")
def answer_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda k: F.max(F.col("event") == k)
    return events(spark, sf_dir).groupBy("session").agg(ses.answer_stage(has("done"), has("text"), has("sources")).alias("stage"))


@query(f"WITH {E_SQL} SELECT session, count(DISTINCT item) AS sources FROM ev GROUP BY session")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("session").agg(F.countDistinct("item").alias("sources"))


@query("SELECT source AS session, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS marker FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 4")
def mention_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four chunks of each article that a session mentions, numbered."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("session"), F.col("lang").alias("url"), F.col("doc_id").alias("chunk_id"))
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("session", "url").orderBy("chunk_id"))).where("n <= 4")
    return first.select("session", "chunk_id", F.row_number().over(Window.partitionBy("session").orderBy("chunk_id")).alias("marker"))
