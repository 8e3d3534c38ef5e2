"""Event sessions: numbered sources, folds of event streams, frames, chat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(events: DataFrame, session: str = "session", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events with ``seq``, their 1-based place in their session."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def marker_registry(events: DataFrame, session: str = "session", item: str = "item") -> DataFrame:
    """(session, item, first_seq, marker): items of a session numbered from 1 as they are first seen."""
    first = events.groupBy(session, item).agg(F.min("seq").alias("first_seq"))
    return first.withColumn("marker", F.row_number().over(Window.partitionBy(session).orderBy("first_seq", item)))


def resumed_markers(fresh: DataFrame, kept: DataFrame, session: str = "session", item: str = "item") -> DataFrame:
    """Markers of items that the kept registry lacks, numbered after its largest of the session."""
    new = fresh.join(kept.select(session, item), [session, item], "left_anti").groupBy(session, item).agg(F.min("seq").alias("first_seq"))
    last = kept.groupBy(session).agg(F.max("marker").alias("last"))
    n = F.row_number().over(Window.partitionBy(session).orderBy("first_seq", item))
    return new.withColumn("n", n).join(last, session, "left").select(session, item, "first_seq", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("marker"))


def cumulative_counts(events: DataFrame, session: str = "session", item: str = "item") -> DataFrame:
    """(session, seq, sources): after each event, how many distinct items the session has shown: its list's length then.

    The lists themselves follow from the registry: the markers up to that number.
    """
    first = F.row_number().over(Window.partitionBy(session, item).orderBy("seq")) == 1
    over = Window.partitionBy(session).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("fresh", first.cast("long")).select(session, "seq", F.sum("fresh").over(over).alias("sources"))


def grouped_sources(sources: DataFrame) -> DataFrame:
    """(session, url, markers, snippets, title): a url's markers and non-empty snippets in order, and its first row's title."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull() & (c.cast("string") != ""), F.struct("seq", c.alias("x"))))), lambda e: e.x)
    return sources.groupBy("session", "url").agg(in_order(F.col("marker")).alias("markers"), in_order(F.col("snippet")).alias("snippets"), F.min_by("title", "seq").alias("title"))


def event_fold(events: DataFrame) -> DataFrame:
    """(session, answer, sources, n_calls, ended): texts up to the first end joined in order, the last sources, calls, and how it ended.

    Events after the first ``done`` or ``error`` don't count; an answer that ends in an error or not at all is marked.
    """
    end = F.min(F.when(F.col("event").isin("done", "error"), F.col("seq"))).over(Window.partitionBy("session"))
    rows = events.withColumn("end", end).where(F.col("end").isNull() | (F.col("seq") <= F.col("end")))
    pick = lambda kind, value: F.when(F.col("event") == kind, value)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(pick("text", F.struct("seq", "payload")))), lambda x: x.payload), "")
    ended = F.coalesce(F.max(F.when(F.col("event").isin("done", "error"), F.col("event"))), F.lit("open"))
    out = rows.groupBy("session").agg(
        text.alias("answer"), F.max_by(pick("sources", F.col("payload")), pick("sources", F.col("seq"))).alias("sources"), F.count_if(F.col("event") == "tool_call").alias("n_calls"), ended.alias("ended")
    )
    return out.withColumn("answer", F.when(F.col("ended") == "done", F.col("answer")).otherwise(F.concat("answer", F.lit(" [cut off]"))))


def usage_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("session").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.count("*").alias("events"))


def stop_reasons(events: DataFrame, most: int = 30) -> DataFrame:
    """(session, iterations, stop, truncated): calls, the last event, and whether a session ended at a call or at the limit."""
    out = events.groupBy("session").agg(F.count_if(F.col("event") == "tool_call").alias("iterations"), F.max_by("event", "seq").alias("stop"))
    return out.withColumn("truncated", (F.col("stop") == "tool_call") | (F.col("iterations") >= most) & (F.col("stop") != "done"))


def sse_encoded(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_frames(streams: DataFrame, key: str, col: str) -> DataFrame:
    """(key, ord, event, data) of whole frames; lines of data are joined, the event is ``message`` by default, an unfinished last frame goes."""
    frames = F.split(col, "\n\n")
    whole = F.slice(frames, F.lit(1), F.greatest(F.size(frames) - 1, F.lit(0)))
    rows = streams.select(key, F.posexplode(whole).alias("ord", "frame")).withColumn("lines", F.split("frame", "\n"))
    data = F.transform(F.filter("lines", lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substring(x, F.lit(6), F.length(x))))
    event = F.get(F.filter("lines", lambda x: x.startswith("event:")), 0)
    out = rows.select(key, "ord", F.coalesce(F.ltrim(F.substring(event, F.lit(7), F.length(event))), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"), F.size(data).alias("n"))
    return out.where("n > 0").drop("n")


def ndjson_frames(streams: DataFrame, key: str, col: str) -> DataFrame:
    """(key, ord, line) of the whole JSON lines of a stream; broken lines and the unfinished rest go."""
    lines = F.split(col, "\n")
    whole = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    rows = streams.select(key, F.posexplode(whole).alias("ord", "line"))
    return rows.where(F.try_parse_json("line").isNotNull() & (F.trim("line") != ""))


def valid_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, valid): turns of users and assistants that are not blank; valid if the last is a user's."""
    rows = turns.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.max_by("role", "turn") == "user").alias("valid"))


def chat_titles(turns: DataFrame, most: int = 80) -> DataFrame:
    """(conv_id, title): the first user turn on one line, up to 80 characters."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(F.substring(F.trim(F.regexp_replace(first, r"\s+", " ")), 1, most).alias("title"))


def chat_prompts(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): earlier turns as blocks under a heading, then the last user's text."""
    entry = F.struct("turn", "role", "text")
    rows = turns.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    block = lambda t: F.concat(F.when(t.role == "user", "User: ").otherwise("Assistant: "), t.text)
    before = F.transform(F.slice("all", F.lit(1), F.size("all") - 1), block)
    last = F.element_at("all", -1)["text"]
    return rows.select("conv_id", F.when(F.size("all") == 1, last).otherwise(F.concat(F.lit("Earlier turns:\n\n"), F.array_join(before, "\n\n"), F.lit("\n\nCurrent turn:\n\n"), last)).alias("prompt"))


def trimmed_transcripts(turns: DataFrame, most_chars: int = 262_144, keep: int = 20) -> DataFrame:
    """(conv_id, kept): turn numbers of a transcript, the last twenty where it is longer than a quarter of a million characters."""
    rows = turns.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list("turn")).alias("all"))
    cut = (F.col("chars") > most_chars) & (F.size("all") > keep)
    return rows.select("conv_id", F.when(cut, F.slice("all", F.lit(-keep), F.lit(keep))).otherwise(F.col("all")).alias("kept"))


def valid_mentions(mentions: DataFrame) -> DataFrame:
    """The first mention of each secure url in a chat."""
    w = Window.partitionBy("chat", "url").orderBy("ord")
    return mentions.where(F.col("url").startswith("https://")).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def typed_mention(text: Column) -> Column:
    """What is typed after the last @ before the cursor: up to 80 characters on one line, after a blank or at the start; else null."""
    found = F.regexp_extract(text, r"(?:^|\s)@([^@\n\r]{0,80})\z", 1)
    return F.when(F.regexp_like(text, F.lit(r"(?:^|\s)@[^@\n\r]{0,80}\z")), found)


def answer_stage(done: Column, has_text: Column, has_sources: Column) -> Column:
    return F.when(done, "done").when(has_text, "writing").when(has_sources, "reading").otherwise("preflight")


def asked_last(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, asked): the last user turn's text, or the last turn's where there is none; of turns with one number the greatest text."""
    own = F.col("role") == "user"
    last = turns.groupBy(key).agg(F.max(F.when(own, F.struct("turn", "text"))).alias("u"), F.max(F.struct("turn", "text")).alias("a"))
    return last.select(key, F.coalesce("u.text", "a.text", F.lit("")).alias("asked"))


MESSAGES = "array<struct<content:array<struct<type:string,input:struct<command:string>>>>>"


def message_queries(rows: DataFrame, key: str, script: str = "search.sh") -> DataFrame:
    """(key, message, block, asked): what the shell commands in tool blocks of messages (a JSON array) search for, quoted or bare.

    Contents that are no lists of blocks, blocks of other types and commands of other scripts have none.
    """
    messages = rows.select(key, F.posexplode(F.from_json("messages", MESSAGES)).alias("message", "m"))
    blocks = messages.select(key, "message", F.posexplode("m.content").alias("block", "b")).where("b.type = 'tool_use'")
    raw = F.regexp_extract("b.input.command", rf"""bash\s+\S*{script.replace(".", "[.]")}\s+("[^"]*"|'[^']*'|\S+)""", 1)
    quoted = (raw.startswith('"') & raw.endswith('"')) | (raw.startswith("'") & raw.endswith("'"))
    asked = F.when(quoted, F.substring(raw, F.lit(2), F.greatest(F.length(raw) - 2, F.lit(0)))).otherwise(raw)
    return blocks.select(key, "message", "block", asked.alias("asked")).where("asked <> ''")


def source_lines(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """Numbered sources of JSON lines (column line): blank and broken lines and those that are no objects are left out; a missing marker is 0.

    ``place`` gives the order by marker of a session's (``key``'s) sources, lines that share one in their own order (line_no).
    """
    read = lines.where(F.trim("line").startswith("{")).withColumn("r", F.when(F.try_parse_json("line").isNotNull(), F.from_json("line", schema))).where("r IS NOT NULL")
    rows = read.select(key, "line_no", F.coalesce("r.marker", F.lit(0)).alias("marker"), *[F.col(f"r.{c.split()[0]}").alias(c.split()[0]) for c in schema.split(",") if c.split()[0] != "marker"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("marker", "line_no")) - 1)


def known_markers(lines: DataFrame, key: str) -> DataFrame:
    """(key, chunk_id, marker, last): the marker of a chunk's last line, and the session's greatest."""
    kept = lines.groupBy(key, "chunk_id").agg(F.max_by("marker", "line_no").alias("marker"))
    return kept.join(lines.groupBy(key).agg(F.max("marker").alias("last")), key)


def source_cards(sources: DataFrame) -> DataFrame:
    """Sources as they are shown: without chunk and text, with defaults, the kind of source only where it is abstract or body."""
    cols = [c for c in sources.columns if c not in ("chunk_id", "chunk_text")]
    defaults = {"authors": F.coalesce("authors", F.array().cast("array<string>")), "snippet": F.coalesce("snippet", F.lit("")), "source": F.when(F.col("source").isin("abstract", "body"), F.col("source"))}
    return sources.select(*[defaults.get(c, F.col(c)).alias(c) for c in cols])
