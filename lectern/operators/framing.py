"""Frames of streams that arrive in pieces: any cut of a stream gives the frames of the whole.

A piece of a stream is a head that ends a line begun before, whole lines, and a rest that a later piece ends. Lines are numbered by the newlines before them,
frames by the blank lines before them, both as running sums over all pieces; the parts of a line, and the lines of a frame, then meet in
groups of their own. No stream needs one row or one task: a long one is split by its lines and frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import running_sums


def whole_lines(pieces: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """(key, no, line, ended): the lines of each stream from its pieces (key, order, col), numbered from 0; ``ended`` is false for a rest without a newline.

    A null piece is empty. A stream that ends with a newline has an empty rest, as a split by newlines gives it.
    """
    rows = pieces.select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.split(F.coalesce(F.col(col), F.lit("")), "\n").alias("parts"))
    sums = running_sums(rows, "__key", ["__order"], {"after": F.size("parts") - 1})
    first = F.col("after") - F.size("parts") + 1
    parts = sums.select("__key", "__order", first.alias("first"), F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
    parts = parts.select("__key", "__order", (F.col("first") + F.col("at")).alias("no"), "part", (F.col("at") < F.col("n") - 1).alias("ends"))
    # Most lines lie within one piece; those that do not have a part for each piece that they cross.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__order", "part"))), lambda x: x["part"]), "")
    return parts.groupBy(F.col("__key").alias(key), "no").agg(text.alias("line"), F.max("ends").alias("ended"))


def sse_frames(pieces: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """(key, ord, event, data), as ``sessions.sse_frames`` gives it for the whole stream: frames end at an empty line, frames without data and an unfinished last one go."""
    lines = whole_lines(pieces, key, order, col)
    ends = lines.groupBy(key).agg(F.max("no").alias("newlines"), F.max(F.when(F.col("line") != "", F.col("no"))).alias("last"))
    full = lines.where(F.col("line") != "")
    # Of a run of newlines, pairs end frames and an odd one begins the next: the line before is found by its number, a partition at a time.
    gaps = _since_last(full, key, "no")
    frames = running_sums(gaps, key, ["no"], {"ord": F.floor(F.col("gap") / 2)})
    # Of each stream its number of newlines and its last line.
    frames = frames.join(ends.withColumnRenamed(key, "__end"), F.col(key).eqNullSafe(F.col("__end"))).drop("__end")
    last = frames.where(F.col("no") == F.col("last")).select(F.col(key).alias("__key"), F.col("ord").alias("open"), (F.col("newlines") - F.col("last") >= 2).alias("closed"))
    frames = frames.join(last, F.col(key).eqNullSafe(F.col("__key"))).where(F.col("closed") | (F.col("ord") < F.col("open")))
    value = lambda n: F.ltrim(F.substring("line", n, F.length("line")))
    is_data, is_event = F.col("line").startswith("data:"), F.col("line").startswith("event:")
    out = frames.groupBy(key, "ord").agg(
        F.min_by(F.when(is_event, value(F.lit(7))), F.when(is_event, F.col("no"))).alias("event"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_data, F.struct("no", value(F.lit(6)).alias("d"))))), lambda x: x["d"]), "\n").alias("data"),
        F.count_if(is_data).alias("n"),
    )
    return out.where("n > 0").select(key, F.col("ord").cast("int").alias("ord"), F.coalesce("event", F.lit("message")).alias("event"), "data")


def _since_last(lines: DataFrame, key: str, no: str) -> DataFrame:
    """Lines with ``gap``, how far back the stream's line before is; for a first one its own number.

    Numbers are cut into blocks: a window sorts one block of one stream, and the first line of each looks up the last of the block before that has any.
    """
    block = F.floor(F.col(no) / 65536)
    rows = lines.withColumn("__block", block)
    tops = rows.groupBy(key, "__block").agg(F.max(no).alias("__top"))
    tops = tops.withColumn("__back", F.lag("__top").over(Window.partitionBy(key).orderBy("__block"))).select(F.col(key).alias("__key"), F.col("__block").alias("__of"), "__back")
    rows = rows.withColumn("__lag", F.lag(no).over(Window.partitionBy(key, "__block").orderBy(no)))
    both = rows.join(tops, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of")))
    return both.withColumn("gap", F.col(no) - F.coalesce("__lag", "__back", F.lit(0))).drop("__block", "__lag", "__back", "__key", "__of")


def ndjson_lines(pieces: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """(key, ord, line), as ``sessions.ndjson_frames`` gives it for the whole stream: whole JSON lines; broken ones and the rest go."""
    rows = whole_lines(pieces, key, order, col).where("ended")
    return rows.where(F.try_parse_json("line").isNotNull() & (F.trim("line") != "")).select(key, F.col("no").cast("int").alias("ord"), "line")
