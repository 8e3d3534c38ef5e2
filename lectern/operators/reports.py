"""Reports of runs: Markdown and HTML pages, one a run, dashboard JSON, and which logs they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite_rounded

# Least composites of the two better colour classes.
GOOD, FAIR = 0.85, 0.6


def escaped(text: Column) -> Column:
    """Text with the five characters that HTML gives a meaning replaced."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def colour(composite: Column) -> Column:
    return F.when(composite >= GOOD, "ok").when(composite >= FAIR, "warn").otherwise("bad")


def three_places(x: Column) -> Column:
    """A number of three places, halves up."""
    return F.format_string("%d.%03d", F.floor(F.floor(x * 1000 + 0.5) / 1000).cast("long"), F.pmod(F.floor(x * 1000 + 0.5), F.lit(1000)).cast("long"))


def _by_run(tracks: DataFrame, line: Column, head: Column, foot: str, joint: str) -> DataFrame:
    """One text a run: a head, a line a track in the order of their names, a foot. A run has a few tracks."""
    rows = tracks.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("track", line.alias("line")))).alias("lines"), F.sum("n").alias("items"),
        (F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("overall"),
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), joint)
    return rows.withColumn("overall", F.coalesce("overall", F.lit(0.0))).select("run", F.concat(head, body, F.lit(foot)).alias("page"))


def markdown_report(tracks: DataFrame, title: str) -> DataFrame:
    """(run, page) of tracks (run, track, n, mean): items, the mean weighted by items, and a table of tracks."""
    head = F.concat(
        F.lit(f"# {title}\n\n**Total items**: "), F.col("items").cast("string"), F.lit("  **Overall composite (n-weighted)**: **"), three_places(F.col("overall")),
        F.lit("**\n\n## Per-track summary\n\n| Track | n | Composite |\n|---|---:|---:|\n"),
    )
    line = F.concat(F.lit("| "), "track", F.lit(" | "), F.col("n").cast("string"), F.lit(" | **"), three_places(F.coalesce("mean", F.lit(0.0))), F.lit("** |"))
    return _by_run(tracks, line, head, "\n", "\n")


def html_report(tracks: DataFrame, title: str) -> DataFrame:
    """``markdown_report`` as HTML, names escaped, composites in the class of their colour."""
    mean = F.coalesce("mean", F.lit(0.0))
    line = F.concat(F.lit("<tr><td>"), escaped(F.col("track")), F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td><td class='"), colour(mean), F.lit("'>"), three_places(mean), F.lit("</td></tr>"))
    head = F.concat(
        F.lit(f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body><h1>{title}</h1><p>Run "), escaped(F.col("run")), F.lit(", items "), F.col("items").cast("string"),
        F.lit(", overall <span class='"), colour(F.col("overall")), F.lit("'>"), three_places(F.col("overall")), F.lit("</span></p><table>"),
    )
    return _by_run(tracks, line, head, "</table></body></html>", "")


def dashboard_rows(rows: DataFrame, *numbers: str) -> DataFrame:
    """(line): ``rows`` as JSON, nulls kept, with null for numbers that are none (JSON has no NaN)."""
    return rows.withColumns({c: finite_rounded(F.col(c)) for c in numbers}).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def latest_logs(files: DataFrame, *keys: str) -> DataFrame:
    """The last file by name of each key."""
    return files.groupBy(*keys).agg(F.max("name").alias("name"))
