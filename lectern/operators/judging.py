"""A judge as data: requests are columns with a key, replies are a table, and what is missing takes a default."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_snippet
from ..functions.values import loose_json


def request_key(scorer: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(scorer), text), 256)


def requests(rows: DataFrame, scorer: str, text: Column, passes: int = 1) -> DataFrame:
    """``rows`` with (scorer, pass, request_key, user_text), one a pass."""
    out = rows.withColumn("user_text", text).withColumns({"scorer": F.lit(scorer), "request_key": request_key(scorer, F.col("user_text"))})
    return out.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))


def replayed(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with ``reply``, from responses (request_key, pass, text): null where there is none."""
    return asked.join(responses.select("request_key", "pass", F.col("text").alias("reply")), ["request_key", "pass"], "left")


def aligned_elements(elements: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Elements (keys, idx, element) with (verdict, rationale) of a reply's results by element_index.

    Indexes out of range don't count, and the last of an index does; elements without a result, and
    those of a reply that is no JSON, are MISSING.
    """
    kind = "struct<results:array<struct<element_index:int,verdict:string,rationale:string>>>"
    told = replies.select(*keys, F.posexplode(F.from_json(loose_json(F.col("reply")), kind)["results"]).alias("place", "r"))
    last = told.groupBy(*keys, F.col("r.element_index").alias("idx")).agg(F.max_by("r", "place").alias("r"))
    verdict = F.upper(F.trim("r.verdict"))
    verdict = F.when(verdict.isin("PRESENT", "PARTIAL", "MISSING"), verdict).otherwise("MISSING")
    return elements.join(last, [*keys, "idx"], "left").select(*keys, "idx", "element", verdict.alias("verdict"), F.coalesce("r.rationale", F.lit("")).alias("rationale"))


def extracted_outputs(rows: DataFrame) -> DataFrame:
    """(output_id, answer, confidence, citations) of replies that should be JSON; a confidence outside 0 to 1 is null, citations need a url or a title.

    The answer falls back to the raw text.
    """
    cite = T.StructType().add("url", "string").add("title", "string").add("passage", "string").add("supports", "string")
    kind = T.StructType().add("final_answer", "string").add("confidence", "double").add("citations", T.ArrayType(cite))
    read = F.from_json(loose_json(F.col("reply")), kind)
    cites = F.filter(F.coalesce(read["citations"], F.array().cast(T.ArrayType(cite))), lambda c: c["url"].isNotNull() | c["title"].isNotNull())
    sure = F.when(read["confidence"].between(0.0, 1.0), read["confidence"])
    return rows.select("output_id", F.coalesce(read["final_answer"], F.col("reply")).alias("answer"), sure.alias("confidence"), cites.alias("citations"))


def unsupported_claims(reply: Column) -> Column:
    """How many claims a reply lists as unsupported; none for a broken one."""
    listed = F.from_json(loose_json(reply), "struct<unsupported_claims:array<string>>")["unsupported_claims"]
    return F.when(listed.isNull(), 0).otherwise(F.size(listed))


def target_rendered(value: Column, unit: Column) -> Column:
    """A numeric target as text: probabilities also as percentages, % and x directly after the number."""
    plain = F.format_string("%.2f", value)
    return (
        F.when(unit == "probability", F.concat(plain, F.lit(" ("), F.format_string("%.0f", value * 100), F.lit("%)"))).when(unit.isin("%", "x"), F.concat(plain, unit))
        .when(unit.isNull() | (unit == ""), plain).otherwise(F.concat(plain, F.lit(" "), unit))
    )


def tolerance_rendered(relative: Column, absolute: Column) -> Column:
    """The tolerances that are above 0, joined by ``and``; ``exact`` without any."""
    parts = F.array(F.when(relative > 0, F.concat(F.lit("±"), F.format_string("%.0f", relative * 100), F.lit("%"))), F.when(absolute > 0, F.concat(F.lit("±"), F.format_string("%.2f", absolute))))
    made = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " and ")
    return F.when(made == "", "exact").otherwise(made)


def source_list(sources: DataFrame) -> DataFrame:
    """(output_id, listing): an output's sources, a line each, in order of their marks."""
    line = F.struct("marker", F.concat(F.lit("["), "marker", F.lit("] "), "title", F.lit(" — "), "url").alias("line"))
    return sources.groupBy("output_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n").alias("listing"))


def citation_parts(text: Column) -> Column:
    """Text pieces and marks in turn: the pieces between marks, each but the last followed by its mark's numbers."""
    marks = F.concat(F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1), F.array(F.lit(None).cast("string")))
    return F.zip_with(F.split(text, r"\[\d+(?:\s*,\s*\d+)*\]"), marks, lambda a, b: F.struct(a.alias("text"), b.alias("marks")))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a seeded hash of their key, the same ones each time."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def probe_pairs(outputs: DataFrame, faithful: Column, mutated: Column) -> DataFrame:
    """(output_id, variant, answer): each output as it is and with its answer made wrong."""
    both = F.array(F.struct(F.lit("faithful").alias("variant"), faithful.alias("answer")), F.struct(F.lit("hallucinated").alias("variant"), mutated.alias("answer")))
    return outputs.select("output_id", F.inline(both))


def phrases_of(clean: str, least: int = 12) -> list[tuple[str, str]]:
    """Up to four (start, end) phrases by which a browser can find a clean snippet.

    Of the first sentence of 30 to 220 characters, of the second and of the longest sentence; and the
    snippet's own start and end. Phrases have at least three words and ten characters; where there is
    none, the snippet's first six words are tried.
    """
    # The characters and words that sentences and phrases must have, and how many phrases there are.
    if len(clean) < least:
        return []
    lines = [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", clean)) if s]
    tries = [(next((s for s in lines if 30 <= len(s) <= 220), ""), 8), (lines[1] if len(lines) > 1 else "", 7), (max(lines, key=len, default=""), 8)]

    def begin(text: str, n: int) -> str:
        words = text.split()
        phrase = " ".join(words[:n])
        return phrase if len(words) >= 3 and len(phrase) >= 10 else ""

    found = {(p, ""): None for p in (begin(*t) for t in tries) if p}
    words = clean.split()
    if len(words) >= 14:
        found[" ".join(words[2:9]), " ".join(words[-5:])] = None
    if not found and (p := begin(clean, 6)):
        found[p, ""] = None
    return list(found)[:4]


def text_fragment(text: Column) -> Column:
    """``#:~:text=…&text=…`` for a snippet's phrases; empty without any.

    Sentences and phrases are a row-at-a-time matter, so that they are found in Arrow batches of
    snippets; cleaning stays with Spark.
    """

    @F.pandas_udf("string")
    def link(snippets: pd.Series) -> pd.Series:
        encoded = lambda p: quote(p, safe="!'()*").replace("-", "%2D")
        made = (["text=" + encoded(a) + ("," + encoded(b) if b else "") for a, b in phrases_of(s or "")] for s in snippets)
        return pd.Series(["#:~:" + "&".join(m) if m else "" for m in made])

    body = F.regexp_replace(text, r"^\s*#{1,6}\s+[^\n]*\n+", "")
    return link(clean_snippet(F.when(body == "", text).otherwise(body)))
