"""Citations: from marks in answers to sources, claims, passages and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import markers_in, sentences, strip_markers
from ..functions.urls import lookup_key
from ..sources.shared import spread


def marker_walk(answers: DataFrame) -> DataFrame:
    """(output_id, place, claim, marker) of every mark of (output_id, answer) in text order; repeats stay."""
    parts = answers.select("output_id", F.posexplode(sentences(F.col("answer"))).alias("s", "sentence"))
    marks = parts.select("output_id", "s", strip_markers(F.col("sentence")).alias("claim"), F.posexplode(markers_in(F.col("sentence"))).alias("m", "marker"))
    order = Window.partitionBy("output_id").orderBy("s", "m")
    return marks.where("claim <> ''").select("output_id", (F.row_number().over(order) - 1).alias("place"), "claim", "marker")


def last_sources(sources: DataFrame) -> DataFrame:
    """One source a (output_id, marker): the last by seq."""
    cols = [c for c in sources.columns if c not in ("output_id", "marker", "seq")]
    return sources.groupBy("output_id", "marker").agg(F.max_by(F.struct(*cols), "seq").alias("s")).select("output_id", "marker", "s.*")


def extract_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(output_id, idx, marker, url, title, passage, claim): marks that have a source, the first of each claim and mark."""
    walk = marker_walk(answers)
    first = walk.groupBy("output_id", "claim", "marker").agg(F.min("place").alias("place"))
    found = first.join(last_sources(sources), ["output_id", "marker"])
    order = Window.partitionBy("output_id").orderBy("place")
    return found.select(
        "output_id", (F.row_number().over(order) - 1).alias("idx"), "marker", "url", "title",
        F.coalesce(F.nullif("chunk_text", F.lit("")), F.col("snippet")).alias("passage"), "claim",
    )


def fallback_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(output_id, marker, url, passage): plain marks like [3] alone, one citation a mark, without claims."""
    marks = answers.select("output_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1))).alias("m"))
    marks = marks.select("output_id", F.col("m").try_cast("int").alias("marker"))
    return marks.join(last_sources(sources), ["output_id", "marker"]).select("output_id", "marker", "url", F.coalesce("chunk_text", "snippet").alias("passage"))


def refined_claims(citations: DataFrame, refinements: DataFrame) -> DataFrame:
    """Citations with the claims of (output_id, idx, supports) where these are not blank; the first of an index counts, and outputs whose counts differ stay as they are."""
    counts = citations.groupBy("output_id").agg(F.count("*").alias("have"))
    first = refinements.groupBy("output_id", "idx").agg(F.min_by("supports", "ord").alias("supports"), F.max("walked").alias("walked"))
    out = citations.join(counts, "output_id").join(first, ["output_id", "idx"], "left")
    better = (F.trim("supports") != "") & (F.col("walked") == F.col("have"))
    return out.withColumn("claim", F.when(better, F.trim("supports")).otherwise(F.col("claim"))).drop("have", "supports", "walked")


def corpus_lookup(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """Citations with ``record_url``: their exact url's record, else that of the canonical url; null without one.

    Two equi-joins, one a key: a condition with OR would take the hash join away.
    """
    exact = corpus.select(F.col("url").alias("exact_url")).distinct()
    plain = corpus.select(F.col("url").alias("plain_url")).distinct()
    out = citations.join(exact, citations["url"] == F.col("exact_url"), "left").withColumn("key", lookup_key(F.col("url")))
    out = out.join(plain, F.col("key") == F.col("plain_url"), "left")
    return out.withColumn("record_url", F.coalesce("exact_url", "plain_url")).drop("exact_url", "plain_url", "key")


def exact_passages(passages: DataFrame, docs: DataFrame, longest: int = 5) -> DataFrame:
    """(passage_id, doc_id) of documents that hold a passage, character for character.

    If they do, the passage's words but the first and the last, which may be cut, are whole words of
    the document. A hash of up to five of these is what both sides are joined on; a substring test
    confirms. Passages of one or two words have no such words and must be whole words of the document.
    Documents are hashed where they are read: one number a word is compared, texts only meet in hits.
    The passages are the small side, which Spark broadcasts where its size allows.
    """
    words = F.filter(F.split("passage", r"\s+"), lambda w: w != "")
    asked = passages.select("passage_id", "passage", words.alias("w")).where(F.size("w") > 0)
    inner = F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.least(F.size("w") - 2, F.lit(longest)))).otherwise(F.col("w"))
    asked = asked.select("passage_id", "passage", F.xxhash64(F.transform(inner, lambda w: F.xxhash64(w))).alias("key"), F.size(inner).alias("k"))
    # Words are hashed once, runs over the words' hashes; only lengths that a passage asks for are made (at most ``longest`` numbers).
    sizes = sorted(r["k"] for r in asked.select("k").distinct().collect())
    own = spread(docs.select("doc_id", "text")).select("doc_id", F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h"))

    def runs(k: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("h") - k + 1), lambda i: F.xxhash64(F.slice("h", i, F.lit(k))))
        return F.when(F.size("h") >= k, made).otherwise(F.array().cast("array<bigint>"))

    every = F.array_distinct(F.concat(*[runs(k) for k in sizes], F.array().cast("array<bigint>")))
    keys = own.select("doc_id", F.explode(every).alias("key"))
    hits = keys.join(asked.select("passage_id", "key"), "key").select("passage_id", "doc_id").distinct()
    both = hits.join(passages.select("passage_id", "passage"), "passage_id").join(docs.select("doc_id", "text"), "doc_id")
    return both.where(F.col("text").contains(F.col("passage"))).select("passage_id", "doc_id")


def doc_window(text: Column, snippet: Column, most: int) -> Column:
    """The text, or ``most`` characters of it around the snippet (or its first 60 characters), or its beginning."""
    exact = F.instr(text, snippet)
    head = F.substring(snippet, 1, 60)
    at = F.when(exact > 0, exact).when(F.length(snippet) > 60, F.instr(text, head)).otherwise(0)
    middle = at - 1 + F.floor(F.length(snippet) / 2).cast("int")
    start = F.least(F.greatest(middle - most // 2, F.lit(0)), F.length(text) - most)
    windowed = F.substring(text, (F.when(at > 0, start).otherwise(0) + 1).cast("int"), F.lit(most))
    return F.when(F.length(text) <= most, text).otherwise(windowed)


def packed_lengths(blocks: DataFrame, cap: int, head: int = 64, least: int = 200) -> DataFrame:
    """Blocks (output_id, ord, len) with ``taken``, their characters within a cap a output.

    All of them where they fit; else each its share, at least 200 characters, of what the heads leave.
    """
    w = Window.partitionBy("output_id")
    total, n = F.sum("len").over(w), F.count("*").over(w)
    budget = F.lit(cap) - head * n
    share = F.least(F.col("len"), F.greatest(F.lit(least), F.floor(F.col("len") / total * budget)))
    return blocks.withColumn("taken", F.when(total <= cap, F.col("len")).when(budget <= 0, 0).otherwise(share).cast("long"))


def first_by_url(citations: DataFrame) -> DataFrame:
    """The first citation of each (output_id, url) by idx."""
    cols = [c for c in citations.columns if c not in ("output_id", "url")]
    return citations.groupBy("output_id", "url").agg(F.min_by(F.struct(*cols), "idx").alias("c")).select("output_id", "url", "c.*")


def verdict_of(url: Column, known: Column, passage: Column, in_cited: Column, elsewhere: Column, claim: Column, judged: Column) -> Column:
    """A citation's verdict: fabricated without a known url or with a passage that its document lacks, partial without a claim, else the judge's."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    word = F.upper(F.trim(judged))
    said = F.when(word.startswith("SUPPORT"), "valid").when(word.startswith("PARTIAL"), "partial").otherwise("real_but_unsupportive")
    verdict = F.when(~has(url), "fabricated").when(~known, "fabricated").when(has(passage) & ~in_cited, "fabricated").when(~has(claim), "partial").otherwise(F.coalesce(said, F.lit("real_but_unsupportive")))
    found = F.when(~has(url) | ~known, False).when(has(passage) & ~in_cited, elsewhere).otherwise(True)
    return F.struct(verdict.alias("verdict"), found.alias("found"))


def faithfulness(checks: DataFrame, outputs: DataFrame) -> DataFrame:
    """(output_id, n, valid, partial, unsupportive, fabricated, score): the valid share; 1 for an output without citations."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    rows = checks.groupBy("output_id").agg(
        F.count("*").alias("n"), count("valid").alias("valid"), count("partial").alias("partial"),
        count("real_but_unsupportive").alias("unsupportive"), count("fabricated").alias("fabricated"),
    )
    out = outputs.select("output_id").join(rows, "output_id", "left").na.fill(0)
    return out.withColumn("score", F.when(F.col("n") == 0, 1.0).otherwise(F.col("valid") / F.col("n")))


def display_numbers(answers: DataFrame) -> DataFrame:
    """(output_id, marker, shown): marks by their first place in the text, numbered from 1."""
    marks = answers.select("output_id", F.posexplode(markers_in(F.col("answer"))).alias("place", "marker")).groupBy("output_id", "marker").agg(F.min("place").alias("place"))
    return marks.select("output_id", "marker", F.row_number().over(Window.partitionBy("output_id").orderBy("place")).alias("shown"))


def cited_only(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """Sources whose mark occurs in their answer."""
    marks = answers.select("output_id", F.explode(markers_in(F.col("answer"))).alias("marker")).distinct()
    return sources.join(marks, ["output_id", "marker"], "left_semi")


def recall(expected: DataFrame, cited: DataFrame) -> DataFrame:
    """(output_id, score, missing): matched over expected (output_id, key, ord), repeats counting; 1 without expectations is the caller's."""
    hit = expected.join(cited.select("output_id", "key").distinct().withColumn("hit", F.lit(True)), ["output_id", "key"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("key"))))
    return hit.groupBy("output_id").agg((F.count("hit") / F.count("*")).alias("score"), missing.alias("missing"))


def checked_citations(citations: DataFrame, checks: DataFrame, verdict: str = "real_but_unsupportive") -> DataFrame:
    """Citations (output_id, idx, ...) with the rationale of checks (output_id, citation_index, verdict, rationale) of one verdict; indexes that fit no citation are left out."""
    told = checks.where(F.col("verdict") == verdict).select("output_id", F.col("citation_index").alias("idx"), "verdict", "rationale")
    return citations.join(told, ["output_id", "idx"])


def evidence_block(number: Column, title: Column, url: Column, text: Column) -> Column:
    """A numbered block of evidence."""
    return F.concat(F.lit("[Source "), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit(" ("), url, F.lit(")\n"), text)
