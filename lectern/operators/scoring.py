"""Deterministic scorers: numbers with tolerances, hedges, votes, weighted composites.

A judge's replies are rows of a table, joined by request; a missing or broken reply takes the
scorer's own default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words for probabilities, in the order in which they count, and groups of hedges that stand for each other.
WORD_VALUES = {"half": 0.5, "a third": 0.33, "two thirds": 0.67, "a quarter": 0.25, "three quarters": 0.75}
HEDGE_GROUPS = (
    ("~", "around", "approximately", "roughly", "about", "circa"),
    ("might", "may", "could", "possibly", "perhaps"),
    ("likely", "probably", "we estimate", "we think", "our best guess"),
    ("highly likely", "very likely"),
    ("somewhat unlikely", "unlikely"),
    ("plausibly", "plausible", "at least"),
)
# Fixed value: the grammar of numbers in answers.
NUMBER = r"(?i)(-)?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|x|×|fold|-fold|percent|percentage\s+points?|trillion|billion|million)?"
# What words after a number multiply it by.
SCALES = {"trillion": 1e12, "billion": 1e9, "million": 1e6}


def _unit_of(suffix: Column) -> Column:
    return (
        F.when((suffix == "%") | suffix.startswith("percent"), "%").when(suffix.isin("x", "×"), "x").when(suffix.isin("fold", "-fold"), "fold").otherwise(suffix)
    )


def number_candidates(text: Column, unit: Column) -> Column:
    """Array of (value, unit) of the numbers in a text, words for probabilities first where these are asked for."""
    lower = F.lower(text)
    entry = lambda value, kind: F.struct(value.alias("value"), kind.alias("unit"))
    words = F.array(*[F.when((unit == "probability") & lower.rlike(rf"\b{w}\b"), entry(F.lit(v), F.lit("word"))) for w, v in WORD_VALUES.items()])
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(NUMBER), 1).alias("sign"), F.regexp_extract_all(text, F.lit(NUMBER), 2).alias("digits"), F.regexp_extract_all(text, F.lit(NUMBER), 3).alias("suffix")
    )

    def read(p: Column) -> Column:
        n = F.replace(p["digits"], F.lit(","), F.lit("")).try_cast("double") * F.when(p["sign"] == "-", -1.0).otherwise(1.0)
        kind = _unit_of(F.lower(F.trim(p["suffix"])))
        scale = F.when((kind == "%") & F.coalesce(unit == "probability", F.lit(False)), F.lit(0.01))
        for word, factor in SCALES.items():
            scale = scale.when(kind == word, factor)
        return entry(F.when((kind == "%") & F.coalesce(unit == "probability", F.lit(False)), n / 100.0).otherwise(n * scale.otherwise(1.0)), kind)

    return F.concat(F.filter(words, lambda x: x.isNotNull()), F.transform(parts, read))


def first_number(text: Column, unit: Column) -> Column:
    """The first number that fits the unit, else the first of all, else null."""
    every = number_candidates(text, unit)
    fits = lambda c: (
        F.when(unit == "x", c["unit"].isin("x", "fold")).when(unit == "probability", c["unit"].isin("%", "word") | ((c["unit"] == "") & c["value"].between(0.0, 1.0))).otherwise(True)
    )
    return F.coalesce(F.get(F.filter(every, fits), 0)["value"], F.get(every, 0)["value"])


def within(value: Column, target: Column, relative: Column, absolute: Column) -> Column:
    return F.coalesce(F.abs(value - target) <= F.greatest(relative * F.abs(target), absolute), F.lit(False))


def _shows(text: Column, group: tuple[str, ...]) -> Column:
    """Whether a text has one of a group's hedges."""
    words = [h for h in group if h != "~"]
    found = text.rlike(rf"\b(?:{'|'.join(words)})\b")
    return found | text.contains("~") if "~" in group else found


def missing_hedges(answer: Column, hedges: Column) -> Column:
    """The hedges of which an answer has neither the word nor another of its group; an answer is searched once a group."""
    lower = F.lower(answer)
    seen = F.struct(lower.alias("text"), *[_shows(lower, g).alias(f"g{i}") for i, g in enumerate(HEDGE_GROUPS)])

    def lacks(shown: Column, h: Column) -> Column:
        kept = F.when(F.lit(False), F.lit(True))
        for i, g in enumerate(HEDGE_GROUPS):
            kept = kept.when(h.isin(*g), shown[f"g{i}"])
        return ~kept.otherwise(F.regexp_like(shown["text"], F.concat(F.lit(r"\b\Q"), h, F.lit(r"\E\b"))))

    # A lambda's variable is computed once, whatever the number of hedges.
    return F.get(F.transform(F.array(seen), lambda shown: F.filter(hedges, lambda h: lacks(shown, F.lower(h)))), 0)


def majority(votes: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    """(keys, verdict, n): the most frequent verdict of three; of equals the one whose value is nearest to the votes' mean, in the order given.

    The nearest may be one for which nobody voted. Votes other than the three are left out.
    """
    names = list(values)
    value = F.lit(None).cast("double")
    for v, x in values.items():
        value = F.when(F.col("verdict") == v, x).otherwise(value)
    rows = votes.where(F.col("verdict").isin(names)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), *[F.count_if(F.col("verdict") == v).alias(f"c{i}") for i, v in enumerate(names)]
    )
    most = F.greatest(*[F.col(f"c{i}") for i in range(len(names))])
    leaders = sum((F.col(f"c{i}") == most).cast("int") for i in range(len(names)))
    alone = F.coalesce(*[F.when(F.col(f"c{i}") == most, F.lit(v)) for i, v in enumerate(names)])
    gaps = [F.abs(F.col("mean") - x) for x in values.values()]
    nearest = F.coalesce(*[F.when(g == F.least(*gaps), F.lit(v)) for g, v in zip(gaps, names)])
    return rows.select(*keys, F.when(leaders == 1, alone).otherwise(nearest).alias("verdict"), "n")


RUBRIC = {"PRESENT": 1.0, "PARTIAL": 0.5, "MISSING": 0.0}
INTEGRATION = {"INTEGRATED": 1.0, "PARTIAL": 0.5, "LIST_ONLY": 0.0}


def rubric_fractions(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, present, at_least_partial): shares of elements that are present, and with half of a partial one."""
    present, partial = F.count_if(F.col("verdict") == "PRESENT"), F.count_if(F.col("verdict") == "PARTIAL")
    return verdicts.groupBy(by).agg((present / F.count("*")).alias("present"), ((present + 0.5 * partial) / F.count("*")).alias("at_least_partial"))


def with_rationale(votes: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Merged verdicts with the rationale of the first pass that voted so, else of the first pass."""
    both = votes.join(merged.select(*keys, F.col("verdict").alias("winner")), keys)
    said = F.min_by(F.when(F.col("verdict") == F.col("winner"), F.col("rationale")), F.when(F.col("verdict") == F.col("winner"), F.col("pass")))
    return both.groupBy(*keys).agg(F.first("winner").alias("verdict"), F.coalesce(said, F.min_by("rationale", "pass")).alias("rationale"))


def ensemble(replies: DataFrame, key: str) -> DataFrame:
    """(key, majority, all_agree, first): the most frequent text (of equals the first seen), the text all give or DISAGREE, and the first."""
    counts = replies.groupBy(key, "text").agg(F.count("*").alias("c"), F.min("ord").alias("o"))
    return counts.groupBy(key).agg(
        F.min_by("text", F.struct((-F.col("c")).alias("c"), F.col("o"))).alias("majority"),
        F.when(F.count("*") == 1, F.min("text")).otherwise("DISAGREE").alias("all_agree"), F.min_by("text", "o").alias("first"),
    )


def head_verdict(reply: Column, verdicts: tuple[str, ...], default: str) -> Column:
    """The verdict with which the first line that is not blank begins, as a whole word."""
    first = F.regexp_extract(F.upper(reply), r"^\s*(\S[^\n]*)", 1)
    word = F.regexp_extract(first, "^(" + "|".join(verdicts) + r")\b", 1)
    return F.when(F.coalesce(word, F.lit("")) == "", default).otherwise(word)


def support_score(answer_chars: Column, unsupported: Column) -> Column:
    """1 without unsupported claims, else 1 less their share of the claims that an answer of its length has (150 characters each, 1 to 20), at least 0.10."""
    claims = F.greatest(F.lit(1), F.least(F.lit(20), F.floor(answer_chars / 150)))
    return F.when(unsupported == 0, 1.0).otherwise(F.floor(F.greatest(F.lit(0.10), 1 - unsupported / claims) * 1000 + 0.5) / 1000)


def answer_support(answer: Column, evidence: Column, unsupported: Column) -> Column:
    """1 for an empty answer, 0.5 without evidence, else by unsupported claims; a broken reply counts none."""
    return F.when(F.trim(answer) == "", 1.0).when(evidence == 0, 0.5).otherwise(support_score(F.length(answer), F.coalesce(unsupported, F.lit(0))))


#: Weights of the parts of each track's composite (fixed values).
COMPOSITES = {
    "claim_recall": {"correctness": 0.5, "hedge": 0.2, "cite": 0.15, "support": 0.15},
    "definitions": {"verbal": 0.6, "cite": 0.2, "support": 0.2},
    "arguments": {"rubric": 0.6, "cite": 0.2, "support": 0.2},
    "synthesis": {"recall": 0.25, "rubric": 0.25, "integration": 0.2, "cite": 0.15, "support": 0.15},
    "gate": {"behaviour": 1.0},
    "open_research": {"rubric": 0.7, "cite": 0.3},
}


def composite(track: str) -> Column:
    """The weighted sum of a track's parts, from columns of their names."""
    return sum(F.col(name) * weight for name, weight in COMPOSITES[track].items())


def target_text(phrasings: Column, value: Column, unit: Column) -> Column:
    """The first accepted phrasing, else the target's number and unit, else nothing."""
    return F.coalesce(F.get(phrasings, 0), F.trim(F.concat(value.cast("string"), F.lit(" "), F.coalesce(unit, F.lit("")))), F.lit(""))


def correctness(claim_type: Column, target: Column, numeric_score: Column, phrasings: Column, verdict: Column) -> Column:
    """An item's correctness: the numeric score of a numeric item with a target, else the verdict's value where there are phrasings, else 0."""
    said = F.when(verdict == "MATCH", 1.0).when(verdict == "PARTIAL", 0.5).otherwise(0.0)
    numeric = F.coalesce((claim_type == "numeric") & target.isNotNull(), F.lit(False))
    return F.when(numeric, numeric_score).when(F.coalesce(F.size(phrasings) > 0, F.lit(False)), said).otherwise(0.0)
