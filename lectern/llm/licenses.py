"""License scan by ordered signature rules over a text's words.

A text that has no stem of a keyword is done with once its words are counted. In others, the places
of keywords are found, and at each the rules of that keyword are tried on the words around it: first the word that
a rule needs, then its expression. Of the rules that fit at a place the first by level,
length and order is its detection; of detections that overlap, a higher level wins, and of the same level
one that contains the other. All of it happens within a row, on arrays of Catalyst expressions: nothing is shuffled,
and no Python runs. The rules are a fixed list that the plan carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import KEYWORDS, RULES, Rule

#: A word, capitals included: digits, letters and all that is not ASCII. Java takes eight times as long over the complement of what parts words.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words before and after a keyword that a rule may take in.
SPAN = 24
#: Every keyword has one of these; the last at the start of a word.
STEMS = ("licen", "gpl", "gfdl", "spdx", "commons", "domain", "wtfpl", "copyleft", "permission", "redistribution", "cc")
#: Phrases that are counted at all their places, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: How sure a detection of a level is.
SURE = {3: 1.0, 2: 0.8, 1: 0.4}
DETECTION = "struct<level:int,words:int,rank:int,first:int,last:int,label:string>"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _whole(pattern: str) -> str:
    """A pattern for whole words of a window, as its first group."""
    return f"(?:^| )({pattern})(?: |$)"


def may_have(text: Column) -> Column:
    """Whether a text has a stem of a keyword."""
    small = F.lower(text)
    found = small.contains(STEMS[-1]) & small.rlike(f"(?<![0-9a-z]){STEMS[-1]}")
    for stem in STEMS[:-1]:
        found |= small.contains(stem)
    return found


def _rules_of(rules: list[Rule], kind: str) -> Column:
    """The rules of a kind as a constant array, in their order."""
    rows = [f"named_struct('level', {r.level}, 'rank', {-r.number}, 'label', {_text(r.label)}, 'needs', {_text(r.needs)}, 'pattern', {_text(_whole(r.pattern))})" for r in rules if r.kind == kind]
    none = "filter(array(named_struct('level', 0, 'rank', 0, 'label', '', 'needs', '', 'pattern', '')), x -> false)"
    return F.expr(f"array({', '.join(rows)})" if rows else none)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _matched(window: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", window, pattern, F.lit(1))


def _placed(text: Column, at: Column) -> tuple[Column, Column]:
    """First and last word of a match, whose keyword has an @ and stands at word ``at``."""
    first = at - _spaces(F.substring_index(text, "@", 1))
    return first.cast("int"), (first + _spaces(text)).cast("int")


def _base_at(hit: Column) -> Column:
    """The base phrase whose keyword this is, as a detection; null without one. No two phrases share a keyword's place."""
    found = F.lit(None)
    for phrase, label in BASE.items():
        head, _, last = phrase.rpartition(" ")
        marked = f"@{phrase}" if last not in KEYWORDS["licence"] else f"{head} @{last}"
        text = _matched(hit["window"], F.lit(_whole(marked)))
        first, stop = _placed(text, hit["at"])
        made = F.struct(F.lit(2).alias("level"), (_spaces(text) + 1).alias("words"), F.lit(0).alias("rank"), first.alias("first"), stop.alias("last"), F.lit(label).alias("label"))
        found = F.when(text != "", made).otherwise(found.cast(DETECTION))
    return found


def _best_at(hit: Column, rules: list[Rule]) -> Column:
    """The first rule by level, length and order that fits at a keyword, as a detection; null without one."""

    def tried(rule: Column) -> Column:
        text = _matched(hit["window"], rule["pattern"])
        first, last = _placed(text, hit["at"])
        return F.struct(rule["level"].alias("level"), F.when(text != "", _spaces(text) + 1).alias("words"), rule["rank"].alias("rank"), first.alias("first"), last.alias("last"), rule["label"].alias("label"))

    found = F.lit(None).cast(DETECTION)
    for kind, words in KEYWORDS.items():
        near = F.filter(_rules_of(rules, kind), lambda r: hit["window"].contains(r["needs"]))
        best = F.array_max(F.filter(F.transform(near, tried), lambda x: x["words"].isNotNull()))
        found = F.when(hit["word"].isin(words.split()), best).otherwise(found)
    return found


def _kept(all_found: Column) -> Column:
    """Detections that none beats. Two overlap only if their keywords are within twice the span, and each place has one detection at most: neighbours suffice."""

    def beats(e: Column, d: Column) -> Column:
        overlap = (e["first"] <= d["last"]) & (d["first"] <= e["last"])
        inside = (e["first"] <= d["first"]) & (d["last"] <= e["last"])
        first = (e["words"] > d["words"]) | (e["rank"] > d["rank"])
        return (overlap & (e["level"] > d["level"])) | (inside & (e["level"] == d["level"]) & first)

    near = lambda i: F.slice(all_found, F.greatest(i - 2 * SPAN + 1, F.lit(1)), 4 * SPAN + 1)
    return F.filter(all_found, lambda d, i: ~F.exists(near(i), lambda e: beats(e, d)))


def _labels(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: x["label"]))


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with n_words, base (array of detections of the base phrases), detections (array), and score in place of the text.

    A detection has level, words, rank, first, last (places of words from 0) and label. A rule spans at most ``SPAN`` words on either
    side of its keyword. A detection is beaten by any other that overlaps it and has a higher level, or that contains it at its own
    level and is longer or, for the same words, comes earlier in the list; whether that one stays is not asked. Base phrases are never beaten.
    score is how sure the surest detection or base phrase is, 0 without any. A null or empty text has no words; repeated rows count each;
    texts are scanned whole; the other columns stay, and those of the names above are replaced.
    """
    made = ["n_words", "base", "detections", "score"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in docs.columns if c not in (text_col, *made)]
    words = F.when(may_have(text), F.regexp_extract_all(F.translate(text, CAPITALS, CAPITALS.lower()), F.lit(WORD), F.lit(0)))
    rows = docs.select(*others, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), words.alias("__words"))
    keywords = [w for ws in KEYWORDS.values() for w in ws.split()]
    places = F.filter(F.transform("__words", lambda w, i: F.when(w.isin(keywords), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("__places", F.when(F.col("__words").isNotNull(), places))

    def around(i: Column) -> Column:
        before = F.slice("__words", F.greatest(i - SPAN + 1, F.lit(1)), F.least(i, F.lit(SPAN)))
        after = F.slice("__words", i + 2, SPAN)
        word = F.get("__words", i)
        window = F.array_join(F.concat(before, F.array(F.concat(F.lit("@"), word)), after), " ")
        return F.struct(i.alias("at"), word.alias("word"), window.alias("window"))

    rows = rows.withColumn("__hits", F.transform("__places", around)).drop("__words", "__places")
    found = lambda f: F.coalesce(F.filter(F.transform("__hits", f), lambda x: x.isNotNull()), F.array().cast(f"array<{DETECTION}>"))
    rows = rows.select(*others, "n_words", found(_base_at).alias("base"), found(lambda h: _best_at(h, rules)).alias("__found"))
    rows = rows.withColumn("detections", _kept(F.col("__found"))).drop("__found")
    level = F.array_max(F.transform(F.concat("base", "detections"), lambda x: x["level"]))
    score = F.lit(0.0)
    for n, sure in SURE.items():
        score = F.when(level == n, sure).otherwise(score)
    return rows.withColumn("score", score)


def label_columns(scanned: DataFrame) -> DataFrame:
    """Rows of ``scan_licenses`` with n_base, first_word, last_word, base_labels and labels in place of the arrays."""
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    first = F.transform("base", lambda x: x["first"])
    return scanned.select(
        *[c for c in scanned.columns if c not in ("base", "detections", "score")],
        F.size("base").cast("long").alias("n_base"), F.array_min(first).cast("long").alias("first_word"), F.array_max(first).cast("long").alias("last_word"),
        joined(_labels(F.col("base"))).alias("base_labels"), joined(F.array_union(_labels(F.col("base")), _labels(F.col("detections")))).alias("labels"), "score",
    )


def _oracle() -> str:
    """The same in SQL for DuckDB, as joins: keywords with rules, detections with their neighbours."""
    kinds = ", ".join(f"({_text(w)}, {_text(k)})" for k, ws in KEYWORDS.items() for w in ws.split())
    rules = ", ".join(f"({r.number}, {_text(r.kind)}, {r.level}, {_text(r.label)}, {_text(r.needs)}, {_text(_whole(r.pattern))})" for r in RULES)
    phrases = ", ".join(f"({_text(p)}, {_text(x)}, {len(p.split())})" for p, x in BASE.items())
    firsts = ", ".join(_text(w) for w in dict.fromkeys([p.split()[0] for p in BASE] + [w for ws in KEYWORDS.values() for w in ws.split()]))
    sure = " ".join(f"WHEN {n} THEN {s}" for n, s in SURE.items())
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH keywords(word, kind) AS (VALUES {kinds}),
rules(number, kind, level, label, needs, pattern) AS (VALUES {rules}),
phrases(phrase, label, n) AS (VALUES {phrases}),
d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '{pattern}') AS words FROM documents
), places AS (
    SELECT r, words, unnest(list_filter(range(len(words)), lambda i: list_contains([{firsts}], words[i + 1]))) AS pos FROM d
), base AS (
    SELECT r, pos AS first, label FROM places JOIN phrases ON words[pos + 1] = split_part(phrase, ' ', 1) AND array_to_string(words[pos + 1 : pos + n], ' ') = phrase
), hits AS (
    SELECT r, pos, kind, array_to_string(list_concat(words[greatest(pos - {SPAN} + 1, 1) : pos], ['@' || word], words[pos + 2 : pos + 1 + {SPAN}]), ' ') AS win
    FROM places JOIN keywords ON word = words[pos + 1]
), tried AS (
    SELECT r, pos, number, level, label, regexp_extract(win, pattern, 1) AS m FROM hits JOIN rules USING (kind) WHERE contains(win, needs)
), fits AS (
    SELECT *, pos - (length(split_part(m, '@', 1)) - length(replace(split_part(m, '@', 1), ' ', ''))) AS first, length(m) - length(replace(m, ' ', '')) + 1 AS n FROM tried WHERE m <> ''
), best AS (
    SELECT *, first + n - 1 AS last FROM fits QUALIFY row_number() OVER (PARTITION BY r, pos ORDER BY level DESC, n DESC, number) = 1
), kept AS (
    SELECT * FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM best e WHERE e.r = b.r AND e.pos <> b.pos AND e.first <= b.last AND b.first <= e.last
        AND (e.level > b.level OR (e.level = b.level AND e.first <= b.first AND b.last <= e.last AND (e.n > b.n OR e.number < b.number))))
), labelled AS (
    SELECT r, label, 2 AS level FROM base UNION ALL SELECT r, label, level FROM kept
)
SELECT doc_id, len(words)::BIGINT AS n_words,
    (SELECT count(*) FROM base b WHERE b.r = d.r) AS n_base, (SELECT min(first) FROM base b WHERE b.r = d.r) AS first_word, (SELECT max(first) FROM base b WHERE b.r = d.r) AS last_word,
    coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM base b WHERE b.r = d.r), '') AS base_labels,
    coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM labelled b WHERE b.r = d.r), '') AS labels,
    (CASE (SELECT max(level) FROM labelled b WHERE b.r = d.r) {sure} ELSE 0.0 END)::DOUBLE AS score
FROM d
"""


ORACLE = _oracle()
