"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations alone.

Lines at an edit distance of at most one (a character put in, left out or changed) are equal after
at most one deletion in each. So every line's variants with one character left out are emitted as
hashed keys, along with the line itself as a key for lines that are one longer, and equal keys are
joined. Four steps keep that linear:

* equal lines are one, which stands at its first occurrence;
* a line with a partner shares its first or its second half with it, so that lines whose halves no
  other line has emit nothing, and the others only leave out characters of the half that differs;
* of such a line, a block of about the root of its length is left out first: only blocks without
  which another line is the same go on to have single characters left out;
* a key's group is never paired off: all of its lines that leave out the same place are within one
  edit of each other, so that the earliest of them is the witness against all others.

Witnesses are then confirmed on the lines themselves. Lines that get so far are numbered in the order
of their first occurrences, so that what is joined are rows of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bitmap_table, discard, filter_bit, settled


def _numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, no, line) of all lines but blank ones; version tells texts of one doc_id apart."""
    # The text is hashed and parted once; beside the lines' own generator the hash would be made for each of them.
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("doc_id", "version", F.posexplode("lines").alias("no", "line"))
    return rows.where(F.col("line").rlike(r"[^ \t\r]"))


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line", F.hash("line"))})


def _part(line: Column, start: Column, size: Column) -> Column:
    """``size`` characters from position ``start``, counted from 0."""
    return F.substring(line, (start + 1).cast("int"), size.cast("int"))


def _half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the line's halves, as a string of its own length and as one that lacks a character of the next length."""
    h0, h1 = F.floor(n / 2), F.floor((n + 1) / 2)
    return [
        F.xxhash64(n, F.lit("first"), _part(line, F.lit(0), h0)),
        F.xxhash64(n, F.lit("second"), _part(line, h0, n)),
        F.xxhash64(n + 1, F.lit("first"), _part(line, F.lit(0), h1)),
        F.xxhash64(n + 1, F.lit("second"), _part(line, h1 - 1, n)),
    ]


def _only_in(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``col`` may be among ``ids`` (one column of that name), by a bitmap of bounded size; a join must follow."""
    mask = bitmap_table(ids, col)
    rows = rows.withColumn("__bit", filter_bit(col)).join(F.broadcast(mask), F.shiftright("__bit", 6) == F.col("word"))
    return rows.where(F.expr("(shiftright(mask, cast(__bit & 63 as int)) & 1L) = 1")).drop("__bit", "word", "mask")


def _blocks(texts: DataFrame) -> DataFrame:
    """(lid, own, start, middle, bkey): lines with a block left out, where ``sides`` asks for it.

    bkey is equal for lines that are the same but for that block; own is false for a line taken as
    one that lacks a character of the next length. The bits of sides say whether another line has the
    same first half, second half, and the same at the next length.
    """
    out = []
    for long_by, first, second in ((0, 1, 2), (1, 4, 8)):
        size = F.length("line") + long_by
        step = F.ceil(F.sqrt(size)).cast("int")
        half = F.floor(size / 2).cast("int")
        has = lambda bit: F.col("sides").bitwiseAND(F.lit(bit)) != 0
        # Places to leave out: the second half if the first is shared, and the other way round.
        low, high = F.when(has(second), F.lit(0)).otherwise(half), F.when(has(first), size).otherwise(half)
        rows = texts.where(has(first) | has(second)).select("lid", "line", size.alias("size"), step.alias("step"), low.alias("low"), high.cast("int").alias("high")).where("low < high")
        rows = rows.select("*", F.explode(F.sequence(F.floor(F.col("low") / F.col("step")), F.floor((F.col("high") - 1) / F.col("step")))).alias("block"))
        start = (F.col("block") * F.col("step")).cast("int")
        width = F.col("step") - long_by
        before, after = F.xxhash64(_part(F.col("line"), F.lit(0), start)), F.xxhash64(_part(F.col("line"), start + width, F.col("size")))
        out.append(rows.select("lid", F.lit(not long_by).alias("own"), start.alias("start"), _part(F.col("line"), start, width).alias("middle"), F.xxhash64("size", "block", before, after).alias("bkey")))
    return out[0].union(out[1])


def _variants(blocks: DataFrame) -> DataFrame:
    """(key, place, lid): each character of a block left out, and the block of a line that lacks one, at place -1."""
    own = blocks.where("own").select("lid", "bkey", "start", "middle", F.explode(F.sequence(F.lit(0), F.length("middle") - 1)).alias("k"))
    left_out = F.concat(_part(F.col("middle"), F.lit(0), F.col("k")), _part(F.col("middle"), F.col("k") + 1, F.length("middle")))
    cut = own.select(F.xxhash64("bkey", left_out).alias("key"), (F.col("start") + F.col("k")).cast("int").alias("place"), "lid")
    return cut.union(blocks.where("NOT own").select(F.xxhash64("bkey", "middle").alias("key"), F.lit(-1).alias("place"), "lid"))


def near_repeats(first: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2) of distinct lines of at least ``min_chars`` characters that have an earlier distinct one within one edit."""
    sides = F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("half"), F.lit(1 << i).alias("side")) for i in range(4)])).alias("x")
    posts = first.where(F.col("n") >= min_chars).select("h1", "h2", sides).select("h1", "h2", "x.half", "x.side")
    shared = settled(posts.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half"), "shared-halves")
    found = _only_in(posts, "half", shared).join(shared.hint("merge"), "half").groupBy("h1", "h2").agg(F.bit_or("side").alias("sides"))
    wanted = settled(first.select("h1", "h2", "at").join(found.hint("merge"), ["h1", "h2"]), "wanted-lines")

    # The lines themselves, at their first occurrences and numbered in that order.
    at = F.struct("doc_id", "version", "no")
    texts = _only_in(lines, "h1", wanted.select("h1")).select("h1", "h2", "line", at.alias("here")).join(wanted.hint("merge"), ["h1", "h2"])
    texts = texts.where(F.col("here").eqNullSafe(F.col("at"))).select("h1", "h2", "line", "at", "sides").dropDuplicates(["h1", "h2"])
    texts = settled(texts.orderBy("at").withColumn("lid", F.monotonically_increasing_id()).drop("at"), "open-texts")

    blocks = _blocks(texts)
    same = blocks.groupBy("bkey").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.max("own").alias("any")).where("lo < hi AND any").select("bkey")
    same = settled(same, "shared-blocks")
    made = settled(_variants(_only_in(blocks, "bkey", same).join(same.hint("merge"), "bkey")), "variants")
    places = made.groupBy("key", "place").agg(F.min("lid").alias("w"), F.max("lid").alias("last"))
    twice = places.where("place >= 0 AND w < last").select("key", "place", "w")
    mixed = places.groupBy("key").agg(
        F.min(F.when(F.col("place") < 0, F.col("w"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("w"))).alias("cut")
    ).where("whole IS NOT NULL AND cut IS NOT NULL")
    a = made.join(twice.hint("merge"), ["key", "place"]).select("lid", "w")
    b = made.join(mixed.hint("merge"), "key").select("lid", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.col("whole")).alias("w"))
    pairs = a.union(b).where("w < lid").distinct()

    # Confirmed on the lines themselves.
    both = pairs.join(texts.select("lid", "h1", "h2", "line").hint("merge"), "lid").join(texts.select(F.col("lid").alias("w"), F.col("line").alias("witness")).hint("merge"), "w")
    out = settled(both.where(F.levenshtein("line", "witness", 1).between(0, 1)).select("h1", "h2").distinct(), "near-lines")
    discard(shared, wanted, texts, same, made)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of the text, and two counts.

    Lines are parted by newlines; blank ones (spaces, tabs and carriage returns alone) stay.
    Occurrences are ordered by doc_id, then by their number in the text. A line goes if an earlier
    occurrence of the same line exists anywhere, or, where both have at least ``min_chars``
    characters, an earlier one within one edit (a character put in, left out or changed). New
    columns: n_lines (before) and n_removed.

    Cases: a null text stays null, with null counts; an empty one is one blank line, and stays. Rows
    that repeat doc_id and text are one document, treated alike; texts that share a doc_id are ordered
    by a hash. A null doc_id comes before all others. Equal lines within a text count, too: the first
    stays. A text whose lines all go becomes empty. An empty table gives no rows. Columns named
    n_lines or n_removed are replaced; others may have any name.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    lines = _hashed(_numbered_lines(base))
    at = F.struct("doc_id", "version", "no")
    # Every line is hashed where it is read: rows of a few numbers are shuffled, not lines.
    n = F.length("line")
    first = lines.select("h1", "h2", n.alias("n"), at.alias("at"), *[F.when(n >= min_chars, k).alias(f"k{i}") for i, k in enumerate(_half_keys(F.col("line"), n))])
    first = first.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.min("n").alias("n"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)], F.count("*").alias("times"))
    first = settled(first, "first-lines")
    near = near_repeats(first, lines, min_chars)

    touched = first.select("h1", "h2", "at", "times").join(near.withColumn("near", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
    touched = touched.where("times > 1 OR near").select("h1", "h2", F.col("at").alias("stays"), F.coalesce("near", F.lit(False)).alias("near"))
    touched = settled(touched, "touched-lines")
    gone = _only_in(lines.select("doc_id", "version", "no", "h1", "h2"), "h1", touched.select("h1")).join(touched.hint("merge"), ["h1", "h2"])
    gone = gone.where(F.col("near") | ~at.eqNullSafe(F.col("stays"))).groupBy("doc_id", "version").agg(F.collect_set("no").alias("gone"))
    gone = settled(gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("gone").alias("__gone")), "gone-lines")
    discard(first, near, touched)

    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*kept, F.xxhash64(text_col).alias("__hash"))
    rows = rows.join(gone.hint("merge"), rows[id_col].eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__version")), "left")
    # The lines are a column of their own, so that the text is parted once; places that stay are found by hashing those that go.
    rows = rows.withColumn("__parts", F.split(text_col, "\n", -1))
    parts = F.col("__parts")
    removed = F.size(F.coalesce("__gone", F.array().cast("array<int>")))
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone")
    text = F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n")
    return rows.select(
        *[F.when(removed > 0, text).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in kept],
        F.when(F.col(text_col).isNotNull(), F.size(parts)).alias("n_lines"),
        F.when(F.col(text_col).isNotNull(), removed).alias("n_removed"),
    )


ORACLE = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, i AS no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts) WHERE regexp_matches(p[i], '[^ \t\r]')),
uniq AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + no) AS occ FROM lines GROUP BY line),
keys AS (
  SELECT line, n, occ, 2 * n AS k, substr(line, 1, n // 2) AS h FROM uniq WHERE n >= 20
  UNION ALL SELECT line, n, occ, 2 * n + 1, substr(line, n // 2 + 1) FROM uniq WHERE n >= 20
  UNION ALL SELECT line, n, occ, 2 * n + 2, substr(line, 1, (n + 1) // 2) FROM uniq WHERE n >= 20
  UNION ALL SELECT line, n, occ, 2 * n + 3, substr(line, (n + 1) // 2) FROM uniq WHERE n >= 20),
near AS (SELECT DISTINCT a.line FROM keys a JOIN keys b ON a.k = b.k AND a.h = b.h WHERE b.occ < a.occ AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT l.doc_id, l.no FROM lines l JOIN uniq u ON l.line = u.line
  WHERE l.doc_id * 1000000 + l.no > u.occ OR l.line IN (SELECT line FROM near)),
removed AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id),
every AS (SELECT doc_id, i AS no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
stay AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.no) AS text
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.no = g.no WHERE g.no IS NULL GROUP BY e.doc_id)
SELECT p.doc_id, coalesce(s.text, '') AS text, len(p.p) AS n_lines, coalesce(r.c, 0) AS n_removed
FROM parts p LEFT JOIN removed r ON p.doc_id = r.doc_id LEFT JOIN stay s ON p.doc_id = s.doc_id
"""
