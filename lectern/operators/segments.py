"""A search index of immutable segments: documents come, go and are replaced without indexing the others anew.

A segment is a folder of tables: its documents, postings in runs in the order of terms, the greatest frequency and least
length of each term's postings in each block of documents, and n-grams of heads. A version lists the segments and what has been dropped from
them; it is written whole, under the next number, so that a reader sees one version or the other. Counts of the corpus are
sums over segments less those of dropped documents, and so equal those of an index built anew.

A search reads the block maxima of its terms first. The blocks that could hold the best scores are scored; those that cannot reach the k-th score found there
are never read. The ranks are those of scoring everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PERSON_TERMS, looks_like_references
from ..functions.values import rounded
from ..sources.shared import shared_dir, spread, stored
from .index import RUN, counted, postings, runs_of, token_counts, weighed
from .search import FEW, K1, PEOPLE_FACTOR, PER_URL, REFERENCE_FACTOR, TITLE_BONUS, B, asked_terms

#: Documents of a block, blocks of a query that are scored first, and segments of like size that are merged into one.
BLOCK, FIRST, MERGE = 512, 8, 4
#: Lengths of the n-grams of heads.
GRAMS = (1, 2, 3)
#: Scores are rounded to places well above this.
SLACK = 1e-2
VERSION = "segment string, records long, tokens long, drops array<string>, gone long, gone_tokens long"
TABLES = ("documents", "postings", "blocks", "terms", "grams")
_STORED: dict[tuple, str] = {}


def block_maxima(documents: DataFrame) -> DataFrame:
    """(term, block, n, tf, dl, tokens) of documents (ord, text): number, greatest count and least length of a term's postings, a row for each run that has documents of the block."""
    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords = batch.column(0).to_numpy()
            for first, texts in runs_of(batch.column(1)):
                terms, term, at, n, dl = token_counts(texts)
                if not len(term):
                    continue
                block = ords[first + at] // size
                order = np.lexsort((block, term))
                term, block, n, dl = term[order], block[order], n[order], dl[at[order]]
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(block) != 0)]))
                sums = [np.diff(np.append(starts, len(term))), np.maximum.reduceat(n, starts), np.minimum.reduceat(dl, starts), np.add.reduceat(n, starts)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                columns = [terms.take(pa.array(term[starts])), pa.array(block[starts], pa.int64()), *(pa.array(c, k) for c, k in zip(sums, kinds))]
                yield pa.record_batch(columns, names=["term", "block", "n", "tf", "dl", "tokens"])

    return documents.select("ord", "text").mapInArrow(run, "term string, block long, n long, tf long, dl int, tokens long")


def grams(documents: DataFrame) -> DataFrame:
    """(gram, ord) of the different n-grams of heads (ord, hay), in runs in the order of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, heads in runs_of(batch.column(1), RUN >> 4):
                parts = [[h[i : i + n].encode() for n in GRAMS for i in range(len(h) - n + 1)] for h in heads]
                made, gram, at, _, _ = counted(parts)
                yield pa.record_batch([made.take(pa.array(gram)), batch.column(0).take(pa.array(first + at))], names=["gram", "ord"])

    return documents.select("ord", "hay").where(F.col("hay") != "").mapInArrow(run, "gram string, ord long")


def weight(idf: Column, tf: Column, dl: Column, mean: Column) -> Column:
    """A term's part of a score; it grows with tf and falls with dl, so that the greatest and the least of a block bound it."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


class Segments:
    """The index in a folder, of chunks (id, ordinal, url, title, authors, topics, section, category, text); columns that are missing count as null."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "chunk_id"):
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col

    # Versions

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest version that was written to its end; 0 before the first."""
        path, files = self._files()
        if not files.exists(path):
            return 0
        child = lambda f, name: self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), name)
        return max((int(f.getPath().getName()) for f in files.listStatus(path) if files.exists(child(f, "_SUCCESS"))), default=0)

    def segments(self, version: int | None = None) -> list[dict]:
        """What a version, by default the newest, lists."""
        n = self.version() if version is None else version
        return [r.asDict() for r in self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/{n}").collect()] if n else []

    def _commit(self, rows: list[dict], seen: int) -> None:
        """Write the next version after ``seen``; a writer that was overtaken fails here and changes nothing."""
        order = [c.split()[0] for c in VERSION.replace("array<string>", "x").split(", ")]
        made = self.spark.createDataFrame([tuple(r[c] for c in order) for r in sorted(rows, key=lambda r: r["segment"])], VERSION)
        made.coalesce(1).write.mode("error").parquet(f"{self.path}/versions/{seen + 1}")

    def _table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment}/{name}")

    def _every(self, name: str, segments: list[dict]) -> DataFrame:
        """A table of all segments, with the segment's name."""
        out = None
        for s in segments:
            one = self._table(s["segment"], name).withColumn("segment", F.lit(s["segment"]))
            out = one if out is None else out.unionByName(one)
        return out

    def _dropped(self, segments: list[dict], name: str) -> DataFrame | None:
        """``documents`` (segment, ord) or ``terms`` (segment, term, df) of what has been dropped."""
        out = None
        for s in segments:
            for d in s["drops"]:
                one = self.spark.read.parquet(f"{self.path}/segments/{s['segment']}/drops/{d}/{name}").withColumn("segment", F.lit(s["segment"]))
                out = one if out is None else out.unionByName(one)
        return out

    def _live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows (segment, ord) without those of dropped documents."""
        gone = self._dropped(segments, "documents")
        return rows if gone is None else rows.join(gone.select("segment", "ord"), ["segment", "ord"], "left_anti")

    # Writing

    def _write(self, documents: DataFrame, name: str) -> dict:
        """The tables of a segment, from its documents (as stored).

        Texts are counted in the tasks that read them, in runs in the order of terms, so that postings are neither shuffled
        nor sorted: files have as many runs as texts fill, and a search skips the pages of a run that lack its terms.
        """
        place = f"{self.path}/segments/{name}"
        documents.write.parquet(f"{place}/documents")
        texts = spread(self._table(name, "documents"))
        postings(texts, "ord").select("term", F.floor(F.col("ord") / BLOCK).alias("block"), "ord", "dl", "tf").write.parquet(f"{place}/postings")
        block_maxima(texts).write.parquet(f"{place}/blocks")
        blocks = self._table(name, "blocks")
        blocks.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{place}/terms")
        grams(texts).write.parquet(f"{place}/grams")
        records = self._table(name, "documents").count()
        return {"segment": name, "records": records, "tokens": blocks.agg(F.sum("tokens")).first()[0] or 0, "drops": [], "gone": 0, "gone_tokens": 0}

    def _documents(self, chunks: DataFrame) -> DataFrame:
        have = set(chunks.columns)
        kinds = {"authors": "array<string>", "topics": "array<string>", "ordinal": "long"}
        col = lambda c: F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string"))
        hay = F.lower(F.concat_ws(" ", col("title"), F.concat_ws(" ", col("authors")), F.concat_ws(" ", col("topics")), col("section")))
        return chunks.select(
            F.monotonically_increasing_id().alias("ord"), F.col(self.id_col).alias("id"), col("ordinal").alias("ordinal"), col("url").alias("url"), col("category").alias("category"), hay.alias("hay"),
            F.coalesce(looks_like_references(F.col("text"), col("section")), F.lit(False)).alias("is_list"), "text",
        )

    def add(self, chunks: DataFrame) -> None:
        """A segment of new chunks; their ids must not be in the index."""
        seen = self.version()
        made = self._write(self._documents(spread(chunks)), uuid.uuid4().hex)
        self._commit([*self.segments(seen), made], seen)

    def _drops(self, ids: DataFrame, segments: list[dict]) -> list[dict]:
        """The segments with the documents of ``ids`` (one column) dropped."""
        out, ids = [], ids.select(F.col(ids.columns[0]).alias("id")).where("id IS NOT NULL").distinct()
        for s in segments:
            name = uuid.uuid4().hex
            place = f"{self.path}/segments/{s['segment']}/drops/{name}"
            found = self._table(s["segment"], "documents").select("id", "ord").join(ids, "id", "left_semi").withColumn("segment", F.lit(s["segment"]))
            self._live(found, [s]).select("ord").write.parquet(f"{place}/documents")
            gone = self.spark.read.parquet(f"{place}/documents")
            if not (n := gone.count()):
                out.append(s)
                continue
            texts = self._table(s["segment"], "documents").select("ord", "text").join(gone, "ord", "left_semi")
            block_maxima(texts).groupBy("term").agg(F.sum("n").alias("df"), F.sum("tokens").alias("tokens")).write.parquet(f"{place}/terms")
            tokens = self.spark.read.parquet(f"{place}/terms").agg(F.sum("tokens")).first()[0] or 0
            out.append(s | {"drops": [*s["drops"], name], "gone": s["gone"] + n, "gone_tokens": s["gone_tokens"] + tokens})
        return out

    def drop(self, ids: DataFrame) -> None:
        """Drop documents by id; ids that are not there count for nothing."""
        seen = self.version()
        self._commit(self._drops(ids, self.segments(seen)), seen)

    def replace(self, chunks: DataFrame) -> None:
        """New chunks in place of those with their ids, in one version; chunks with new ids are added."""
        seen = self.version()
        made = self._write(self._documents(spread(chunks)), uuid.uuid4().hex)
        ids = self._table(made["segment"], "documents").select("id")
        self._commit([*self._drops(ids, self.segments(seen)), made], seen)

    def merge(self, factor: int = MERGE) -> None:
        """Merge segments of like size, from ``factor`` of one power of it on, into one without what was dropped; texts are counted anew, which takes less than moving their postings.

        A segment that has lost more than half of its documents counts as smaller, and so is merged sooner.
        """
        seen = self.version()
        now, tiers = self.segments(seen), {}
        for s in now:
            live, tier = s["records"] - s["gone"], 0
            while live >= factor:
                live, tier = live // factor, tier + 1
            tiers.setdefault(tier, []).append(s)
        for group in [g for g in tiers.values() if len(g) >= factor]:
            old = self._live(self._every("documents", group), group).drop("segment").withColumn("ord", F.monotonically_increasing_id())
            made = self._write(old, uuid.uuid4().hex)
            gone = {s["segment"] for s in group}
            now = [s for s in now if s["segment"] not in gone] + [made]
        self._commit(now, seen)

    # Reading

    def statistics(self, segments: list[dict] | None = None) -> tuple[int, int]:
        """(documents, tokens) that are in the index."""
        now = self.segments() if segments is None else segments
        return sum(s["records"] - s["gone"] for s in now), sum(s["tokens"] - s["gone_tokens"] for s in now)

    def frequencies(self, segments: list[dict] | None = None, terms: Column | None = None) -> DataFrame:
        """(term, df, idf) of the index, or of the terms that a condition picks."""
        now = self.segments() if segments is None else segments
        counts = self._every("terms", now).select("term", "df")
        gone = self._dropped(now, "terms")
        if gone is not None:
            counts = counts.union(gone.select("term", -F.col("df")))
        if terms is not None:
            counts = counts.where(terms)
        n = self.statistics(now)[0]
        sums = counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return weighed(sums, F.lit(n))

    def head_hits(self, terms: DataFrame, segments: list[dict] | None = None) -> DataFrame:
        """(segment, ord, term) of live documents whose head contains a term (column term, in lower case), even within a word.

        A term is looked up by the rarest of its longest n-grams; the heads that have it are read and tested for the term.
        """
        now = self.segments() if segments is None else segments
        terms = terms.select("term").where(F.length("term") > 0).distinct()
        size = F.least(F.length("term"), F.lit(GRAMS[-1]))
        own = terms.select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - size + 1), lambda i: F.substring(F.col("term"), i, size)))).alias("gram"))
        table = self._every("grams", now)
        asked = own.select("gram").distinct()
        few = asked.limit(FEW + 1).count() <= FEW
        counts = table.join(F.broadcast(asked) if few else asked, "gram").groupBy("gram").agg(F.count("*").alias("n"))
        rare = own.join(counts, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
        # Each term has one rarest n-gram, so that few n-grams have few rows here as well.
        found = table.join(F.broadcast(rare) if few else rare, "gram").select("segment", "ord", "term")
        heads = self._every("documents", now).select("segment", "ord", "hay")
        return self._live(found, now).join(heads, ["segment", "ord"]).where(F.col("hay").contains(F.col("term"))).select("segment", "ord", "term")

    def _asked(self, queries: DataFrame, now: list[dict]) -> tuple[DataFrame, Column | None]:
        """(query_id, term, idf) of the queries' terms that occur, and a condition that reads only row groups which have them, if they are few."""
        words = asked_terms(queries).select("query_id", F.explode("terms").alias("term"))
        few = [r["term"] for r in words.select("term").distinct().limit(FEW + 1).collect()]
        only = F.col("term").isin(few) if len(few) <= FEW else None
        return words.join(self.frequencies(now, only).select("term", "idf"), "term"), only

    def bm25(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) of all documents with a term of the query."""
        now = self.segments()
        asked, only = self._asked(queries, now)
        sums = self._scores(now, asked, only, None)
        return sums.join(self._every("documents", now).select("segment", "ord", "id"), ["segment", "ord"]).select("query_id", F.col("id").alias(self.id_col), "score")

    def _scores(self, now: list[dict], asked: DataFrame, only: Column | None, within: DataFrame | None) -> DataFrame:
        """(query_id, segment, ord, score), of all blocks or those ``within`` (query_id, segment, block)."""
        posts = self._every("postings", now)
        posts = posts if only is None else posts.where(only)
        hits = posts.join(asked, "term")
        if within is not None:
            hits = hits.join(within.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_semi")
        n, tokens = self.statistics(now)
        mean = F.lit(tokens / max(n, 1))
        hits = self._live(hits, now)
        return hits.groupBy("query_id", "segment", "ord").agg(F.sum(weight(F.col("idf"), F.col("tf"), F.col("dl"), mean)).alias("score"))

    def _bounds(self, now: list[dict], asked: DataFrame, only: Column | None) -> DataFrame:
        """(query_id, segment, block, bound, n): no document of the block scores more than ``bound``, n postings have the query's terms."""
        blocks = self._every("blocks", now)
        blocks = blocks if only is None else blocks.where(only)
        n, tokens = self.statistics(now)
        most = weight(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(tokens / max(n, 1)))
        # A block whose documents came in two runs has two rows a term.
        whole = blocks.join(asked, "term").groupBy("query_id", "segment", "block", "term", "idf").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        return whole.groupBy("query_id", "segment", "block").agg(F.sum(most).alias("bound"), F.sum("n").alias("n"))

    def _in_two(self, bounds: DataFrame, scored, least) -> tuple[DataFrame, DataFrame]:
        """(scored rows of the first blocks and of those others that could matter, the blocks that were read).

        ``scored`` gives the rows of blocks; ``least`` gives (query_id, least), the score that others must reach.
        """
        over = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        ranks = self._kept(bounds.withColumn("r", F.row_number().over(over)), "bounds")
        first = self._kept(scored(ranks.where(F.col("r") <= FIRST)), "first")
        floor = least(first)
        rest = ranks.where(F.col("r") > FIRST).join(floor, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        read = ranks.where(F.col("r") <= FIRST).select("query_id", "segment", "block", "n").union(rest.select("query_id", "segment", "block", "n"))
        return first.unionByName(scored(rest)), read

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that several parts of a search read."""
        return stored(rows, name)

    def top(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, id, score) of the k best by BM25 alone; ties to the smaller id."""
        return self._top(queries, k)[0]

    def postings_read(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, blocks, blocks_read, postings, postings_read): what ``top`` reads of what its terms have."""
        _, bounds, read = self._top(queries, k)
        whole = bounds.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("n").alias("postings"))
        part = read.groupBy("query_id").agg(F.count("*").alias("blocks_read"), F.sum("n").alias("postings_read"))
        return whole.join(part, "query_id").select("query_id", "blocks", "blocks_read", "postings", "postings_read")

    def _top(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        now = self.segments()
        asked, only = self._asked(queries, now)
        ids = self._every("documents", now).select("segment", "ord", "id")
        bounds = self._bounds(now, asked, only)
        scored = lambda blocks: self._scores(now, asked, only, blocks)
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
        least = lambda rows: rows.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
        found, read = self._in_two(bounds, scored, least)
        # Documents that share the last score are all kept until their ids decide.
        near = found.withColumn("score", rounded(F.col("score"))).withColumn("r", F.rank().over(by_score)).where(F.col("r") <= k)
        over = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        ranks = near.join(ids, ["segment", "ord"]).withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
        return ranks.select("query_id", "rank", F.col("id").alias(self.id_col), "score"), bounds, read

    def ranked(self, queries: DataFrame, k: int = 12) -> DataFrame:
        """(query_id, rank, id, url, score): what ``search.ranked`` gives, from the index alone; no text is read.

        A block's bound adds the greatest bonus of its heads, and counts people's factor if the query asks for people.
        """
        now = self.segments()
        asked, only = self._asked(queries, now)
        terms = asked_terms(queries).select("query_id", "terms", F.arrays_overlap("terms", F.array(*[F.lit(t) for t in PERSON_TERMS])).alias("people"))
        words = terms.select("query_id", F.explode("terms").alias("term"))
        bonus = self.head_hits(words, now).join(words, "term").groupBy("query_id", "segment", "ord").agg((F.count("*") * F.lit(TITLE_BONUS)).alias("bonus"))
        bonus = self._kept(bonus.withColumn("block", F.floor(F.col("ord") / BLOCK)), "bonus")
        heads = bonus.groupBy("query_id", "segment", "block").agg(F.max("bonus").alias("more"))
        both = self._bounds(now, asked, only).join(heads, ["query_id", "segment", "block"], "full").join(terms.select("query_id", "people"), "query_id")
        most = (F.coalesce("bound", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))) * F.when(F.col("people"), PEOPLE_FACTOR).otherwise(1.0)
        bounds = both.select("query_id", "segment", "block", most.alias("bound"), F.coalesce("n", F.lit(0)).alias("n"))
        about = self._every("documents", now).select("segment", "ord", "id", "ordinal", "url", "category", "is_list")

        def scored(blocks: DataFrame) -> DataFrame:
            blocks = blocks.select("query_id", "segment", "block")
            extra = bonus.join(blocks, ["query_id", "segment", "block"], "left_semi").select("query_id", "segment", "ord", "bonus")
            rows = self._scores(now, asked, only, blocks).join(extra, ["query_id", "segment", "ord"], "full")
            rows = rows.join(about, ["segment", "ord"]).join(terms.select("query_id", "people"), "query_id")
            score = F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))
            score = F.when(F.col("is_list"), score * REFERENCE_FACTOR).otherwise(score)
            score = F.when(F.col("people") & (F.col("category") == "people"), score * PEOPLE_FACTOR).otherwise(score)
            return rows.select("query_id", "id", "url", "ordinal", F.col("score").isNotNull().alias("hit"), rounded(score).alias("score")).where("score > 0")

        order = [F.desc("score"), F.desc("hit"), F.asc("ordinal"), F.asc("id")]

        def capped(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy(*order))).where(F.col("n") <= PER_URL)
            return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)

        # More documents only raise what the cap leaves, so that the k-th score of some bounds that of all from below.
        least = lambda rows: capped(rows).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        found, _ = self._in_two(bounds, scored, least)
        return capped(found).select("query_id", "rank", F.col("id").alias(self.id_col), "url", "score")

    def complete(self, typed: DataFrame, k: int = 8) -> DataFrame:
        """(text_id, rank, id, score) of heads for typed texts (text_id, typed): those that begin with it score 2, those that have it elsewhere 1; ties to the smaller id."""
        now = self.segments()
        asked = typed.select("text_id", F.lower(F.trim("typed")).alias("term")).where(F.length("term") > 0)
        about = self._every("documents", now).select("segment", "ord", "id", "hay")
        found = self.head_hits(asked, now).join(asked, "term").join(about, ["segment", "ord"])
        rows = found.select("text_id", "id", F.when(F.col("hay").startswith(F.col("term")), 2).otherwise(1).alias("score"))
        over = Window.partitionBy("text_id").orderBy(F.desc("score"), "id")
        return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).select("text_id", "rank", F.col("id").alias(self.id_col), "score")


def stored_segments(chunks: DataFrame, source: str, id_col: str = "chunk_id") -> Segments:
    """The index of ``chunks``, which come from the table file ``source``: built on first use of the session, opened after that, built anew if the files have changed."""
    spark = chunks.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)))
    key = (spark.sparkContext.applicationId, id_col, now)
    if key not in _STORED:
        made = Segments(spark, f"{shared_dir(spark)}/lectern/segments-{uuid.uuid4().hex}", id_col)
        made.add(chunks)
        _STORED[key] = made.path
    return Segments(spark, _STORED[key], id_col)
