"""Alignment of two tokenizers' tokens over the same bytes, by products of sparse incidence matrices.

Tokens times bytes is an incidence matrix for each tokenizer, in CSR form. Gustavson's row by row
product A * Bt has an entry for each pair of tokens that overlap, with the number of bytes they share;
those whose ends agree are the links that are counted. Offsets where tokens of both end cut a text
into groups; the product of tokens times groups gives the pairs that share a group.

Both tokenizers cut at white space that follows other characters, so that a text is a chain of words
that are encoded, multiplied and looked up one by one: the matrices are block diagonal, and a word
that repeats is computed once. What is gathered from the corpus is a count for each pair of ids. Of two
tokens that end together one is a suffix of the other, so that there are at most as many pairs as the
vocabularies have suffixes, whatever the corpus: that table has a proven bound and is sent to all tasks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled
from .tokencount import PATTERN

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A word: spaces and newlines with what follows them. Where other white space comes before a space or newline, no cut is made.
CHUNK = re.compile(r"[ \n]+[^ \n]*(?:(?<=\s)[ \n]+[^ \n]*)*")
#: Characters of texts that are encoded together; words, and characters of words, that a worker remembers before it starts afresh.
TOGETHER, REMEMBERED, CHARACTERS = 1 << 21, 200_000, 1 << 23
#: Pairs of one row of counts.
ROW = 50_000
_MADE: dict[tuple[str, str], Tokenizers] = {}


class CSR(NamedTuple):
    """A sparse matrix with ones: the columns of row r are indices[indptr[r] : indptr[r + 1]]."""

    indptr: np.ndarray
    indices: np.ndarray


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers one after another, the size of each list)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, of the given sizes, one after another."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - sizes), sizes)


def intervals(starts: np.ndarray, ends: np.ndarray) -> CSR:
    """Tokens times bytes: a row has the bytes from its token's start to its end."""
    sizes = ends - starts
    return CSR(np.concatenate([[0], np.cumsum(sizes)]), _spans(starts, sizes))


def transposed(m: CSR, columns: int) -> CSR:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    return CSR(np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=columns))]), rows[order])


def product(a: CSR, b: CSR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of a * b, row by row: row r sums the rows of ``b`` that r's columns name.

    All rows are expanded at once and equal (row, column) summed; the work is the number of products,
    which for bytes that one token covers is the number of bytes.
    """
    rows = np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr))
    sizes = np.diff(b.indptr)[a.indices]
    rows = np.repeat(rows, sizes)
    columns = b.indices[_spans(b.indptr[a.indices], sizes)]
    if not len(rows):
        return rows, columns, rows
    width = int(columns.max()) + 1
    keys = rows * width + columns
    if (keys[1:] < keys[:-1]).any():
        keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    value = np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first] // width, keys[first] % width, value


class Aligned(NamedTuple):
    """Of some texts in a row: pairs of token places that overlap, with shared bytes and whether they end together, and those that share a group; each token's group."""

    overlap: tuple[np.ndarray, np.ndarray, np.ndarray]
    together: np.ndarray
    shared: tuple[np.ndarray, np.ndarray]
    group_a: np.ndarray
    group_b: np.ndarray


def aligned(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """From the byte sizes of two token sequences over the same bytes; every size is at least 1."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    bytes_a, bytes_b = intervals(ends_a - sizes_a, ends_a), intervals(ends_b - sizes_b, ends_b)
    a, b, n = product(bytes_a, transposed(bytes_b, total))
    together = ends_a[a] == ends_b[b]
    cuts = ends_a[a[together]]
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    in_a, in_b = (CSR(np.arange(len(g) + 1), g) for g in (group_a, group_b))
    shared = product(in_a, transposed(in_b, len(cuts)))[:2]
    return Aligned((a, b, n), together, shared, group_a, group_b)


class Tokenizers:
    """The two encoders, the bytes of their ids, and what is remembered of words."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        # Byte-level entries write bytes that are no visible Latin-1 character as those from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {chr(c): c for c in shown} | {chr(0x100 + i): c for i, c in enumerate(sorted(set(range(256)) - set(shown)))}
        added = {i: x.content.encode() for i, x in self.a.get_added_tokens_decoder().items()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = added[i] if i in added else bytes(signs[c] for c in piece)
        own = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(own)]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id(SPACE)
        # Words may be encoded one by one if no piece goes on after white space that follows something else.
        plain = [p for i, p in enumerate(own) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        kind = str(self.a.pre_tokenizer)
        self.by_word = all(SPACE not in p.lstrip(SPACE) and ("\n" not in p or len(p) == 1) for p in plain) and self.a.normalizer is None and kind.startswith("ByteLevel") and "use_regex=True" in kind
        self.ascii = self._by_ranks(byte_bpe) if self.by_word and not added.keys() - vocabulary.values() else None
        self.texts_a = np.array([str(i) for i in range(len(self.bytes_a))], object)
        self.texts_b = np.array([str(i) for i in range(len(own))], object)
        self.forget()

    def _by_ranks(self, byte_bpe: str):
        """An encoder three times as fast for words of ASCII, where no release of the letter tables matters; None unless the file's merges are in the order of their ids.

        If every entry is what its own merges make of it, a pair of tokens that makes an entry only stands side by side
        where that is the entry's own merge, so that merging by rank of the result is merging by the list.
        """
        import tiktoken

        with open(byte_bpe) as f:
            merges = json.load(f)["model"]["merges"]
        vocabulary = self.a.get_vocab()
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if any(x >= y for x, y in zip(made, made[1:])) or len(made) + 256 > len(vocabulary):
            return None
        special = self.a.get_added_tokens_decoder()
        ranks = {b: i for i, b in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.characters = 0
        #: For each word: its groups as text, its numbers of A and B tokens, groups, links and pairs in a shared group, and whether it decodes.
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 6), np.int64)
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def encoded(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of words that begin with a space or newline, as they stand within a text."""
        plain = [self.ascii is not None and w.isascii() for w in words]
        rest = iter(self.a.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        a = [self.ascii.encode_ordinary(w) if p else next(rest).ids for w, p in zip(words, plain)]
        # The second encoder puts a space before what it is given: it stands for a word's own, or is taken off.
        b = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        b = [x if w[0] == " " and len(w) > 1 else [self.blank] if w == " " else x[1:] if x[:1] == [self.blank] else [] for w, x in zip(words, b)]
        return a, b

    def learn(self, words: list[str]) -> None:
        """Encode and align words not met before, all in one product."""
        a, b = self.encoded(words)
        (ids_a, n_a), (ids_b, n_b) = _flat(a), _flat(b)
        exact = [True] * len(words)
        whole = [w.encode() for w in words]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        # Words decode one by one if all of them do together, each to its own number of bytes.
        same = all((np.bincount(np.repeat(np.arange(len(words)), n), size_of[ids], len(words)) == sizes).all() for ids, n, size_of in ((ids_a, n_a, self.sizes_a), (ids_b, n_b, self.sizes_b)))
        if not same or not (b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == b"".join(whole) == b"".join(map(self.bytes_b.__getitem__, ids_b.tolist()))):
            exact = [b"".join(map(self.bytes_a.__getitem__, x)) == w == b"".join(map(self.bytes_b.__getitem__, y)) for w, x, y in zip(whole, a, b)]
            (ids_a, n_a), (ids_b, n_b) = (_flat([x if e else [] for x, e in zip(t, exact)]) for t in (a, b))
        made = aligned(self.sizes_a[ids_a], self.sizes_b[ids_b])
        word_a = np.repeat(np.arange(len(words)), n_a)
        link_a, link_b = (x[made.together] for x in made.overlap[:2])
        count = lambda rows: np.bincount(word_a[rows], minlength=len(words))
        links = count(link_a)
        # A word's end is an end of both, so that groups lie within words, and as many links as groups do.
        group_word = word_a[link_a]
        texts = self._texts(ids_a, ids_b, made)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(group_word, minlength=len(words)))]).tolist()
        place = len(self.known)
        self.known.update((w, place + i) for i, w in enumerate(words))
        self.characters += sum(map(len, words))
        self.groups += [";".join(texts[i:j]) for i, j in zip(cuts, cuts[1:])]
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, np.bincount(group_word, minlength=len(words)), links, count(made.shared[0]), np.array(exact, np.int64)], axis=1)])
        self.pairs = np.concatenate([self.pairs, ids_a[link_a] * len(self.bytes_b) + ids_b[link_b]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])

    def _texts(self, ids_a: np.ndarray, ids_b: np.ndarray, made: Aligned) -> list[str]:
        """``a1,a2|b1`` of each group."""
        sides = []
        for texts, ids, group in ((self.texts_a, ids_a, made.group_a), (self.texts_b, ids_b, made.group_b)):
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
            parts, first = texts[ids].tolist(), cuts[:-1]
            out = texts[ids[first]]  # of most groups the only one
            long = np.flatnonzero(np.diff(cuts) > 1)
            for g, i, j in zip(long.tolist(), cuts[long].tolist(), cuts[long + 1].tolist()):
                out[g] = ",".join(parts[i:j])
            sides.append(out.tolist())
        return list(map("|".join, zip(*sides)))

    def exact_whole(self, text: str) -> bool:
        """Whether both decode the whole text to itself."""
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        return b"".join(map(self.bytes_a.__getitem__, a)) == text.encode() == b"".join(map(self.bytes_b.__getitem__, b))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words of all texts as places in what is remembered, number of words of each text); a text that does not decode has none."""
        if len(self.known) > REMEMBERED or self.characters > CHARACTERS:
            self.forget()
        cut = [(CHUNK.findall(" " + t) if self.by_word else [" " + t]) if t else [] for t in texts]
        known = self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        if new:
            self.learn(new)
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        places = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        wrong = np.unique(np.repeat(np.arange(len(texts)), n)[self.numbers[places, 5] == 0])
        if len(wrong):
            for t in wrong.tolist():
                # A word that does not decode could still be part of a text that does, if others made up for it: no known tokenizer does that.
                if self.by_word and self.exact_whole(" " + texts[t]):
                    raise ValueError("the tokenizers do not decode word by word; they need whole texts")
            keep = ~np.isin(np.repeat(np.arange(len(texts)), n), wrong)
            places, n = places[keep], np.where(np.isin(np.arange(len(texts)), wrong), 0, n)
        return places, n


def tokenizers(byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> Tokenizers:
    if (byte_bpe, pieces) not in _MADE:
        _MADE[byte_bpe, pieces] = Tokenizers(byte_bpe, pieces)
    return _MADE[byte_bpe, pieces]


def _parts(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``TOGETHER`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _counted(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(pairs, return_inverse=True)
    return found, np.bincount(place, times, len(found)).astype(np.int64)


def align_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's tokens by both tokenizers, aligned: id_col, n_a, n_b, n_groups, n_links, n_shared, groups, pairs, times, total.

    A encodes a space and the text, B the text, before which it puts a space itself. groups is
    ``a1,a2|b1;a3|b2,b3``: ids of A and B between offsets where tokens of both end. n_links counts pairs of
    tokens that end together, n_shared those that share a group; pairs has the different
    (A id * size of B's vocabulary + B id) of the links, times how often each occurs. Texts that are null, empty, or that
    the tokens of either do not give back have zeros and an empty ``groups``. Repeated rows count each;
    other columns are ignored. Texts are encoded whole, long ones alone.

    Rows with ``total`` true are no documents: they have the pairs and times of all documents of a task, so that
    counts over the corpus are summed before they are shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(byte_bpe, pieces)
        ids, lists = None, pa.list_(pa.int64())
        all_pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(ids: pa.Array, numbers: np.ndarray, groups: list[str | None], starts: np.ndarray, pairs: np.ndarray, times: np.ndarray, total: bool) -> pa.RecordBatch:
            at = pa.array(starts, pa.int32())
            columns = [ids, *(pa.array(numbers[:, k]) for k in range(5)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(at, pa.array(pairs)), pa.ListArray.from_arrays(at, pa.array(times)), pa.array([total] * len(ids))]
            assert columns[7].type == lists
            return pa.record_batch(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "pairs", "times", "total"])

        for batch in batches:
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in _parts(texts):
                size = part.stop - part.start
                places, n = own.words(texts[part])
                ends = np.cumsum(n)
                numbers = np.zeros((size, 5), np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    numbers[full] = np.add.reduceat(own.numbers[places, :5], (ends - n)[full], axis=0)
                texts_of = list(map(own.groups.__getitem__, places.tolist()))
                groups = [";".join(texts_of[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
                sizes = own.first[places + 1] - own.first[places]
                found = own.pairs[_spans(own.first[places], sizes)]
                width = len(own.bytes_a) * len(own.bytes_b)
                keys, times = np.unique(np.repeat(np.repeat(np.arange(size), n), sizes) * width + found, return_counts=True)
                pairs = keys % width
                starts = np.searchsorted(keys, np.arange(size + 1) * width)
                yield rows(ids.slice(part.start, size), numbers, groups, starts, pairs, times, False)
                all_pairs.append(_counted(pairs, times))
                if len(all_pairs) > 16:
                    all_pairs = [_counted(*map(np.concatenate, zip(*all_pairs)))]
        if all_pairs:
            pairs, times = _counted(*map(np.concatenate, zip(*all_pairs)))
            for i in range(0, len(pairs), ROW):
                part = pairs[i : i + ROW]
                yield rows(pa.nulls(1, ids.type), np.zeros((1, 5), np.int64), [None], np.array([0, len(part)]), part, times[i : i + ROW], True)

    form = f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, pairs array<long>, times array<long>, total boolean"
    return docs.select(id_col, text_col).mapInArrow(run, form)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus have a pair of ids, and whether no pair of its B id has more.

    At most as many rows as both vocabularies have suffixes, a million for those of 50,000 and 32,000 entries.
    """
    flat = rows.where("total").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    sums = flat.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.pmod("pair", F.lit(width))))
    return sums.select("pair", "n", (F.col("n") == most).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``align_tokens`` with n_best and count_sum: links whose pair is among the most frequent of its B id, and the sum of all links' counts."""
    spark = rows.sparkSession
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy(), kind="stable")
    held = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            cuts = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            sums = [np.concatenate([[0], np.cumsum(times * x[at])])[cuts] for x in (best, n)]
            columns = [batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")] + [pa.array(np.diff(s)) for s in sums]
            yield pa.record_batch(columns, names=[*(c for c in batch.schema.names if c not in ("pairs", "times")), "n_best", "count_sum"])

    kept = [c for c in rows.columns if c not in ("total", "pairs", "times")]
    form = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.where("not total").select(*kept, "pairs", "times").mapInArrow(run, f"{form}, n_best long, count_sum long")


def tokenizer_alignment(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256; see ``align_tokens``.

    Documents are encoded once: what their links are is written to the shared folder, the
    corpus' counts are summed from it, and a second pass over it adds what hangs on them. An empty
    table gives no rows.
    """
    rows = align_tokens(docs, byte_bpe, pieces)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = settled(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    width = tokenizers(byte_bpe, pieces).b.get_piece_size()
    return with_counts(rows, pair_counts(rows, width))


def token_links(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """For each document its tokens and all links between them, as places within its own tokens.

    doc_id, a_ids, b_ids, overlaps (a, b, shared bytes, whether they end together) and shared (a, b in one group). Texts without
    tokens, see ``align_tokens``, have empty lists.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {kind}, a_ids array<long>, b_ids array<long>, overlaps array<struct<a:long,b:long,bytes:long,together:boolean>>, shared array<struct<a:long,b:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(byte_bpe, pieces)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                full = " " + (text or "")
                a, b = (own.a.encode(full, add_special_tokens=False).ids, own.b.encode(text)) if text else ([], [])
                if b"".join(map(own.bytes_a.__getitem__, a)) != full.encode() or b"".join(map(own.bytes_b.__getitem__, b)) != full.encode():
                    a, b = [], []
                made = aligned(own.sizes_a[np.array(a, np.int64)], own.sizes_b[np.array(b, np.int64)])
                overlaps = [dict(zip(("a", "b", "bytes", "together"), x)) for x in zip(*(y.tolist() for y in (*made.overlap, made.together)))]
                shared = [dict(zip("ab", x)) for x in zip(*(y.tolist() for y in made.shared))]
                types = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64()), ("together", pa.bool_())])), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
                yield pa.record_batch([batch.column(0).slice(i, 1), *(pa.array([x], t) for x, t in zip((a, b, overlaps, shared), types))], names=["doc_id", "a_ids", "b_ids", "overlaps", "shared"])

    return docs.select("doc_id", "text").mapInArrow(run, form)
