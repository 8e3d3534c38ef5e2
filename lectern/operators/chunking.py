"""Chunks of documents along their paragraphs and headings. One document is read at a time, in the task that holds it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.text import strip_markdown, tokenize
from .index import runs_of

TARGET, MOST = 800, 1400
HEADING = re.compile(r"(#{1,6})[^\S\n]+(\S.*|[^\S\n]+.+)")
ABSTRACT = "**Abstract.**"
OUT = [("ordinal", T.IntegerType()), ("section", T.StringType()), ("source", T.StringType()), ("text", T.StringType())]


def chunks_of(body: str, separator: str = r"\n{2,}", blanks: str | None = None) -> list[tuple[str | None, str, str]]:
    """(section, source, text) of a document's chunks.

    Paragraphs gather until they have 800 characters, or would have more than 1,400; a heading begins
    a chunk. A second or third level heading names the section at once, so that the chunk which it
    ends already has the new name. Up to the second heading of a document with an abstract, chunks
    come from the ``abstract``, else from the ``body``. Paragraphs lose white space at both ends, or
    only the characters of ``blanks``, and go if nothing is left.
    """
    out: list[tuple[str | None, str, str]] = []
    held: list[str] = []
    section, titled = None, False
    source = "abstract" if ABSTRACT in body else "body"

    def close() -> None:
        if held:
            out.append((section, source, "\n\n".join(held)))
            held.clear()

    for paragraph in filter(None, (p.strip(blanks) for p in re.split(separator, body))):
        heading = HEADING.fullmatch(paragraph)
        if heading:
            if len(heading[1]) in (2, 3):
                section = heading[2].strip()
            close()
            if titled:
                source = "body"
            titled = True
            held.append(paragraph)
            continue
        if held and sum(map(len, held)) + len(paragraph) > MOST:
            close()
        held.append(paragraph)
        if sum(map(len, held)) >= TARGET:
            close()
    close()
    return out


def chunk_documents(docs: DataFrame, id_col: str, body_col: str = "body", text_col: str = "text", separator: str = r"\n{2,}", blanks: str | None = None, outer: bool = False) -> DataFrame:
    """(id, ordinal, section, source, text, tokens) of all chunks; from the body if it has more than 50 characters, else from the text.

    A document without chunks has no row, or, with ``outer``, one whose other columns are null.
    """
    body = F.when(F.length(body_col) > 50, F.col(body_col)).otherwise(F.col(text_col))
    source = docs.select(id_col, F.coalesce(body, F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs_of(batch.column(1)):
                ids, rows = [], []
                for row, text in enumerate(texts, first):
                    made = [(k, *c) for k, c in enumerate(chunks_of(text, separator, blanks))]
                    if outer and not made:
                        made = [(None,) * len(OUT)]
                    ids += [row] * len(made)
                    rows += made
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))]
                yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=[id_col, *(n for n, _ in OUT)])

    schema = T.StructType([source.schema[0], *(T.StructField(n, t) for n, t in OUT)])
    return source.mapInArrow(run, schema).withColumn("tokens", tokenize(strip_markdown(F.col("text"))))


@udtf(returnType="ordinal int, section string, source string, text string")
class Chunks:
    """Table function of a body: its chunks in order, for SQL (``LATERAL chunks(body)``) once registered with ``spark.udtf.register``; with ``outer``, a row of nulls if there are none."""

    def eval(self, body: str, separator: str = r"\n{2,}", blanks: str | None = None, outer: bool = False):
        made = chunks_of(body or "", separator, blanks)
        for k, chunk in enumerate(made):
            yield (k, *chunk)
        if outer and not made:
            yield (None,) * len(OUT)
