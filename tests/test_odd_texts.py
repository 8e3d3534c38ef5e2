"""Queries against their SQL on texts that the given tables lack: none, empty, blank, with other white space at the ends of lines."""

import duckdb
import pytest

import __spark_entry__

TEXTS = [
    None, "", " ", "\n\n", "\t", "one line", " two \n\n lines ", "\tindented\r\n\x0bline\x1f \n", "\u00a0\u3000wide\u2003\n\u2028", "\r\n\r\n", "# Title\n\t# no title\n## Part",
    "a\x00b\x00", "é\u0085", "long line " * 300 + "\n" + "\tmore" * 400,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, ""), (1, "the same id"), (100, None), (100, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def both(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    return order(__spark_entry__.queries()[name](spark, path).collect()), order(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_chunk_function_counts_as_its_sql(spark, odd):
    got, want = both(spark, odd, "chunk_function")
    assert got == want and (2, 0) in got and (4, 1) in got


def test_chunked_chars_counts_as_its_sql(spark, odd):
    got, want = both(spark, odd, "chunked_chars")
    assert got == want and (2, 0) in got and (4, 1) in got
