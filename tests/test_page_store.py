"""The page store reads only what is new, replaces what has changed and keeps equal pages once."""

from lectern.sources.pages import PageStore

PAGES = "url string, html string"


def test_second_run_reads_what_is_new(spark, tmp_path):
    store = PageStore(spark, f"file://{tmp_path}/store")
    site = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "url string")
    assert sorted(r.url for r in store.missing(site).collect()) == ["a", "b", "c"]
    store.put(spark.createDataFrame([("a", "<p>1"), ("b", "<p>1"), ("b", "<p>1"), (None, "x"), ("n", None)], PAGES), 0)
    assert [r.url for r in store.missing(site).collect()] == ["c"]
    assert store._rows("texts", "hash string, html string").count() == 1, "equal pages are stored once"
    for _ in range(2):  # a batch that runs again writes the same
        store.put(spark.createDataFrame([("c", "<p>3"), ("a", "<p>2"), ("b", "<p>1")], PAGES), 1)
        assert sorted(map(tuple, store.pages().collect())) == [("a", "<p>2"), ("b", "<p>1"), ("c", "<p>3")]
        assert {r.url: (r.changed, r.batch) for r in store.urls().collect()} == {"a": (True, 1), "b": (False, 1), "c": (True, 1)}
    store.put(spark.createDataFrame([], PAGES), 2)
    assert store.pages().count() == 3 and store.missing(site).count() == 0
