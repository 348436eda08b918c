from pyspark.sql import functions as F

from millrace.operators import signals


def test_signals(spark):
    rows = [(1, "ab 1!\nab 1!\n"), (2, None), (3, ""), (4, "see https://a.b and\n```\nxx\n```")]
    out = {r["id"]: r for r in signals.signals(spark.createDataFrame(rows, "id long, t string"), "t").collect()}
    assert out[1]["letter_ratio"] == 4 / 12 and out[1]["punctuation_ratio"] == 2 / 12 and out[1]["digit_ratio"] == 2 / 12 and out[1]["repeated_line_ratio"] == 0.5
    assert all(out[2][c] == out[3][c] == 0 for c in ("letter_ratio", "repeated_line_ratio", "repeated_ngram_ratio", "url_density", "code_ratio"))
    assert out[4]["url_density"] == 1 / 6 and 0 < out[4]["code_ratio"] < 1


def test_addresses(spark):
    rows = [("https://WWW.A.example:443/Path/?utm_source=x#top", "a.example/Path"), ("http://a.example/Path", "a.example/Path"), ("a.example?q=1&ref=z", "a.example?q=1"), ("https://a.example/?ref=z&q=1", "a.example?q=1"), (None, None), ("", "")]
    got = spark.createDataFrame([(u,) for u, _ in rows], "u string").select(signals.canonical_url("u").alias("x")).collect()
    assert [r["x"] for r in got] == [x for _, x in rows]
    df = spark.createDataFrame([(1, "http://a.b/c", "train"), (2, "https://www.a.b/c/", "test"), (3, "a.b/d", "test"), (4, None, "test")], "id long, u string, part string")
    assert [(r["id"], r["train_key"]) for r in signals.shared_addresses(df, "u", "part", "id").collect()] == [(2, 1)]


def test_mixture_table(spark):
    docs = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "s string, n long")
    targets = spark.createDataFrame([("a", 0.5), ("c", 0.5)], "source string, weight double")
    out = {r["source"]: r["filled"] for r in signals.mixture_table(docs, "s", F.col("n"), targets, 100).collect()}
    assert out == {"a": 0.6, "c": 0.0}
