"""Profiles of records, documents and lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import approx_tokens, word_count


def _chars(messages: Column, role: str | None = None) -> Column:
    chosen = messages if role is None else F.filter(messages, lambda m: m["role"] == role)
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))


def record_statistics(records: DataFrame, messages: str = "messages") -> DataFrame:
    """One row: records, average question and answer characters, average, least and most approximate tokens.

    Averages have two digits. Of no records they are 0 and so are least and most.
    """
    ms = F.col(messages)
    per = records.select(_chars(ms, "user").alias("q"), _chars(ms, "assistant").alias("a"), approx_tokens(_chars(ms)).alias("t"))
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    mean = lambda c: zero(F.bround(F.avg(c), 2), 0.0)
    return per.agg(
        F.count("*").alias("n_records"),
        mean("q").alias("avg_question_chars"),
        mean("a").alias("avg_answer_chars"),
        mean("t").alias("avg_tokens"),
        zero(F.min("t"), 0).cast("long").alias("min_tokens"),
        zero(F.max("t"), 0).cast("long").alias("max_tokens"),
    )


def histogram(df: DataFrame, col: Column | str, name: str = "value") -> DataFrame:
    """Counts by value, null as ``unknown``, with the share in per cent to one digit."""
    c = F.col(col) if isinstance(col, str) else col
    counts = df.groupBy(F.coalesce(c.cast("string"), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    return counts.join(F.broadcast(total)).withColumn("pct", F.bround(F.col("n") * 100.0 / F.col("__total"), 1)).drop("__total")


def length_percentiles(df: DataFrame, length: Column, by: Sequence[str] = ()) -> DataFrame:
    """Median, 90th, 95th and 99th percentile by linear interpolation, and the greatest; 0 of no rows."""
    p = F.percentile(length, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = df.groupBy(*by).agg(p.alias("p"), F.max(length).alias("longest"), F.count("*").alias("n"))
    at = [F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(("median", "p90", "p95", "p99"))]
    return out.select(*by, "n", *at, F.coalesce(F.col("longest").cast("double"), F.lit(0.0)).alias("longest"))


def document_statistics(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Documents, bytes, characters and words by group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"),
        F.coalesce(F.sum(word_count(text)), F.lit(0)).cast("long").alias("n_words"),
    )


def tokenizer_report(counted: DataFrame, text: str, tokens: str, unknown: str | None = None) -> DataFrame:
    """One row on a table of texts and token counts: characters a token, tokens a word, unknown rate, mean and median."""
    n = F.sum(tokens)
    per = lambda a, b: a / F.nullif(b, F.lit(0))
    return counted.agg(
        F.count("*").alias("n_docs"),
        per(F.sum(F.length(text)), n).alias("chars_per_token"),
        per(n, F.sum(word_count(text))).alias("tokens_per_word"),
        (per(F.sum(unknown), n) if unknown else F.lit(0.0)).alias("unknown_rate"),
        F.avg(tokens).alias("mean_tokens"),
        F.percentile(tokens, F.lit(0.5)).alias("median_tokens"),
    )


def duplicate_rate(df: DataFrame, first: str, key: str, by: Sequence[str]) -> DataFrame:
    """By group: rows, rows that repeat an earlier one (``first`` differs from ``key``), and their share."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(first) != F.col(key)).alias("n_duplicates"), F.avg((F.col(first) != F.col(key)).cast("int")).alias("duplicate_rate"))


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    """exp of the mean loss, which counts as 20 at the most."""
    return df.agg(F.exp(F.least(F.lit(20.0), F.avg(loss))).alias("perplexity"))


def throughput(df: DataFrame, tokens: str, seconds: str) -> DataFrame:
    return df.agg((F.sum(tokens) / F.nullif(F.sum(seconds), F.lit(0.0))).alias("tokens_per_second"))


def markdown_table(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> str:
    """A small table as Markdown; one of more than ``limit`` rows is refused."""
    rows = df.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"
