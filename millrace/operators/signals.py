"""Signals of document quality, slices to look at, and addresses in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let, repetition, squeeze, strip, text_of, word_count, words
from millrace.session import materialize

# Query parameters that only track visitors.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def _share(t: Column, pattern: str) -> Column:
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit(pattern)) / F.length(t)).otherwise(F.lit(0.0))


def repeated_lines(col: Column | str) -> Column:
    """Share of non-blank lines that repeat an earlier one; 0 without lines."""
    lines = F.filter(F.transform(F.split(text_of(col), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return let(lines, lambda x: F.when(F.size(x) > 0, 1.0 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(0.0)))


def code_share(col: Column | str) -> Column:
    """Share of characters within closed code fences."""
    t = text_of(col)
    outside = F.length(F.regexp_replace(t, r"(?s)```.*?```", ""))
    return F.when(F.length(t) > 0, (F.length(t) - outside) / F.length(t)).otherwise(F.lit(0.0))


def signals(df: DataFrame, text: str) -> DataFrame:
    """``df`` with letters, punctuation and digits a character, repeated lines and 4-grams, addresses a word, code share."""
    t = text_of(text)
    n_words = word_count(text)
    return df.withColumns({
        "letter_ratio": _share(t, r"\p{L}"), "punctuation_ratio": _share(t, r"[^\p{L}\p{N}\s]"), "digit_ratio": _share(t, r"\p{N}"),
        "repeated_line_ratio": repeated_lines(text), "repeated_ngram_ratio": repetition(text),
        "url_density": F.when(n_words > 0, F.regexp_count(t, F.lit(r"https?://")) / n_words).otherwise(F.lit(0.0)), "code_ratio": code_share(text),
    })


def inspection_slice(df: DataFrame, by: str, key: str, *, largest: bool, rows: int = 20) -> DataFrame:
    """The ``rows`` documents with the largest or least value of a signal; of equal ones the first by key."""
    return df.where(F.col(by).isNotNull()).orderBy(F.desc(by) if largest else F.asc(by), key).limit(rows)


def canonical_url(col: Column | str) -> Column:
    """An address in lower case but for its path, without scheme, www, default port, fragment, tracking parameters and a
    closing slash; null stays null."""
    u = F.trim(F.col(col) if isinstance(col, str) else col)
    u = F.regexp_replace(u, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"\?(.*)$", 1), rf"(?:^|&)(?:{TRACKING})=[^&]*", ""), "^&", "")
    return F.when(u.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def shared_addresses(df: DataFrame, url: str, split: str, key: str) -> DataFrame:
    """Held-out documents whose address a training document has too: key, url, train_key (the least)."""
    rows = df.select(F.col(key), canonical_url(url).alias("url"), F.col(split).alias("split")).where("url is not null and url <> ''")
    train = rows.where("split = 'train'").groupBy("url").agg(F.min(key).alias("train_key"))
    return rows.where("split <> 'train'").join(train, "url").select(key, "url", "train_key")


def mixture_table(df: DataFrame, source: str, tokens: Column, targets: DataFrame, budget: int) -> DataFrame:
    """By target source: weight, token budget, tokens there are, and the share of the budget that they fill.

    ``targets``: source, weight.
    """
    have = df.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens"))
    both = targets.select("source", "weight").join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return both.select("source", "weight", (F.col("weight") * budget).alias("token_budget"), "tokens", (F.col("tokens") / F.nullif(F.col("weight") * budget, F.lit(0.0))).alias("filled"))


def simhash(col: Column | str, bits: int = 60) -> Column:
    """The sign, bit by bit, of the sum over a text's words of their hashes' bits; 0 without words. Similar texts differ in
    few bits."""

    def of(hashes: Column) -> Column:
        bit = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda x, b: x + F.when(bit(b) > 0, F.expr("1L")).otherwise(F.lit(0).cast("long")) * F.pow(F.lit(2), b).cast("long"))

    number = lambda w: F.conv(F.substring(F.md5(w), 1, bits // 4), 16, 10).cast("long")
    return let(F.transform(words(col), number), of)


def boilerplate(df: DataFrame, key: str, text: str, *, least_docs: int = 20) -> DataFrame:
    """Every text without the lines that ``least_docs`` documents or more have: key, n_dropped, text.

    Lines are equal but for case and white space; blank ones are never dropped. Null stays null. Lines move by their
    hash: counts are pre-aggregated, and of the texts only those that hold such a line are put together anew.
    """
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    marked = lines.withColumn("h", F.when(strip("line") != "", F.xxhash64(squeeze("line"))))
    common = marked.where("h is not null").select(key, "h").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("h")
    common = materialize(common, "lines")
    dropped = marked.select(key, "i", "h").join(common, "h").groupBy(key).agg(F.collect_set("i").alias("gone"))
    rows = df.join(dropped, key, "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i)), "\n")
    return rows.select(key, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col(text)).otherwise(kept).alias(text))


def source_registry(df: DataFrame, source: str, text: str, url: str, fetched: str, lang: str) -> DataFrame:
    """One row per source in one spelling: names (how it is written), n_docs, n_bytes, n_hosts, n_langs, and when first
    and last fetched. Null and blank sources are one, named null."""
    name = F.nullif(F.regexp_replace(F.lower(text_of(source)), r"[^\p{L}\p{N}]", ""), F.lit(""))
    host = F.nullif(F.regexp_extract(canonical_url(url), "^[^/?]*", 0), F.lit(""))
    return df.groupBy(name.alias("source")).agg(
        F.countDistinct(source).alias("names"), F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n_bytes"),
        F.countDistinct(host).alias("n_hosts"), F.countDistinct(F.lower(F.trim(F.col(lang)))).alias("n_langs"), F.min(fetched).alias("first_fetched"), F.max(fetched).alias("last_fetched"),
    )


def markup_share(col: Column | str) -> Column:
    """Share of characters within tags."""
    t = text_of(col)
    return F.when(F.length(t) > 0, (F.length(t) - F.length(F.regexp_replace(t, r"<[A-Za-z/!][^<>]*>", ""))) / F.length(t)).otherwise(F.lit(0.0))
