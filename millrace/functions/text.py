"""Text functions: Column in, Column out, all inside the JVM unless said otherwise.

Nulls are read as empty texts. White space is Unicode's, letters and digits are Unicode's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A class of all white space, for Java and RE2 alike.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters one by one.
BLANKS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: What is no word character of the comparison form.
NO_WORD = r"[^\p{L}\p{N}_]"
FENCE = r"(?m)^```"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; an expression used within a lambda is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip(col: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(text_of(col), F.lit(BLANKS))


def words(col: Column | str) -> Column:
    """The runs between white space."""
    return F.filter(F.split(text_of(col), f"{SPACE}+"), lambda w: w != "")


def word_count(col: Column | str) -> Column:
    return F.size(words(col))


def squeeze(col: Column | str) -> Column:
    """Lower case, white space as single spaces: the form that exact hashes are taken of."""
    return F.trim(F.regexp_replace(F.lower(text_of(col)), f"{SPACE}+", " "))


def exact_hash(col: Column | str) -> Column:
    return F.sha2(squeeze(col), 256)


def comparison_form(col: Column | str) -> Column:
    """Lower case, anything but letters, digits and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text_of(col)), f"{NO_WORD}+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.str.normalize("NFKC")


_LINE_BLANK = r"[\t\x{0B}-\r\x{1C}-\x{20}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BEYOND_ASCII = r"[^\x{00}-\x{7F}]"


def _tidy(t: Column) -> Column:
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = let(t, lambda x: F.when(x.rlike(r"[\x{A0}\x{200B}\x{00}]"), F.translate(x, "\u00a0\u200b\x00", " ")).otherwise(x))
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    # Looked for at line ends only, which is far cheaper; those at the end of the text are stripped.
    t = let(t, lambda x: F.when(x.rlike(f"(?<={_LINE_BLANK})\n"), F.regexp_replace(x, f"{_LINE_BLANK}+(?=\n)", "")).otherwise(x))
    return strip(t)


def normalize_text(col: Column | str) -> Column:
    """NFKC, one kind of line end, no odd blanks, at most one empty line in a row, no blanks at line ends.

    Only texts with characters beyond ASCII pass through Python, for NFKC: of others a null is sent.
    """
    t = text_of(col)
    return _tidy(F.coalesce(_nfkc(F.when(t.rlike(_BEYOND_ASCII), t)), t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in texts:
        yield column.map(lambda ts: None if ts is None else [unicodedata.normalize("NFKC", t) for t in ts])


def normalize_texts(texts: Column) -> Column:
    """Every text of an array without nulls normalized as :func:`normalize_text` does, within the row."""
    wide = F.exists(texts, lambda t: t.rlike(_BEYOND_ASCII))
    return F.transform(F.coalesce(_nfkc_all(F.when(wide, texts)), texts), _tidy)


def _runs(items: Column, n: int) -> Column:
    last = F.size(items) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(items, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` items as strings; none if there are fewer."""
    return let(items, lambda x: _runs(x, n))


def repetition(col: Column | str, n: int = 4) -> Column:
    """Share of n-grams of words that repeat an earlier one; 0 without n-grams."""
    share = lambda g: F.when(F.size(g) > 0, 1.0 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0))
    return let(ngrams(words(col), n), share)


def repeats_too_much(col: Column | str, *, limit: float = 0.4, n: int = 4, least: int = 20) -> Column:
    """Looping text: at least ``least`` words and more than ``limit`` of the n-grams repeated."""

    def found(w: Column) -> Column:
        # Hashes may take two runs for one, never one for two: only where they see too many repeats are the runs compared.
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.slice(h, 1, F.size(h) - n + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)])))
        seems = let(hashes, lambda r: 1.0 - F.size(F.array_distinct(r)) / F.size(r) > limit)
        exact = lambda: let(_runs(w, n), lambda g: 1.0 - F.size(F.array_distinct(g)) / F.size(g) > limit)
        return F.when(F.size(w) < max(least, n), F.lit(False)).when(seems, exact()).otherwise(F.lit(False))

    return let(words(col), found)


def unigram_repetition(col: Column | str, *, empty: float = 1.0) -> Column:
    """Share of words that repeat an earlier one; ``empty`` without words."""
    return let(words(col), lambda w: F.when(F.size(w) > 0, 1 - F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(empty)))


def fences_balanced(col: Column | str) -> Column:
    return F.regexp_count(text_of(col), F.lit(FENCE)) % 2 == 0


# Words that no finished text ends with.
ORPHANS = ("and", "or", "but", "because", "the", "a", "an", "with", "in", "for")


def cut_off(col: Column | str) -> Column:
    """Blank, an open fence, or an orphaned word at the end."""

    def found(t: Column) -> Column:
        return (t == "") | ~fences_balanced(t) | F.lower(F.right(t, F.lit(20))).rlike(f" (?:{'|'.join(ORPHANS)})$")

    return let(strip(col), found)


def shingles(tokens: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` tokens; of fewer tokens, the distinct tokens."""
    return let(tokens, lambda x: F.array_distinct(F.when(F.size(x) < k, x).otherwise(_runs(x, k))))


def ascii_words(col: Column | str) -> Column:
    """Runs of ASCII letters, digits, underscores and hyphens that begin and end at word boundaries, in lower case."""
    return F.regexp_extract_all(F.lower(text_of(col)), F.lit(r"(?U)\b[a-zA-Z0-9_-]+\b"), 0)


def prompt_shingles(col: Column | str, k: int = 3) -> Column:
    return shingles(ascii_words(col), k)


def comparison_shingles(col: Column | str, k: int = 3) -> Column:
    return shingles(F.filter(F.split(comparison_form(col), " "), lambda w: w != ""), k)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def has_keyword(col: Column | str, keywords: Column) -> Column:
    """Whether any keyword stands in the text between word boundaries, without case."""
    return let(F.lower(text_of(col)), lambda t: F.exists(keywords, lambda k: F.rlike(t, _bounded(k))))


def has_all_keywords(col: Column | str, keywords: Column) -> Column:
    return let(F.lower(text_of(col)), lambda t: F.forall(keywords, lambda k: F.rlike(t, _bounded(k))))


def _bounded(keyword: Column) -> Column:
    return F.concat(F.lit(r"(?U)\b"), F.regexp_replace(F.lower(keyword), r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b"))


def first_words(col: Column | str, n: int = 8) -> Column:
    return F.array_join(F.slice(words(col), 1, n), " ")


def echoes_wrapped(prompt: Column | str, answer: Column | str) -> Column:
    """Whether the answer begins like the prompt's last line, without its speaker mark, or like a turn."""
    line = F.element_at(F.split(text_of(prompt), "\n"), -1)
    q = F.substring(F.lower(strip(F.replace(line, F.lit("Assistant:"), F.lit("")))), 1, 80)
    a = F.substring(F.lower(text_of(answer)), 1, 80)
    return F.when((q == "") | (a == ""), F.lit(False)).otherwise(F.startswith(a, F.substring(q, 1, 40)) | F.startswith(a, F.lit("user:")))


def echoes_plain(prompt: Column | str, answer: Column | str) -> Column:
    q, a = (F.substring(F.lower(text_of(c)), 1, 80) for c in (prompt, answer))
    return F.when((q == "") | (a == ""), F.lit(False)).otherwise(F.startswith(a, q))


def drifts_to_dialog(col: Column | str) -> Column:
    return F.contains(text_of(col), F.lit("User:")) | F.contains(text_of(col), F.lit("Assistant:"))


def approx_tokens(chars: Column) -> Column:
    """Characters by four, halves to the even number."""
    return F.bround(chars / 4).cast("long")


def checkpoint_step(col: Column | str) -> Column:
    """The number in ``checkpoint-N``, -1 without one."""
    step = F.regexp_extract(text_of(col), r"checkpoint-(\d+)", 1)
    return F.when(step == "", F.lit(-1).cast("long")).otherwise(step.cast("long"))


def title(col: Column | str) -> Column:
    """Underscores as spaces, words with a capital."""
    return F.initcap(F.replace(text_of(col), F.lit("_"), F.lit(" ")))


def score_text(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", col))


def delta_text(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("N/A")).otherwise(F.concat(F.when(col > 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.4f", col)))
