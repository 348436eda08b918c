"""Token counts under a longest-match reading of a tokenizer's vocabulary, and token budgets by slice (problem 1).

The vocabulary becomes a byte trie with failure links and precomputed emissions: a mismatch emits the tokens that
longest match would have taken for the pending bytes and jumps to the node of what is left, so each byte is read once.
Pre-tokens repeat, so their counts are kept by worker and a text costs one dictionary look-up a pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import LanguageModel, contents, name_key, seeded

#: The folder of vocabulary files and the file used; both are parameters of every operator that counts tokens.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Splits text before matching. The vocabulary's own pattern, written for the standard library's engine.
PRETOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Counts kept by a worker before it starts anew.
CACHE = 500_000


def read_vocabulary(path: str | None = None) -> list[bytes]:
    with open(path or os.path.join(TOKENIZERS, VOCABULARY), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Matcher:
    """Counts longest-match tokens of byte strings in linear time.

    Bytes that no token begins with count as one token each.
    """

    def __init__(self, vocabulary: list[bytes]) -> None:
        child: dict[int, int] = {}  # node * 256 + byte -> node
        final = [False]
        for token in sorted({*vocabulary, *(bytes([b]) for b in range(256))} - {b""}):
            node = 0
            for b in token:
                key = node << 8 | b
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(final)
                    final.append(False)
                node = nxt
            final[node] = True
        fail, emit = [0] * len(final), [0] * len(final)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        todo = deque([0])
        while todo:
            parent = todo.popleft()
            for b, node in below.get(parent, ()):
                todo.append(node)
                if final[node]:
                    fail[node], emit[node] = 0, 1
                    continue
                at, sent = fail[parent], emit[parent]
                while (nxt := child.get(at << 8 | b)) is None:
                    sent += emit[at]
                    at = fail[at]
                fail[node], emit[node] = nxt, sent
        self.child, self.fail, self.emit = child, fail, emit

    def count(self, data: bytes) -> int:
        child, fail, emit = self.child, self.fail, self.emit
        node = n = 0
        for b in data:
            while (nxt := child.get(node << 8 | b)) is None:
                n += emit[node]
                node = fail[node]
            node = nxt
        while node:
            n += emit[node]
            node = fail[node]
        return n


class Counts(dict):
    """Token counts by pre-token, filled when first asked for."""

    def __init__(self, matcher: Matcher) -> None:
        super().__init__()
        self.matcher = matcher

    def __missing__(self, pretoken: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[pretoken] = self.matcher.count(pretoken.encode("utf-8", "surrogatepass"))
        return n


_BY_VOCABULARY: dict[str, Counts] = {}


def counter(vocabulary: list[bytes]) -> Callable[[str], int]:
    """A function from text to tokens; a worker builds the automaton once for all its tasks."""
    key = hashlib.sha256(b"\n".join(vocabulary)).hexdigest()
    if key not in _BY_VOCABULARY:
        _BY_VOCABULARY[key] = Counts(Matcher(vocabulary))
    look, split = _BY_VOCABULARY[key].__getitem__, PRETOKEN.findall
    return lambda text: sum(map(look, split(text)))


def with_tokens(df: DataFrame, text: Column, *, tokens: str = "n_tokens", lang: str | None = None, keep: list[str] | None = None, vocabulary: str | None = None, languages: LanguageModel | None = None) -> DataFrame:
    """``keep`` columns (all by default), the tokens of ``text`` and, if ``lang`` is named, its language.

    A null or empty text has 0 tokens and the language ``und``. Texts are read whole, whatever their length. Without a
    model of ``languages``, function words tell them.
    """
    keep = df.columns if keep is None else keep
    vocab = read_vocabulary(vocabulary)
    model = (languages or seeded()) if lang else None
    extra = [pa.field(tokens, pa.int64()), *([pa.field(lang, pa.string())] if lang else [])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocab)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            more = [pa.array([of(t) if t else 0 for t in texts], pa.int64())]
            if lang:
                more.append(pa.array([model.language(t) for t in texts], pa.string()))
            cols = [batch.column(i) for i in range(len(keep))] + more
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f.name for f in extra)])

    inside = "__text"
    while inside in keep:
        inside += "_"
    schema = df.select(*keep).schema.add(tokens, "long")
    if lang:
        schema = schema.add(lang, "string")
    return df.select(*keep, text.alias(inside)).mapInArrow(count, schema)


def token_budget(df: DataFrame, *, messages: str = "messages", source: str = "source", category: str = "category", vocabulary: str | None = None, languages: LanguageModel | None = None) -> DataFrame:
    """Records, characters and tokens by source, by language of the text, by category, and in all.

    Spellings of one source or category count together under their letters and digits; null, blank and unnamed ones
    count as ``(none)``. One row per slice: dimension (source, language, category, all), slice, n_records, n_chars,
    n_tokens, token_share (null where there is no token). An empty table gives no rows. Sums are made per partition before the
    shuffle, so a slice that holds most rows costs no more than others.
    """
    none = F.lit("(none)")
    text = contents(F.col(messages), sep="\n")
    rows = df.select(
        F.coalesce(name_key(F.col(source)), none).alias("source"), F.coalesce(name_key(F.col(category)), none).alias("category"),
        text.alias("text"), F.length(text).cast("bigint").alias("n_chars"),
    )
    counted = with_tokens(rows, F.col("text"), lang="language", keep=["source", "category", "n_chars"], vocabulary=vocabulary, languages=languages)
    cells = counted.groupBy("source", "language", "category").agg(F.count("*").alias("n_records"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
    sums = [F.sum(c).alias(c) for c in ("n_records", "n_chars", "n_tokens")]
    sides = F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(d) if d in cells.columns else F.lit(d)).alias("slice")) for d in ("source", "language", "category", "all")])
    slices = cells.select(F.explode(sides).alias("side"), "n_records", "n_chars", "n_tokens").groupBy("side.dimension", "side.slice").agg(*sums)
    total = F.sum("n_tokens").over(Window.partitionBy("dimension"))
    return slices.withColumn("token_share", F.col("n_tokens") / F.nullif(total, F.lit(0)))


__all__ = ["Matcher", "counter", "read_vocabulary", "token_budget", "with_tokens"]
