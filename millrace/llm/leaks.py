"""Evaluation texts leaking into training text (problem 6).

The items' words make one generalised suffix automaton. A document's words are streamed through it; the length matched
at each word is the longest run ending there that some item contains. Where it reaches the least length, the state that
holds the run's last ``length`` words knows every item that contains them, so no pair of document and item is missed.
Workers build the automaton from the items' words, once a process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.words import WORD

LENGTH = 13
#: Share of a document's words in leaked runs from which on the whole document is to be dropped.
COVERAGE = 0.5
#: Words of items in one automaton, which takes about 700 bytes a word; more items are searched for in further passes
#: over the documents.
MAX_WORDS = 250_000
#: Separates items in the word stream; no word has this number.
_NONE = -1


class SuffixAutomaton:
    """A generalised suffix automaton over word numbers, with the items of every run of ``length`` words."""

    def __init__(self, items: list[tuple[int, list[str]]], length: int = LENGTH) -> None:
        self.length = length
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        numbered = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            numbered.append((item, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        #: The state, among those a run passes by links, that holds the run's last `length` words.
        self.base = [self._base(s) for s in range(len(self.len))]
        found: dict[int, set[int]] = {}
        for item, ids in numbered:
            state = at = 0
            for w in ids:
                state, at = self.step(state, at, w)
                if at >= length:
                    found.setdefault(self.base[state], set()).add(item)
        self.items = {s: tuple(sorted(v)) for s, v in found.items()}

    def _extend(self, last: int, w: int) -> int:
        nxt, link, size = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        cur = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        clone = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _base(self, s: int) -> int:
        if self.len[s] < self.length:
            return -1
        while self.len[self.link[s]] >= self.length:
            s = self.link[s]
        return s

    def step(self, state: int, at: int, w: int) -> tuple[int, int]:
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            at = self.len[state]
        if w in nxt[state]:
            return nxt[state][w], at + 1
        return 0, 0

    def search(self, words: list[str]) -> tuple[set[int], list[tuple[int, int]]]:
        """The items that share a run of at least ``length`` words, and the words' spans (first, behind the last)."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, _NONE) for w in words), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(ids == _NONE)
        edges = np.r_[-1, unknown, len(ids)]
        items: set[int] = set()
        spans: list[tuple[int, int]] = []
        # A run lies between two words that no item has.
        for k in np.flatnonzero(np.diff(edges) > self.length):
            first, end = int(edges[k]) + 1, int(edges[k + 1])
            state = at = 0
            for i, w in enumerate(ids[first:end].tolist(), first):
                state, at = self.step(state, at, w)
                if at >= self.length:
                    items.update(self.items[self.base[state]])
                    if spans and i - at + 1 <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i - at + 1), i + 1)
                    else:
                        spans.append((i - at + 1, i + 1))
        return items, spans


def words_of(text: str) -> tuple[list[str], str]:
    """The words in lower case, and a text in which they stand at the same places as in ``text``."""
    low = text.lower()
    if len(low) == len(text):
        return WORD.findall(low), low
    # A letter that becomes two in lower case would move all behind it, and may be cut by its accent.
    return [w.lower() for w in WORD.findall(text)], text


_BY_ITEMS: dict[str, SuffixAutomaton] = {}


def _automaton(block: list[tuple[int, list[str]]], length: int, digest: str) -> SuffixAutomaton:
    """A process keeps the last automaton that it built: its tasks follow one another through one block."""
    if digest not in _BY_ITEMS:
        _BY_ITEMS.clear()
        _BY_ITEMS[digest] = SuffixAutomaton(block, length)
    return _BY_ITEMS[digest]


def _blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items, as many at a time as one automaton may hold; an item with more words is a block of its own."""
    block, size = [], 0
    for item, t in items.select(key, text).where(f"`{key}` is not null and `{text}` is not null").orderBy(key).toLocalIterator():
        words, _ = words_of(t)
        if size + len(words) > limit and block:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield block


_SPAN = ("first", "end", "first_char", "end_char")
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in _SPAN]))


def leaks(docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", length: int = LENGTH, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents that share a run of at least ``length`` words with an item.

    One row per such document: key, items, n_words, spans (first word, behind the last word, first character, behind the
    last character; rising and apart), coverage (share of words in spans). ``doc_key`` is unique. Null and blank texts,
    and items with fewer words, match nothing; repeated items are reported under each key. Copies of a document are
    reported each. Empty tables give no rows. Items beyond ``max_words`` cost one more pass over the documents for each
    such block; what the passes found is then merged by document.
    """
    schema = docs.select(doc_key).schema.add("items", _longs()).add("n_words", "long").add("spans", _spans()).add("coverage", "double")
    out, passes = None, 0
    for block in _blocks(items, item_key, item_text, max_words):
        digest = hashlib.sha256(repr((length, block)).encode("utf-8", "surrogatepass")).hexdigest()

        def run(batches: Iterator[pa.RecordBatch], block: list = block, digest: str = digest) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block, length, digest)
            for batch in batches:
                at, found = [], ([], [], [], [])
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if not t:
                        continue
                    words, placed = words_of(t)
                    hit, spans = automaton.search(words)
                    if not hit:
                        continue
                    places = [m.span() for m in WORD.finditer(placed)]
                    at.append(i)
                    found[0].append(sorted(hit))
                    found[1].append(len(words))
                    found[2].append([dict(zip(_SPAN, (a, b, places[a][0], places[b - 1][1]), strict=True)) for a, b in spans])
                    found[3].append(sum(b - a for a, b in spans) / len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(found[0], pa.list_(pa.int64())), pa.array(found[1], pa.int64()), pa.array(found[2], _SPANS), pa.array(found[3], pa.float64())],
                    names=[doc_key, "items", "n_words", "spans", "coverage"],
                )

        part = docs.select(doc_key, doc_text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
        passes += 1
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out if passes == 1 else _merged(out, doc_key)


def _merged(found: DataFrame, doc_key: str) -> DataFrame:
    """One row per document of the passes' rows: spans that touch or overlap become one."""
    whole = found.groupBy(doc_key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shares = [], []
            for spans, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept = []
                for s in spans:
                    if kept and s["first"] <= kept[-1]["end"]:
                        kept[-1]["end"], kept[-1]["end_char"] = max(kept[-1]["end"], s["end"]), max(kept[-1]["end_char"], s["end_char"])
                    else:
                        kept.append(s)
                rows.append(kept)
                shares.append(sum(s["end"] - s["first"] for s in kept) / n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, _SPANS), pa.array(shares, pa.float64())], names=[doc_key, "items", "n_words", "spans", "coverage"])

    return whole.mapInArrow(run, found.schema)


def _longs():
    return T.ArrayType(T.LongType())


def _spans():
    return T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in _SPAN]))


def leaked_pairs(found: DataFrame, *, doc_key: str = "doc_id") -> DataFrame:
    """All distinct pairs of document and leaked item."""
    return found.select(doc_key, F.explode("items").alias("item_id")).distinct()


def leak_report(found: DataFrame, *, doc_key: str = "doc_id", coverage: float = COVERAGE) -> DataFrame:
    """By leaking document: n_items, n_words, leaked_words (words in spans) and whether it is to be dropped whole."""
    leaked = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(doc_key, F.size("items").cast("long").alias("n_items"), "n_words", leaked.alias("leaked_words"), (F.col("coverage") > coverage).alias("dropped"))


def scrub(docs: DataFrame, found: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without leaks: spans are cut out, documents whose ``coverage`` exceeds the limit are left out.

    ``found`` is what :func:`leaks` gives, one row per document. Rows without a leak pass as they are, null texts too.
    """
    mine = found.select(F.col(doc_key).alias("__key"), F.col("spans").alias("__spans"), F.col("coverage").alias("__coverage"))
    joined = docs.join(mine, docs[doc_key] == F.col("__key"), "left").where(F.coalesce(F.col("__coverage") <= coverage, F.lit(True)))
    text = F.col(doc_text)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__spans", lambda s: s["end_char"]))
    ends = F.concat(F.transform("__spans", lambda s: s["first_char"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(text, p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int"))), "")
    return joined.withColumn(doc_text, F.when(F.col("__spans").isNull(), text).otherwise(kept)).select(*docs.columns)
