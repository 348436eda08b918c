"""Records held against benchmark prompts: equal, contained, or similar by shingles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import comparison_form, comparison_shingles, ngrams
from millrace.operators.dedup import similar_sets
from millrace.session import materialize

#: Texts must be longer than this, in comparison form, to match by containment.
LEAST_CONTAINED = 40
#: Characters of the windows by which containment is found: no more than the shortest text that may match has.
WINDOW = 32
#: Benchmark characters that are sent to every task, at 9 bytes each; more are held against the records in further passes.
MAX_SENT = 2_000_000
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def windows(text: str) -> np.ndarray:
    """Hashes of all runs of WINDOW characters, by doubling; none of a shorter text."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(h) < WINDOW:
        return h[:0]
    size = 1
    for k in _K:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(31))) * k + h[size:]
        size *= 2
    return h


class Prompts:
    """Benchmark prompts by their windows: which of them equal, hold, or lie within a text."""

    def __init__(self, prompts: list[tuple[int, str]]) -> None:
        self.last = {}
        for item, form in sorted(prompts):
            self.last[form] = item
        self.long = [(i, f) for i, f in sorted(prompts) if len(f) > LEAST_CONTAINED]
        self.most = max((len(f) for _, f in self.long), default=0)
        hashes = [windows(f) for _, f in self.long]
        self.first = np.array([h[0] for h in hashes], dtype=np.uint64)
        self.by_first = np.argsort(self.first, kind="stable")
        self.first = self.first[self.by_first]
        # Every window of every prompt: its hash, prompt and place.
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.all = flat[order]
        ends = np.cumsum([len(h) for h in hashes]) if hashes else np.empty(0, np.int64)
        self.owner = np.searchsorted(ends, order, side="right").astype(np.int32)
        self.place = (order - (ends - [len(h) for h in hashes])[self.owner] if hashes else order).astype(np.int32)

    def equal(self, form: str) -> int | None:
        """Of equal prompts the last one."""
        return self.last.get(form)

    def containing(self, form: str) -> int | None:
        """The least prompt that the text holds, or that holds the text; both are longer than LEAST_CONTAINED."""
        if len(form) <= LEAST_CONTAINED or not self.long:
            return None
        found = []
        h = windows(form)
        at = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
        for i in np.flatnonzero(self.first[at] == h):
            for k in range(at[i], len(self.first)):
                if self.first[k] != h[i]:
                    break
                item, prompt = self.long[self.by_first[k]]
                if form.startswith(prompt, int(i)):
                    found.append(item)
        if len(form) <= self.most:
            for k in range(int(np.searchsorted(self.all, h[0])), len(self.all)):
                if self.all[k] != h[0]:
                    break
                item, prompt = self.long[self.owner[k]]
                if prompt.startswith(form, int(self.place[k])):
                    found.append(item)
        return min(found, default=None)


def _blocks(bench: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The prompts, as many at a time as may be sent to every task."""
    block, size = [], 0
    for item, form in bench.select("bench_id", "bench_form").orderBy("bench_id").toLocalIterator():
        if size + len(form) > limit and block:
            yield block
            block, size = [], 0
        block.append((item, form))
        size += len(form)
    if block:
        yield block


def benchmark_forms(bench: DataFrame, item: str, text: str) -> DataFrame:
    """bench_id, bench_form, bench_set. Blank prompts are left out; of equal forms the last item names the match."""
    rows = bench.select(F.col(item).alias("bench_id"), comparison_form(text).alias("bench_form"), comparison_shingles(text).alias("bench_set"))
    return rows.where("bench_form <> '' and bench_id is not null")


def contamination(df: DataFrame, bench: DataFrame, *, key: str, text: str, item: str = "item_id", bench_text: str = "text", threshold: float = 0.7, max_sent: int = MAX_SENT) -> DataFrame:
    """Contaminated records: key, kind (exact, substring or jaccard), bench_id, similarity (null but for jaccard).

    The first kind that applies is named, and of several items the least one (of equal ones the last). Blank texts match
    nothing. ``key`` is unique. Texts never leave their task: equal and contained prompts are looked up where a record is
    read, and for the similarity only shingles' hashes move. Items beyond ``max_sent`` characters cost a further pass.
    """
    forms = materialize(df.select(F.col(key).alias("__key"), comparison_form(text).alias("form")).where("form <> ''"), "forms")
    b = materialize(benchmark_forms(bench, item, bench_text), "bench")
    schema = forms.select("__key").schema.add("equal", "long").add("inside", "long")
    looked = None
    for block in _blocks(b, max_sent):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            prompts = Prompts(block)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                equal, inside = [prompts.equal(t) for t in texts], [prompts.containing(t) for t in texts]
                hit = pa.array([e is not None or i is not None for e, i in zip(equal, inside, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(equal, pa.int64()), pa.array(inside, pa.int64())], names=["__key", "equal", "inside"]).filter(hit)

        part = forms.mapInArrow(run, schema)
        looked = part if looked is None else looked.unionByName(part)
    if looked is None:
        return df.sparkSession.createDataFrame([], df.select(key).schema.add("kind", "string").add("bench_id", "long").add("similarity", "double"))
    hashed = lambda s: F.array_sort(F.array_distinct(F.transform(s, lambda x: F.xxhash64(x))))
    docs = forms.select(F.col("__key").alias("id"), hashed(comparison_shingles("form")).alias("set"))
    near = similar_sets(docs, threshold, b.select(F.col("bench_id").alias("id"), hashed(F.col("bench_set")).alias("set")).where("size(set) > 0"))
    none = F.lit(None)
    hits = looked.select("__key", "equal", "inside", none.cast("struct<b:bigint,s:double>").alias("near")).unionByName(
        near.select(F.col("a").alias("__key"), none.cast("long").alias("equal"), none.cast("long").alias("inside"), F.struct(F.col("b").cast("long").alias("b"), F.col("similarity").alias("s")).alias("near"))
    )
    best = hits.groupBy("__key").agg(F.max("equal").alias("equal"), F.min("inside").alias("inside"), F.min("near").alias("near"))
    kind = F.when(F.col("equal").isNotNull(), "exact").when(F.col("inside").isNotNull(), "substring").otherwise("jaccard")
    return best.select(F.col("__key").alias(key), kind.alias("kind"), F.coalesce("equal", "inside", "near.b").alias("bench_id"), F.when(kind == "jaccard", F.col("near.s")).alias("similarity"))


def drop_contaminated(df: DataFrame, bench: DataFrame, *, text: str, item: str = "item_id", bench_text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` without the rows that :func:`contamination` names, row by row: works on a stream as on a table.

    The benchmark is sent to every task; one of more than MAX_SENT characters is refused.
    """
    forms = [(r[0], r[1], r[2]) for r in benchmark_forms(bench, item, bench_text).limit(MAX_SENT).toLocalIterator()]
    if sum(len(f) for _, f, _ in forms) > MAX_SENT:
        raise ValueError(f"a benchmark of more than {MAX_SENT} characters cannot be held against single rows")
    form = "__form"
    while form in df.columns:
        form += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prompts = Prompts([(i, f) for i, f, _ in forms])
        sizes = [len(s) for _, _, s in forms]
        having: dict[str, list[int]] = {}
        for k, (_, _, shingles) in enumerate(forms):
            for x in shingles:
                having.setdefault(x, []).append(k)

        def similar(form: str) -> bool:
            words = form.split(" ")
            own = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or set(words)
            common = Counter(k for x in own for k in having.get(x, ()))
            return any(n >= threshold * (len(own) + sizes[k] - n) for k, n in common.items())

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            clean = pa.array([not t or (prompts.equal(t) is None and prompts.containing(t) is None and not similar(t)) for t in texts], pa.bool_())
            yield batch.select(range(batch.num_columns - 1)).filter(clean)

    return df.withColumn(form, comparison_form(text)).mapInArrow(run, df.schema)


def ngram_matches(df: DataFrame, bench: DataFrame, *, key: str, text: str, item: str = "item_id", bench_text: str = "text", n: int = 13) -> DataFrame:
    """Records that share a run of ``n`` words with a benchmark item: key, bench_id, n_shared (distinct runs).

    Runs are told apart by 64-bit hashes, which alone move; a record's runs meet the benchmark's where it is read as long
    as the planner sends those along. Shorter texts match nothing.
    """

    def grams(rows: DataFrame, k: str, t: str, name: str) -> DataFrame:
        runs = ngrams(F.filter(F.split(comparison_form(t), " "), lambda w: w != ""), n)
        return rows.select(F.col(k).alias(name), F.explode(F.array_distinct(F.transform(runs, lambda g: F.xxhash64(g)))).alias("g"))

    items = materialize(grams(bench, item, bench_text, "bench_id"), "runs")
    return grams(df, key, text, key).join(items, "g").groupBy(key, "bench_id").agg(F.count("*").alias("n_shared"))


def decontaminate(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Without contaminated records."""
    return df.join(found.select(key), key, "left_anti")
