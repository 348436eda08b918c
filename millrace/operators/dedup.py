"""Exact and near deduplication on word shingles, and contamination between splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import exact_hash, prompt_shingles
from millrace.session import materialize

#: Rounds after which the keep-first rule must be done, or it raises: half the longest chain of records each near the one before.
MAX_ROUNDS = 1000
#: Sets of which a sample is drawn to learn which shingles are frequent, and how many of these are remembered, at the most.
FREQUENT_SAMPLE, FREQUENT = 20_000, 500_000
#: Rows under one shingle from which on they are dealt to blocks, and how many a block holds, about.
HOT = BLOCK = 4096
#: Parts in which the shingles of large tables are taken, and how many pairs are compared at once.
PARTS, COMPARED = 4, 1_000_000
#: Ids of copies or of records in doubt up to this number are sent to all tasks; more are joined.
MAX_SENT = 2_000_000


def first_by(df: DataFrame, by: Sequence[Column | str], key: str, first: str = "first_id") -> DataFrame:
    """Every row with the least ``key`` among rows equal in ``by``; null values are equal.

    The least keys are pre-aggregated, so a value that a third of all rows share costs one row per partition.
    """
    names = [f"__by{i}" for i in range(len(by))]
    rows = df.withColumns(dict(zip(names, [F.col(b) if isinstance(b, str) else b for b in by], strict=True)))
    least = rows.groupBy(*names).agg(F.min(key).alias(first))
    on = None
    renamed = least.select(*[F.col(n).alias(n + "_r") for n in names], first)
    for n in names:
        c = rows[n].eqNullSafe(renamed[n + "_r"])
        on = c if on is None else on & c
    return rows.join(renamed, on).select(*df.columns, first)


def exact_duplicates(df: DataFrame, text: Column | str, key: str) -> DataFrame:
    """Every row with ``first_id``, the least key of rows with the same text but for case and white space."""
    return first_by(df, [exact_hash(text)], key)


def keep_first(df: DataFrame, text: Column | str, key: str) -> DataFrame:
    """The first row of each text."""
    return exact_duplicates(df, text, key).where(F.col(key) == F.col("first_id")).drop("first_id")


def hashed_sets(df: DataFrame, key: str, sets: Column) -> DataFrame:
    """id and set: the distinct 64-bit hashes of the shingles."""
    return df.select(F.col(key).alias("id"), F.array_distinct(F.transform(sets, lambda s: F.xxhash64(s))).alias("set"))


#: Gives id and set of the records with the ids, of all without.
Sets = Callable[[DataFrame | None], DataFrame]


def _sets_of(df: DataFrame, key: str, sets: Column) -> Sets:
    """Records are chosen before their sets are computed: Spark does not move a join or a filter below them."""

    def chosen(ids: DataFrame | None) -> DataFrame:
        rows = df if ids is None else df.join(sent(ids.toDF("__id")), F.col(key) == F.col("__id"), "left_semi")
        return hashed_sets(rows, key, sets)

    return chosen


def sent(ids: DataFrame) -> DataFrame:
    """``ids``, a small table, to be sent to all tasks; to be joined if they are too many."""
    return F.broadcast(ids) if ids.count() <= MAX_SENT else ids


def shingle_classes(df: DataFrame, key: str, sets: Column) -> DataFrame:
    """id, rep (the least id with the same set of shingles), set (sorted hashes), n. Null and empty sets are left out.

    Sets are told apart by two hashes of 96 bits in all. The shingles are computed once and kept in a table.
    """
    rows = hashed_sets(df, key, sets).withColumn("set", F.sort_array("set"))
    rows = materialize(rows.where("size(set) > 0").withColumns({"__a": F.xxhash64("set"), "__b": F.hash("set")}), "shingles")
    return first_by(rows, ["__a", "__b"], "id", "rep").select("id", "rep", "set", F.size("set").alias("n"))


def _sampled(df: DataFrame, key: str) -> DataFrame:
    """About ``FREQUENT_SAMPLE`` rows, chosen by a hash of the key; all if there are no more."""
    share = FREQUENT_SAMPLE / max(FREQUENT_SAMPLE, df.count())
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 53)) < F.lit(int((1 << 53) * share)))


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled ``sets`` have, rising, and how many have them.

    They only order the shingles of a set: results do not depend on what the sample holds.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten()], names=["h"])

    seen = sets.select("set").mapInArrow(flat, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rows = seen.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    shingle, count = (rows.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(shingle)
    return shingle[order], count[order]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes mixed once more (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sketches(sets: DataFrame, threshold: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, n, ha and hb (equal for equal sets), sketch, prefix of each set that is not empty.

    ``prefix``: 32 bits of the first n - ceil(threshold * n) + 1 shingles, seldom ones first; the order goes by 40 bits,
    and shingles that agree in these count as one that occurs twice. ``sketch``: 256 bits, each the parity of how many
    shingles fall on it: sets differ in at least as many shingles as their sketches in bits.
    """
    known, often = frequent
    rank = np.minimum(255, np.round(16 * np.log2(np.maximum(often, 1)))).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1 << 15):  # the row has 16 bits of the sort key
                batch = whole.slice(start, 1 << 15)
                batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(1)), 0), 0))
                if not batch.num_rows:
                    continue
                n = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
                flat = batch.column(1).flatten().to_numpy()
                ends = np.cumsum(n)
                first = ends - n
                row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                mixed = _mixed(flat.view(np.uint64))
                key = (row << np.uint64(48)) | (mixed >> np.uint64(24))
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    key |= np.where(known[at] == flat, rank[at], np.uint64(0)) << np.uint64(40)
                key.sort()
                length = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
                kept = np.arange(len(flat)) - np.repeat(first, n) < np.repeat(length, n)
                prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), key[kept].astype(np.uint32).view(np.int32))
                bit, word = np.uint64(1) << (mixed & np.uint64(63)), (mixed >> np.uint64(6)) & np.uint64(3)
                sketch = np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), first) for w in range(4)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(n.astype(np.int32)),
                        pa.array(np.add.reduceat(mixed, first).view(np.int64)),
                        pa.array(np.add.reduceat(_mixed(mixed ^ np.uint64(0x9E3779B97F4A7C15)), first).view(np.int64)),
                        pa.Array.from_buffers(pa.binary(32), len(n), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary()),
                        prefix,
                    ],
                    names=["id", "n", "ha", "hb", "sketch", "prefix"],
                )

    schema = sets.select("id").schema.add("n", "integer").add("ha", "long").add("hb", "long").add("sketch", "binary").add("prefix", T.ArrayType(T.IntegerType()))
    return sets.select("id", "set").mapInArrow(run, schema)


def _packets(sketches: DataFrame, side: int, part: int, parts: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """bucket, data: the prefix entries of every ``parts``-th shingle as Arrow tables, those of one group in one bucket.

    An entry is g (its group), s (its side), id, n, p (its place) and sketch. A group is a shingle; those of a hot shingle
    are dealt to blocks, and a group is a pair of blocks (of one table) or a block against all (of two). Within a group
    all are compared if their side is 0, else those of different sides.
    """
    shingle, blocks = hot
    kind = pa.binary(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 20_000:
                yield packed(pa.Table.from_batches(held).combine_chunks())
                held = []
        if held:
            yield packed(pa.Table.from_batches(held).combine_chunks())

    def packed(rows: pa.Table) -> pa.RecordBatch:
        z, ids, sizes, sketch, prefix = (rows.column(c).combine_chunks() for c in ("z", "id", "n", "sketch", "prefix"))
        prefix = prefix.chunk(0) if isinstance(prefix, pa.ChunkedArray) else prefix
        n = pc.list_value_length(prefix).to_numpy().astype(np.int64)
        h = prefix.flatten().to_numpy().view(np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        if parts > 1:
            mine = (h >> 7) % parts == part
            h, row, place = h[mine], row[mine], place[mine]
        g, s = h, np.full(len(h), side, np.int8)
        if len(shingle):
            at = np.minimum(np.searchsorted(shingle, h), len(shingle) - 1)
            k = np.where(shingle[at] == h, blocks[at], 1)
            own = z.to_numpy()[row].view(np.uint64).astype(np.float64) / 2.0**64
            own = np.minimum((own * k).astype(np.int64), k - 1)
            times = np.where(k > 1, 1 if side == 1 else k, 1)
            again = np.repeat(np.arange(len(h)), times)
            other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            h, row, place, k, own = h[again], row[again], place[again], k[again], own[again]
            if side:
                cell, s = np.where(k > 1, own if side == 1 else other, 0), s[again]
            else:
                cell = np.minimum(own, other) * k + np.maximum(own, other)
                cell, s = np.where(k > 1, cell, 0), np.where((k == 1) | (own == other), 0, np.where(own < other, 1, 2)).astype(np.int8)
            g = h | (cell << 32)
        bucket = (_mixed(g.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        take = pa.array(row[order])
        table = pa.RecordBatch.from_arrays([pa.array(g[order]), pa.array(s[order]), ids.take(take), sizes.take(take), pa.array(place[order].astype(np.int32)), sketch.cast(kind).take(take)], names=["g", "s", "id", "n", "p", "sketch"])
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        data = []
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_batch(table.slice(a, b - a))
            data.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return sketches.select(F.xxhash64("id").alias("z"), "id", "n", "sketch", "prefix").mapInArrow(run, "bucket int, data binary")


def _met(packets: DataFrame, threshold: float, ids: tuple[T.DataType, T.DataType], one: bool) -> DataFrame:
    """a, b: pairs that share a group and that sizes, places and sketches allow to be similar; often more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for batch in batches for x in batch.column(0)]
        if not tables:
            return
        table = pa.concat_tables(tables)
        del tables
        g, s, n, p = (table.column(c).to_numpy() for c in ("g", "s", "n", "p"))
        order = np.lexsort((n, g))
        g, s, n, p = g[order], s[order], n[order].astype(np.int64), p[order].astype(np.int64)
        id_ = table.column("id").combine_chunks().take(pa.array(order))
        sketch = np.frombuffer(table.column("sketch").combine_chunks().take(pa.array(order)).buffers()[1], np.uint64).reshape(-1, 4)
        rank = np.cumsum(np.diff(g, prepend=g[0]) != 0) << 32
        count = np.searchsorted(rank + n, rank + np.floor(n / threshold + 1e-9).astype(np.int64), side="right") - np.arange(len(g)) - 1
        total, at = np.cumsum(count), 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARED, side="right")))
            c = count[at:to]
            i = np.repeat(np.arange(at, to), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
            common = np.ceil(threshold / (1 + threshold) * (n[i] + n[j]) - 1e-9).astype(np.int64)
            # Of what is left behind the shared shingle, all may be common at the most.
            good = (1 + np.minimum(n[i] - p[i] - 1, n[j] - p[j] - 1) + np.minimum(p[i], p[j]) >= common) & ((s[i] != s[j]) | (s[i] == 0))
            i, j, common = i[good], j[good], common[good]
            good = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j] - 2 * common
            i, j = i[good], j[good]
            if not one:
                i, j = np.where(s[i] == 1, i, j), np.where(s[i] == 1, j, i)
            if len(i):
                yield pa.RecordBatch.from_arrays([id_.take(pa.array(i)), id_.take(pa.array(j))], names=["a", "b"])
            at = to

    return packets.select("data").mapInArrow(run, T.StructType().add("a", ids[0]).add("b", ids[1]))


def _candidates(left: DataFrame, threshold: float, right: DataFrame | None = None) -> DataFrame:
    """a, b: pairs of sketched sets that may be similar, each once.

    The shingles are taken in parts, one after the other, so that the entries of one part only are on disk at a time.
    """
    one = right is None
    sides = [(left, 0)] if one else [(left, 1), (right, 2)]
    entries = sum(d.agg(F.sum(F.size("prefix"))).first()[0] or 0 for d, _ in sides)
    # Which shingles are dealt changes the cost only, so their rows are counted on a share of the sets.
    share = max(1, HOT // 256)
    seen = left.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select(F.explode("prefix").alias("h")).groupBy("h").agg((F.count("*") * share).alias("n")).where(F.col("n") > HOT).toArrow()
    shingle = seen.column("h").to_numpy().view(np.uint32).astype(np.int64)
    order = np.argsort(shingle)
    hot = shingle[order], np.ceil(seen.column("n").to_numpy() / BLOCK).astype(np.int64)[order]
    parts = min(PARTS, 1 + entries // 1_000_000)
    buckets = max(64, entries // parts // 50_000) if entries > 50_000 else 8
    types = left.schema["id"].dataType, (left if one else right).schema["id"].dataType
    found = None
    for part in range(parts):
        packets = None
        for d, side in sides:
            made = _packets(d, side, part, parts, buckets, hot)
            packets = made if packets is None else packets.unionByName(made)
        met = _met(packets.repartition("bucket"), threshold, types, one)
        if one:
            met = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = materialize(met.distinct(), "met")
        found = met if found is None else found.unionByName(met)
    return found if parts == 1 else found.distinct()


def _wide(sets: DataFrame) -> DataFrame:
    """id, n, sketch: as in :func:`_sketches`, of 2048 bits, which tells large sets apart too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
            mixed = _mixed(batch.column(1).flatten().to_numpy().view(np.uint64))
            at, times = np.unique((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(11)) | (mixed & np.uint64(2047)), return_counts=True)
            bits = np.zeros(len(n) << 11, np.uint8)
            bits[at[times % 2 == 1].astype(np.int64)] = 1
            sketch = pa.Array.from_buffers(pa.binary(256), len(n), [None, pa.py_buffer(np.packbits(bits).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), sketch.cast(pa.binary())], names=["id", "n", "sketch"])

    return sets.mapInArrow(run, sets.select("id").schema.add("n", "long").add("sketch", "binary"))


def _allowed(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs (with na, nb, ka, kb: sizes and wide sketches) that these allow to be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, 32) for c in (4, 5))
                most = n - 2 * np.ceil(threshold / (1 + threshold) * n - 1e-9).astype(np.int64)
                yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most))

    return pairs.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, pairs.select("a", "b").schema)


def _ends(pairs: DataFrame, left: Sets, right: Sets | None) -> list[tuple[DataFrame, DataFrame]]:
    """The sets of records in ``pairs``, and their ids with a and b; of both tables if there are two."""
    out = []
    for sets, names in [(left, ("a", "b"))] if right is None else [(left, ("a",)), (right, ("b",))]:
        end = pairs.select(F.explode(F.array(*names)).alias("id"), "a", "b")
        out.append((sets(materialize(end.select("id").distinct(), "ids")), end))
    return out


def _similarities(pairs: DataFrame, threshold: float, left: Sets, right: Sets | None = None) -> DataFrame:
    """a, b, similarity of the ``pairs`` whose sets are similar. Sets are taken only of records that pairs hold for which
    wide sketches allow it too."""
    pairs = materialize(pairs, "pairs")
    wide = [materialize(_wide(sets), "wide") for sets, _ in _ends(pairs, left, right)]
    for sketch, at in ((wide[0], "a"), (wide[-1], "b")):
        pairs = pairs.join(sketch.toDF(at, "n" + at, "k" + at), at)
    pairs = materialize(_allowed(pairs, threshold), "pairs")
    sent = F.broadcast if pairs.count() <= MAX_SENT // 4 else lambda d: d
    ends = [sets.join(sent(end), "id").select("a", "b", "set") for sets, end in _ends(pairs, left, right)]
    both = (ends[0] if right is None else ends[0].unionByName(ends[1])).groupBy("a", "b").agg(F.collect_list("set").alias("s"))
    both = both.select("a", "b", F.col("s")[0].alias("sa"), F.col("s")[1].alias("sb"))
    common = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("k"), (F.size("sa") + F.size("sb")).alias("n"))
    found = common.select("a", "b", (F.col("k") / (F.col("n") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)
    return materialize(found, "similar")


def similar_sets(left: DataFrame, threshold: float, right: DataFrame | None = None) -> DataFrame:
    """a, b, similarity: pairs of sets with a Jaccard similarity of at least ``threshold`` (above 0), exactly.

    ``left`` and ``right`` have id and set (distinct hashes); without ``right``, pairs a < b within ``left``. Both are
    computed more than once. Prefix filter: with shingles in one order, here from those seldom met in a sample to frequent
    ones, similar sets of n shingles share one of the first n - ceil(threshold * n) + 1. Only these leave their row, with
    a sketch of the set. Sizes, places and sketches must allow the similarity; what they allow is compared on whole sets.
    """
    frequent = _frequent(_sampled(left, "id"))
    a, b = (None if d is None else materialize(_sketches(d, threshold, frequent), "sketches") for d in (left, right))
    of = [lambda ids, d=d: d.select("id", "set").join(sent(ids), "id", "left_semi") for d in (left, right)]
    return _similarities(_candidates(a, threshold, b), threshold, of[0], None if right is None else of[1])


def similar_classes(df: DataFrame, key: str, sets: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes (id, rep: the least id with the same set) of the records with shingles, and the similar pairs of reps.

    Sets are told apart by two sums of 128 bits in all. They are not kept: those of records in doubt are computed again.
    """
    frequent = _frequent(hashed_sets(_sampled(df, key), key, sets))
    sketches = materialize(_sketches(hashed_sets(df, key, sets), threshold, frequent), "sketches")
    classes = materialize(first_by(sketches.select("id", "ha", "hb"), ["ha", "hb"], "id", "rep").select("id", "rep"), "classes")
    reps = sketches.join(sent(classes.where("id <> rep").select("id")), "id", "left_anti")
    return classes, _similarities(_candidates(reps, threshold), threshold, _sets_of(df, key, sets))


def near_duplicate_pairs(df: DataFrame, text: Column | str, key: str, *, threshold: float = 0.8, k: int = 3, sets: Column | None = None) -> DataFrame:
    """Pairs between the first records of equal shingle sets: a, b, similarity. Membership: :func:`shingle_classes`.

    ``sets`` are shingles that take the place of the text's.
    """
    return similar_classes(df, key, prompt_shingles(text, k) if sets is None else sets, threshold)[1]


def near_duplicate_links(df: DataFrame, text: Column | str, key: str, *, threshold: float = 0.8, k: int = 3, sets: Column | None = None, every: bool = False) -> DataFrame:
    """One row per record with shingles: id, class_id (first record with the same set), n_links (similar records).

    ``sets`` are shingles that take the place of the text's. With ``every``, a record without shingles has a row too: it
    is a class of its own without links.
    """
    classes, pairs = similar_classes(df, key, prompt_shingles(text, k) if sets is None else sets, threshold)
    size = classes.groupBy("rep").agg(F.count("*").alias("n_copies"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other")))).alias("e")).select("e.*")
    linked = ends.join(size, ends["other"] == size["rep"]).groupBy("me").agg(F.sum("n_copies").alias("linked"))
    per = size.join(linked, size["rep"] == linked["me"], "left").select(F.col("rep").alias("class_id"), (F.col("n_copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    found = classes.select("id", F.col("rep").alias("class_id")).join(per, "class_id").select("id", "class_id", "n_links")
    if not every:
        return found
    return df.select(F.col(key).alias("id")).join(found, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def greedy_keep(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kept_by (null if the record is kept, else the first kept record near it).

    ``nodes``: id; ``edges``: a < b. The sequential rule in rounds: whoever has no undecided or kept record near and
    before itself is kept; whoever has a kept one is dropped.
    """
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    undecided = materialize(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "undecided")
    live, dropped = edges, None
    for _ in range(MAX_ROUNDS):
        waits = live.select(F.col("b").alias("id")).distinct()
        kept = materialize(undecided.join(waits, "id", "left_anti"), "kept")
        if kept.isEmpty():
            break
        gone = materialize(live.join(kept.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min("a").alias("kept_by")).select(F.col("b").alias("id"), "kept_by"), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        done = kept.select("id").unionByName(gone.select("id"))
        undecided = materialize(undecided.join(done, "id", "left_anti"), "undecided")
        live = live.join(done.select(F.col("id").alias("a")), "a", "left_anti").join(done.select(F.col("id").alias("b")), "b", "left_anti")
        live = materialize(live, "live")
    else:
        if not undecided.isEmpty():
            raise RuntimeError(f"records are still undecided after {MAX_ROUNDS} rounds")
    if dropped is None:
        return nodes.select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("kept_by"))
    # The rule names the first kept record near, which may have been kept in a later round than the one that dropped.
    kept_all = nodes.join(dropped.select("id"), "id", "left_anti").select(F.col("id").alias("a"))
    by = edges.join(kept_all, "a").groupBy("b").agg(F.min("a").alias("kept_by")).select(F.col("b").alias("id"), "kept_by")
    return nodes.select("id").join(by, "id", "left")


def near_duplicates_kept_first(df: DataFrame, text: Column | str, key: str, *, threshold: float = 0.8, k: int = 3) -> DataFrame:
    """Every record with ``kept_by``: null for kept ones, else the first kept record that it is near to.

    Records are taken by rising key and compared with kept ones only. Records without shingles are always kept.
    """
    classes, pairs = similar_classes(df, key, prompt_shingles(text, k), threshold)
    decided = greedy_keep(classes.where("id = rep").select("id"), pairs)
    by = classes.join(decided.withColumnRenamed("id", "r"), F.col("rep") == F.col("r")).select(
        F.col("id").alias("__id"), F.coalesce("kept_by", F.when(F.col("id") != F.col("rep"), F.col("rep"))).alias("kept_by")
    )
    return df.join(by, df[key] == F.col("__id"), "left").drop("__id")


def split_contamination(train: DataFrame, held: DataFrame, text: str, key: str, *, threshold: float = 0.75, k: int = 3) -> DataFrame:
    """Held-out records that a training record equals or nearly equals: key, train_id, kind, similarity.

    An exact match goes before a near one; of several the one with the least key is named. Texts without shingles match
    only exactly.
    """
    t = train.select(F.col(key).alias("train_id"), exact_hash(text).alias("h"), prompt_shingles(text, k).alias("s"))
    e = held.select(F.col(key), exact_hash(text).alias("h"), prompt_shingles(text, k).alias("s"))
    exact = e.join(t.groupBy("h").agg(F.min("train_id").alias("train_id")), "h").select(key, "train_id", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    rest = e.join(exact.select(key), key, "left_anti")
    tc, ec = shingle_classes(t, "train_id", F.col("s")), materialize(shingle_classes(rest, key, F.col("s")), "held")
    near = similar_sets(ec.where("id = rep"), threshold, tc.where("id = rep"))
    best = near.groupBy("a").agg(F.min_by(F.struct("b", "similarity"), "b").alias("m"))
    found = ec.join(best, F.col("rep") == F.col("a")).select(F.col("id").alias(key), F.col("m.b").alias("train_id"), F.lit("near").alias("kind"), F.col("m.similarity").alias("similarity"))
    return exact.unionByName(found)


def first_seen(df: DataFrame, by: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The first row in ``order`` of each value of ``by``; ``order`` tells rows apart, its nulls come first."""
    placed = df.withColumn("__order", F.struct(*order))
    return first_by(placed, by, "__order", "__first").where(F.col("__order") == F.col("__first")).select(*df.columns)
