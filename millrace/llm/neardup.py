"""Near-duplicate records with small edits (problem 4).

Each record's set of word sequences is sketched by minwise hashing into a signature of SYMBOLS symbols. Two signatures'
distance is the number of symbols that differ. A multi-index Hamming join finds close signatures: the signature is cut
into chunks, and by the pigeonhole principle two signatures with at most 2 * chunks - 1 differing symbols agree in some
chunk up to one symbol; so each chunk is indexed once for every symbol that may be left out, and pairs that meet under a
key are compared on a b-bit form of the whole signature. The number of chunks follows from the distance that the
similarity asks for, so that every pair within it meets. What remains is verified on the exact sets.

Texts with the same words in the same order are one class from the start: only one representative of each is indexed.
Keys are counted before rows move: rows of keys that very many representatives share are dealt to blocks, which are
paired each against each, spread over tasks; no task ever holds a whole such group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import spanning_forest
from millrace.llm.words import WORD, contents
from millrace.session import materialize

SYMBOLS = 36
#: Numbers of chunks that a signature may be cut into. With one symbol left out of each, c chunks have SYMBOLS keys of
#: SYMBOLS / c - 1 symbols, and signatures that differ in up to 2 c - 1 symbols are certain to meet.
CHUNKS = (4, 6, 9, 12, 18)
#: Bits of a symbol in the compared form, and how many words of 64 bits hold it.
BITS, PACKED = 5, 3
#: Ids up to this number are sent to all tasks when texts are read again; more are joined.
MAX_SENT = 1_000_000
#: Representatives under one key from which on its rows are dealt to blocks, and how many a block holds, about.
HOT = BLOCK = 1024
#: Parts of a hot key's rows if hot keys are joined.
SALTS = 64
#: Comparisons that are held in memory at once.
AT_ONCE = 1 << 20
FORM = [f"s{i}" for i in range(PACKED)]
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(20240607).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * _U(2) + _U(1)
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _A
    return h ^ (h >> _U(29))


def sequences(texts: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of ``width`` words of each text, and how many each text has."""
    look = _HASHES.__getitem__
    flat = np.fromiter((look(w) for ws in texts for w in ws), dtype=np.uint64)
    n = np.array([len(ws) for ws in texts], dtype=np.int64)
    if len(flat) < width:
        return flat[:0], np.zeros(len(n), np.int64)
    h = flat[: len(flat) - width + 1].copy()
    for i in range(1, width):
        h = _mix(h) + flat[i : len(flat) - width + 1 + i]
    h = _mix(h)
    own = np.maximum(n - width + 1, 0)
    starts = np.cumsum(n) - n
    keep = np.repeat(starts, own) + (np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own))
    return h[keep], own


def signatures(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minwise signatures, a row for each text with n > 0."""
    starts = (np.cumsum(n) - n)[n > 0]
    out = np.empty((len(starts), SYMBOLS), dtype=np.uint64)
    for k in range(SYMBOLS if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(hashes * _MULTIPLIERS[k], starts)
    return _mix(out)


def compared_form(symbols: np.ndarray) -> np.ndarray:
    """BITS bits of each symbol, packed into PACKED words a row."""
    low = (symbols & _U((1 << BITS) - 1)).reshape(len(symbols), PACKED, SYMBOLS // PACKED)
    return (low << (np.arange(SYMBOLS // PACKED, dtype=np.uint64) * _U(BITS))).sum(axis=2, dtype=np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many symbols compared forms differ; words lie along the last axis."""
    x = a ^ b
    any_bit = x
    for i in range(1, BITS):
        any_bit = any_bit | (x >> _U(i))
    return np.bitwise_count(any_bit & _U(sum(1 << (BITS * i) for i in range(SYMBOLS // PACKED)))).sum(axis=-1, dtype=np.int64)


def allowed_distance(similarity: float) -> int:
    """The most symbols in which compared forms of a pair at ``similarity`` may differ: the mean and 3.2 deviations."""
    p = (1 - similarity) * (1 - 2.0**-BITS)
    return int(SYMBOLS * p + 3.2 * (SYMBOLS * p * (1 - p)) ** 0.5 + 0.5)


def chunks_for(distance: int) -> int:
    """The fewest chunks that make all signatures within ``distance`` meet: the fewer, the longer are the keys."""
    for c in CHUNKS:
        if 2 * c - 1 >= distance:
            return c
    raise ValueError(f"signatures that differ in {distance} of {SYMBOLS} symbols cannot be found for certain")


def _batches(batch: pa.RecordBatch, step: int = 2_000_000) -> Iterator[tuple[int, list[list[str]]]]:
    """Runs of rows with about ``step`` characters, so that arrays stay small whatever a batch holds."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
        texts.append(WORD.findall(t.lower()) if t else [])
        size += len(t or "")
        if size > step:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def sign(df: DataFrame, key: str, text: Column, *, width: int) -> DataFrame:
    """id, copy_a and copy_b (128 bits that name the text's words), sig, form; sig is null below ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _batches(batch):
                hashes, n = sequences(texts, width)
                symbols = signatures(hashes, n)
                form = compared_form(symbols)
                has = n > 0
                at = np.cumsum(has) - 1
                at[~has] = 0
                if not len(symbols):
                    symbols, form = np.zeros((1, SYMBOLS), np.uint64), np.zeros((1, PACKED), np.uint64)
                copies = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(ws)) for ws in texts), dtype=np.int64).reshape(-1, 2)
                flat = (symbols[at] >> _U(32)).astype(np.uint32).view(np.int32)
                offsets = np.arange(len(texts) + 1, dtype=np.int32) * SYMBOLS
                sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel(), pa.int32()), mask=pa.array(~has))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(copies[:, 0]), pa.array(copies[:, 1]), sig, *(pa.array(form[at, i].view(np.int64), mask=~has) for i in range(PACKED))],
                    names=["id", "copy_a", "copy_b", "sig", *FORM],
                )

    return df.select(F.col(key).cast("long").alias("id"), text.alias("text")).mapInArrow(run, "id long, copy_a long, copy_b long, sig array<int>, " + ", ".join(f"{c} long" for c in FORM))


def _keys(chunks: int) -> list[Column]:
    """Keys of all chunks, one for each symbol that is left out of its chunk."""
    width = SYMBOLS // chunks
    sig = [F.col("sig")[i] for i in range(SYMBOLS)]
    return [F.xxhash64(F.lit(out), *[sig[i] for i in range(out // width * width, out // width * width + width) if i != out]) for out in range(SYMBOLS)]


def _close(ids: np.ndarray, form: np.ndarray, others: np.ndarray, other_form: np.ndarray, distance: int, *, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one side's ids with the other's, within ``distance``; ``within`` one side, each pair once."""
    step = max(1, AT_ONCE // max(1, len(others)))
    for i in range(0, len(ids), step):
        near = differing(form[i : i + step, None], other_form[None]) <= distance
        x, y = np.nonzero(np.triu(near, i + 1) if within else near)
        a, b = ids[i : i + step][x], others[y]
        if len(a):
            yield a[a != b], b[a != b]


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that are sorted by their first column, some whole groups at a time, and where the groups begin and end."""
    held: list[np.ndarray] = []

    def whole(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows, np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0], True])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0], side="left"))
        if last == 0 and held and held[0][-1, 0] == rows[0, 0]:
            held.append(rows)
            continue
        if held or last:
            yield whole(np.concatenate([*held, rows[:last]]))
        held = [rows[last:]]
    if held:
        yield whole(np.concatenate(held))


def _meet(keyed: DataFrame, distance: int) -> DataFrame:
    """Pairs of ids under one key within ``distance``; ``keyed`` is key, id and FORM, with HOT ids a key at the most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _grouped(batches):
            sizes = np.diff(edge)
            form = np.ascontiguousarray(rows[:, 2:]).view(_U)
            for k in np.flatnonzero(sizes > 24):
                g = slice(edge[k], edge[k + 1])
                for a, b in _close(rows[g, 1], form[g], rows[g, 1], form[g], distance, within=True):
                    yield _pair_batch(a, b)
            # Of small groups the rows that lie d apart are compared, all groups at once.
            small = np.repeat((sizes > 1) & (sizes <= 24), sizes)
            key, ids, form = rows[small, 0], rows[small, 1], form[small]
            left = np.arange(len(ids))
            for d in range(1, 24):
                left = left[left + d < len(ids)]
                left = left[key[left] == key[left + d]]
                if not len(left):
                    break
                near = left[(differing(form[left], form[left + d]) <= distance) & (ids[left] != ids[left + d])]
                if len(near):
                    yield _pair_batch(ids[near], ids[near + d])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _meet_in_blocks(hot: DataFrame, distance: int, block: int) -> DataFrame:
    """All pairs of ids under one key within ``distance``; ``hot`` is key, n (ids of the key), id and FORM.

    A key's ids are dealt to blocks of about ``block`` ids. A cell is two blocks, or one with itself: it is one task's
    work at the most, and each pair of ids lies in one cell of its key.
    """
    own = hot.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edge in _grouped(batches):
            form = np.ascontiguousarray(rows[:, 3:]).view(_U)
            for start, end in zip(edge[:-1], edge[1:], strict=True):
                x, y = (start + np.flatnonzero(rows[start:end, 1] == k) for k in (0, 1))
                z = start + np.flatnonzero(rows[start:end, 1] == 2)
                for left, right, within in ((x, y, False), (z, z, True)):
                    for a, b in _close(rows[left, 2], form[left], rows[right, 2], form[right], distance, within=within):
                        yield _pair_batch(a, b)

    return dealt.select(cell.alias("cell"), side.alias("side"), "id", *FORM).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def candidates(signed: DataFrame, distance: int, *, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """All pairs of representatives within ``distance``; ``signed`` is a table of id, sig and FORM."""
    keys = _keys(chunks_for(distance))
    keyed = signed.where("sig is not null").select(F.explode(F.array(*keys)).alias("key"), "id", *FORM)
    burning = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot")
    n = burning.count()
    if not n:
        return _meet(keyed, distance).distinct()
    if n <= MAX_SENT:
        cold, many = keyed.join(F.broadcast(burning), "key", "left_anti"), keyed.join(F.broadcast(burning), "key")
    else:  # too many to be sent along: joined, each under several numbers, so that no task gets all rows of a key
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        each = burning.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        cold, many = salted.join(each, ["key", "salt"], "left_anti").drop("salt"), salted.join(each, ["key", "salt"]).drop("salt")
    return _meet(cold, distance).unionByName(_meet_in_blocks(many.select("key", "n", "id", *FORM), distance, block)).distinct()


def _sets(df: DataFrame, key: str, text: Column, ids: DataFrame, width: int) -> DataFrame:
    """id and its distinct sequences as sorted 48-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _batches(batch):
                hashes, n = sequences(texts, width)
                ends = np.cumsum(n)
                blobs = [np.unique(hashes[e - k : e] >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(blobs, pa.binary())], names=["id", "set"])

    few = ids.limit(MAX_SENT + 1).count() <= MAX_SENT
    rows = df.select(F.col(key).cast("long").alias("id"), text.alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return rows.select("id", "text").mapInArrow(run, "id long, set binary")


def _numbered(sets: pa.Array, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The 48-bit hashes of some rows' sets, each with its row's number in the upper bits, and the sets' sizes."""
    parts = [np.frombuffer(s.as_buffer(), dtype=np.uint8).reshape(-1, 6) for s in sets.slice(first, end - first)]
    n = np.array([len(p) for p in parts])
    flat = np.zeros((n.sum(), 8), np.uint8)
    flat[:, :6] = np.concatenate(parts)
    return flat.view(_U).ravel() | np.repeat(np.arange(end - first, dtype=_U) << _U(48), n), n


def _verify(pairs: DataFrame, similarity: float) -> DataFrame:
    """a, b, similarity of the pairs whose sets are similar enough; all sets of a run of rows are intersected at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                (x, n), (y, m) = (_numbered(part.column(c), 0, part.num_rows) for c in (2, 3))
                both = np.bincount((np.intersect1d(x, y, assume_unique=True) >> _U(48)).astype(np.int64), minlength=part.num_rows)
                sims = both / np.maximum(1, n + m - both)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sims)], names=["a", "b", "similarity"]).filter(pa.array(sims >= similarity))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, similarity double")


class NearDuplicates:
    """The tables of one search: ``members`` (id, rep) of every record, ``links`` (a, b, similarity) between reps."""

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links

    def groups(self) -> DataFrame:
        """One row per record: id, group_id (the least id of its group), n_links: similar records of other texts or copies."""
        label, _ = spanning_forest(self.links)
        least = label.groupBy("component").agg(F.min("vertex").alias("least"))
        label = label.join(least, "component").select("vertex", F.col("least").alias("component"))
        size = self.members.groupBy("rep").agg(F.count("*").alias("n"))
        ends = self.links.select(F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("other")), F.struct(F.col("b").alias("me"), F.col("a").alias("other")))).alias("e")).select("e.me", "e.other")
        linked = ends.join(size, ends.other == size.rep).groupBy("me").agg(F.sum("n").alias("linked"))
        per = size.join(linked, size.rep == linked.me, "left").join(label, size.rep == label.vertex, "left")
        per = per.select(F.col("rep").alias("r"), F.coalesce("component", "rep").alias("group_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        return self.members.join(per, F.col("rep") == F.col("r")).select("id", "group_id", "n_links")

    def pairs(self) -> DataFrame:
        """All pairs of similar records, a < b: links between classes spread over their members, and copies."""
        left, right = self.members.select(F.col("rep").alias("ra"), F.col("id").alias("x")), self.members.select(F.col("rep").alias("rb"), F.col("id").alias("y"))
        across = self.links.join(left, F.col("a") == F.col("ra")).join(right, F.col("b") == F.col("rb")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        alike = self.members.where("has_words")
        copies = alike.select(F.col("rep").alias("ra"), F.col("id").alias("a")).join(alike.select(F.col("rep").alias("rb"), F.col("id").alias("b")), (F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b"))).select("a", "b")
        return across.unionByName(copies)


def near_duplicates(df: DataFrame, text: Column, *, key: str = "row_id", width: int = 5, similarity: float = 0.8, hot: int = HOT, block: int = BLOCK) -> NearDuplicates:
    """Find records whose sets of ``width``-word sequences have a Jaccard similarity of at least ``similarity``.

    ``key`` is a unique integer. A null or blank text, or one with fewer than ``width`` words, has no sequences and is
    like no other; it forms a class with rows of the same words, but no pairs. Repeated rows under other keys are
    copies. Rows with a null key are left out. All pairs within :func:`allowed_distance` are found for certain, and a
    similarity that no layout can guarantee is refused; pairs are exact, as sets are compared. An empty table gives
    empty tables.
    """
    rows = df.where(F.col(key).isNotNull())
    signed = materialize(sign(rows, key, text, width=width), "signed")
    reps = signed.groupBy("copy_a", "copy_b").agg(F.min("id").alias("rep"))
    members = signed.select("id", "copy_a", "copy_b", F.col("sig").isNotNull().alias("has_words")).join(reps, ["copy_a", "copy_b"]).select("id", "rep", "has_words")
    members = materialize(members, "members")
    firsts = members.where("id = rep and has_words").select("id")
    alone = signed.join(firsts, "id", "left_semi")
    pairs = materialize(candidates(alone, allowed_distance(similarity), hot=hot, block=block), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(_sets(rows, key, text, ids, width), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return NearDuplicates(members, materialize(_verify(both, similarity), "links"))


def similar_conversations(df: DataFrame, *, messages: str = "messages", key: str = "row_id", width: int = 3, similarity: float = 0.6) -> NearDuplicates:
    """Near-duplicates by the words of all contents but the system's; null messages and contents are empty."""
    return near_duplicates(df, contents(F.col(messages), without=("system",)), key=key, width=width, similarity=similarity)
