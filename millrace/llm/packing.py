"""Filling fixed-capacity containers with items of varying length (problem 2).

Variable-capacity best fit, planned on the histogram of lengths: lengths are whole numbers up to the largest capacity,
so the plan's input has at most that many rows however many items there are. Items are then ranked within their length
and look their container up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import with_tokens
from millrace.llm.words import contents
from millrace.operators.prefix import bits_for, hash_bucket, hash_order, prefix
from millrace.session import materialize

#: Largest permitted capacity, which bounds the histogram that the driver plans on; larger ones are refused.
MAX_CAPACITY = 1 << 20
#: Plan segments that are sent along with the tasks; a longer plan is joined instead.
MAX_SENT = 500_000
#: Capacities of which every subset is tried; of more, sets are improved by one capacity at a time.
MAX_JOINT = 8


class Plan:
    """Containers chosen for a histogram of lengths.

    ``segments``: (length, first rank, items, first bin, items per bin); ranks start at 0 within a length.
    ``ranges``: (first bin, bins, capacity after downsizing, content).
    """

    def __init__(self) -> None:
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.ranges: list[tuple[int, int, int, int]] = []
        self.bins = self.cost = 0


def best_fit(histogram: dict[int, int], opened: Sequence[int], permitted: Sequence[int]) -> Plan:
    """Best fit by falling length, whole runs of equal items at a time.

    An item goes to the fullest open bin that takes it. If none does, a bin of the capacity from ``opened`` is opened
    that wastes the least share of its space on items of this length (of equal ones the largest). In the end every bin
    shrinks to the least ``permitted`` capacity that holds its content.
    """
    plan = Plan()
    spaces: list[int] = []  # free spaces that open bins have, rising
    bins: dict[int, list[tuple[int, int, int]]] = {}  # free space -> (first bin, bins, capacity)

    def put(space: int, entry: tuple[int, int, int]) -> None:
        if space not in bins:
            bins[space] = []
            insort(spaces, space)
        bins[space].append(entry)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                size = min((c for c in opened if c >= length), key=lambda c: ((c % length) / c, -c), default=None) or min(c for c in permitted if c >= length)
                n = -(-left // (size // length))
                put(size, (plan.bins, n, size))
                plan.bins += n
                continue
            space = spaces[at]
            first, n, size = bins[space].pop()
            if not bins[space]:
                del bins[space], spaces[at]
            each = space // length
            full = min(n, left // each)
            if not full:
                each, full = left, 1
            if n > full:
                put(space, (first + full, n - full, size))
            plan.segments.append((length, rank, full * each, first, each))
            rank += full * each
            left -= full * each
            put(space - each * length, (first, full, size))
    for space, entries in bins.items():
        for first, n, size in entries:
            content = size - space
            fits = min(c for c in permitted if c >= content)
            plan.ranges.append((first, n, fits, content))
            plan.cost += n * fits
    plan.ranges.sort()
    return plan


def joint_plan(histogram: dict[int, int], capacities: Sequence[int], exhaustive: int = MAX_JOINT) -> Plan:
    """The cheapest plan (least total capacity, then fewest bins) over the sets of capacities that may be opened.

    Up to ``exhaustive`` capacities every set is tried. Of more there are too many sets: from each single capacity's plan
    that is cheapest, and from all capacities together, the one is added or taken out that lowers the cost most, until
    none does.
    """
    caps = sorted(set(capacities))
    plans: dict[frozenset, Plan] = {}

    def plan(chosen: frozenset) -> Plan:
        if chosen not in plans:
            plans[chosen] = best_fit(histogram, sorted(chosen), caps)
        return plans[chosen]

    def rank(chosen: frozenset) -> tuple:
        return plan(chosen).cost, plan(chosen).bins, sorted(chosen)

    if len(caps) <= exhaustive:
        return plan(min((frozenset(s) for k in range(1, len(caps) + 1) for s in combinations(caps, k)), key=rank))
    ends = []
    for at in (min((frozenset([c]) for c in caps), key=rank), frozenset(caps)):
        while True:
            best = min((x for x in (at ^ {c} for c in caps) if x), key=rank)
            if rank(best)[:2] >= rank(at)[:2]:
                break
            at = best
        ends.append(at)
    return plan(min(ends, key=rank))


def pack(items: DataFrame, capacities: Sequence[int], *, key: Sequence[str] = ("row_id",), length: str = "n_tokens") -> DataFrame:
    """Containers for ``items``: key, piece, n_pieces, piece_tokens, bin_id, capacity, bin_tokens.

    Only an item longer than the largest capacity is split: into full pieces and a rest, which is placed like an item.
    Items of length 0 or null need no space and have no container: one row with a null ``bin_id``. Equal keys are
    separate items. ``items`` is read several times: hand in a materialized table. No items give no rows. Capacities
    beyond MAX_CAPACITY are refused.
    """
    caps = sorted({int(c) for c in capacities if c})
    if not caps or caps[0] < 1 or caps[-1] > MAX_CAPACITY:
        raise ValueError(f"capacities must be from 1 to {MAX_CAPACITY}: {caps}")
    most = caps[-1]
    n = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    count = F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    pieces = items.select(*key, n.alias("__n"), count.alias("n_pieces")).select(*key, "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"), "__n")
    pieces = pieces.select(*key, "piece", "n_pieces", F.least(F.col("__n") - F.col("piece").cast("long") * most, F.lit(most).cast("long")).alias("piece_tokens"))
    histogram = {r[0]: r[1] for r in pieces.where("piece_tokens > 0").groupBy("piece_tokens").count().collect()}  # at most `most` rows
    plan = joint_plan(histogram, caps)
    h = hash_order(*key, "piece")
    ranked = prefix(pieces, ["piece_tokens"], hash_bucket(h, bits_for(sum(histogram.values()))), [h, *key, "piece"], rank="__rank")
    if len(plan.segments) + len(plan.ranges) <= MAX_SENT:
        return _look_up(ranked, plan, key)
    return _join(ranked, plan, key)


def _look_up(ranked: DataFrame, plan: Plan, key: Sequence[str]) -> DataFrame:
    segments = np.array(sorted(plan.segments) or [(1 << 22, 0, 0, 0, 1)], dtype=np.int64)
    ranges = np.array(plan.ranges or [(0, 0, 0, 0)], dtype=np.int64)
    starts = (segments[:, 0] << 41) + segments[:, 1]
    width = len(key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(width + 2).to_numpy()
            rank = batch.column(width + 3).to_numpy() - 1
            s = segments[np.maximum(np.searchsorted(starts, (n << 41) + rank, side="right") - 1, 0)]
            bin_id = s[:, 3] + (rank - s[:, 1]) // s[:, 4]
            r = ranges[np.maximum(np.searchsorted(ranges[:, 0], bin_id, side="right") - 1, 0)]
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(width + 3)), *(pa.array(x, pa.int64(), mask=none) for x in (bin_id, r[:, 2], r[:, 3]))],
                names=[*batch.schema.names[: width + 3], "bin_id", "capacity", "bin_tokens"],
            )

    schema = ranked.select(*key, "piece", "n_pieces", "piece_tokens").schema
    for c in ("bin_id", "capacity", "bin_tokens"):
        schema = schema.add(c, "long")
    return ranked.select(*key, "piece", "n_pieces", "piece_tokens", "__rank").mapInArrow(place, schema)


def _join(ranked: DataFrame, plan: Plan, key: Sequence[str]) -> DataFrame:
    """The way of a plan too long to be sent along."""
    spark = ranked.sparkSession
    segments = spark.createDataFrame(plan.segments, "s_len long, s_rank long, s_items long, s_bin long, s_each long")
    ranges = spark.createDataFrame(plan.ranges, "r_bin long, r_bins long, capacity long, bin_tokens long").withColumn("bin_id", F.explode(F.expr("sequence(r_bin, r_bin + r_bins - 1)")))
    inside = (F.col("piece_tokens") == F.col("s_len")) & (F.col("__rank") > F.col("s_rank")) & (F.col("__rank") <= F.col("s_rank") + F.col("s_items"))
    placed = ranked.join(segments, inside, "left").withColumn("bin_id", F.expr("s_bin + (__rank - 1 - s_rank) div s_each"))
    return placed.join(ranges.select("bin_id", "capacity", "bin_tokens"), "bin_id", "left").select(*key, "piece", "n_pieces", "piece_tokens", "bin_id", "capacity", "bin_tokens")


def pack_conversations(df: DataFrame, capacities: Sequence[int], *, messages: str = "messages", key: Sequence[str] = ("row_id",), text: Column | None = None, vocabulary: str | None = None) -> DataFrame:
    """Count the tokens of each conversation and pack conversations; see :func:`pack`."""
    counted = with_tokens(df, contents(F.col(messages), sep="\n") if text is None else text, keep=list(key), vocabulary=vocabulary)
    return pack(materialize(counted, "lengths"), capacities, key=key)


def packing_faults(packed: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per item: its pieces are numbered through and only an item beyond the largest capacity has several
    (``whole``), and no container of it holds more than its capacity or other than its stated content (``fits``)."""
    most = packed.agg(F.max("capacity").alias("__most"))  # one row
    bins = packed.where("bin_id is not null").groupBy("bin_id").agg(F.sum("piece_tokens").alias("__sum"))
    ok = (F.col("__sum") == F.col("bin_tokens")) & (F.col("bin_tokens") <= F.col("capacity"))
    rows = packed.join(bins, "bin_id", "left").withColumn("__ok", F.coalesce(ok, F.col("piece_tokens") == 0))
    each = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("piece").alias("d"), F.max("n_pieces").alias("m"), F.sum("piece_tokens").alias("t"), F.bool_and("__ok").alias("fits"))
    whole = (F.col("n") == F.col("m")) & (F.col("d") == F.col("n")) & ((F.col("m") == 1) | (F.col("t") > F.col("__most") * (F.col("m") - 1)))
    return each.join(F.broadcast(most)).select(key, whole.alias("whole"), "fits")


def fill_report(packed: DataFrame) -> DataFrame:
    """By capacity: bins, items, tokens, unused space and the share of space that is used."""
    bins = packed.where("bin_id is not null")
    return (
        bins.groupBy("capacity")
        .agg(F.countDistinct("bin_id").alias("n_bins"), F.count("*").alias("n_items"), F.sum("piece_tokens").alias("n_tokens"))
        .withColumn("unused", F.col("n_bins") * F.col("capacity") - F.col("n_tokens"))
        .withColumn("fill", F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")))
    )
