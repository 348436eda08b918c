"""Ranks and running sums over groups of any size.

A window over a whole group puts that group into one task. Here each group is cut into ordered buckets: bucket totals
are pre-aggregated, their running sums give each bucket's offset, and only the rows of one bucket meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let

#: Rows that a bucket holds, about: as many as one task sorts with ease. There are 2^MIN_BITS buckets at the least and
#: 2^MAX_BITS at the most.
ROWS_A_BUCKET, MIN_BITS, MAX_BITS = 1 << 18, 6, 20
#: Cut points of a numeric order, at the most: the square of the number that a row is compared with.
SIDE = 512


def bits_for(rows: int) -> int:
    """Bits of a bucket number that leave about ROWS_A_BUCKET of so many rows to a bucket."""
    return min(MAX_BITS, max(MIN_BITS, (rows // ROWS_A_BUCKET).bit_length()))


def hash_order(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable shuffled order."""
    return F.xxhash64(F.lit(seed), *cols)


def hash_bucket(h: Column, bits: int = MIN_BITS) -> Column:
    """The top bits of a 64-bit hash, so that bucket order and hash order agree."""
    return F.shiftright(h, 64 - bits)


def value_bucket(df: DataFrame, col: str, rows_a_bucket: int = ROWS_A_BUCKET) -> Column:
    """A bucket number that rises with a numeric column; null comes first.

    Cut points are approximate quantiles of all rows, as many as the number of rows asks for. They are kept in two
    levels, so that a row is compared with few of them.
    """
    buckets = min(SIDE * SIDE, max(1 << MIN_BITS, df.count() // rows_a_bucket))
    points = sorted(set(df.approxQuantile(col, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    if not points:
        return F.coalesce(F.col(col).cast("int") * 0, F.lit(-1))
    side = int(len(points) ** 0.5) + 1
    rows = [points[i : i + side] for i in range(0, len(points), side)]
    x = F.col(col).cast("double")
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < x))
    upper = below(F.array(*[F.lit(float(r[-1])) for r in rows]))
    table = F.array(*[F.array(*[F.lit(float(p)) for p in r]) for r in rows])
    within = let(upper, lambda i: F.coalesce(below(F.get(table, i)), F.lit(0)) + i * side)
    return F.when(x.isNull(), F.lit(-1)).otherwise(within)


def prefix(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    sums: dict[str, Column] | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Add exclusive running sums (``sums``: new column -> summed expression) and a 1-based ``rank`` per group.

    ``bucket`` must not fall as ``order`` rises, and ``order`` must be total for a repeatable result. ``df`` is read
    twice: hand in a scan or a materialized table. Null group keys form one group. No rows give no rows.
    """
    values = {**(sums or {}), **({rank: F.lit(1)} if rank else {})}
    by = list(by)
    taken = set(df.columns) | set(values)
    b = next(x for x in (f"__bucket{i}" for i in range(99)) if x not in taken)
    tmp = {k: f"{b}_{i}" for i, k in enumerate(values)}
    rows = df.withColumn(b, bucket)
    totals = rows.groupBy(*by, b).agg(*[F.sum(v).alias(tmp[k]) for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"{b}_k{i}") for i, c in enumerate([*by, b])],
        *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"{t}_o") for t in tmp.values()],
    )
    on = [rows[c].eqNullSafe(offsets[f"{b}_k{i}"]) for i, c in enumerate([*by, b])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    inside = Window.partitionBy(*by, b).orderBy(*order)
    out = rows.join(offsets, cond, "left")
    for k, v in values.items():
        running = F.coalesce(F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(k, F.col(f"{tmp[k]}_o") + running + (1 if k == rank else 0))
    return out.select(*df.columns, *values)
