"""Partitions, splits, quotas, budgets and interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import squeeze
from millrace.operators.prefix import bits_for, hash_bucket, hash_order, prefix, value_bucket

# Fixed value: salts the partition hash; changing it would move records between partitions.
PARTITION_SALT = "project_xyz_sft_seed_42"
# 0.90 and 0.9500000000000001 of 2^128 in hexadecimal, compared as text.
TRAIN_BELOW, VALIDATION_BELOW = "e6666666666668000000000000000000", "f3333333333338000000000000000000"


def partition_of(instruction: Column | str, response: Column | str, *, salt: str = PARTITION_SALT, train_below: str = TRAIN_BELOW, validation_below: str = VALIDATION_BELOW) -> Column:
    """train, validation or test by a salted content hash: the same for texts equal but for case and white space."""
    digest = F.md5(F.concat_ws("::", F.lit(salt), squeeze(instruction), squeeze(response)))
    return F.when(digest < train_below, "train").when(digest < validation_below, "validation").otherwise("test")


def split_sizes(n: int, validation: float = 0.05, test: float = 0.05, train: float = 0.90) -> tuple[int, int, int]:
    """Rows for train, validation and test; each gets one at least."""
    if not 0.99 <= train + validation + test <= 1.01:
        raise ValueError("ratios must sum to 1")
    if n < 3:
        raise ValueError(f"3 rows are needed, got {n}")
    v, t = max(1, round(n * validation)), max(1, round(n * test))
    if n - v - t < 1:
        v, t = (v - 1, t) if v > 1 else (v, t - 1)
    return n - v - t, v, t


def exact_split(df: DataFrame, key: str, *, train: float = 0.90, validation: float = 0.05, test: float = 0.05, seed: int = 42) -> DataFrame:
    """``split``: exact sizes in a repeatable shuffled order. ``key`` tells rows apart; ``df`` is read three times."""
    n = df.count()
    sizes = split_sizes(n, validation, test, train)
    h = hash_order(key, seed=seed)
    ranked = prefix(df, [], hash_bucket(h, bits_for(n)), [h, key], rank="__rank")
    part = F.when(F.col("__rank") <= sizes[0], "train").when(F.col("__rank") <= sizes[0] + sizes[1], "validation").otherwise("test")
    return ranked.withColumn("split", part).drop("__rank")


def quota_targets(total: int, shares: dict[str, float]) -> dict[str, int]:
    return {s: round(total * w) for s, w in shares.items()}


def rows_per_batch(batch: int, shares: dict[str, float], *, spare: str, filler: str, trim: Sequence[str]) -> dict[str, int]:
    """Rows of a batch by share: at least one each, scaled to the batch, trimmed in the order of ``trim``, filled up.

    ``spare`` may fall to none, ``filler`` gets what is left over.
    """
    rows = {s: max(1, round(batch * w)) for s, w in shares.items()}
    scale = batch / sum(rows.values())
    rows = {s: max(0 if s == spare else 1, round(n * scale)) for s, n in rows.items()}
    while sum(rows.values()) > batch:
        before = dict(rows)
        for s in trim:
            rows[s] = max(0 if s == spare else 1, rows[s] - 1)
        if rows == before:
            break
    rows[filler] += max(0, batch - sum(rows.values()))
    return rows


def budget_prefix(df: DataFrame, order: str, size: Column, budget: int) -> DataFrame:
    """The first rows by ``order`` until ``size`` adds up to ``budget``: the row that reaches it is the last.

    ``prior`` is the sum before each row. ``order`` is a number; rows with a null one come first.
    """
    sized = prefix(df, [], value_bucket(df, order), [order], sums={"prior": F.coalesce(size, F.lit(0)).cast("long")})
    return sized.where(F.col("prior") < budget)


def held_out_window(df: DataFrame, order: str, tokens: Column, *, least: int = 100, cap: int = 4000, budget: int = 40_000) -> DataFrame:
    """``held``: whether a document belongs to the first ones (of ``least`` tokens or more, ``cap`` counted of each) that
    make up ``budget`` tokens. Shorter documents are left out."""
    long_enough = df.withColumn("__n", tokens).where(F.col("__n") >= least)
    sized = prefix(long_enough, [], value_bucket(df, order), [order], sums={"prior": F.least("__n", F.lit(cap)).cast("long")})
    return sized.withColumn("held", F.col("prior") < budget).drop("__n", "prior")


def _quotas(quotas: dict[str, int], source: str) -> tuple[Column, Column]:
    """The quota and the position of a row's source; null for sources without a quota."""
    names = list(quotas)
    quota, place = F.lit(None).cast("long"), F.lit(None).cast("int")
    for i, s in enumerate(names):
        quota = F.when(F.col(source) == s, F.lit(quotas[s]).cast("long")).otherwise(quota)
        place = F.when(F.col(source) == s, F.lit(i)).otherwise(place)
    return quota, place


def intake(df: DataFrame, quotas: dict[str, int], *, source: str, order: str, status: str = "status") -> DataFrame:
    """What a round-robin reader with quotas does with each row: outcome and position.

    ``status`` is null for rows that may be accepted, else why not. Sources are read in ``order``, one accepted row
    each in turn, until their quota is full: ``outcome`` is ``accepted``, the status of a row read before that, or null
    for rows that are never read. ``position`` counts accepted rows in the order of output. Sources without a quota
    are not read. ``order`` is a number and unique within a source.
    """
    quota, place = _quotas(quotas, source)
    rows = df.where(quota.isNotNull())
    good = F.when(F.col(status).isNull(), 1).otherwise(0)
    seen = prefix(rows, [source], value_bucket(df, order), [order], sums={"__before": good})
    open_ = F.col("__before") < quota
    rows = seen.withColumn("outcome", F.when(open_, F.coalesce(F.col(status), F.lit("accepted"))))
    # The k-th accepted row of a source comes out in round k: behind all rows of earlier rounds, and those of its own
    # round from sources placed before it. How many those are follows from how many each source has in all.
    got = {r[0]: r[1] for r in rows.where("outcome = 'accepted'").groupBy(source).count().collect()}  # one row per quota
    earlier = F.lit(0).cast("long")
    for i, s in enumerate(quotas):
        n = F.lit(got.get(s, 0)).cast("long")
        earlier = earlier + F.least(n, F.col("__before") + F.when(place > i, 1).otherwise(0))
    return rows.withColumn("position", F.when(F.col("outcome") == "accepted", earlier + 1)).drop("__before")


def intake_summary(read: DataFrame, quotas: dict[str, int], *, source: str, reasons: Sequence[str] = ("quality", "contamination", "duplicate", "too_long")) -> DataFrame:
    """By source: target, accepted, rejected by reason, and the share of all accepted rows in per cent to two digits.

    Nothing is rejected for its length: long rows are cut where they are tokenized, so that count is 0.
    """
    spark = read.sparkSession
    asked = spark.createDataFrame(list(quotas.items()), f"{source} string, target long")
    n = read.groupBy(source).agg(F.count_if(F.col("outcome") == "accepted").alias("accepted"), *[F.count_if(F.col("outcome") == r).alias(f"rejected_{r}") for r in reasons])
    cols = ["accepted", *[f"rejected_{r}" for r in reasons]]
    both = asked.join(n, source, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in cols})
    total = both.agg(F.sum("accepted").alias("__total"))  # one row
    share = F.when(F.col("__total") > 0, F.bround(F.col("accepted") * 100.0 / F.col("__total"), 2)).otherwise(F.lit(0.0))
    return both.join(F.broadcast(total)).withColumn("actual_pct", share).drop("__total")


def capped_per_source(df: DataFrame, source: str, part: str, order: str, targets: dict[str, int], shares: dict[str, float], *, least: int = 5) -> DataFrame:
    """The first rows of each source in each part of ``targets``: ``max(least, int(target * share))`` of them."""
    limit = F.lit(None).cast("long")
    for p, total in targets.items():
        for s, w in shares.items():
            limit = F.when((F.col(part) == p) & (F.col(source) == s), F.lit(max(least, int(total * w))).cast("long")).otherwise(limit)
    ranked = prefix(df.where(limit.isNotNull()), [source, part], value_bucket(df, order), [order], rank="__rank")
    return ranked.where(F.col("__rank") <= limit).drop("__rank")


def weighted_choice(weights: Sequence[tuple[str, float]], u: Column) -> Column:
    """A name by a uniform number in [0, 1): each as often as its weight says."""
    total, upto, out = sum(w for _, w in weights), 0.0, F.lit(weights[-1][0])
    edges = []
    for s, w in weights:
        upto += w
        edges.append((s, upto / total))
    for s, e in reversed(edges[:-1]):
        out = F.when(u < e, F.lit(s)).otherwise(out)
    return out


def shuffled(df: DataFrame, *key: str, seed: int = 42) -> DataFrame:
    """A repeatable shuffled order, the same on any number of partitions."""
    return df.orderBy(hash_order(*key, seed=seed), *key)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows, twice as many at the most, chosen by a hash of the key; all rows if there are no more than ``n``.

    For fitting only. Rows are chosen where they are read, so nothing is sorted or moved for it.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 53)) < F.lit(int((1 << 53) * (n / total)))).limit(2 * n)
