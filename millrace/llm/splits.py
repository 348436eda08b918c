"""Train, validation and test splits that keep related records together (problem 3).

Sources and cases are vertices, records that bear both are edges. Components of the spanning forest are dealt to the
splits: the few that are large against the smallest split one by one to where most is missing, the others by size band,
each band in a shuffled order cut at the shares still missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import spanning_forest
from millrace.llm.words import name_key
from millrace.operators.prefix import bits_for, hash_bucket, hash_order, prefix
from millrace.session import materialize

#: A component with more than this part of the smallest split's records is dealt on its own; there are at most
#: 1 / (LARGE * smallest share) such components.
LARGE = 0.02


def source_key(col: Column) -> Column:
    """What names a source: null for null and blank values, else the letters and digits, which may be none."""
    return F.when(F.length(F.regexp_replace(col, r"[\s\p{Z}]", "")) > 0, F.coalesce(name_key(col), F.lit("")))


def case_key(col: Column) -> Column:
    """The case that a category names; null for topics, which tie nothing."""
    key = name_key(col)
    return F.when(key.rlike(r"^case.*\p{Nd}$"), key)


def ties(df: DataFrame, source: str, category: str) -> tuple[DataFrame, DataFrame]:
    """(vertex -> component, forest). Vertices are ``s:`` and a source key or ``c:`` and a case key."""
    s, c = F.concat(F.lit("s:"), source_key(F.col(source))), F.concat(F.lit("c:"), case_key(F.col(category)))
    return spanning_forest(df.select(s.alias("a"), c.alias("b")))


def _component(df: DataFrame, label: DataFrame, source: str, category: str) -> DataFrame:
    """``df`` with ``__vertex`` (a record's source, else its case) and ``__component``, null for untied records."""
    vertex = F.coalesce(F.concat(F.lit("s:"), source_key(F.col(source))), F.concat(F.lit("c:"), case_key(F.col(category))))
    rows = df.withColumn("__vertex", vertex)
    known = label.select(F.col("vertex").alias("__v"), F.col("component").alias("__c"))
    return rows.join(known, F.col("__vertex") == F.col("__v"), "left").withColumn("__component", F.coalesce("__c", "__vertex")).drop("__v", "__c")


def grouped_split(df: DataFrame, shares: Sequence[tuple[str, float]], *, key: str = "row_id", source: str = "source", category: str = "category", seed: int = 0) -> DataFrame:
    """One split per record: key, component, split_name.

    Records of one source (in any spelling) or one case never part, through chains of both; records with neither stand
    alone, with a null component. Shares are met as far as components allow: one that exceeds its split's share cannot
    be cut. Shares are scaled to a sum of 1; a split without a positive share gets nothing. No records give no rows.
    """
    shares = [(s, float(w)) for s, w in shares if w and w > 0]
    if not shares:
        raise ValueError("no split has a positive share")
    whole = sum(w for _, w in shares)
    label, _ = ties(df, source, category)
    rows = materialize(_component(df.select(key, source, category), label, source, category).select(key, "__component"), "components")
    groups = rows.where("__component is not null").groupBy(F.col("__component").alias("root")).agg(F.count("*").alias("size")).select("root", F.lit(None).cast("long").alias("alone"), "size")
    groups = groups.unionByName(rows.where("__component is null").select(F.lit(None).cast("string").alias("root"), F.xxhash64(F.lit(seed), key).alias("alone"), F.lit(1).cast("long").alias("size")))
    groups = materialize(groups.withColumn("band", F.floor(F.log2("size")).cast("int")), "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    missing = {s: total * w / whole for s, w in shares}
    limit = max(1.0, LARGE * min(missing.values()))
    dealt: dict[str, list[str]] = {s: [] for s, _ in shares}
    for root, size in groups.where((F.col("size") > limit) & F.col("root").isNotNull()).orderBy(F.desc("size"), "root").select("root", "size").collect():
        # Where the share still missing is largest against the split's whole share; whoever can hold it comes first.
        to = max(missing, key=lambda s: (missing[s] >= size, missing[s]))
        dealt[to].append(root)
        missing[to] -= size
    large = F.lit(None).cast("string")
    for s, roots in dealt.items():
        if roots:
            large = F.when(F.col("root").isin(roots), F.lit(s)).otherwise(large)
    small = groups.where((F.col("size") <= limit) | F.col("root").isNull())
    bands = {r[0]: r[1] for r in small.groupBy("band").agg(F.sum("size")).collect()}  # one row per power of two
    room = {s: max(0.0, m) for s, m in missing.items()}
    all_room = sum(room.values()) or 1.0
    h = hash_order("root", "alone", seed=seed)
    placed = prefix(small, ["band"], hash_bucket(h, bits_for(small.count())), [h, "root", "alone"], sums={"__before": F.col("size")})
    width = F.coalesce(*[F.when(F.col("band") == b, F.lit(float(n))) for b, n in bands.items()], F.lit(1.0))
    at = (F.col("__before") + F.col("size") / 2) / width
    name, upto = F.lit(shares[-1][0]), 1.0
    for s in reversed([s for s, _ in shares]):
        name = F.when(at < upto, F.lit(s)).otherwise(name) if room[s] > 0 else name
        upto -= room[s] / all_room
    placed = placed.select("root", "alone", name.alias("split_name"))
    if any(dealt.values()):
        placed = placed.unionByName(groups.where((F.col("size") > limit) & F.col("root").isNotNull()).select("root", "alone", large.alias("split_name")))
    placed = materialize(placed, "dealt")
    tied = rows.where("__component is not null").join(placed.where("root is not null").select("root", "split_name"), F.col("__component") == F.col("root"))
    alone = rows.where("__component is null").withColumn("alone", F.xxhash64(F.lit(seed), key)).join(placed.where("root is null").select("alone", "split_name").dropDuplicates(["alone"]), "alone")
    return tied.select(key, F.col("__component").alias("component"), "split_name").unionByName(alone.select(key, F.lit(None).cast("string").alias("component"), "split_name"))


def tied_values(df: DataFrame, *, source: str = "source", category: str = "category") -> DataFrame:
    """All pairs of different source values (exact strings) whose records must share a split: source_a < source_b."""
    label, _ = ties(df, source, category)
    values = df.select(F.col(source).alias("value")).where(source_key(F.col("value")).isNotNull()).distinct()
    members = materialize(_component(values.withColumn("__none", F.lit(None).cast("string")), label, "value", "__none").select("value", "__component"), "members")
    other = members.select(F.col("value").alias("source_b"), F.col("__component").alias("__other"))
    return members.join(other, (F.col("__component") == F.col("__other")) & (F.col("value") < F.col("source_b"))).select(F.col("value").alias("source_a"), "source_b")


def splits_by_tie(df: DataFrame, splits: DataFrame, *, key: str = "row_id", source: str = "source", category: str = "category") -> DataFrame:
    """By source and by case: kind, name (its letters and digits), n_records and n_splits, which is to be 1."""
    name = F.array(F.struct(F.lit("source").alias("kind"), source_key(F.col(source)).alias("name")), F.struct(F.lit("case").alias("kind"), case_key(F.col(category)).alias("name")))
    rows = df.select(key, F.explode(name).alias("t")).where("t.name is not null").join(splits.select(key, "split_name"), key)
    cells = rows.groupBy("t.kind", "t.name", "split_name").agg(F.count("*").alias("n"))
    return cells.groupBy("kind", "name").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_splits"))


def split_report(splits: DataFrame, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """By split: records, share reached and share asked for."""
    whole = sum(w for _, w in shares if w and w > 0)
    asked = splits.sparkSession.createDataFrame([(s, float(w) / whole) for s, w in shares if w and w > 0], "split_name string, target_share double")
    n = splits.groupBy("split_name").agg(F.count("*").alias("n_records"))
    n = asked.join(n, "split_name", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    total = n.agg(F.sum("n_records").alias("t"))
    return n.join(F.broadcast(total)).select("split_name", "n_records", "target_share", (F.col("n_records") / F.nullif("t", F.lit(0))).alias("actual_share"))


__all__ = ["grouped_split", "split_report", "splits_by_tie", "tied_values", "ties"]
