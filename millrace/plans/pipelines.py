"""Whole jobs: curation of records, intake of sources with quotas, finite evaluation sets, and dataset validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.quality import content_reason, issues, pair_reason, schema_reason
from millrace.functions.text import let, normalize_texts, strip, text_of
from millrace.operators.decontam import contamination
from millrace.operators.dedup import first_by, near_duplicates_kept_first, sent, split_contamination
from millrace.operators.normalize import user_prompt
from millrace.operators.splits import capped_per_source, exact_split, intake, partition_of
from millrace.session import materialize

SOURCE_ORDER = ("opencoder", "bigcode", "smoltalk", "cybersecurity")
# Shares of the sources.
SHARES = {"opencoder": 0.45, "bigcode": 0.25, "smoltalk": 0.20, "cybersecurity": 0.10}


def validated(records: DataFrame, key: str) -> DataFrame:
    """Every record with ``reason`` (null if it is valid) and, cleaned, its messages.

    Messages are normalized within their record, so nothing moves; they pass through Python for NFKC only where one
    holds characters beyond ASCII. ``key`` is carried along.
    """
    cols = {c: F.col(c) for c in ("id", "category", "difficulty", "source", "tags", "messages")}
    rows = records.withColumn("__schema", schema_reason(**cols))
    said = F.when(F.col("__schema").isNull(), F.transform("messages", lambda m: text_of(m["content"])))
    rows = rows.withColumn("__said", said).withColumn("__said", normalize_texts(F.col("__said")))
    clean = F.transform("messages", lambda m, i: let(F.get("__said", i), lambda t: F.struct(m["role"].alias("role"), t.alias("content"), issues(t).alias("found"))))
    rows = rows.withColumn("__clean", F.when(F.col("__said").isNotNull(), clean))
    rows = rows.withColumn("reason", F.coalesce("__schema", content_reason(F.col("__clean"))))
    return rows.withColumn("messages", F.when(F.col("reason").isNull(), F.transform("__clean", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).otherwise(F.col("messages"))).drop("__schema", "__said", "__clean")


def curate(records: DataFrame, key: str, *, threshold: float = 0.8) -> DataFrame:
    """Every record with ``outcome``: accepted, invalid, duplicate_id, exact_duplicate or near_duplicate, and ``reason``: a code, with the id or row that goes before.

    Records are taken by rising ``key``. Of records with one id the first valid one stays, then of those with one user
    prompt the first, then of near duplicates the first that is near to no kept one.
    """
    prompt = F.when(F.col("reason").isNull(), user_prompt(F.col("messages")))
    checked = materialize(validated(records, key).select(key, "id", "reason", prompt.alias("__prompt")), "checked")
    bad = checked.where("reason is not null").select(key, F.lit("invalid").alias("outcome"), "reason")
    form = F.trim(F.regexp_replace(F.lower("__prompt"), r"\s+", " "))
    good = checked.where("reason is null").select(key, "id", F.unhex(F.sha2(form, 256)).alias("__form"))
    by_id = materialize(first_by(good, ["id"], key, "__first"), "by_id")
    twice = by_id.where(F.col("__first") != F.col(key)).select(key, F.lit("duplicate_id").alias("outcome"), F.concat(F.lit("same_id="), "id").alias("reason"))
    same = materialize(first_by(by_id.where(F.col("__first") == F.col(key)).select(key, "__form"), ["__form"], key, "__first").select(key, "__first"), "same")
    exact = same.where(F.col("__first") != F.col(key)).select(key, F.lit("exact_duplicate").alias("outcome"), F.concat(F.lit("same_prompt="), F.col("__first").cast("string")).alias("reason"))
    # Prompts don't move: they are read again without the records that are out.
    out = bad.select(key).unionByName(twice.select(key)).unionByName(exact.select(key))
    left = materialize(checked.select(key, "__prompt").join(sent(out), key, "left_anti"), "left")
    near = near_duplicates_kept_first(left, "__prompt", key, threshold=threshold)
    last = near.select(key, F.when(F.col("kept_by").isNull(), "accepted").otherwise("near_duplicate").alias("outcome"), F.concat(F.lit("near="), F.col("kept_by").cast("string")).alias("reason"))
    return bad.unionByName(twice).unionByName(exact).unionByName(last)


def curate_and_split(records: DataFrame, key: str, *, seed: int = 42) -> DataFrame:
    """The accepted records with their split; an error if none is accepted."""
    outcome = materialize(curate(records, key), "outcome")
    kept = materialize(outcome.where("outcome = 'accepted'").select(key), "accepted")
    if kept.isEmpty():
        raise ValueError("no record was accepted")
    return exact_split(kept, key, seed=seed)


def pairs_of(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Normalized records as instruction and response."""
    return records.select(*keep, "id", F.col("messages")[1]["content"].alias("instruction"), F.col("messages")[2]["content"].alias("response"))


def intake_status(pairs: DataFrame, bench: DataFrame, *, source: str = "source", order: str = "seq", key: str = "row", wanted: str = "train", places: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """``pairs`` with ``status``: null if a row may be accepted, else quality, contamination, duplicate or partition.

    A pair is a duplicate if it equals one that passed before it, by source position and then by order. ``key`` is
    unique; ``bench`` is (item_id, text).
    """
    place = F.lit(len(places))
    for i, s in enumerate(places):
        place = F.when(F.col(source) == s, i).otherwise(place)
    rows = pairs.withColumn("__quality", pair_reason("instruction", "response")).withColumn("__at", F.struct(place.alias("p"), F.col(order).alias("o"), F.col(key).alias("k")))
    rows = materialize(rows, "rows")
    hit = contamination(rows.where("__quality is null"), bench, key=key, text="instruction").select(F.col(key).alias("__hit"))
    marked = materialize(rows.join(hit, F.col(key) == F.col("__hit"), "left"), "marked")
    passed = marked.where("__quality is null and __hit is null")
    content = F.sha2(F.concat_ws("::", strip("instruction"), strip("response")), 256)
    firsts = first_by(passed, [content], "__at", "__first").where(F.col("__at") != F.col("__first")).select(F.col(key).alias("__again"))
    out = marked.join(firsts, F.col(key) == F.col("__again"), "left")
    status = F.when(F.col("__quality").isNotNull(), "quality").when(F.col("__hit").isNotNull(), "contamination").when(F.col("__again").isNotNull(), "duplicate").when(partition_of("instruction", "response") != wanted, "partition")
    return out.withColumn("status", status).drop("__quality", "__at", "__hit", "__again")


def stream_mixture(pairs: DataFrame, bench: DataFrame, quotas: dict[str, int], *, source: str = "source", order: str = "seq", key: str = "row", wanted: str = "train") -> DataFrame:
    """What the round-robin intake with quotas does with each pair; see :func:`millrace.operators.splits.intake`."""
    status = materialize(intake_status(pairs, bench, source=source, order=order, key=key, wanted=wanted, places=list(quotas)), "status")
    return intake(status, quotas, source=source, order=order)


def finite_evaluation(pairs: DataFrame, bench: DataFrame, *, validation: int = 600, test: int = 400, source: str = "source", order: str = "seq", key: str = "row", shares: dict[str, float] = SHARES) -> DataFrame:
    """The first pairs of each source for validation and test, that pass the filter and match no benchmark; not deduplicated."""
    rows = materialize(pairs.where(pair_reason("instruction", "response").isNull()).withColumn("partition", partition_of("instruction", "response")), "pairs")
    hit = contamination(rows, bench, key=key, text="instruction").select(F.col(key).alias("__hit"))
    clean = materialize(rows.join(hit, F.col(key) == F.col("__hit"), "left_anti"), "clean")
    return capped_per_source(clean, source, "partition", order, {"validation": validation, "test": test}, shares)


def validate_splits(splits: DataFrame, split: str, text: str, key: str, *, threshold: float = 0.75) -> DataFrame:
    """Contamination of every other split by the training split: key, train_id, kind, similarity."""
    return split_contamination(splits.where(F.col(split) == "train"), splits.where(F.col(split) != "train"), text, key, threshold=threshold)
