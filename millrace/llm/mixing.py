"""Mixing sources to target weights (problem 7).

The mixture is a schedule of slots of equal token counts. The slots' van der Corput points, mapped through the sources'
cumulated weights, spread every source evenly; the k-th slot of a source is filled with the k-th block of the source's
documents in shuffled order. Blocks are cut from the stream of the documents' tokens, so all of them are equal but a
source's last; a document that a block's end cuts goes on in the source's next slot. A source that runs out is shuffled
anew, as often as it may be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tokens import with_tokens
from millrace.llm.words import name_key
from millrace.operators.prefix import bits_for, hash_bucket, hash_order, prefix
from millrace.session import materialize

#: Tokens of a slot.
BLOCK = 512
#: Sources that a plan may have: the plan is sent along with the tasks; a longer one is refused.
MAX_SOURCES = 10_000
#: Bits of the schedule's points: slots from 2^40 on would repeat them.
POINT_BITS = 40


def van_der_corput(i: Column) -> Column:
    """The i-th point of the base-2 van der Corput sequence: the number's bits mirrored at the binary point."""
    return F.conv(F.reverse(F.lpad(F.bin(i), POINT_BITS, "0")), 2, 10).cast("double") / F.lit(float(1 << POINT_BITS))


def allot(supply: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Tokens to take of each source.

    By default as many as keep every share exact among the sources that have documents: until the first source is used
    up. With a larger ``total``, sources that are used up give all they may, and the others share the rest by weight.
    """
    live = {s: w for s, w in shares.items() if w > 0 and supply.get(s, 0) > 0}
    most = {s: supply[s] * repeats[s] for s in live}
    weight = sum(live.values())
    if not live:
        return {}
    exact = min(most[s] * weight / live[s] for s in live)
    if total is None or total <= exact:
        total = exact if total is None else total
        return {s: total * w / weight for s, w in live.items()}
    out: dict[str, float] = {}
    left = float(total)
    while live:
        weight = sum(live.values())
        full = [s for s in live if most[s] <= left * live[s] / weight]
        if not full:
            return {**out, **{s: left * w / weight for s, w in live.items()}}
        for s in full:
            out[s] = float(most[s])
            live.pop(s)
        left = max(0.0, float(total) - sum(out.values()))
    return out


class Mixture:
    """``rows``: slot, source, doc_id, repetition, first_token and end_token (of the document's tokens), n_tokens. ``plan``: (source name, key, share, repeats, supply, taken)."""

    def __init__(self, rows: DataFrame, plan: list[tuple[str, str, float, int, int, float]]) -> None:
        self.rows, self.plan = rows, plan

    def report(self) -> DataFrame:
        """By target source: target_share, actual_share of all tokens, n_tokens, n_docs (placements), most_uses, max_repeats,
        n_slots, and exact_share, which the target is among the sources that have documents."""
        spark = self.rows.sparkSession
        there = sum(p[2] for p in self.plan if p[4] > 0 and p[3] > 0) or 1.0
        asked = spark.createDataFrame([(p[0], p[2], p[3], p[2] / there if p[4] > 0 and p[3] > 0 else 0.0) for p in self.plan], "source string, target_share double, max_repeats int, exact_share double")
        got = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("first_token") == 0).alias("n_docs"), (F.max("repetition") + 1).alias("most_uses"), F.countDistinct("slot").alias("n_slots"))
        both = asked.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_tokens", "n_docs", "most_uses", "n_slots")})
        total = both.agg(F.sum("n_tokens").alias("__total"))  # one row
        return both.join(F.broadcast(total)).withColumn("actual_share", F.col("n_tokens") / F.nullif("__total", F.lit(0))).drop("__total")


    def kept(self, block: int = BLOCK) -> DataFrame:
        """By target source, what the mixture promises: its tokens are its exact share of all within a block
        (``share_met``), no document is used too often (``uses_met``), and all its slots but one hold a whole block at
        the least (``slots_full``)."""
        part = self.rows.groupBy("source", "slot").agg(F.sum("n_tokens").alias("n")).groupBy("source").agg(F.count_if(F.col("n") != block).alias("partial"))
        whole = self.report()
        total = whole.agg(F.sum("n_tokens").alias("__total"))  # one row
        met = F.abs(F.col("n_tokens") - F.col("exact_share") * F.col("__total")) <= block
        return whole.join(part, "source", "left").join(F.broadcast(total)).select("source", met.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("uses_met"), (F.coalesce("partial", F.lit(0)) <= 1).alias("slots_full"))


def mix(docs: DataFrame, targets: Sequence[tuple[str, float, int | None]], *, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, total: int | None = None, seed: int = 0, vocabulary: str | None = None) -> Mixture:
    """A mixture in which sources hold their target shares of all tokens as nearly as possible.

    ``targets``: (source, target share, most uses of one document). Spellings of one source are one source; rows for
    the same source add their shares. Null or negative shares count as 0, a null ``max_repeats`` as 1. Documents of
    other sources, and those without a token, are not used. A target without documents gets nothing and the others keep
    their proportions. Empty tables give an empty mixture. A source gets its share to the token, in slots of ``block``
    tokens of which only the last may hold less.
    """
    spark = docs.sparkSession
    keyed = docs.select(key, F.coalesce(name_key(F.col(source)), F.lit("")).alias("__source"), F.col(text).alias("__text"))
    named = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(targets)], "i int, s string").select("i", F.coalesce(name_key(F.col("s")), F.lit("")).alias("k")).collect()
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    keys = {r["i"]: r["k"] for r in named}
    shares: dict[str, float] = {}
    repeats: dict[str, int] = {}
    names: dict[str, str] = {}
    for i, (s, w, r) in enumerate(targets):
        k = keys[i]
        if k:
            shares[k] = shares.get(k, 0.0) + max(0.0, w or 0.0)
            repeats[k] = max(0, 1 if r is None else int(r))
            names.setdefault(k, s)
    wanted = keyed.where(F.col("__source").isin(*shares)) if shares else keyed.limit(0)
    sized = materialize(with_tokens(wanted, F.col("__text"), tokens="n_tokens", keep=[key, "__source"], vocabulary=vocabulary).where("n_tokens > 0"), "sized")
    supply = {r[0]: r[1] for r in sized.groupBy("__source").agg(F.sum("n_tokens")).collect()}  # one row per target
    taken = allot(supply, shares, repeats, total)
    tokens = {s: max(1, int(t)) for s, t in taken.items() if t > 0}
    slots = {s: -(-t // block) for s, t in tokens.items()}
    plan = [(names[k], k, shares[k], repeats[k], supply.get(k, 0), taken.get(k, 0.0)) for k in shares]
    schema = f"slot long, source string, {key} {docs.schema[key].dataType.simpleString()}, repetition int, first_token long, end_token long, n_tokens long"
    live = [k for k in shares if slots.get(k)]
    if not live:
        return Mixture(spark.createDataFrame([], schema), plan)

    # Documents in the order of use: every repetition is another shuffle.
    uses = {k: min(repeats[k], -(-tokens[k] // supply[k])) for k in live}
    by_key = lambda of, kind: F.create_map(*[x for k in live for x in (F.lit(k), F.lit(of[k]).cast(kind))])[F.col("__source")]
    copies = sized.where(F.col("__source").isin(*live)).withColumn("repetition", F.explode(F.sequence(F.lit(0), by_key(uses, "int") - 1)))
    h, bits = hash_order("repetition", key, seed=seed), bits_for(sized.count())
    placed = prefix(copies, ["__source"], F.col("repetition") * (2 << bits) + hash_bucket(h, bits), ["repetition", h, key], sums={"__offset": F.col("n_tokens")})
    end = F.least(F.col("__offset") + F.col("n_tokens"), by_key(tokens, "long"))
    placed = placed.withColumn("__end", end).where("__offset < __end").withColumn("__block", F.explode(F.expr(f"sequence(__offset div {block}, (__end - 1) div {block})")))
    first, last = F.greatest(F.col("__block") * block - F.col("__offset"), F.lit(0)), F.least((F.col("__block") + 1) * block, "__end") - F.col("__offset")
    pieces = placed.select("__source", key, "repetition", "__block", first.alias("first_token"), last.alias("end_token"))

    ranked = _schedule(spark, {k: slots[k] for k in live}).select(F.col("source").alias("__s"), "k", "slot")
    joined = pieces.join(ranked, (F.col("__source") == F.col("__s")) & (F.col("__block") == F.col("k")))
    title = F.create_map(*[x for k in live for x in (F.lit(k), F.lit(names[k]))])[F.col("__source")]
    rows = joined.select("slot", title.alias("source"), key, "repetition", "first_token", "end_token", (F.col("end_token") - F.col("first_token")).alias("n_tokens"))
    return Mixture(rows, plan)


def _schedule(spark: SparkSession, slots: dict[str, int]) -> DataFrame:
    """slot, source and k, the slot's number within its source from 0: as many slots of each source as ``slots`` says.

    The points of the sequence, mapped through the cumulated shares, deal a source a few slots more or less than it
    needs: at most about log2 of all slots. Sources that got too many give some up, evenly spread, and these go to the
    others in turn, so that all sources stay spread to the end.
    """
    n = sum(slots.values())
    point, upto, name = van_der_corput(F.col("id")), 1.0, F.lit(list(slots)[-1])
    for k in reversed(list(slots)):
        name = F.when(point < upto, F.lit(k)).otherwise(name)
        upto -= slots[k] / n
    dealt = spark.range(n).select(F.col("id").alias("slot"), name.alias("source"))
    got = {r[0]: r[1] for r in dealt.groupBy("source").count().collect()}  # one row per source
    bits = bits_for(n)
    bucket = F.expr(f"cast(slot * {1 << bits} div {n} as int)")
    ranked = prefix(dealt, ["source"], bucket, ["slot"], rank="k")
    surplus = {k: got[k] - slots[k] for k in slots if got.get(k, 0) > slots[k]}
    if not surplus:
        return ranked.withColumn("k", F.col("k") - 1)
    of = lambda d: F.coalesce(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[F.col("source")], F.lit(0))
    given = F.expr("k * __more div __all") > F.expr("(k - 1) * __more div __all")
    marked = ranked.withColumns({"__more": of(surplus).cast("long"), "__all": F.greatest(of({k: got[k] for k in surplus}), F.lit(1)).cast("long")}).withColumn("__given", given)
    free = [r[0] for r in marked.where("__given").orderBy("slot").select("slot").collect()]  # log2 of n for each source at the most, about
    wanting = sorted(((i + 0.5) / (slots[k] - got.get(k, 0)), k) for k in slots for i in range(max(0, slots[k] - got.get(k, 0))))
    moved = spark.createDataFrame([(s, k) for s, (_, k) in zip(free, wanting, strict=True)], "slot long, to string")
    settled = marked.select("slot", "source").join(moved, "slot", "left").select("slot", F.coalesce("to", "source").alias("source"))
    return prefix(materialize(settled, "schedule"), ["source"], bucket, ["slot"], rank="k").withColumn("k", F.col("k") - 1)
