"""Tokens of documents and conversations: encoding, masking, padding, blocks and packing.

Tokens are arrays. The default tokenizer splits at white space and numbers words by hash, so that every result can be
checked in SQL; a vocabulary file of a public tokenizer takes its place in :func:`encode`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import words
from millrace.operators.prefix import prefix, value_bucket

IGNORE = -100
#: A tokenizer file; the path is a parameter of all that encodes.
PUBLIC = os.path.join(os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: The token that ends a document, and the one that fills up.
EOS, PAD = 3, 0


def word_ids(col: Column | str, vocabulary: int = 16_000) -> Column:
    """Numbers of the words, from 4 on; the first four are special tokens."""
    return F.transform(words(col), lambda w: (F.pmod(F.crc32(w.cast("binary")), F.lit(vocabulary - 4)) + 4).cast("int"))


def encode(df: DataFrame, text: str, path: str, *, out: str = "ids") -> DataFrame:
    """``df`` with token ids of a tokenizer file (JSON of the tokenizers library), in Arrow batches; null texts have none."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.encode_special_tokens = True
        for pdf in batches:
            done = tokenizer.encode_batch(pdf[text].fillna("").tolist(), add_special_tokens=False)
            yield pdf.assign(**{out: [e.ids for e in done]})

    return df.mapInPandas(run, _with(df, out))


def _with(df: DataFrame, out: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` array<int>"])


def turn_segments(messages: Column) -> Column:
    """The template's pieces: (tokens, whether the assistant says them). A turn's opening is never the assistant's."""
    pieces = F.transform(
        messages,
        lambda m: F.array(
            F.struct(F.array(F.concat(F.lit("<|im_start|>"), m["role"])).alias("tokens"), F.lit(False).alias("own")),
            F.struct(F.concat(words(m["content"]), F.array(F.lit("<|im_end|>"))).alias("tokens"), (m["role"] == "assistant").alias("own")),
        ),
    )
    return F.flatten(pieces)


def assistant_mask(df: DataFrame, messages: str = "messages", *, limit: int | None = None) -> DataFrame:
    """``tokens``, and ``labels``: the token where the assistant speaks, else null; both cut after ``limit`` tokens."""
    seg = turn_segments(F.col(messages))
    tokens = F.flatten(F.transform(seg, lambda s: s["tokens"]))
    labels = F.flatten(F.transform(seg, lambda s: F.transform(s["tokens"], lambda t: F.when(s["own"], t))))
    cut = (lambda c: F.slice(c, 1, limit)) if limit is not None else (lambda c: c)
    return df.withColumn("tokens", cut(tokens)).withColumn("labels", cut(labels))


def marker_mask(df: DataFrame, ids: str, marker: int, *, least: int = 3, most: int = 300, eos: int = EOS) -> DataFrame:
    """Inputs with an end token, and a loss mask that is 1 from the first ``marker`` on.

    Rows without the marker, or with fewer than ``least`` or more than ``most`` tokens, are left out.
    """
    full = F.concat(F.col(ids), F.array(F.lit(eos)))
    rows = df.withColumn("input_ids", full).withColumn("__at", F.array_position("input_ids", F.lit(marker)))
    rows = rows.where((F.col("__at") > 0) & (F.size("input_ids") >= least) & (F.size("input_ids") <= most))
    return rows.withColumn("loss_mask", F.transform("input_ids", lambda _, i: F.when(i + 1 >= F.col("__at"), 1).otherwise(0))).drop("__at")


def dynamic_pad(df: DataFrame, batch: str, ids: str = "input_ids", labels: str = "labels", *, multiple: int = 8, pad: int = PAD) -> DataFrame:
    """Rows padded to their batch's longest, rounded up to ``multiple``: input_ids, attention_mask, labels."""
    width = F.ceil(F.max(F.size(ids)).over(Window.partitionBy(batch)) / multiple) * multiple
    gap = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), (F.col("__width") - F.size(c)).cast("int")))
    rows = df.withColumn("__width", width)
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), (F.col("__width") - F.size(ids)).cast("int")))
    return rows.select(*[c for c in df.columns if c not in (ids, labels)], gap(ids, pad).alias("input_ids"), mask.alias("attention_mask"), gap(labels, IGNORE).alias("labels"))


def token_stream(df: DataFrame, ids: str, order: str, *, eos: int | None = EOS) -> DataFrame:
    """Documents with ``start``, the place of their first token in the stream of all, and an end token each.

    ``order`` is a number, unique by document. Null tokens are none. ``df`` is read several times.
    """
    own = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    rows = df.withColumn(ids, F.concat(own, F.array(F.lit(eos).cast("int"))) if eos is not None else own)
    return prefix(rows, [], value_bucket(df, order), [order], sums={"start": F.size(ids).cast("long")})


def _cut(stream: DataFrame, ids: str, stride: int, width: int) -> DataFrame:
    """block and tokens: the stream's tokens from every ``stride``-th place on, ``width`` of them; only full blocks.

    Documents are cut into the pieces that fall into blocks, so rows move by piece, not by token.
    """
    rows = stream.select("start", F.col(ids).alias("ids"), (F.col("start") + F.size(ids) - 1).alias("end")).where(F.size("ids") > 0)
    first = F.expr(f"greatest(0L, (start - {width - 1} + {stride - 1}) div {stride})")
    parts = rows.where(first <= F.expr(f"end div {stride}")).select("start", "end", "ids", F.explode(F.sequence(first, F.expr(f"end div {stride}"))).alias("block"))
    low, high = F.greatest("start", F.col("block") * stride), F.least(F.col("end"), F.col("block") * stride + width - 1)
    parts = parts.where(low <= high).select("block", low.alias("at"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low + 1).cast("int")).alias("piece"))
    made = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return made.select("block", F.flatten(F.transform("p", lambda x: x["piece"])).alias("tokens")).where(F.size("tokens") == width)


def blocks(stream: DataFrame, ids: str, length: int, *, overlap: bool = True) -> DataFrame:
    """The stream in blocks of ``length`` + 1 tokens: block, tokens.

    With ``overlap`` a block begins with the last token of the one before. An incomplete last block is left out.
    """
    return _cut(stream, ids, length if overlap else length + 1, length + 1)


def inputs_and_targets(made: DataFrame) -> DataFrame:
    """Blocks as inputs and, one token on, targets."""
    n = F.size("tokens")
    return made.select("block", F.slice("tokens", F.lit(1), n - 1).alias("x"), F.slice("tokens", F.lit(2), n - 1).alias("y"))


def manifest(stream: DataFrame, ids: str, *, source: str, vocabulary: int, eos: int = EOS) -> DataFrame:
    """One row on a packed stream: source, vocabulary, number type, end token, documents and tokens."""
    return stream.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(ids)), F.lit(0)).cast("long").alias("tokens")).select(
        F.lit(source).alias("source"), F.lit(vocabulary).alias("vocab_size"), F.lit("uint16" if vocabulary <= 65535 else "uint32").alias("dtype"), F.lit(eos).alias("eos_token_id"), "documents", "tokens"
    )


def greedy_windows(df: DataFrame, ids: str, order: Sequence[str], shard: str, length: int, *, pad: int = PAD, split: bool = False) -> DataFrame:
    """Examples packed in their order into windows: an example that no longer fits opens the next window.

    shard, window, tokens (padded to ``length``), n_examples. With ``split``, longer examples are packed in pieces of
    ``length``, each counted as an example, so that no token is lost; without it, all behind ``length`` is cut off. Empty
    examples are left out. Each shard is packed on its own, as one group in Python: choose shards of bounded size.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        held: list[int] = []
        n = 0
        for whole in pdf.sort_values(list(order))[ids]:
            for at in range(0, len(whole) if split else min(len(whole), 1), length):
                x = list(whole[at : at + length])
                if len(held) + len(x) > length:
                    out.append((held, n))
                    held, n = [], 0
                held = held + x
                n += 1
        if held:
            out.append((held, n))
        return pd.DataFrame({shard: [pdf[shard].iloc[0]] * len(out), "window": range(len(out)), "tokens": [h + [pad] * (length - len(h)) for h, _ in out], "n_examples": [k for _, k in out]})

    kind = df.schema[shard].dataType.simpleString()
    return df.select(shard, *dict.fromkeys([*order, ids])).groupBy(shard).applyInPandas(pack, f"{shard} {kind}, window long, tokens array<int>, n_examples long")


def repeat_and_crop(ids: Column, length: int, offset: Column) -> Column:
    """The tokens repeated until ``length`` of them follow ``offset`` (taken within the tokens), and cut there."""
    n = F.size(ids)
    at = F.pmod(offset.cast("int"), F.greatest(n, F.lit(1)))
    times = F.ceil((F.lit(length) + at) / F.greatest(n, F.lit(1))).cast("int")
    return F.when(n > 0, F.slice(F.flatten(F.array_repeat(ids, times)), at + 1, length))


def mixed_rows(a: DataFrame, b: DataFrame, ids: str, *, width: int, share: float) -> DataFrame:
    """Rows of ``width`` tokens: the first ``int(width * share)`` from stream ``a``, the rest from stream ``b``, in order.

    As many rows as both streams fill.
    """
    na = int(width * share)
    nb = width - na

    def pieces(stream: DataFrame, n: int, name: str) -> DataFrame:
        return _cut(stream, ids, n, n).toDF("row", name)

    return pieces(a, na, "x").join(pieces(b, nb, "y"), "row").select("row", F.concat("x", "y").alias("tokens"))


def drop_short(df: DataFrame, ids: str, least: int = 2) -> DataFrame:
    return df.where(F.size(ids) >= least)
