"""Reading and writing corpora: JSON lines, plain text, packed tokens, and reports."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip, word_count
from millrace.operators.splits import budget_prefix
from millrace.operators.tokens import EOS

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
#: The schema of chat records in JSON lines.
RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("difficulty", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("messages", MESSAGES),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str = RECORD) -> DataFrame:
    """JSON lines in parallel; blank lines are skipped, and a line that is no JSON fails the query and is quoted."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def check_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, line and text of the lines that are no JSON object or array.

    Files are read in pieces like any other: a line's number is its place within its piece and the lines of the pieces
    before, which are counted for it.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("i"))
    pieces = lines.groupBy("file", "start").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("file", "start", "first", before.alias("before"))
    bad = lines.where((strip("value") != "") & F.try_parse_json("value").isNull())
    return bad.join(pieces, ["file", "start"]).select("file", (F.col("before") + F.col("i") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def read_text_field(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """The non-blank strings of one top-level field of JSON lines; other values, and lines that are no JSON, are passed over."""
    value = F.try_variant_get(F.try_parse_json("value"), f"$.{field}", "variant")
    rows = spark.read.text(path).where(F.schema_of_variant(value) == "STRING")
    return rows.select(F.variant_get(value, "$", "string").alias(field)).where(strip(field) != "")


def write_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One object a line, in UTF-8, nulls written as such; ``mode`` append adds to what is there."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_log(records: DataFrame, log: str, summary_path: str, summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append ``records`` to a log of JSON lines and write the summary of all of it anew; the summary."""
    write_jsonl(records, log, mode="append")
    write_jsonl(summarize(read_jsonl(records.sparkSession, log, records.schema)), summary_path)
    return read_jsonl(records.sparkSession, summary_path, summarize(records).schema)


def write_text(df: DataFrame, text: str, order: str, budget: int, path: str) -> None:
    """Documents as paragraphs until the budget of UTF-8 bytes is reached; the document that reaches it is the last."""
    byte_budget(df, text, order, budget).select(F.concat(F.col(text), F.lit("\n"))).write.mode("overwrite").text(path)


def byte_budget(df: DataFrame, text: str, order: str, budget: int) -> DataFrame:
    """The first documents whose texts, each with an empty line behind it, make up ``budget`` bytes. Blank ones don't count."""
    return budget_prefix(df.where(strip(text) != ""), order, F.octet_length(text) + 2, budget)


def word_budget(df: DataFrame, text: str, order: str, budget: int) -> DataFrame:
    """The first documents that make up ``budget`` words."""
    return budget_prefix(df, order, word_count(text), budget)


def preview(df: DataFrame, text: str, order: str, *, rows: int = 5, chars: int = 1000) -> DataFrame:
    """The beginning of the first documents."""
    return df.orderBy(order).limit(rows).select(order, F.substring(text, 1, chars).alias("preview"))


def materialize_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written first if there is none that was finished."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_packed(stream: DataFrame, ids: str, path: str, *, vocabulary: int, least: int = 2, eos: int = EOS, tokenizer: str | None = None) -> DataFrame:
    """Write a token stream as binary numbers, a file per range of the stream, and return the files' manifest.

    ``stream`` has start and ids. file, first (place of its first token), tokens. Numbers are 16 bits wide if the
    vocabulary allows. A stream of fewer than ``least`` tokens is an error. ``path`` is a folder that all executors reach
    as files. The manifest names the end token, the documents and, of a ``tokenizer`` file, the SHA-256.
    """
    total, documents = stream.agg(F.coalesce(F.sum(F.size(ids)), F.lit(0)), F.count("*")).first()
    if total < least:
        raise ValueError(f"{total} tokens, {least} are needed")
    kind = "uint16" if vocabulary <= 65535 else "uint32"
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, n, file = None, 0, None
        for pdf in batches:
            for start, tokens in zip(pdf["start"], pdf[ids], strict=True):
                if first is None:
                    first = int(start)
                    file = os.path.join(path, f"tokens-{first:020d}.bin")
                    out = open(file + ".part", "wb")  # noqa: SIM115
                np.asarray(tokens, dtype=kind).tofile(out)
                n += len(tokens)
        if first is not None:
            out.close()
            os.replace(file + ".part", file)
            yield pd.DataFrame({"file": [file], "first": [first], "tokens": [n]})

    ordered = stream.where(F.size(ids) > 0).select("start", ids).repartitionByRange("start").sortWithinPartitions("start")
    files = ordered.mapInPandas(run, "file string, first long, tokens long").collect()  # one row per written file
    with open(os.path.join(path, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump({"dtype": kind, "vocab_size": vocabulary, "eos_token_id": eos, "documents": documents, "tokens": int(total), "tokenizer_sha256": tokenizer_digest(tokenizer) if tokenizer else None, "files": [[r["file"], r["first"], r["tokens"]] for r in sorted(files, key=lambda r: r["first"])]}, f, indent=2)
    return stream.sparkSession.createDataFrame(files, "file string, first long, tokens long")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_packed(path: str) -> np.ndarray:
    """The tokens of a packed stream in order, for a consumer on one machine."""
    with open(os.path.join(path, "manifest.json"), encoding="utf-8") as f:
        meta = json.load(f)
    return np.concatenate([np.fromfile(f, dtype=meta["dtype"]) for f, _, _ in meta["files"]])


def write_report(row: dict, markdown: str, folder: str) -> None:
    """A summary as stats.json and stats.md."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "stats.json"), "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, ensure_ascii=False, default=str)
    with open(os.path.join(folder, "stats.md"), "w", encoding="utf-8") as f:
        f.write(markdown)
