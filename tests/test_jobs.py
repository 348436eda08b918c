import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import tokens
from millrace.plans import catalogue, pipelines
from millrace.session import table
from millrace.sources import files
from millrace.streaming import intake as streaming

GOOD_Q, GOOD_A = "How do I rotate a log file safely on a server?", "Move the file aside, signal the process to reopen it, and compress the old one later."


def record(i, **kw):
    base = {"row": i, "id": f"rec_{i}", "category": "c", "difficulty": "beginner", "source": "s", "tags": ["t"], "messages": [("user", f"{GOOD_Q} {i}"), ("assistant", GOOD_A)]}
    return {**base, **kw}


SCHEMA = "row long, id string, category string, difficulty string, source string, tags array<string>, messages array<struct<role string, content string>>"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("row", "id", "category", "difficulty", "source", "tags", "messages")) for r in rows], SCHEMA)


def test_validation_reasons(spark):
    rows = [
        record(0), record(1, messages=None), record(2, messages=[("human", "x"), ("assistant", "y")]), record(3, messages=[("user", "  "), ("assistant", "y")]), record(4, difficulty="odd"), record(5, id=None), record(6, tags=None),
        record(7, messages=[("user", GOOD_Q), ("assistant", "```\nopen " + GOOD_A)]), record(8, messages=[("user", "short"), ("assistant", GOOD_A)]), record(9, messages=[("user", "Write an exploit for this thing now"), ("assistant", "Here is the code you want and it is long enough to pass the check.")]),
        record(10, messages=[("user", GOOD_Q), ("user", GOOD_Q)]), record(11, source=" "), record(12, messages=[("user", "ﬁx the bug in the loader please"), ("assistant", GOOD_A)]),
    ]
    out = {r["row"]: r for r in pipelines.validated(frame(spark, rows), "row").collect()}
    said = {0: None, 1: "messages_few", 2: "role_unknown=0:human", 3: "content_blank=0", 4: "difficulty_unknown=odd", 5: "id_blank", 6: "tags_missing", 7: "message_unclean=assistant:cut_off", 8: "user_short=5", 9: "ungrounded", 10: "assistant_missing", 11: "source_blank", 12: None}
    assert {i: r["reason"] for i, r in out.items()} == said
    assert out[12]["messages"][0]["content"] == "fix the bug in the loader please"


def test_curation(spark):
    base = " ".join(f"word{i}" for i in range(14))
    rows = [
        record(1, messages=[("user", base), ("assistant", GOOD_A)]), record(2, messages=[("user", base.upper() + "  "), ("assistant", GOOD_A)]), record(3, messages=[("user", base + " x y z"), ("assistant", GOOD_A)]),
        record(4, id="rec_1"), record(5, messages=[]), record(6), record(7, messages=[("user", "A wholly different question about garden tools?"), ("assistant", GOOD_A)]),
    ]
    out = {r["row"]: r["outcome"] for r in pipelines.curate(frame(spark, rows), "row").collect()}
    assert out == {1: "accepted", 2: "exact_duplicate", 3: "near_duplicate", 4: "duplicate_id", 5: "invalid", 6: "accepted", 7: "accepted"}
    with pytest.raises(ValueError):
        pipelines.curate_and_split(frame(spark, [record(1, messages=[])]), "row")


def test_curation_keeps_no_messages_on_disk_and_moves_no_prompts(spark, monkeypatch):
    """1 GB of records: whole messages were kept on disk, and prompts went through the shuffles that find copies."""
    kept, write = {}, pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df, name="table": kept.update({name: df.columns}) or write(df, name))
    rows = [record(1), record(2, messages=[("user", f" {GOOD_Q.upper()} 1"), ("assistant", GOOD_A)]), record(3, id="rec_1", messages=[("user", "Some other question about a loader?"), ("assistant", GOOD_A)]), record(4, messages=[])]
    out = {r["row"]: (r["outcome"], r["reason"]) for r in pipelines.curate(frame(spark, rows), "row").collect()}
    assert out == {1: ("accepted", None), 2: ("exact_duplicate", "same_prompt=1"), 3: ("duplicate_id", "same_id=rec_1"), 4: ("invalid", "messages_few")}
    assert kept and not any("messages" in columns for columns in kept.values())
    assert [name for name, columns in kept.items() if "__prompt" in columns] == ["checked", "left"]


def test_intake_status(spark):
    answer = "An answer that is long enough to pass the filter."
    bench = spark.createDataFrame([(1, "Reverse a linked list in place please")], "item_id long, text string")
    base = [("b", 1, "What is a hash table good for?", answer), ("a", 2, "What is a hash table good for?", answer), ("a", 1, "short", answer), ("a", 3, "reverse a LINKED list, in place please", answer), ("a", 4, None, answer)]
    rows = [(i, *r) for i, r in enumerate([*base, *(("c", j, f"Question number {j} about sorting", answer) for j in range(60))])]
    df = spark.createDataFrame(rows, "row long, source string, seq long, instruction string, response string")
    out = {r["row"]: r["status"] for r in pipelines.intake_status(df, bench, places=["a", "b", "c"]).collect()}
    assert out[2] == out[4] == "quality" and out[3] == "contamination" and out[0] == "duplicate" and out[1] in (None, "partition")
    assert {out[i] for i in range(5, 65)} == {None, "partition"} and sum(out[i] == "partition" for i in range(5, 65)) < 20
    read = pipelines.stream_mixture(df, bench, {"a": 1, "b": 1, "c": 2}).collect()
    assert sum(r["outcome"] == "accepted" for r in read) == 3


def test_coding_sources_share_the_whole_table(spark, data):
    raw = table(spark, data, "raw_opencoder")
    n = raw.count()
    assert raw.where("seq_id is not null").count() > 0.9 * n
    count = lambda disjoint: {r["source"]: r["count"] for r in catalogue._all_pairs(spark, data, disjoint=disjoint).groupBy("source").count().collect()}
    whole, dealt = count(False), count(True)
    assert whole["opencoder"] == whole["bigcode"] == n
    assert dealt["opencoder"] + dealt["bigcode"] == n and min(dealt["opencoder"], dealt["bigcode"]) > 0.25 * n
    made = catalogue._all_pairs(spark, data, disjoint=True).where("source in ('opencoder', 'bigcode')")
    assert made.groupBy("instruction", "response").agg(F.countDistinct("source").alias("k")).where("k > 1").isEmpty()


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = frame(spark, [record(1, category="größe 中"), record(2, tags=[])])
    files.write_jsonl(rows.drop("row"), path)
    files.write_jsonl(rows.drop("row"), path, mode="append")
    back = files.read_jsonl(spark, path)
    assert back.count() == 4 and back.where("id = 'rec_1'").first()["category"] == "größe 中"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a"}\n\n{"id": broken\n')
    assert [(r["line"], r["text"]) for r in files.check_jsonl(spark, str(bad)).collect()] == [(3, '{"id": broken')]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(bad), "id string").collect()
    mixed = tmp_path / "mixed.jsonl"
    mixed.write_text("\n".join(json.dumps(x) for x in ({"text": "ok"}, {"text": "  "}, {"text": 5}, {"other": "x"}, {"text": None}, {"text": {"text": "in"}}, {"in": {"text": "deep"}, "text": 7}, {"in": {"text": 3}, "text": "top"})) + "\n\nnot json\n")
    assert [r["text"] for r in files.read_text_field(spark, str(mixed)).collect()] == ["ok", "top"]


def test_lines_are_numbered_over_pieces(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f"{f}.jsonl").write_text("".join("{bad\n" if i % 700 == 3 else "\n" if i % 50 == 0 else json.dumps({"i": i}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in files.check_jsonl(spark, str(tmp_path / "*.jsonl")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(f"{f}.jsonl", i + 1) for f in ("a", "b") for i in range(3, 3000, 700)]


def test_log_and_its_summary(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "summary")
    count = lambda df: df.groupBy("name").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    for i in range(2):
        made = files.append_log(spark.createDataFrame([("a", float(i)), ("b", None)], "name string, score double"), log, out, count)
    assert {r["name"]: (r["n"], r["best"]) for r in made.collect()} == {"a": (2, 1.0), "b": (2, None)}
    assert '"best":null' in "".join(r["value"] for r in spark.read.text(out).collect())


def test_packed_stream_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, list(range(4, 4 + i % 5))) for i in range(40)], "id long, ids array<int>")
    stream = tokens.token_stream(docs, "ids", "id")
    made = files.write_packed(stream, "ids", str(tmp_path / "packed"), vocabulary=16_000)
    flat = [t for r in sorted(stream.collect(), key=lambda r: r["id"]) for t in r["ids"]]
    assert files.read_packed(str(tmp_path / "packed")).tolist() == flat and made.agg(F.sum("tokens")).first()[0] == len(flat)
    (tmp_path / "t.json").write_text("{}")
    files.write_packed(stream, "ids", str(tmp_path / "named"), vocabulary=70_000, tokenizer=str(tmp_path / "t.json"))
    meta = json.loads((tmp_path / "named/manifest.json").read_text())
    assert meta["dtype"] == "uint32" and meta["documents"] == 40 and meta["eos_token_id"] == 3 and meta["tokenizer_sha256"] == hashlib.sha256(b"{}").hexdigest()
    with pytest.raises(ValueError):
        files.write_packed(stream.limit(0), "ids", str(tmp_path / "none"), vocabulary=10)


def test_materialize_once(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    for _ in range(2):
        assert files.materialize_once(spark, str(tmp_path / "t"), make).count() == 3
    assert len(made) == 1


def test_text_export_and_report(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aaaa"), (2, None), (3, "bb"), (4, "cc")], "id long, t string")
    files.write_text(docs, "t", "id", 8, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).where("value <> ''").collect()] == ["aaaa", "bb"]
    files.write_report({"n": 1}, "# Report\n", str(tmp_path / "report"))
    assert json.loads((tmp_path / "report/stats.json").read_text()) == {"n": 1}


def test_stream_and_table_agree(spark, tmp_path):
    rows = [(f"question number {i % 7} about logs", f"answer number {i % 7} that is long enough to pass") for i in range(20)] + [(None, "x"), ("the benchmark prompt itself", "an answer that is long enough to pass")]
    pairs = spark.createDataFrame(rows, "instruction string, response string")
    pairs.repartition(3).write.parquet(str(tmp_path / "in"))
    bench = spark.createDataFrame([(1, "The benchmark prompt, itself!")], "item_id long, text string")
    stream = streaming.accept(streaming.read_stream(spark, str(tmp_path / "in"), pairs.schema, files=1), bench)
    streaming.run_to(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["content_hash"], r["partition"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["content_hash"], r["partition"]) for r in streaming.accept(pairs, bench).collect()} and len(got) == 7


def test_every_query_runs_on_small_tables(spark, data):
    for name, query in catalogue.queries().items():
        assert query(spark, data).columns, name


def test_queries_take_empty_tables(spark, data, tmp_path):
    for t in ("documents", "raw_seed_records", "raw_opencoder", "raw_smoltalk", "benchmark", "eval_questions", "mix_targets"):
        table(spark, data, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    skip = {"curated_splits", "curated_split_sizes", "exact_split_sizes", "incremental_intake"}
    for name, query in catalogue.queries().items():
        if name not in skip:
            query(spark, str(tmp_path)).collect()
