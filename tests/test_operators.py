import os
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import prompt_shingles
from millrace.operators import decontam, dedup, evaluate, generate, lineage, normalize, signals, splits, stats, tokens
from millrace.operators.prefix import bits_for, hash_bucket, hash_order, prefix, value_bucket
from millrace.plans import catalogue


@pytest.mark.parametrize("rows_a_bucket", [1, 1 << 18])
def test_prefix_equals_a_window(spark, rows_a_bucket):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {r["i"]: (r["before"], r["n"]) for r in prefix(df, ["g"], value_bucket(df, "i", rows_a_bucket), ["i"], sums={"before": F.col("v")}, rank="n").collect()}
    for g in ("a", "b", None):
        before = 0
        for k, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            assert got[i] == (before, k)
            before += v


def test_buckets_rise_with_their_column(spark):
    df = spark.createDataFrame([(None,), *((i * i % 997 - 300,) for i in range(600))], "i long")
    rows = sorted(((r["i"] is not None, r["i"], r["b"]) for r in df.select("i", value_bucket(df, "i", 2).alias("b")).collect()), key=lambda r: (r[0], r[1] or 0))
    assert [r[2] for r in rows] == sorted(r[2] for r in rows) and len({r[2] for r in rows}) > 150
    assert bits_for(0) == bits_for(1000) == 6 and bits_for(10**12) == 20 and 1e9 / 2 ** bits_for(10**9) <= 1 << 18


def test_prefix_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i long")
    assert prefix(df, ["g"], value_bucket(df, "i"), ["i"], rank="n").count() == 0


def test_hash_buckets_follow_the_hash(spark):
    h = hash_order("id")
    rows = spark.range(2000).select(h.alias("h"), hash_bucket(h).alias("b")).orderBy("h").collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows)


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for i in range(120):
        if out and rng.random() < 0.5:
            ws = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        else:
            ws = rng.choices(vocab, k=rng.randint(1, 40))
        out.append((i, " ".join(ws)))
    return out + [(1000, None), (1001, ""), (1002, "w1"), (1003, "w1"), (1004, "!!!")]


def sets_of(spark, texts, k=3):
    df = spark.createDataFrame(texts, "id long, t string")
    return df, {r["id"]: frozenset(r["s"]) for r in df.select("id", prompt_shingles("t", k).alias("s")).collect()}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_sets_equal_brute_force(spark, texts, threshold):
    df, sets = sets_of(spark, texts)
    classes = dedup.shingle_classes(df, "id", prompt_shingles("t")).cache()
    rep = {r["id"]: r["rep"] for r in classes.select("id", "rep").collect()}
    assert all(sets[i] == sets[r] and r <= i for i, r in rep.items()) and set(rep) == {i for i, s in sets.items() if s}
    want = {(a, b) for a, b in combinations(sorted(set(rep.values())), 2) if jaccard(sets[a], sets[b]) >= threshold}
    assert {(r["a"], r["b"]) for r in dedup.similar_sets(classes.where("id = rep"), threshold).collect()} == want


@pytest.mark.parametrize("sent", [dedup.MAX_SENT, 0])
def test_hot_shingles_are_paired_in_blocks(spark, texts, monkeypatch, sent):
    for name, value in (("HOT", 2), ("BLOCK", 2), ("MAX_SENT", sent), ("FREQUENT_SAMPLE", 20)):
        monkeypatch.setattr(dedup, name, value)
    test_similar_sets_equal_brute_force(spark, texts, 0.5)
    left, right = ([(i, t) for i, t in texts if t and i % 2 == k] for k in (0, 1))
    _, sets = sets_of(spark, texts)
    made = [dedup.shingle_classes(spark.createDataFrame(x, "id long, t string"), "id", prompt_shingles("t")) for x in (left, right)]
    got = {(r["a"], r["b"]) for r in dedup.similar_sets(made[0], 0.5, made[1]).collect()}
    assert got == {(a, b) for a, _ in left for b, _ in right if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.5}


def test_boundary_of_twelve_in_fifteen(spark):
    a = " ".join(f"x{i}" for i in range(15))  # 13 shingles
    both = [(1, a + " y0"), (2, a + " z0 z1")]  # 13 common, 1 and 2 own: 13 of 16
    _, sets = sets_of(spark, both)
    assert jaccard(sets[1], sets[2]) == 13 / 16
    at = [(1, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m n o p q")]  # 12 of 15
    df, sets = sets_of(spark, at)
    assert jaccard(sets[1], sets[2]) == 0.8
    assert dedup.near_duplicate_pairs(df, "t", "id").count() == 1


def test_keep_first_equals_the_sequential_rule(spark, texts):
    df, sets = sets_of(spark, texts)
    kept, by = [], {}
    for i, _ in sorted(texts):
        hit = next((k for k in kept if sets[i] and sets[k] and jaccard(sets[i], sets[k]) >= 0.5), None)
        by[i] = hit
        if hit is None:
            kept.append(i)
    got = {r["id"]: r["kept_by"] for r in dedup.near_duplicates_kept_first(df, "t", "id", threshold=0.5).collect()}
    assert got == by


def test_keep_first_decides_all_or_raises(spark, monkeypatch):
    nodes = spark.range(6)
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")
    monkeypatch.setattr(dedup, "MAX_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="undecided"):
        dedup.greedy_keep(nodes, edges)
    monkeypatch.setattr(dedup, "MAX_ROUNDS", 3)
    assert {r["id"]: r["kept_by"] for r in dedup.greedy_keep(nodes, edges).collect()} == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4}


def test_links_count_every_similar_record(spark, texts):
    df, sets = sets_of(spark, texts)
    got = {r["id"]: r["n_links"] for r in dedup.near_duplicate_links(df, "t", "id", threshold=0.5).collect()}
    ids = [i for i in sets if sets[i]]
    assert got == {i: sum(j != i and jaccard(sets[i], sets[j]) >= 0.5 for j in ids) for i in ids}


def test_links_have_a_row_for_every_record(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(20))
    texts = {1: base, 2: base, 3: base + " more", 4: "中文文档", 5: " ", 6: None, 7: "中文文档"}
    want = {1: (1, 2), 2: (1, 2), 3: (3, 2), **{i: (i, 0) for i in range(4, 8)}}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in catalogue.queries()["near_dup_links"](spark, str(tmp_path)).collect()} == want
    rows = [(i, [("user", t)] if i < 6 else None) for i, t in texts.items()]
    spark.createDataFrame(rows, "row_id long, messages array<struct<role string, content string>>").write.parquet(str(tmp_path / "raw_seed_records.parquet"))
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in catalogue.queries()["near_dup_record_links"](spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) and {i: got[i] for i in (1, 2, 3, 5, 6, 7)} == {i: want[i] for i in (1, 2, 3, 5, 6, 7)}


def test_exact_duplicates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b "), (3, "c"), (4, None), (5, "")], "id long, t string")
    assert {r["id"]: r["first_id"] for r in dedup.exact_duplicates(df, "t", "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    none = df.limit(0)
    assert dedup.keep_first(none, "t", "id").count() == dedup.near_duplicate_pairs(none, "t", "id").count() == dedup.near_duplicates_kept_first(none, "t", "id").count() == 0


def test_split_contamination(spark):
    train = spark.createDataFrame([(1, "how to sort a list in python quickly today"), (2, "something else entirely different here")], "id long, t string")
    held = spark.createDataFrame([(10, "How to sort  a list in python quickly TODAY"), (11, "how to sort a list in python quickly today please"), (12, "unrelated words only"), (13, None)], "id long, t string")
    got = {r["id"]: (r["train_id"], r["kind"]) for r in dedup.split_contamination(train, held, "t", "id").collect()}
    assert got == {10: (1, "exact"), 11: (1, "near")}


def test_contamination_kinds(spark):
    bench = spark.createDataFrame([(1, "Write a function that reverses a linked list in place."), (2, ""), (3, None)], "item_id long, text string")
    long = "Write a function that reverses a linked list in place"
    rows = [(1, "write a FUNCTION that reverses a linked list, in place"), (2, f"Please: {long}. Thanks and more words follow after it to make it long enough for any measure"), (3, "write a function that reverses a linked list in place now"), (4, "garbage collection explained"), (5, None), (6, "!!!")]
    got = {r["k"]: r["kind"] for r in decontam.contamination(spark.createDataFrame(rows, "k long, t string"), bench, key="k", text="t").collect()}
    assert got == {1: "exact", 2: "substring", 3: "substring"}
    near = spark.createDataFrame([(7, "write a function that reverses some linked list in place")], "k long, t string")
    assert decontam.contamination(near, bench, key="k", text="t", threshold=0.3).first()["kind"] == "jaccard"


@pytest.mark.parametrize(("form", "hits"), [(40, 0), (41, 1)])
def test_containment_needs_more_than_forty_characters(spark, form, hits):
    word = "a" * form
    bench = spark.createDataFrame([(1, word)], "item_id long, text string")
    assert decontam.contamination(spark.createDataFrame([(1, word + " tail")], "k long, t string"), bench, key="k", text="t").count() == hits


def forms_of(rng, n, prompts=()):
    """Random forms of few words, in several scripts; some hold a prompt, lie within one at any place, or nearly are one."""
    out = []
    for i in range(n):
        t = " ".join(rng.choices(["alpha", "beta", "gamma", "中文字", "delta", "été"], k=rng.randint(1, 25)))
        if prompts and rng.random() < 0.5:
            p = rng.choice(prompts)[1]
            a, b = sorted(rng.sample(range(len(p) + 1), 2)) if len(p) > 1 else (0, len(p))
            t = rng.choice([f"{t[:9]}{p}{t[9:]}", p[a:b], p, " ".join(["omega", *p.split()[1:]])]).strip()
        out.append((i, re.sub(r" +", " ", t)))
    return out


@pytest.mark.parametrize("max_sent", [60, decontam.MAX_SENT])
def test_contamination_equals_brute_force(spark, max_sent):
    rng = random.Random(13)
    bench = forms_of(rng, 25)
    rows = forms_of(rng, 150, bench)
    got = {r["k"]: (r["kind"], r["bench_id"]) for r in decontam.contamination(spark.createDataFrame([(*r, "x") for r in rows], "k long, t string, bench_id string"), spark.createDataFrame(bench, "item_id long, text string"), key="k", text="t", max_sent=max_sent).collect()}
    grams = lambda t: {" ".join(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} or set(t.split())
    want = {}
    for k, t in rows:
        equal, inside = [i for i, b in bench if b == t], [i for i, b in bench if min(len(b), len(t)) > 40 and (b in t or t in b)]
        near = [i for i, b in bench if jaccard(grams(t), grams(b)) >= 0.7]
        if equal or inside or near:
            want[k] = ("exact", max(equal)) if equal else ("substring", min(inside)) if inside else ("jaccard", min(near))
    assert got == want and {k for k, _ in want.values()} == {"exact", "substring", "jaccard"}
    one_by_one = decontam.drop_contaminated(spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame(bench, "item_id long, text string"), text="t")
    assert {r["k"] for r in one_by_one.collect()} == {k for k, _ in rows} - set(want)


def test_contamination_of_nothing(spark):
    none, some = spark.createDataFrame([], "k long, t string"), spark.createDataFrame([(1, None), (2, "a b")], "k long, t string")
    bench = spark.createDataFrame([(1, "a b c"), (2, None)], "item_id long, text string")
    assert decontam.contamination(none, bench, key="k", text="t").count() == decontam.contamination(some, bench.limit(0), key="k", text="t").count() == 0
    assert decontam.drop_contaminated(some, bench.limit(0), text="t").count() == 2 and decontam.ngram_matches(some, bench, key="k", text="t").count() == 0


def test_ngram_matches(spark):
    words_ = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words_[:20])), (2, " ".join(words_[10:14]))], "item_id long, text string")
    rows = spark.createDataFrame([(1, "X " + ", ".join(words_[5:19]).upper()), (2, " ".join(words_[5:10])), (3, None)], "k long, t string")
    assert [tuple(r) for r in decontam.ngram_matches(rows, bench, key="k", text="t", n=13).collect()] == [(1, 1, 2)]


def test_boilerplate_and_simhash(spark):
    rows = [(i, f"Own line {i}\n  ALL rights  reserved \n\n- x{i % 2}") for i in range(6)] + [(10, None), (11, ""), (12, "all rights reserved")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id long, t string, n_dropped int")
    out = {r["id"]: (r["n_dropped"], r["t"]) for r in signals.boilerplate(df, "id", "t", least_docs=5).collect()}
    assert out[0] == (1, "Own line 0\n\n- x0") and out[10] == (0, None) and out[11] == (0, "") and out[12] == (1, "") and len(out) == 9
    hashes = [r["h"] for r in spark.createDataFrame([("a b c d e f g h",), ("a b c d e f g x",), ("k l m n o p q r",), (None,), ("",)], "t string").select(signals.simhash("t").alias("h")).collect()]
    assert (hashes[0] ^ hashes[1]).bit_count() < (hashes[0] ^ hashes[2]).bit_count() and hashes[3:] == [0, 0]


def test_encode_equals_the_tokenizer(spark):
    if not os.path.exists(tokens.PUBLIC):
        pytest.skip("no tokenizer file here")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.PUBLIC)
    own.encode_special_tokens = True
    texts_ = [None, "", "Hello there, 中文 ünï", "<|endoftext|> x", "w " * 3000]
    out = tokens.encode(spark.createDataFrame(list(enumerate(texts_)), "i long, t string"), "t", tokens.PUBLIC).orderBy("i").collect()
    assert [r["ids"] for r in out] == [own.encode(t or "", add_special_tokens=False).ids for t in texts_]


def test_lineage_too_deep(spark, monkeypatch):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "parent_checkpoint string, checkpoint_path string")
    monkeypatch.setattr(lineage, "MAX_DEPTH", 5)
    assert lineage.paths(chain).count() == 6
    monkeypatch.setattr(lineage, "MAX_DEPTH", 3)
    with pytest.raises(RuntimeError):
        lineage.paths(chain)


def test_partition_is_stable(spark):
    df = spark.createDataFrame([("Implement quicksort algorithm in Python.", "def quicksort(arr): return arr"), (" implement QUICKSORT  algorithm in python. ", "def quicksort(arr): return arr\n")], "i string, r string")
    assert [r[0] for r in df.select(splits.partition_of("i", "r")).collect()] == ["train", "train"]
    parts = spark.range(20000).select(splits.partition_of(F.col("id").cast("string"), F.lit("x")).alias("p")).groupBy("p").count().collect()
    n = {r["p"]: r["count"] / 20000 for r in parts}
    assert abs(n["train"] - 0.9) < 0.01 and abs(n["test"] - 0.05) < 0.01


def test_exact_split(spark):
    df = spark.range(20)
    out = {r["id"]: r["split"] for r in splits.exact_split(df, "id", train=0.8, validation=0.1, test=0.1).collect()}
    assert sorted(out.values()).count("train") == 16 and list(out.values()).count("test") == 2 and len(out) == 20
    assert out == {r["id"]: r["split"] for r in splits.exact_split(df.repartition(3), "id", train=0.8, validation=0.1, test=0.1).collect()}
    with pytest.raises(ValueError):
        splits.split_sizes(2)
    with pytest.raises(ValueError):
        splits.split_sizes(10, 0.5, 0.5, 0.5)
    assert splits.split_sizes(3) == (1, 1, 1)


def sequential_intake(rows, quotas):
    queues = {s: sorted((r for r in rows if r[0] == s), key=lambda r: r[1]) for s in quotas}
    at, accepted, seen, order = dict.fromkeys(quotas, 0), dict.fromkeys(quotas, 0), {}, []
    while True:
        moved = False
        for s in quotas:
            while accepted[s] < quotas[s] and at[s] < len(queues[s]):
                row = queues[s][at[s]]
                at[s] += 1
                seen[row[:2]] = row[2] or "accepted"
                if row[2] is None:
                    accepted[s] += 1
                    order.append(row[:2])
                    moved = True
                    break
        if not moved:
            return seen, order


@pytest.mark.parametrize("seed", range(4))
def test_intake_equals_the_round_robin_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(s, i, rng.choice([None, None, "quality", "duplicate"])) for s in "abcd" for i in range(rng.randint(0, 12))]
    quotas = {s: rng.randint(0, 6) for s in "abc"}
    df = spark.createDataFrame(rows + [("d", 99, None)], "source string, seq long, status string")
    out = splits.intake(df, quotas, source="source", order="seq").collect()
    seen, order = sequential_intake(rows, quotas)
    assert {(r["source"], r["seq"]): r["outcome"] for r in out if r["outcome"]} == seen
    assert [(r["source"], r["seq"]) for r in sorted((r for r in out if r["position"]), key=lambda r: r["position"])] == order


def test_budget_stops_behind_the_row_that_reaches_it(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "i long, n long")
    assert sorted(r["i"] for r in splits.budget_prefix(df, "i", F.col("n"), 25).collect()) == [0, 1, 2]
    assert splits.budget_prefix(df, "i", F.col("n"), 0).count() == 0


def test_rows_per_batch():
    rows = splits.rows_per_batch(16, {"binding": 0.4, "instruction": 0.2, "semantic": 0.2, "web": 0.15, "arithmetic": 0.05}, spare="arithmetic", filler="binding", trim=("arithmetic", "web", "instruction"))
    assert sum(rows.values()) == 16 and min(rows.values()) >= 0
    assert splits.quota_targets(16000, {"a": 0.45, "b": 0.25, "c": 0.2, "d": 0.1}) == {"a": 7200, "b": 4000, "c": 3200, "d": 1600}


def test_weighted_choice(spark):
    n = {r["c"]: r["count"] for r in spark.range(20000).select(splits.weighted_choice([("a", 1), ("b", 3)], generate.uniform(F.col("id"), "x", 1)).alias("c")).groupBy("c").count().collect()}
    assert abs(n["b"] / 20000 - 0.75) < 0.02


def test_normalizers(spark):
    oc = spark.createDataFrame([("do it", "done", None, None, None, 101), ("do it", "done", None, None, None, None), (" ", "x", None, None, None, 1), (None, "x", None, None, None, 1)], "instruction string, output string, code string, entry_point string, testcase string, seq_id long")
    out = normalize.normalize_opencoder(oc).collect()
    assert out[0]["id"] == "opencoder_101" and out[1]["id"].startswith("opencoder_") and len(out) == 2
    assert [m["role"] for m in out[0]["messages"]] == ["system", "user", "assistant"] and out[0]["category"] == "coding_educational"
    sm = spark.createDataFrame([([("user", ""), ("user", "a"), ("assistant", "b"), ("assistant", "c")], None, None, None, None, None), ([("user", "a")], None, None, None, None, None), (None, None, None, None, None, None)], "messages array<struct<role string, content string>>, category string, difficulty string, quality string, reward_model_score double, conversation_tokens long")
    out = normalize.normalize_smoltalk(sm).collect()
    assert len(out) == 1 and out[0]["id"] == "smoltalk_55972a13e910693d" and out[0]["messages"][2]["content"] == "b" and out[0]["category"] == "general_instruction"
    bc = spark.createDataFrame([("i", "r", "bigcode_task_55", "s", None, None), ("i", "r", "", "sha", None, None), ("i", "r", None, None, None, None)], "instruction string, response string, id string, sha1 string, seed string, concepts array<string>")
    ids = [r["id"] for r in normalize.normalize_bigcode(bc).collect()]
    assert ids[:2] == ["bigcode_bigcode_task_55", "bigcode_sha"] and ids[2].startswith("bigcode_")
    flat = spark.createDataFrame([("u", "a", None, None, None), (None, None, None, "i", "r")], "user string, assistant string, system string, instruction string, response string")
    out = normalize.normalize_cybersecurity(flat).collect()
    assert [(r["messages"][1]["content"], r["messages"][2]["content"]) for r in out] == [("u", "a"), ("i", "r")]
    nested = spark.createDataFrame([("x", [("system", "one"), ("system", "two"), ("user", "u"), ("assistant", "a")])], "id string, messages array<struct<role string, content string>>")
    out = normalize.normalize_cybersecurity(nested).first()
    assert out["id"] == "x" and out["messages"][0]["content"] == "two"


def test_chat_template(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", None)],)], "m array<struct<role string, content string>>")
    assert df.select(normalize.render_chat(F.col("m"), generate=True).alias("x")).first()["x"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>assistant\n"


@pytest.mark.parametrize(
    ("messages", "want"),
    [
        ([("user", "hi"), ("assistant", "yo")], "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nyo<|im_end|>\n"),
        ([("system", "s"), ("user", "a"), ("assistant", "<think>\nwhy\n</think>\n\nb"), ("user", "c")], "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"),
        ([("user", "a"), ("assistant", "<think>x</think>b"), ("assistant", "c")], "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<think>\nx\n</think>\n\nb<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nc<|im_end|>\n"),
        ([("user", "a"), ("assistant", "b"), ("tool", "1"), ("tool", "2"), ("odd", "z"), ("assistant", None)], "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\n<tool_response>\n1\n</tool_response>\n<tool_response>\n2\n</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n<|im_end|>\n"),
        ([("user", "a"), ("assistant", "b"), ("user", "<tool_response>r</tool_response>"), ("assistant", "c")], "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\n<tool_response>r</tool_response><|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\nc<|im_end|>\n"),
        ([], ""), (None, None),
    ],
)
def test_agent_chat(spark, messages, want):
    df = spark.createDataFrame([(messages,)], "m array<struct<role string, content string>>")
    assert df.select(normalize.render_agent_chat(F.col("m")).alias("x")).first()["x"] == want


def test_agent_chat_with_tools(spark):
    rows = [([("system", "s", None), ("user", "a", None), ("assistant", "", [("f", '{"x": 1}'), ("g", "{}")]), ("tool", "7", None)], ['{"name": "f"}'])]
    df = spark.createDataFrame(rows, "m array<struct<role string, content string, tool_calls array<struct<name string, arguments string>>>>, t array<string>")
    got = df.select(normalize.render_agent_chat(F.col("m"), tools=F.col("t"), calls=True, generate=True).alias("x")).first()["x"]
    turn = '<|im_start|>assistant\n<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
    assert got == f'<|im_start|>system\ns\n\n{normalize.TOOLS_BEFORE}\n{{"name": "f"}}{normalize.TOOLS_BEHIND}<|im_start|>user\na<|im_end|>\n{turn}<|im_start|>user\n<tool_response>\n7\n</tool_response><|im_end|>\n<|im_start|>assistant\n'


def test_masks_pads_and_blocks(spark):
    df = spark.createDataFrame([(1, [("user", "a b"), ("assistant", "c")])], "id long, messages array<struct<role string, content string>>")
    m = tokens.assistant_mask(df).first()
    assert m["tokens"] == ["<|im_start|>user", "a", "b", "<|im_end|>", "<|im_start|>assistant", "c", "<|im_end|>"]
    assert m["labels"] == [None] * 5 + ["c", "<|im_end|>"]
    assert len(tokens.assistant_mask(df, limit=3).first()["labels"]) == 3
    rows = spark.createDataFrame([(1, [5, 6, 7], [-100, 6, 7]), (1, [8], [8])], "batch long, input_ids array<int>, labels array<int>")
    out = tokens.dynamic_pad(rows, "batch").collect()
    assert all(len(r[c]) == 8 for r in out for c in ("input_ids", "attention_mask", "labels"))
    assert sorted(sum(r["attention_mask"]) for r in out) == [1, 3] and out[0]["labels"][-1] == -100
    docs = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None), (4, [4, 5, 6, 7])], "id long, ids array<int>")
    stream = tokens.token_stream(docs, "ids", "id")
    flat = [t for r in sorted(stream.collect(), key=lambda r: r["id"]) for t in r["ids"]]
    assert flat == [1, 2, 3, 3, 3, 3, 4, 5, 6, 7, 3]
    for overlap, step in ((True, 4), (False, 5)):
        got = {r["block"]: r["tokens"] for r in tokens.blocks(stream, "ids", 4, overlap=overlap).collect()}
        assert got == {i: flat[i * step : i * step + 5] for i in range(len(flat)) if len(flat[i * step : i * step + 5]) == 5}
    xy = tokens.inputs_and_targets(tokens.blocks(stream, "ids", 4)).orderBy("block").first()
    assert (xy["x"], xy["y"]) == (flat[:4], flat[1:5])


def test_packing_windows(spark):
    df = spark.createDataFrame([(0, i, [i] * n) for i, n in enumerate([3, 4, 2, 9, 0, 5])], "shard long, i long, ids array<int>")
    out = sorted(tokens.greedy_windows(df, "ids", ["i"], "shard", 8).collect(), key=lambda r: r["window"])
    assert [r["tokens"] for r in out] == [[0, 0, 0, 1, 1, 1, 1, 0], [2, 2, 0, 0, 0, 0, 0, 0], [3] * 8, [5] * 5 + [0] * 3]
    mixed = tokens.mixed_rows(tokens.token_stream(spark.createDataFrame([(1, [1] * 20)], "id long, ids array<int>"), "ids", "id", eos=None), tokens.token_stream(spark.createDataFrame([(1, [2] * 4)], "id long, ids array<int>"), "ids", "id", eos=None), "ids", width=10, share=0.9)
    assert [r["tokens"] for r in mixed.orderBy("row").collect()] == [[1] * 9 + [2]] * 2
    crop = spark.createDataFrame([([1, 2, 3],), ([],)], "ids array<int>").select(tokens.repeat_and_crop(F.col("ids"), 5, F.lit(4)).alias("x")).collect()
    assert [r["x"] for r in crop] == [[2, 3, 1, 2, 3], None]


def test_packing_windows_keeps_all_of_long_examples(spark):
    df = spark.createDataFrame([(0, i, list(range(1, n + 1))) for i, n in enumerate([3, 9, 0, 16, 2])], "shard long, i long, ids array<int>")
    out = sorted(tokens.greedy_windows(df, "ids", ["i"], "shard", 8, split=True).collect(), key=lambda r: r["window"])
    assert [r["tokens"] for r in out] == [[1, 2, 3, 0, 0, 0, 0, 0], list(range(1, 9)), [9, 0, 0, 0, 0, 0, 0, 0], list(range(1, 9)), list(range(9, 17)), [1, 2, 0, 0, 0, 0, 0, 0]]
    assert [r["n_examples"] for r in out] == [1] * 6


def test_greedy_windows_query_loses_no_token(spark, tmp_path):
    spark.createDataFrame([(0, "a b"), (1, "w " * 1300), (2, "c d e")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    packed = catalogue.queries()["greedy_windows"](spark, str(tmp_path)).collect()
    assert sum(t != tokens.PAD for r in packed for t in r["tokens"]) == 1305


@pytest.mark.parametrize(("stride", "width"), [(4, 5), (5, 5), (1, 2), (7, 8)])
def test_blocks_equal_plain_slices(spark, stride, width):
    rng = random.Random(width)
    docs = spark.createDataFrame([(i, [rng.randint(0, 99) for _ in range(rng.choice([0, 1, 2, 5, 23]))]) for i in range(25)], "id long, ids array<int>")
    stream = tokens.token_stream(docs, "ids", "id", eos=None).cache()
    flat = [t for r in sorted(stream.collect(), key=lambda r: r["id"]) for t in r["ids"]]
    got = {r["block"]: r["tokens"] for r in tokens.blocks(stream, "ids", width - 1, overlap=stride < width).collect()}
    assert got == {i: flat[i * stride : i * stride + width] for i in range(len(flat)) if len(flat[i * stride : i * stride + width]) == width}


def test_first_seen_and_best_candidate(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w"), ("b", 3, "v")], "k string, n int, v string")
    assert sorted(r["v"] for r in dedup.first_seen(df, ["k"], ["n"]).collect()) == ["v", "w", "y"]
    rows = spark.createDataFrame([("p", "b", 0.5, True), ("p", "a", 0.5, True), ("p", "c", 0.9, False), ("q", "d", None, True)], "prefix string, cand string, prob double, ok boolean")
    assert [(r["prefix"], r["cand"]) for r in evaluate.best_candidate(rows, ["prefix"], "cand", "prob", "ok").collect()] == [("p", "a")]


def test_comparison(spark):
    a = spark.createDataFrame([("x", 0.4), ("only_before", 0.1)], "category string, score double")
    b = spark.createDataFrame([("x", 0.9), ("only_after", 0.2)], "category string, score double")
    out = {r["category"]: (r["before_text"], r["after_text"], r["delta_text"]) for r in evaluate.compare(a, b).collect()}
    assert out == {"x": ("0.4000", "0.9000", "+0.5000"), "only_before": ("0.1000", "N/A", "N/A"), "only_after": ("N/A", "0.2000", "N/A")}
    assert "+0.3500" in evaluate.comparison_report(evaluate.compare(a, b), 0.5, 0.85)


def test_reports_are_not_cut(spark):
    a = spark.createDataFrame([(f"c{i}", 0.5) for i in range(5)], "category string, score double")
    assert stats.markdown_table(a, ["category"], limit=5).count("\n") == 7
    for make in (lambda: stats.markdown_table(a, ["category"], limit=4), lambda: evaluate.comparison_report(evaluate.compare(a, a), 1.0, 1.0, limit=4)):
        with pytest.raises(ValueError):
            make()


def test_prompt_accuracy(spark):
    rows = [("a", True, True, True), ("a", True, False, False), ("a", False, True, False), ("b", True, True, True)]
    out = {(r["category"], r["wrapped"]): (r["n"], r["correct"], r["strict"], r["accuracy"]) for r in evaluate.prompt_accuracy(spark.createDataFrame(rows, "category string, w boolean, c boolean, s boolean"), "category", "w", "c", "s").collect()}
    assert out == {("a", True): (2, 1, 1, 0.5), ("a", False): (1, 1, 0, 1.0), ("b", True): (1, 1, 1, 1.0), (None, True): (3, 2, 2, 2 / 3), (None, False): (1, 1, 0, 1.0)}


def test_empty_reports(spark):
    none = spark.createDataFrame([], "passed boolean")
    assert evaluate.pass_at_1(none).first()["pass_at_1"] == 0.0
    ms = spark.createDataFrame([], "messages array<struct<role string, content string>>")
    assert stats.record_statistics(ms).first()["avg_tokens"] == 0.0
    assert stats.length_percentiles(spark.createDataFrame([], "n long"), F.col("n")).first()["median"] == 0.0


def test_lineage_with_a_circle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), (None, "x"), ("c", "b")], "parent_checkpoint string, checkpoint_path string")
    assert [r["node"] for r in lineage.roots(df).collect()] == ["a"]
    assert sorted("".join(r["path"]) for r in lineage.paths(df).collect()) == ["a", "ab", "abc", "abd"]
    loop = spark.createDataFrame([("b", "a"), ("a", "b")], "parent_checkpoint string, checkpoint_path string")
    assert [r["node"] for r in lineage.roots(loop).collect()] == ["a"]


def test_generators(spark):
    rows = generate.dialogs(spark, 300, generate.SEMANTIC, plain=0.35).collect()
    assert len({r["text"] for r in rows}) == len(rows) == 300 and all("{" not in r["text"] for r in rows)
    assert rows == generate.dialogs(spark, 300, generate.SEMANTIC, plain=0.35).collect()
    assert min(len({r["text"] for r in rows if r["category"] == c}) for c, _ in generate.SEMANTIC) >= 3
    assert not [r["text"] for r in rows if re.search(r"\ba [aeiou]|\ban [^aeiou\W]", r["text"], re.I)]
    for r in rows:
        if r["category"] == "comparison":
            n, m = map(int, re.findall(r"\d+", r["question"]))
            first, second = re.findall(r"\b[A-Z][a-z]+(?= (?:has|counted))", r["question"])[:2]
            assert r["answer"] == (f"{first if n > m else second}." if n != m else "They are even.")
    bench = generate.binding_benchmark(spark)
    assert generate.shared_names(generate.dialogs(spark, 2000, generate.SEMANTIC), bench).count() == 0
    assert generate.shared_names(generate.dialogs(spark, 2000, generate.BINDING), bench).count() == 0
    assert generate.names_in(bench, "prompt").count() > 15
    with pytest.raises(ValueError, match="Alba"):
        generate.dialogs(spark, 10, generate.SEMANTIC, pools={**generate.POOLS, "other": ["Alba"]})
    with pytest.raises(ValueError, match="Wim"):
        generate.binding_benchmark(spark, pools={**generate.HELD_OUT, "third": ["Wim"]})
    for r in generate.arithmetic(spark, 20).collect():
        q, a = r["text"].split("\nAssistant: ")
        x, op, y = q.removeprefix("User: What is ").rstrip("?").split()
        assert int(a) == (int(x) + int(y) if op == "+" else int(x) - int(y))
    said = generate.teach(spark.createDataFrame([("hi",), (None,)], "p string"), "p", lambda p: p.upper()).collect()
    assert [r["response"] for r in said] == ["HI", ""]


@pytest.mark.parametrize("run", ["near_duplicates_kept_first", "near_duplicate_links", "near_duplicate_pairs"])
def test_near_duplicates_keep_no_sets_on_disk(spark, monkeypatch, run):
    kept, write = [], dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name="table": kept.append(df.columns) or write(df, name))
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f g h i")], "id long, t string")
    assert getattr(dedup, run)(df, "t", "id").count() in (0, 3)
    assert kept and not any("set" in columns for columns in kept)
