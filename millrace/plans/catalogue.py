"""All queries of the core, by name, and the SQL that states each of them independently where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import quality as Q
from millrace.functions import scoring as S
from millrace.functions import text as X
from millrace.operators import decontam, dedup, evaluate, generate, lineage, normalize, signals, splits, stats, tokens
from millrace.plans import pipelines
from millrace.plans import sql as L
from millrace.session import materialize, shared_root, table
from millrace.sources import files
from millrace.streaming import intake as streaming

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_seed_records")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Sums of fractions depend on their order in the last digits: what is compared by value is rounded."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- duplicates and profiles


@query(f"SELECT doc_id, source, lang FROM documents QUALIFY doc_id = min(doc_id) OVER (PARTITION BY sha256({L.squeeze('text')}))")
def exact_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(_documents(spark, d).select("doc_id", "source", "lang", "text"), "text", "doc_id").select("doc_id", "source", "lang")


@query(f"""
    WITH f AS (SELECT coalesce(source, '(none)') AS source, doc_id, min(doc_id) OVER (PARTITION BY sha256({L.squeeze("text")})) AS first_id FROM documents)
    SELECT source, count(*) AS n, count(*) FILTER (first_id <> doc_id) AS n_duplicates, avg((first_id <> doc_id)::INT) AS duplicate_rate FROM f GROUP BY source""")
def duplicate_rate_per_source(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), "text")
    return stats.duplicate_rate(dedup.exact_duplicates(docs, "text", "doc_id"), "first_id", "doc_id", ["source"])


@query(f"""
    SELECT lang, count(*) AS n_docs, coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, coalesce(sum(len({L.words("text")})), 0)::BIGINT AS n_words
    FROM documents GROUP BY lang""")
def doc_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return stats.document_statistics(_documents(spark, d), "text", ["lang"])


@query("""
    SELECT source, count(*) AS n, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99,
        max(n_chars)::DOUBLE AS longest FROM documents GROUP BY source""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.length_percentiles(_documents(spark, d), F.col("n_chars"), ["source"]), "median", "p90", "p95", "p99")


_MESSAGES = "raw_seed_records r, (SELECT row_id AS k, unnest(messages) AS m FROM raw_seed_records) u WHERE u.k = r.row_id"


@query("""
    WITH p AS (SELECT coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: coalesce(length(m.content), 0))), 0) AS q,
        coalesce(list_sum(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: coalesce(length(m.content), 0))), 0) AS a,
        coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))), 0) AS t FROM raw_seed_records)
    SELECT count(*) AS n_records, round_even(avg(q), 2)::DOUBLE AS avg_question_chars, round_even(avg(a), 2)::DOUBLE AS avg_answer_chars, round_even(avg(round_even(t / 4.0, 0))::DOUBLE, 2) AS avg_tokens,
        min(round_even(t / 4.0, 0))::BIGINT AS min_tokens, max(round_even(t / 4.0, 0))::BIGINT AS max_tokens FROM p""")
def record_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.record_statistics(_records(spark, d))


@query("SELECT coalesce(category, 'unknown') AS value, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM raw_seed_records GROUP BY 1")
def category_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_records(spark, d), "category")


@query("SELECT coalesce(difficulty, 'unknown') AS value, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM raw_seed_records GROUP BY 1")
def difficulty_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_records(spark, d), "difficulty")


@query(f"""
    WITH t AS (SELECT text, len({L.words("text")}) AS n FROM documents)
    SELECT count(*) AS n_docs, sum(length(text)) / sum(n) AS chars_per_token, sum(n) / sum(len({L.words("text")})) AS tokens_per_word, 0.0::DOUBLE AS unknown_rate, avg(n) AS mean_tokens,
        quantile_cont(n, 0.5)::DOUBLE AS median_tokens FROM t""")
def tokenizer_report(spark: SparkSession, d: str) -> DataFrame:
    counted = _documents(spark, d).select("text", X.word_count("text").alias("n"))
    return stats.tokenizer_report(counted, "text", "n")


# ---------------------------------------------------------------- quality


@query(f"""
    WITH g AS (SELECT doc_id, {L.words("text")} AS w FROM documents), r AS (SELECT doc_id, len(w) AS n, {L.repetition(L.ngrams("w", 4))} AS repetition FROM g)
    SELECT doc_id, repetition, n >= 20 AND repetition > 0.4 AS clean_flag, n >= 30 AND repetition > 0.45 AS filter_flag FROM r""")
def ngram_repetition_flags(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", X.repetition("text").alias("repetition"), X.repeats_too_much("text").alias("clean_flag"), X.repeats_too_much("text", limit=0.45, least=30).alias("filter_flag"))


@query(f"""
    WITH p AS (SELECT seq_id, entry_point, {L.strip("instruction")} AS i, {L.strip("output")} AS r FROM raw_opencoder)
    SELECT seq_id, entry_point, {L.pair_reason("i", "r")} AS reason FROM p""")
def quality_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_opencoder").select("seq_id", "entry_point", Q.pair_reason("instruction", "output").alias("reason"))


@query(f"""
    WITH p AS (SELECT {L.strip("instruction")} AS i, {L.strip("output")} AS r FROM raw_opencoder), s AS (SELECT coalesce({L.pair_reason("i", "r")}, 'accepted') AS value FROM p)
    SELECT value, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM s GROUP BY value""")
def rejection_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "raw_opencoder"), F.coalesce(Q.pair_reason("instruction", "output"), F.lit("accepted")))


@query(f"SELECT doc_id, {L.cut_off('text')} AS cut_off, {L.fences('text')} % 2 = 0 AS balanced FROM documents")
def truncation_flags(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", X.cut_off("text").alias("cut_off"), X.fences_balanced("text").alias("balanced"))


@query(f"SELECT row_id, {L.placeholder('m.content')} AS placeholder, len({L.secrets('m.content')}) AS n_secrets FROM {_MESSAGES}")
def placeholder_and_secret_flags(spark: SparkSession, d: str) -> DataFrame:
    said = _records(spark, d).select("row_id", F.explode("messages").alias("m"))
    return said.select("row_id", Q.placeholder("m.content").alias("placeholder"), F.size(Q.find_secrets("m.content")).alias("n_secrets"))


@query(f"SELECT doc_id, {L.ungrounded('text')} AS ungrounded FROM documents")
def grounding_filter(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", Q.ungrounded("text").alias("ungrounded"))


_SCHEMA_SQL = f"""
    CASE WHEN {L.strip("id")} = '' THEN 'id_blank' WHEN {L.strip("category")} = '' THEN 'category_blank'
    WHEN coalesce(difficulty, '') NOT IN ('beginner', 'intermediate', 'advanced') THEN 'difficulty_unknown=' || coalesce(difficulty, 'null')
    WHEN {L.strip("source")} = '' THEN 'source_blank' WHEN tags IS NULL THEN 'tags_missing' WHEN coalesce(len(messages), 0) < 2 THEN 'messages_few'
    WHEN len(faults) > 0 THEN faults[1]
    WHEN NOT list_contains(list_transform(messages, lambda m: m.role), 'user') THEN 'user_missing'
    WHEN NOT list_contains(list_transform(messages, lambda m: m.role), 'assistant') THEN 'assistant_missing' END"""
_FAULTS_SQL = f"""list_filter(list_transform(messages, lambda m, i: CASE WHEN coalesce(m.role, '') NOT IN ('system', 'user', 'assistant')
            THEN 'role_unknown=' || (i - 1) || ':' || coalesce(m.role, 'null') WHEN {L.strip("m.content")} = '' THEN 'content_blank=' || (i - 1) END), lambda x: x IS NOT NULL)"""


@query(f"""
    WITH f AS (SELECT *, {_FAULTS_SQL} AS faults FROM raw_seed_records)
    SELECT row_id, {_SCHEMA_SQL} AS reason FROM f""")
def schema_validation(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("row_id", Q.schema_reason(*[F.col(c) for c in ("id", "category", "difficulty", "source", "tags", "messages")]).alias("reason"))


def _role_named(messages: str = "messages") -> Column:
    """Messages with the two speakers' other names replaced, as a reader of this data would do first."""
    low = lambda m: F.lower(F.trim(m["role"]))
    return F.transform(messages, lambda m: F.struct(F.when(low(m).isin("human", "user"), "user").when(low(m).isin("bot", "assistant"), "assistant").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


_ROLES_SQL = "list_transform(messages, lambda m: struct_pack(role := CASE lower(trim(m.role)) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'bot' THEN 'assistant' WHEN 'assistant' THEN 'assistant' ELSE m.role END, content := m.content))"
_ISSUES_SQL = f"""concat_ws(';', CASE WHEN len({L.secrets("t")}) > 0 THEN 'secret=' || array_to_string(list_transform({L.secrets("t")}, lambda x: left(x, 30) || '...'), ',') END,
        'placeholder=' || {L.placeholder("t")}, CASE WHEN len(w) >= 20 AND {L.repetition(L.ngrams("w", 4))} > 0.4 THEN 'repeats' END, CASE WHEN {L.cut_off("t")} THEN 'cut_off' END)"""
_VALID_SQL = f"""
    named AS (SELECT * REPLACE ({_ROLES_SQL} AS messages) FROM raw_seed_records), f AS (SELECT *, {_FAULTS_SQL} AS faults FROM named), g AS (SELECT *, {_SCHEMA_SQL} AS fault FROM f),
    m AS (SELECT row_id, i, role, {L.tidy("content")} AS t FROM (SELECT row_id, unnest(range(1, len(messages) + 1)) AS i, unnest(messages).role AS role, unnest(messages).content AS content FROM g WHERE fault IS NULL)),
    u AS (SELECT *, {_ISSUES_SQL} AS bad FROM (SELECT *, {L.words("t")} AS w FROM m)),
    c AS (SELECT row_id, arg_min(role || ':' || bad, i) FILTER (bad <> '') AS unclean, coalesce(sum(length(t)) FILTER (role = 'user'), 0) AS nu, coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS na,
        string_agg(t, ' ' ORDER BY i) AS everything, arg_min(t, i) FILTER (role = 'user') AS prompt FROM u GROUP BY row_id),
    checked AS (SELECT row_id, id, prompt, CASE WHEN fault IS NOT NULL THEN fault WHEN unclean IS NOT NULL THEN 'message_unclean=' || unclean WHEN nu < 15 THEN 'user_short=' || nu
        WHEN na < 40 THEN 'assistant_short=' || na WHEN {L.ungrounded("everything")} THEN 'ungrounded' END AS reason FROM g LEFT JOIN c USING (row_id))"""


@query(f"WITH {_VALID_SQL} SELECT row_id, reason FROM checked")
def record_validation(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.validated(_records(spark, d).withColumn("messages", _role_named()), "row_id").select("row_id", "reason")


@query(f"SELECT doc_id, {L.tidy('text')} AS text FROM documents")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", X.normalize_text("text").alias("text"))


_CURATED_SQL = f"""
    WITH RECURSIVE {_VALID_SQL}, good AS (SELECT row_id, id, {L.strip("prompt")} AS prompt, min(row_id) OVER (PARTITION BY id) AS same_id FROM checked WHERE reason IS NULL),
    once AS (SELECT row_id, prompt, min(row_id) OVER (PARTITION BY {L.squeeze("prompt")}) AS same_prompt FROM good WHERE row_id = same_id), left_ AS (SELECT row_id, prompt FROM once WHERE row_id = same_prompt),
    {L.near_pairs("left_", "row_id", L.ascii_words("prompt"), 0.8)}, {L.greedy_keep()},
    curated AS (SELECT row_id, 'invalid' AS outcome, reason FROM checked WHERE reason IS NOT NULL
        UNION ALL SELECT row_id, 'duplicate_id', 'same_id=' || id FROM good WHERE row_id <> same_id UNION ALL SELECT row_id, 'exact_duplicate', 'same_prompt=' || same_prompt FROM once WHERE row_id <> same_prompt
        UNION ALL SELECT row_id, CASE WHEN kept_by IS NULL THEN 'accepted' ELSE 'near_duplicate' END, 'near=' || kept_by FROM left_ LEFT JOIN near_by ON near_by.id = row_id)"""


@query(_CURATED_SQL + " SELECT row_id, outcome, reason FROM curated")
def curated_records(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.curate(_records(spark, d).withColumn("messages", _role_named()), "row_id")


@query()
def curated_splits(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.curate_and_split(_records(spark, d).withColumn("messages", _role_named()), "row_id")


@query(_CURATED_SQL + """, total AS (SELECT count(*) AS n FROM curated WHERE outcome = 'accepted'), v AS (SELECT n, greatest(1, round_even(n * 0.05, 0)::BIGINT) AS v FROM total)
    SELECT unnest(['train', 'validation', 'test']) AS split, unnest([n - 2 * v, v, v]) AS n FROM v""")
def curated_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return curated_splits(spark, d).groupBy("split").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- normalizing


def _shown(df: DataFrame) -> DataFrame:
    ms = F.col("messages")
    return df.select("id", ms[0]["content"].alias("system"), ms[1]["content"].alias("instruction"), ms[2]["content"].alias("response"), "source", "category", "difficulty")


_SYSTEM = L.quoted(normalize.SYSTEM_PROMPT)


@query(f"""
    WITH p AS (SELECT *, {L.strip("instruction")} AS i, {L.strip("output")} AS r FROM raw_opencoder)
    SELECT coalesce('opencoder_' || seq_id, {L.content_id("opencoder", "i", "r")}) AS id, {_SYSTEM} AS system, i AS instruction, r AS response, 'opencoder_educational_instruct' AS source,
        'coding_educational' AS category, 'intermediate' AS difficulty FROM p WHERE i <> '' AND r <> ''""")
def normalize_opencoder(spark: SparkSession, d: str) -> DataFrame:
    return _shown(normalize.normalize_opencoder(table(spark, d, "raw_opencoder")))


@query(f"""
    WITH p AS (SELECT *, {L.strip("instruction")} AS i, {L.strip("output")} AS r FROM raw_opencoder)
    SELECT coalesce('bigcode_' || nullif(seq_id::VARCHAR, ''), 'bigcode_' || nullif(md5(code), ''), {L.content_id("bigcode", "i", "r")}) AS id, {_SYSTEM} AS system, i AS instruction, r AS response,
        'bigcode_self_oss_instruct_sc2' AS source, 'coding_exec_validated' AS category, 'advanced' AS difficulty FROM p WHERE i <> '' AND r <> ''""")
def normalize_bigcode(spark: SparkSession, d: str) -> DataFrame:
    return _shown(normalize.normalize_bigcode(_as_bigcode(table(spark, d, "raw_opencoder"))))


def _as_bigcode(df: DataFrame) -> DataFrame:
    """The coding set in the layout of the other one, of which there is no table."""
    return df.select("instruction", F.col("output").alias("response"), F.col("seq_id").cast("string").alias("id"), F.md5("code").alias("sha1"), F.array("entry_point").alias("concepts"), F.col("testcase").alias("seed"))


@query(f"""
    WITH p AS (SELECT *, coalesce({L.contents("messages", "user")}[1], '') AS i, coalesce({L.contents("messages", "assistant")}[1], '') AS r FROM raw_smoltalk WHERE len(messages) >= 2)
    SELECT {L.content_id("smoltalk", "i", "r")} AS id, {_SYSTEM} AS system, i AS instruction, r AS response, 'smoltalk_magpie_ultra' AS source, coalesce(category, 'general_instruction') AS category,
        coalesce(difficulty, 'intermediate') AS difficulty FROM p WHERE i <> '' AND r <> ''""")
def normalize_smoltalk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(normalize.normalize_smoltalk(table(spark, d, "raw_smoltalk")))


@query(f"""
    WITH p AS (SELECT *, coalesce({L.contents("messages", "user")}[1], '') AS i, coalesce({L.contents("messages", "assistant")}[1], '') AS r, {L.contents("messages", "system")} AS s FROM raw_seed_records)
    SELECT coalesce(nullif(id, ''), {L.content_id("cyber", "i", "r")}) AS id, coalesce(s[len(s)], {_SYSTEM}) AS system, i AS instruction, r AS response, coalesce(source, 'cybersecurity_stream') AS source,
        coalesce(category, 'cybersecurity') AS category, coalesce(difficulty, 'intermediate') AS difficulty FROM p WHERE i <> '' AND r <> ''""")
def normalize_cybersecurity(spark: SparkSession, d: str) -> DataFrame:
    return _shown(normalize.normalize_cybersecurity(_records(spark, d)))


@query("""
    SELECT row_id, md5(coalesce(list_reduce(list_transform(messages, lambda m: '<|im_start|>' || coalesce(m.role, '') || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10)),
        lambda a, b: a || b), '') || '<|im_start|>assistant' || chr(10)) AS rendered FROM raw_seed_records""")
def chat_template_render(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("row_id", F.md5(normalize.render_chat(F.col("messages"), generate=True)).alias("rendered"))


@query("SELECT row_id, len(messages) AS n, md5(list_reduce(list_transform(messages, lambda m: coalesce(m.role, '') || '=' || coalesce(m.content, '') || ';'), lambda a, b: a || b)) AS said FROM raw_seed_records WHERE len(messages) > 0")
def conversation_assembly(spark: SparkSession, d: str) -> DataFrame:
    turns = _records(spark, d).select("row_id", F.posexplode("messages").alias("turn", "m")).select("row_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    made = normalize.assemble(turns, "row_id", "turn", "role", "content")
    said = F.array_join(F.transform("messages", lambda m: F.concat(X.text_of(m["role"]), F.lit("="), X.text_of(m["content"]), F.lit(";"))), "")
    return made.select("row_id", F.size("messages").alias("n"), F.md5(said).alias("said"))


@query(f"""
    WITH f AS (SELECT * FROM raw_opencoder WHERE seq_id IS NOT NULL ORDER BY seq_id, instruction, output LIMIT 100), p AS (SELECT {L.strip("instruction")} AS i, {L.strip("output")} AS r FROM f)
    SELECT 'User: ' || i || chr(10) || 'Assistant: ' || r AS text FROM p WHERE i <> '' AND r <> ''""")
def alpaca_dialogs(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 rows are the feature: the reader takes a fixed number of source rows."""
    rows = table(spark, d, "raw_opencoder").where("seq_id is not null").withColumn("at", F.struct("seq_id", "instruction", "output"))
    return normalize.alpaca(rows, 100, order="at")


# ---------------------------------------------------------------- near duplicates and contamination


@query(f"""
    WITH t AS (SELECT row_id, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ') AS t FROM raw_seed_records),
    w AS (SELECT row_id, list_filter(string_split({L.form("t")}, ' '), lambda x: x <> '') AS w FROM t), s AS (SELECT row_id, list_sort({L.shingles("w")}) AS s FROM w),
    c AS (SELECT min(row_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s), u AS (SELECT id, n, unnest(s) AS g FROM c),
    p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
    SELECT a, b, k / (na + nb - k) AS similarity FROM p WHERE k / (na + nb - k) >= 0.8""")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the first records of equal sets, as the SQL states; near_dup_record_links has every record's class."""
    said = F.array_join(F.transform("messages", lambda m: X.text_of(m["content"])), " ")
    return dedup.near_duplicate_pairs(_records(spark, d), said, "row_id", sets=X.comparison_shingles(said))


_LINKS_SQL = """, both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), cls AS (SELECT id, min(id) OVER (PARTITION BY g) AS class_id FROM (SELECT id, list_sort(list(g)) AS g FROM s GROUP BY id)),
    linked AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
    SELECT w.id, coalesce(class_id, w.id) AS class_id, coalesce(n_links, 0) AS n_links FROM w LEFT JOIN cls ON cls.id = w.id LEFT JOIN linked ON linked.a = w.id"""
_SAID_SQL = "(SELECT row_id, array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ') AS t FROM raw_seed_records)"
_FORM_WORDS = f"list_filter(string_split({L.form('t')}, ' '), lambda x: x <> '')"


@query("WITH " + L.near_pairs(_SAID_SQL, "row_id", _FORM_WORDS, 0.8) + _LINKS_SQL)
def near_dup_record_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the first record with its shingles, which near_dup_pairs names, and how many are similar."""
    said = F.array_join(F.transform("messages", lambda m: X.text_of(m["content"])), " ")
    return dedup.near_duplicate_links(_records(spark, d), said, "row_id", sets=X.comparison_shingles(said), every=True)


@query("WITH " + L.near_pairs("documents", "doc_id", L.ascii_words("text"), 0.8) + _LINKS_SQL)
def near_dup_links(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicate_links(_documents(spark, d), "text", "doc_id", every=True)


@query(f"WITH RECURSIVE {L.near_pairs('documents', 'doc_id', L.ascii_words('text'), 0.8)}, {L.greedy_keep()} SELECT doc_id, source, kept_by FROM documents LEFT JOIN near_by ON near_by.id = doc_id")
def near_dup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates_kept_first(_documents(spark, d).select("doc_id", "source", "text"), "text", "doc_id").select("doc_id", "source", "kept_by")


_PROMPTS_SQL = f"(SELECT row_id, {L.strip('list_filter(messages, lambda m: m.role = chr(117) || chr(115) || chr(101) || chr(114))[1].content')} AS prompt FROM raw_seed_records)"


@query(f"WITH RECURSIVE {L.near_pairs(_PROMPTS_SQL, 'row_id', L.ascii_words('prompt'), 0.8)}, {L.greedy_keep()} SELECT row_id, kept_by FROM raw_seed_records LEFT JOIN near_by ON near_by.id = row_id")
def prompt_near_dup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    prompts = _records(spark, d).select("row_id", normalize.user_prompt(F.col("messages")).alias("prompt"))
    return dedup.near_duplicates_kept_first(prompts, "prompt", "row_id").select("row_id", "kept_by")


@query(f"""
    WITH {L.near_pairs("documents", "doc_id", L.ascii_words("text"), 0.75)}, p AS (SELECT doc_id, {L.partition_of("doc_id::VARCHAR", chr(39) * 2)} = 'train' AS train, {L.squeeze("text")} AS h FROM documents),
    x AS (SELECT t.doc_id, min(o.doc_id) AS train_id FROM p t JOIN p o ON t.h = o.h AND o.train WHERE NOT t.train GROUP BY t.doc_id),
    d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), y AS (SELECT a AS doc_id, min(b) AS train_id FROM d JOIN p t ON t.doc_id = a AND NOT t.train JOIN p o ON o.doc_id = b AND o.train WHERE a NOT IN (SELECT doc_id FROM x) GROUP BY a)
    SELECT doc_id, train_id, 'exact' AS kind, 1.0::DOUBLE AS similarity FROM x
    UNION ALL SELECT doc_id, train_id, 'near', k / (m.n + o.n - k) FROM y JOIN k ON k.a = least(doc_id, train_id) AND k.b = greatest(doc_id, train_id) JOIN n m ON m.id = doc_id JOIN n o ON o.id = train_id""")
def split_contamination(spark: SparkSession, d: str) -> DataFrame:
    """The split is by number: one by content would keep equal texts together."""
    docs = materialize(_documents(spark, d).select("doc_id", "text", splits.partition_of(F.col("doc_id").cast("string"), F.lit("")).alias("split")), "split")
    return pipelines.validate_splits(docs, "split", "text", "doc_id")


_CONTAM_SQL = f"""
    WITH d AS (SELECT doc_id, f, list_filter(string_split(f, ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, {L.form("text")} AS f FROM documents) WHERE f <> ''),
    b AS (SELECT item_id, f, list_filter(string_split(f, ' '), lambda x: x <> '') AS w FROM (SELECT item_id, {L.form("text")} AS f FROM benchmark) WHERE f <> ''),
    ds AS (SELECT doc_id, {L.shingles("w")} AS s FROM d), bs AS (SELECT item_id, {L.shingles("w")} AS s FROM b),
    du AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM ds), bu AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM bs),
    j AS (SELECT doc_id, item_id, k / (nd + nb - k) AS sim FROM (SELECT doc_id, item_id, du.n AS nd, bu.n AS nb, count(*) AS k FROM du JOIN bu USING (g) GROUP BY ALL)),
    hits AS (SELECT doc_id, 0 AS rank, max(item_id) AS item_id, NULL::DOUBLE AS sim FROM d JOIN b ON d.f = b.f GROUP BY doc_id
        UNION ALL SELECT doc_id, 1, min(item_id), NULL FROM d JOIN b ON length(d.f) > 40 AND length(b.f) > 40 AND (contains(d.f, b.f) OR contains(b.f, d.f)) GROUP BY doc_id
        UNION ALL SELECT doc_id, 2, min(item_id), arg_min(sim, item_id) FROM j WHERE sim >= 0.7 GROUP BY doc_id),
    best AS (SELECT doc_id, ['exact', 'substring', 'jaccard'][rank + 1] AS kind, item_id AS bench_id, sim AS similarity FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1)"""


@query(_CONTAM_SQL + " SELECT * FROM best")
def decontam_matches(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contamination(_documents(spark, d), table(spark, d, "benchmark"), key="doc_id", text="text")


@query(_CONTAM_SQL + " SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM best) GROUP BY source")
def decontam_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    found = decontam.contamination(docs, table(spark, d, "benchmark"), key="doc_id", text="text")
    return decontam.decontaminate(docs.select("doc_id", "source"), found, "doc_id").groupBy("source").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- partitions, quotas, budgets


@query(f"SELECT seq_id, entry_point, {L.partition_of('instruction', 'output')} AS part FROM raw_opencoder")
def partition_assign(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_opencoder").select("seq_id", "entry_point", splits.partition_of("instruction", "output").alias("part"))


@query(f"SELECT {L.partition_of('text', chr(39) * 2)} AS part, count(*) AS n FROM documents GROUP BY 1")
def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).groupBy(splits.partition_of("text", F.lit("")).alias("part")).agg(F.count("*").alias("n"))


@query("""
    WITH c AS (SELECT count(*) AS n FROM documents), s AS (SELECT n, greatest(1, round_even(n * 0.05, 0)::BIGINT) AS v FROM c)
    SELECT unnest(['train', 'validation', 'test']) AS split, unnest([n - 2 * v, v, v]) AS n FROM s""")
def exact_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return splits.exact_split(_documents(spark, d).select("doc_id"), "doc_id").groupBy("split").agg(F.count("*").alias("n"))


QUOTAS = {"ridge-crawl": 60, "lantern-wiki": 40, "pebble-forum": 25, "quill-papers": 15}
_PLACES = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(QUOTAS)) + " END"
_LIMITS = "CASE source " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in QUOTAS.items()) + " END"
_INTAKE_SQL = f"""
    WITH s AS (SELECT doc_id, source, {_PLACES} AS place, {_LIMITS} AS quota, CASE WHEN length({L.strip("text")}) < 300 THEN 'quality'
            WHEN doc_id <> min(doc_id) OVER (PARTITION BY sha256({L.squeeze("text")})) THEN 'duplicate' END AS status FROM documents),
    b AS (SELECT *, coalesce(sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM s WHERE quota IS NOT NULL),
    o AS (SELECT *, CASE WHEN prior < quota THEN coalesce(status, 'accepted') END AS outcome FROM b)"""


def _document_intake(spark: SparkSession, d: str) -> DataFrame:
    docs = dedup.exact_duplicates(_documents(spark, d), "text", "doc_id")
    status = F.when(F.length(X.strip("text")) < 300, "quality").when(F.col("first_id") != F.col("doc_id"), "duplicate")
    rows = materialize(docs.select("doc_id", "source", status.alias("status")), "status")
    return splits.intake(rows, QUOTAS, source="source", order="doc_id")


@query(_INTAKE_SQL + " SELECT doc_id, source, CASE WHEN outcome = 'accepted' THEN row_number() OVER (PARTITION BY outcome ORDER BY prior, place) END AS position, outcome FROM o")
def round_robin_order(spark: SparkSession, d: str) -> DataFrame:
    return _document_intake(spark, d).select("doc_id", "source", "position", "outcome")


@query(_INTAKE_SQL + f""", q AS (SELECT unnest({list(QUOTAS)}) AS source, unnest({list(QUOTAS.values())}) AS target)
    SELECT q.source, target::BIGINT AS target, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'quality') AS rejected_quality,
        count(*) FILTER (outcome = 'contamination') AS rejected_contamination, count(*) FILTER (outcome = 'duplicate') AS rejected_duplicate, 0::BIGINT AS rejected_too_long,
        CASE WHEN sum(count(*) FILTER (outcome = 'accepted')) OVER () > 0 THEN round_even(count(*) FILTER (outcome = 'accepted') * 100.0::DOUBLE / sum(count(*) FILTER (outcome = 'accepted')) OVER (), 2) ELSE 0.0 END AS actual_pct
    FROM q LEFT JOIN o ON q.source = o.source GROUP BY q.source, target""")
def quota_mixture_summary(spark: SparkSession, d: str) -> DataFrame:
    return splits.intake_summary(_document_intake(spark, d), QUOTAS, source="source")


_CAPS = {"ridge-crawl": 0.45, "lantern-wiki": 0.25, "pebble-forum": 0.2, "quill-papers": 0.1}
_CAP_SQL = " ".join(f"WHEN part = '{p}' AND source = '{s}' THEN {max(5, int(t * w))}" for p, t in (("validation", 60), ("test", 40)) for s, w in _CAPS.items())


@query(f"""
    WITH p AS (SELECT doc_id, source, {L.partition_of("text", chr(39) * 2)} AS part FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY doc_id) AS k, CASE {_CAP_SQL} END AS cap FROM p)
    SELECT doc_id, source, part FROM r WHERE k <= cap""")
def finite_eval_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(_documents(spark, d).select("doc_id", "source", splits.partition_of("text", F.lit("")).alias("part")), "parts")
    return splits.capped_per_source(rows, "source", "part", "doc_id", {"validation": 60, "test": 40}, _CAPS)


@query(f"""
    WITH r AS (SELECT doc_id, coalesce(sum(len({L.words("text")})) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM documents)
    SELECT doc_id, prior FROM r WHERE prior < 50000""")
def token_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return files.word_budget(_documents(spark, d), "text", "doc_id", 50_000).select("doc_id", "prior")


@query(f"""
    WITH r AS (SELECT doc_id, coalesce(sum(strlen(text) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM documents WHERE {L.strip("text")} <> '')
    SELECT doc_id, prior FROM r WHERE prior < 500000""")
def byte_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return files.byte_budget(_documents(spark, d), "text", "doc_id", 500_000).select("doc_id", "prior")


@query(f"""
    WITH w AS (SELECT doc_id, len({L.words("text")}) AS n FROM documents), r AS (SELECT doc_id, coalesce(sum(least(n, 4000)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM w WHERE n >= 100)
    SELECT doc_id, prior < 40000 AS held FROM r""")
def held_out_window(spark: SparkSession, d: str) -> DataFrame:
    return splits.held_out_window(_documents(spark, d), "doc_id", X.word_count("text")).select("doc_id", "held")


@query("SELECT doc_id, left(text, 1000) AS preview FROM documents ORDER BY doc_id LIMIT 5")
def document_preview(spark: SparkSession, d: str) -> DataFrame:
    """Five rows are the feature: a look at the first documents."""
    return files.preview(_documents(spark, d), "text", "doc_id")


def _all_pairs(spark: SparkSession, d: str, *, disjoint: bool) -> DataFrame:
    """The four sources as pairs with their source's name, a number that orders them within it, and a key.

    The second coding set has no table: the coding table in its layout stands for it. If ``disjoint``, each of its texts
    goes to one of the two by a hash, else both have the whole table.
    """
    coding = table(spark, d, "raw_opencoder")
    half = F.md5(F.concat_ws("::", X.strip("instruction"), X.strip("output"))) < "8"
    first, second = (coding.where(half), coding.where(~half)) if disjoint else (coding, coding)
    parts = []
    for name, made in (
        ("opencoder", normalize.normalize_opencoder(first, drop=False)),
        ("bigcode", normalize.normalize_bigcode(_as_bigcode(second), drop=False)),
        ("smoltalk", normalize.normalize_smoltalk(table(spark, d, "raw_smoltalk"), drop=False)),
        ("cybersecurity", normalize.normalize_cybersecurity(_records(spark, d), drop=False)),
    ):
        parts.append(pipelines.pairs_of(made).withColumn("source", F.lit(name)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # The sets bring no order of their own: a content hash gives one, and repeated rows are told apart by their count.
    keyed = union.groupBy("source", "id", "instruction", "response").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.expr("sequence(1, cast(n as int))")))
    digest = F.md5(F.concat_ws("\x1f", "source", "id", "instruction", "response", F.col("copy").cast("string")))
    number = lambda n: F.conv(F.substring(digest, 1, n), 16, 10).cast("long")
    return materialize(keyed.select("source", "id", "instruction", "response", number(13).alias("seq"), number(15).alias("row")), "pairs")


def _pairs_sql(disjoint: bool) -> str:
    half = lambda test: f" WHERE md5(i || '::' || r) {test} '8'" if disjoint else ""
    return f"""
    oc AS (SELECT *, {L.strip("instruction")} AS i, {L.strip("output")} AS r FROM raw_opencoder), sm AS (SELECT *, coalesce({L.contents("messages", "user")}[1], '') AS i, coalesce({L.contents("messages", "assistant")}[1], '') AS r FROM raw_smoltalk),
    cy AS (SELECT *, coalesce({L.contents("messages", "user")}[1], '') AS i, coalesce({L.contents("messages", "assistant")}[1], '') AS r FROM raw_seed_records),
    u AS (SELECT 'opencoder' AS source, 0 AS place, coalesce('opencoder_' || seq_id, {L.content_id("opencoder", "i", "r")}) AS id, i, r FROM oc{half("<")}
        UNION ALL SELECT 'bigcode', 1, coalesce('bigcode_' || seq_id, 'bigcode_' || md5(code), {L.content_id("bigcode", "i", "r")}), i, r FROM oc{half(">=")}
        UNION ALL SELECT 'smoltalk', 2, {L.content_id("smoltalk", "i", "r")}, CASE WHEN len(messages) >= 2 THEN i ELSE '' END, CASE WHEN len(messages) >= 2 THEN r ELSE '' END FROM sm
        UNION ALL SELECT 'cybersecurity', 3, coalesce(nullif(id, ''), {L.content_id("cyber", "i", "r")}), i, r FROM cy),
    un AS (SELECT *, row_number() OVER (PARTITION BY source, id, i, r) AS copy FROM u),
    ud AS (SELECT *, md5(source || chr(31) || id || chr(31) || i || chr(31) || r || chr(31) || copy) AS digest, {L.words("r")} AS rw FROM un),
    pr AS (SELECT source, place, id, i, r, ('0x' || digest[1:13])::BIGINT AS seq, ('0x' || digest[1:15])::BIGINT AS row, {L.pair_reason("i", "r", "rw")} AS bad, {L.partition_of("i", "r")} AS part FROM ud)"""


_TARGETS_SQL = "CASE source WHEN 'opencoder' THEN 450 WHEN 'bigcode' THEN 250 WHEN 'smoltalk' THEN 200 ELSE 100 END"
_STREAM_SQL = f"""
    WITH {_pairs_sql(True)}, good AS (SELECT * FROM pr WHERE bad IS NULL), {L.contaminated("good", "row", "i")},
    passed AS (SELECT row, row_number() OVER (PARTITION BY sha256(i || '::' || r) ORDER BY place, seq, row) AS k FROM good WHERE row NOT IN (SELECT id FROM hit)),
    st AS (SELECT source, place, id, seq, CASE WHEN bad IS NOT NULL THEN 'quality' WHEN row IN (SELECT id FROM hit) THEN 'contamination' WHEN k > 1 THEN 'duplicate' WHEN part <> 'train' THEN 'partition' END AS status
        FROM pr LEFT JOIN passed USING (row)),
    so AS (SELECT *, {_TARGETS_SQL} AS quota, coalesce(sum((status IS NULL)::INT) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM st),
    o AS (SELECT *, CASE WHEN prior < quota THEN coalesce(status, 'accepted') END AS outcome FROM so)"""


@query(_STREAM_SQL + " SELECT source, id, outcome, CASE WHEN outcome = 'accepted' THEN row_number() OVER (PARTITION BY outcome ORDER BY prior, place) END AS position FROM o")
def stream_mixture(spark: SparkSession, d: str) -> DataFrame:
    quotas = splits.quota_targets(1000, pipelines.SHARES)
    return pipelines.stream_mixture(_all_pairs(spark, d, disjoint=True), table(spark, d, "benchmark"), quotas).select("source", "id", "outcome", "position")


@query(_STREAM_SQL + """, q AS (SELECT unnest(['opencoder', 'bigcode', 'smoltalk', 'cybersecurity']) AS source, unnest([450, 250, 200, 100])::BIGINT AS target)
    SELECT q.source, target, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'quality') AS rejected_quality, count(*) FILTER (outcome = 'contamination') AS rejected_contamination,
        count(*) FILTER (outcome = 'duplicate') AS rejected_duplicate, 0::BIGINT AS rejected_too_long,
        CASE WHEN sum(count(*) FILTER (outcome = 'accepted')) OVER () > 0 THEN round_even(count(*) FILTER (outcome = 'accepted') * 100.0::DOUBLE / sum(count(*) FILTER (outcome = 'accepted')) OVER (), 2) ELSE 0.0 END AS actual_pct
    FROM q LEFT JOIN o ON q.source = o.source GROUP BY q.source, target""")
def stream_mixture_summary(spark: SparkSession, d: str) -> DataFrame:
    quotas = splits.quota_targets(1000, pipelines.SHARES)
    return splits.intake_summary(pipelines.stream_mixture(_all_pairs(spark, d, disjoint=True), table(spark, d, "benchmark"), quotas), quotas, source="source")


@query(f"""
    WITH {_pairs_sql(False)}, good AS (SELECT * FROM pr WHERE bad IS NULL), {L.contaminated("good", "row", "i")},
    rk AS (SELECT source, id, part, row_number() OVER (PARTITION BY source, part ORDER BY seq) AS k FROM good WHERE row NOT IN (SELECT id FROM hit))
    SELECT source, id, part AS partition FROM rk WHERE part <> 'train' AND k <= greatest(5, (CASE part WHEN 'validation' THEN 600 ELSE 400 END * ({_TARGETS_SQL}) // 1000))""")
def finite_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.finite_evaluation(_all_pairs(spark, d, disjoint=False), table(spark, d, "benchmark")).select("source", "id", "partition")


@query(f"""
    WITH p AS (SELECT *, {L.words("r")} AS w FROM (SELECT {L.strip("instruction")} AS i, {L.strip("output")} AS r FROM raw_opencoder)), good AS (SELECT DISTINCT i, r FROM p WHERE {L.pair_reason("i", "r", "w")} IS NULL),
    keyed AS (SELECT *, row_number() OVER () AS row FROM good), {L.contaminated("keyed", "row", "i")}
    SELECT sha256(i || '::' || r) AS content_hash, {L.partition_of("i", "r")} AS partition FROM keyed WHERE row NOT IN (SELECT id FROM hit)""")
def incremental_intake(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the coding set's files, run until all is taken in, and what it wrote."""
    raw = table(spark, d, "raw_opencoder")
    at = f"{shared_root(spark).rstrip('/')}/intake-{uuid.uuid4().hex}"
    stream = streaming.read_stream(spark, f"{d}/raw_opencoder.parquet", raw.schema)
    bench = table(spark, d, "benchmark").select("item_id", "text")
    done = streaming.accept(stream.select("instruction", F.col("output").alias("response")), bench)
    streaming.run_to(done, at + "/out", at + "/state")
    return spark.read.parquet(at + "/out").select("content_hash", "partition")


# ---------------------------------------------------------------- tokens


@query(f"""
    WITH t AS (SELECT row_id, m.role AS role, len({L.words("m.content")}) AS n FROM {_MESSAGES})
    SELECT row_id, sum(n + 2)::BIGINT AS n_tokens, sum(CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END)::BIGINT AS n_labels FROM t GROUP BY row_id""")
def assistant_mask(spark: SparkSession, d: str) -> DataFrame:
    masked = tokens.assistant_mask(_records(spark, d).where(F.size("messages") > 0))
    return masked.select("row_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("labels", lambda x: x.isNotNull())).cast("long").alias("n_labels"))


def _word_lengths(spark: SparkSession, d: str) -> DataFrame:
    return materialize(_documents(spark, d).select("doc_id", F.transform(X.words("text"), lambda w: F.length(w)).alias("ids")), "ids")


def _blocks_sql(length: int, stride: int) -> str:
    again = f" UNION ALL SELECT pos, t, pos // {stride} - 1 FROM n WHERE pos % {stride} = 0 AND pos > 0" if stride == length else ""
    return f"""
    WITH w AS (SELECT doc_id, list_concat(list_transform({L.words("text")}, lambda x: length(x)), [3]) AS ids FROM documents), u AS (SELECT doc_id, unnest(ids) AS t, generate_subscripts(ids, 1) AS i FROM w),
    n AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, t FROM u), b AS (SELECT pos, t, pos // {stride} AS block FROM n{again})
    SELECT block, arg_min(t, pos) AS first, arg_max(t, pos) AS last, sum(t)::BIGINT AS total FROM b GROUP BY block HAVING count(*) = {length + 1}"""


def _block_sums(made: DataFrame) -> DataFrame:
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("block", F.col("tokens")[0].alias("first"), F.element_at("tokens", -1).alias("last"), total.alias("total"))


@query(_blocks_sql(128, 128))
def packed_blocks_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _block_sums(tokens.blocks(tokens.token_stream(_word_lengths(spark, d), "ids", "doc_id"), "ids", 128))


@query(_blocks_sql(128, 129))
def packed_blocks_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _block_sums(tokens.blocks(tokens.token_stream(_word_lengths(spark, d), "ids", "doc_id"), "ids", 128, overlap=False))


@query(f"SELECT 'documents' AS source, 16000 AS vocab_size, 'uint16' AS dtype, 3 AS eos_token_id, count(*) AS documents, sum(len({L.words('text')}) + 1)::BIGINT AS tokens FROM documents")
def token_manifest(spark: SparkSession, d: str) -> DataFrame:
    stream = tokens.token_stream(_word_lengths(spark, d), "ids", "doc_id")
    return tokens.manifest(stream, "ids", source="documents", vocabulary=16_000)


@query(f"""
    WITH w AS (SELECT doc_id, doc_id // 8 AS batch, len({L.words("text")}) AS n FROM documents), m AS (SELECT *, ceil(max(n) OVER (PARTITION BY batch) / 8.0)::BIGINT * 8 AS width FROM w)
    SELECT doc_id, width, n::BIGINT AS n_real, (width - n)::BIGINT AS n_ignored FROM m""")
def dynamic_pad(spark: SparkSession, d: str) -> DataFrame:
    ids = tokens.word_ids("text")
    rows = _documents(spark, d).select("doc_id", F.expr("doc_id div 8").alias("batch"), ids.alias("input_ids"), ids.alias("labels"))
    done = tokens.dynamic_pad(rows, "batch")
    ones = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", F.size("input_ids").cast("long").alias("width"), ones.alias("n_real"), F.size(F.filter("labels", lambda x: x == tokens.IGNORE)).cast("long").alias("n_ignored"))


@query(f"""
    WITH w AS (SELECT doc_id, list_concat(list_transform({L.words("text")}, lambda x: length(x)), [3]) AS ids FROM documents), p AS (SELECT doc_id, len(ids) AS n, list_position(ids, 9) AS pos FROM w)
    SELECT doc_id, n::BIGINT AS n_tokens, (n - pos + 1)::BIGINT AS n_loss FROM p WHERE pos > 0 AND n BETWEEN 3 AND 300""")
def marker_mask(spark: SparkSession, d: str) -> DataFrame:
    done = tokens.marker_mask(_word_lengths(spark, d), "ids", 9)
    return done.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"))


@query(f"""
    WITH RECURSIVE w AS (SELECT doc_id, doc_id // 4096 AS shard, list_transform({L.words("text")}, lambda x: length(x)) AS ids FROM documents),
    c AS (SELECT shard, doc_id, o, ids[o + 1:o + 512] AS piece FROM (SELECT *, unnest(range(0, len(ids), 512)) AS o FROM w)), p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id, o) AS i FROM c),
    r(shard, i, win, fill) AS (SELECT shard, i, 0::BIGINT, len(piece) FROM p WHERE i = 1
        UNION ALL SELECT p.shard, p.i, CASE WHEN r.fill + len(p.piece) > 512 THEN r.win + 1 ELSE r.win END, CASE WHEN r.fill + len(p.piece) > 512 THEN len(p.piece) ELSE r.fill + len(p.piece) END
        FROM r JOIN p ON p.shard = r.shard AND p.i = r.i + 1),
    g AS (SELECT r.shard, win, flatten(list(piece ORDER BY r.i)) AS t, count(*) AS n FROM r JOIN p ON p.shard = r.shard AND p.i = r.i GROUP BY r.shard, win)
    SELECT shard, win AS window, list_concat(t, list_transform(range(0, 512 - len(t)), lambda x: 0)) AS tokens, n AS n_examples FROM g""")
def greedy_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _word_lengths(spark, d).withColumn("shard", F.expr("doc_id div 4096"))
    return tokens.greedy_windows(rows, "ids", ["doc_id"], "shard", 512, split=True)


def _row_sql(name: str, where: str, width: int) -> str:
    return f"""{name}_all AS (SELECT t, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM (SELECT doc_id, unnest(ids) AS t, generate_subscripts(ids, 1) AS i FROM
            (SELECT doc_id, list_concat(list_transform({L.words("text")}, lambda x: length(x)), [3]) AS ids FROM documents WHERE {where}))),
        {name} AS (SELECT pos // {width} AS row, list(t ORDER BY pos) AS tokens FROM {name}_all GROUP BY 1 HAVING count(*) = {width})"""


@query(f"WITH {_row_sql('a', chr(32).join(['source', '<>', L.quoted('lantern-wiki')]), 461)}, {_row_sql('b', 'source = ' + L.quoted('lantern-wiki'), 52)} SELECT row, list_concat(a.tokens, b.tokens) AS tokens FROM a JOIN b USING (row)")
def mixed_token_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = materialize(_documents(spark, d).select("doc_id", "source", F.transform(X.words("text"), lambda w: F.length(w)).alias("ids")), "ids")
    a, b = docs.where("source = 'lantern-wiki'"), docs.where("source <> 'lantern-wiki'")
    return tokens.mixed_rows(tokens.token_stream(b, "ids", "doc_id"), tokens.token_stream(a, "ids", "doc_id"), "ids", width=513, share=0.9)


@query(f"""
    WITH w AS (SELECT doc_id, list_transform({L.words("text")}, lambda x: length(x)) AS ids, doc_id * 7919 % 1000 AS shift FROM documents)
    SELECT doc_id, CASE WHEN len(ids) > 0 THEN list_transform(range(0, 64), lambda j: ids[(shift + j) % len(ids) + 1]) END AS tokens FROM w""")
def repeated_crops(spark: SparkSession, d: str) -> DataFrame:
    return _word_lengths(spark, d).select("doc_id", tokens.repeat_and_crop(F.col("ids"), 64, F.col("doc_id") * 7919 % 1000).alias("tokens"))


# ---------------------------------------------------------------- scores


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies held against questions: the data has no model's responses, so the first reply of each record stands for
    one, and record and question meet by number."""
    q = table(spark, d, "eval_questions").withColumn("n", F.expr("cast(regexp_extract(id, '([0-9]+)$', 1) as int)"))
    q = q.groupBy("n").agg(F.min_by(F.struct("id", "category", "prompt", "required_concepts", "forbidden_concepts"), "id").alias("q"))
    r = _records(spark, d).select("row_id", F.expr("cast(row_id % 60 as int)").alias("k"), normalize.first_content(F.col("messages"), "assistant").alias("response"))
    return r.join(q, F.col("k") == F.col("n")).select("row_id", "response", "q.category", "q.prompt", "q.required_concepts", "q.forbidden_concepts")


_ANSWER_SQL = f"""
    WITH q AS (SELECT n, arg_min(category, id) AS category, arg_min(prompt, id) AS prompt, arg_min(required_concepts, id) AS req, arg_min(forbidden_concepts, id) AS forb
            FROM (SELECT *, regexp_extract(id, '([0-9]+)$', 1)::INT AS n FROM eval_questions) GROUP BY n),
    a AS (SELECT row_id, coalesce({L.contents("messages", "assistant")}[1], '') AS response, category, prompt, coalesce(req, []) AS req, coalesce(forb, []) AS forb
        FROM (SELECT row_id, messages, (row_id % 60)::INT AS k FROM raw_seed_records) JOIN q ON k = n)"""
_SCORED_SQL = """, m AS (SELECT *, len(list_filter(req, lambda c: contains(lower(response), lower(c)))) AS hit, len(list_filter(forb, lambda c: contains(lower(response), lower(c)))) AS bad FROM a),
    s AS (SELECT row_id, category, hit, bad, round_even(greatest(0.0, least(1.0, CASE WHEN len(req) > 0 THEN hit / len(req) ELSE 1.0 END - 0.5 * bad))::DOUBLE, 4) AS score FROM m)"""


@query(_ANSWER_SQL + _SCORED_SQL + " SELECT row_id, category, hit, bad, score FROM s")
def concept_scores(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.score_concepts(_answers(spark, d))
    return s.select("row_id", "category", F.size("matched_required").alias("hit"), F.size("matched_forbidden").alias("bad"), "score")


@query(_ANSWER_SQL + _SCORED_SQL + " SELECT category, count(*) AS n, round_even(avg(score), 4) AS mean_score, grouping(category) AS is_total FROM s GROUP BY ROLLUP (category)")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.category_means(evaluate.score_concepts(_answers(spark, d)))


_KEYED_SQL = f""", k AS (SELECT row_id, category, prompt, response, {L.words("response")} AS w, req FROM a),
    i AS (SELECT *, list_transform(req, lambda c: {L.has_word("array_to_string(w[1:8], ' ')", "c")}) AS near, list_transform(req, lambda c: {L.has_word("response", "c")}) AS hits FROM k),
    f AS (SELECT *, list_contains(near, true) AS strict, list_contains(hits, true) AS loose, NOT list_contains(hits, false) AS all_keywords,
        left(lower({L.strip("replace(string_split(prompt, chr(10))[-1], 'Assistant:', '')")}), 80) AS q, left(lower(response), 80) AS h, left(lower(prompt), 80) AS p FROM i),
    e AS (SELECT *, q <> '' AND h <> '' AND (starts_with(h, left(q, 40)) OR starts_with(h, 'user:')) AS echo, p <> '' AND h <> '' AND starts_with(h, p) AS echo_plain FROM f)"""


@query(_ANSWER_SQL + _KEYED_SQL + " SELECT row_id, strict, loose, all_keywords, echo, echo_plain FROM e")
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score_keywords(_answers(spark, d), answer="response", keywords="required_concepts").select("row_id", "strict", "loose", "all_keywords", "echo", "echo_plain")


@query(_ANSWER_SQL + _KEYED_SQL + " SELECT category, count(*) AS n, avg(strict::INT) AS strict_rate, avg(loose::INT) AS loose_rate, avg(echo::INT) AS echo_rate FROM e GROUP BY category")
def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.category_accuracy(evaluate.score_keywords(_answers(spark, d), answer="response", keywords="required_concepts"))


@query(_ANSWER_SQL + _KEYED_SQL + """, z AS MATERIALIZED (SELECT category, row_id % 2 = 0 AS wrapped, all_keywords AS c, strict AS s FROM e)
    SELECT category, wrapped, count(*) AS n, count(*) FILTER (c) AS correct, count(*) FILTER (s) AS strict, avg(c::INT) AS accuracy, grouping(category) AS is_total FROM z GROUP BY GROUPING SETS ((category, wrapped), (wrapped))""")
def prompt_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Every other row stands for a question that was put as a dialog."""
    scored = evaluate.score_keywords(_answers(spark, d), answer="response", keywords="required_concepts").withColumn("wrapped", F.col("row_id") % 2 == 0)
    return evaluate.prompt_accuracy(scored, "category", "wrapped", "all_keywords", "strict")


@query(_ANSWER_SQL + _KEYED_SQL + " SELECT avg(loose::INT) AS loose_rate FROM e")
def weighted_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.weighted_overall(category_accuracy(spark, d), "loose_rate")


@query(_ANSWER_SQL + _KEYED_SQL + f""", g AS (SELECT CASE WHEN len(req) > 0 THEN loose END AS topic, contains(response, 'User:') OR contains(response, 'Assistant:') AS drift,
        CASE WHEN len(w) > 0 THEN 1 - len(list_distinct(w)) / len(w) ELSE 1.0 END AS rep FROM e), {"p"}p AS (SELECT avg(strict::INT) AS strict, avg(loose::INT) AS loose FROM e),
    r AS (SELECT avg(topic::INT) AS topic, avg(drift::INT) AS drift, avg(rep) AS rep FROM g)
    SELECT strict, loose, topic, drift, round(rep, 6) AS rep, round(0.55::DOUBLE * strict + 0.15::DOUBLE * loose + 0.15::DOUBLE * topic + 0.10::DOUBLE * (1 - drift) + 0.05::DOUBLE * (1 - rep), 6) AS composite FROM pp, r""")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    made = evaluate.composite(evaluate.score_keywords(a, answer="response", keywords="required_concepts"), evaluate.score_generation(a, answer="response", topics="required_concepts"))
    return _rounded(made, "rep", "composite")


@query(_ANSWER_SQL + _SCORED_SQL + """, b AS (SELECT category, avg(score) AS before FROM s WHERE row_id // 60 % 2 = 0 GROUP BY category), c AS (SELECT category, avg(score) AS after FROM s WHERE row_id // 60 % 2 = 1 GROUP BY category)
    SELECT category, array_to_string(list_transform(string_split(replace(category, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, round(before, 6) AS before, round(after, 6) AS after,
        round(after - before, 6) AS delta, coalesce(printf('%.4f', before), 'N/A') AS before_text, coalesce(printf('%.4f', after), 'N/A') AS after_text,
        coalesce(CASE WHEN after > before THEN '+' ELSE '' END || printf('%.4f', after - before), 'N/A') AS delta_text FROM b FULL JOIN c USING (category)""")
def before_after_delta(spark: SparkSession, d: str) -> DataFrame:
    """Every other sixty rows stand for one of two models: each row is one answer of one of them."""
    s = evaluate.score_concepts(_answers(spark, d))
    mean = lambda k: s.where(F.expr("row_id div 60 % 2") == k).groupBy("category").agg(F.avg("score").alias("score"))
    return _rounded(evaluate.compare(mean(0), mean(1)).select("category", "title", "before", "after", "delta", "before_text", "after_text", "delta_text"), "before", "after", "delta")


_CODE_SQL = f"""
    WITH b AS (SELECT seq_id, entry_point, instruction, coalesce(output, '') AS t, 'def ' || entry_point AS start, regexp_extract_all(coalesce(output, ''), '(?si)```(?:python)?\\s*(.*?)\\s*```', 1) AS blocks, testcase FROM raw_opencoder WHERE entry_point IS NOT NULL),
    l AS (SELECT *, string_split(t, chr(10)) AS ls FROM b), f AS (SELECT *, list_position(list_transform(ls, lambda x: contains(x, start)), true) AS first FROM l),
    h AS (SELECT *, CASE WHEN first > 0 THEN ls[first:] END AS tail FROM f),
    e AS (SELECT *, list_position(list_transform(tail, lambda x: starts_with(x, '# ') OR starts_with(x, '## ') OR starts_with(x, 'Explanation:')), true) AS stop FROM h),
    c AS (SELECT *, CASE WHEN len(blocks) > 0 THEN coalesce(list_filter(blocks, lambda x: contains(x, start))[1], blocks[1]) WHEN first > 0 AND coalesce(stop, 0) <> 1
        THEN array_to_string(CASE WHEN stop > 0 THEN tail[1:stop - 1] ELSE tail END, chr(10)) ELSE {L.strip("t")} END AS code FROM e),
    g AS (SELECT seq_id, entry_point, testcase, code, CASE WHEN contains(code, start) THEN code ELSE instruction || chr(10) || code END AS generated_code FROM c)"""


@query(_CODE_SQL + " SELECT seq_id, entry_point, generated_code FROM g")
def extracted_code(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_opencoder").where("entry_point is not null")
    return evaluate.prepare_code(rows, "output", "entry_point", "instruction").select("seq_id", "entry_point", "generated_code")


@query(_CODE_SQL + ", k AS (SELECT contains(code, 'def ' || entry_point) AS ok FROM g) SELECT count(*) AS n_tasks, count(*) FILTER (ok) AS n_passed, round_even(avg(ok::INT) * 100.0::DOUBLE, 2) AS pass_at_1 FROM k")
def pass_at_1(spark: SparkSession, d: str) -> DataFrame:
    """Every task's output is run with its test. The SQL says what comes of it: all that define their function pass."""
    rows = table(spark, d, "raw_opencoder").where("entry_point is not null").repartition(spark.sparkContext.defaultParallelism)
    code = evaluate.prepare_code(rows, "output", "entry_point", "instruction")
    return evaluate.pass_at_1(S.run_code(code.select("generated_code", "testcase"), "generated_code", "testcase", trusted=True, timeout=20.0))


@query(f"""
    WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace({L.strip("text")}, '\\.+$', ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '\\p{{Nd}}+')) AS n FROM documents)
    SELECT doc_id, n[len(n)] AS last_number FROM n""")
def last_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", S.last_number("text").alias("last_number"))


@query(f"""
    WITH n AS (SELECT doc_id, text, doc_id % 100 AS e FROM documents), c AS (SELECT doc_id, coalesce(lang, 'none') AS lang, contains({L.text("text")}, (doc_id % 100)::VARCHAR) AS correct FROM documents)
    SELECT lang AS category, count(*) AS n, count(*) FILTER (correct) AS correct, avg(correct::INT) AS accuracy, grouping(lang) AS is_total FROM c GROUP BY ROLLUP (lang)""")
def arithmetic_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    """The document stands for a continuation and its number for the expected result; a substring is enough."""
    rows = _documents(spark, d).select(F.coalesce("lang", F.lit("none")).alias("category"), S.number_correct("text", F.col("doc_id") % 100).alias("ok"))
    return evaluate.diagnostics(rows, "category", "ok")


_DIRECTIONS = {"east": S.EAST, "west": S.WEST}


@query("WITH e AS (SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'east' ELSE 'west' END AS expected, text FROM documents) SELECT doc_id, expected, CASE expected " + " ".join(f"WHEN '{k}' THEN " + " OR ".join(L.has_word("text", L.quoted(w)) for w in ws) for k, ws in _DIRECTIONS.items()) + " END AS correct FROM e")
def direction_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    e = F.when(F.col("doc_id") % 2 == 0, "east").otherwise("west")
    return _documents(spark, d).select("doc_id", e.alias("expected"), S.direction_correct("text", e).alias("correct"))


@query(f"""
    SELECT doc_id, contains({L.text("text")}, 'User:') OR contains({L.text("text")}, 'Assistant:') AS drift, contains(lower({L.text("text")}), 'running') AND NOT contains(lower({L.text("text")}), 'sleep') AS runs,
        array_to_string({L.words("text")}[1:8], ' ') AS first8, len({L.words("text")}) AS n_words FROM documents""")
def continuation_flags(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", X.drifts_to_dialog("text").alias("drift"), S.runs_while_asleep("text").alias("runs"), X.first_words("text").alias("first8"), X.word_count("text").alias("n_words"))


@query("SELECT lang, source AS candidate, n_chars FROM (SELECT lang, source, max(n_chars) AS n_chars FROM documents WHERE source IS NOT NULL GROUP BY lang, source) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, source) = 1")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).where("source is not null").groupBy("lang", "source").agg(F.max("n_chars").alias("n_chars"))
    return evaluate.best_candidate(rows, ["lang"], "source", "n_chars").select("lang", F.col("source").alias("candidate"), "n_chars")


@query("SELECT exp(least(20.0, avg(ln(1 + n_chars)))) AS perplexity FROM documents")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return stats.perplexity(_documents(spark, d).select(F.log1p("n_chars").alias("loss")), "loss")


# ---------------------------------------------------------------- lineage and generators


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    """A forest of checkpoints by the documents' numbers: every number descends from a third of it."""
    return _documents(spark, d).select(F.concat(F.lit("checkpoint-"), F.expr("doc_id div 3").cast("string")).alias("parent_checkpoint"), F.concat(F.lit("checkpoint-"), F.col("doc_id").cast("string")).alias("checkpoint_path"))


_LINEAGE_SQL = """
    WITH RECURSIVE e AS (SELECT DISTINCT 'checkpoint-' || (doc_id // 3) AS p, 'checkpoint-' || doc_id AS c FROM documents),
    top AS (SELECT DISTINCT p AS node FROM e WHERE p NOT IN (SELECT c FROM e)), r AS (SELECT node FROM top UNION ALL SELECT min(p) FROM e WHERE NOT EXISTS (SELECT * FROM top) HAVING min(p) IS NOT NULL)"""


@query(_LINEAGE_SQL + " SELECT node FROM r")
def lineage_roots(spark: SparkSession, d: str) -> DataFrame:
    return lineage.roots(_lineage(spark, d))


@query(_LINEAGE_SQL + """, t(node, root, depth, path) AS (SELECT node, node, 0, [node] FROM r UNION ALL SELECT e.c, root, depth + 1, list_append(path, e.c) FROM t JOIN e ON t.node = e.p WHERE NOT list_contains(path, e.c))
    SELECT node, root, depth, array_to_string(path, '>') AS path FROM t""")
def lineage_paths(spark: SparkSession, d: str) -> DataFrame:
    return lineage.paths(_lineage(spark, d)).withColumn("path", F.array_join("path", ">"))


@query("SELECT 'checkpoint-' || doc_id AS checkpoint_path, doc_id AS step FROM documents ORDER BY doc_id DESC LIMIT 3")
def latest_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Three are the feature: what is kept of all checkpoints."""
    return lineage.latest(_lineage(spark, d).select("checkpoint_path"), "checkpoint_path", keep=3)


@query("SELECT 'none' AS name WHERE false")
def generated_shared_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that training dialogs of both generators and the benchmark have in common: there are none."""
    trained = generate.dialogs(spark, 2000, generate.SEMANTIC).unionByName(generate.dialogs(spark, 2000, generate.BINDING, seed=20260813))
    return generate.shared_names(trained, generate.binding_benchmark(spark))


@query()
def semantic_dialogs(spark: SparkSession, d: str) -> DataFrame:
    return generate.dialogs(spark, 2000, generate.SEMANTIC, plain=0.35)


@query()
def binding_dialogs(spark: SparkSession, d: str) -> DataFrame:
    return generate.dialogs(spark, 2000, generate.BINDING, seed=20260813)


@query("SELECT unnest(['single_fact', 'multi_fact', 'distractor', 'relation_reversal', 'paraphrase', 'pronoun', 'multi_hop', 'sentence_order', 'entity_generalization', 'distractor_binding']) AS category, 60::BIGINT AS n")
def binding_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return generate.category_counts(generate.binding_benchmark(spark))


@query("SELECT unnest(['addition', 'subtraction']) AS kind, 500::BIGINT AS n")
def arithmetic_dialogs(spark: SparkSession, d: str) -> DataFrame:
    return generate.arithmetic(spark, 500).groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- signals and addresses


_LETTER, _MARK, _DIGIT = r"\p{L}", r"[^\p{L}\p{N}\s]", r"\p{N}"


def _share_sql(pattern: str) -> str:
    return f"CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '{pattern}')) / length(t) ELSE 0.0 END"


_SIGNALS_SQL = f"""
    WITH a AS (SELECT doc_id, {L.text("text")} AS t, {L.words("text")} AS w, list_filter(list_transform(string_split({L.text("text")}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
    s AS (SELECT doc_id, {_share_sql(_LETTER)} AS letter_ratio, {_share_sql(_MARK)} AS punctuation_ratio,
        {_share_sql(_DIGIT)} AS digit_ratio, CASE WHEN len(l) > 0 THEN 1.0::DOUBLE - len(list_distinct(l)) / len(l) ELSE 0.0 END AS repeated_line_ratio, {L.repetition(L.ngrams("w", 4))} AS repeated_ngram_ratio,
        CASE WHEN len(w) > 0 THEN len(regexp_extract_all(t, 'https?://')) / len(w) ELSE 0.0 END AS url_density,
        CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '```.*?```', '', 'gs'))) / length(t) ELSE 0.0 END AS code_ratio FROM a)"""


@query(_SIGNALS_SQL + " SELECT * FROM s")
def quality_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.signals(_documents(spark, d).select("doc_id", "text"), "text").drop("text")


@query(_SIGNALS_SQL + " SELECT doc_id, punctuation_ratio FROM s ORDER BY punctuation_ratio DESC, doc_id LIMIT 20")
def high_symbol_slice(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows are the feature: a slice to look at."""
    return signals.inspection_slice(quality_signals(spark, d), "punctuation_ratio", "doc_id", largest=True).select("doc_id", "punctuation_ratio")


_URL_SQL = """
    WITH u AS (SELECT doc_id, text, regexp_replace(trim(url), '#.*$', '') AS u FROM documents), p AS (SELECT doc_id, text, u,
        regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), '^www\\.|:(?:80|443)$', '', 'g') AS host,
        regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
        regexp_replace(regexp_replace(regexp_extract(u, '\\?(.*)$', 1), '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS q FROM u),
    c AS (SELECT doc_id, text, CASE WHEN u IS NOT NULL THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url FROM p)"""


@query(_URL_SQL + " SELECT doc_id, url FROM c")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", signals.canonical_url("url").alias("url"))


@query(_URL_SQL + f""", s AS (SELECT doc_id, url, {L.partition_of("text", chr(39) * 2)} AS part FROM c WHERE url <> ''), t AS (SELECT url, min(doc_id) AS train_key FROM s WHERE part = 'train' GROUP BY url)
    SELECT doc_id, url, train_key FROM s JOIN t USING (url) WHERE part <> 'train'""")
def shared_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", "url", splits.partition_of("text", F.lit("")).alias("part"))
    return signals.shared_addresses(rows, "url", "part", "doc_id")


@query(f"""
    WITH h AS (SELECT source, sum(len({L.words("text")}))::BIGINT AS tokens FROM documents GROUP BY source)
    SELECT m.source, target_share AS weight, target_share * 1000000 AS token_budget, coalesce(tokens, 0) AS tokens, coalesce(tokens, 0) / (target_share * 1000000) AS filled FROM mix_targets m LEFT JOIN h ON m.source = h.source""")
def mixture_table(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets").select("source", F.col("target_share").alias("weight"))
    return signals.mixture_table(_documents(spark, d), "source", X.word_count("text").cast("long"), targets, 1_000_000)


@query("SELECT coalesce(lang, 'unknown') AS value, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM documents GROUP BY 1")
def language_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_documents(spark, d), "lang")


# ---------------------------------------------------------------- what a corpus is like


@query(f"""
    WITH h AS (SELECT doc_id, list_transform({L.words("text")}, lambda w: ('0x' || md5(w)[1:15])::BIGINT) AS h FROM documents)
    SELECT doc_id, coalesce(list_sum(list_transform(range(0, 60), lambda b: CASE WHEN list_sum(list_transform(h, lambda x: CASE WHEN (x >> b) & 1 = 1 THEN 1 ELSE -1 END)) > 0 THEN 1::BIGINT << b ELSE 0::BIGINT END)), 0)::BIGINT AS simhash FROM h""")
def simhashes(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", signals.simhash("text").alias("simhash"))


@query(f"""
    WITH l AS (SELECT doc_id, i, line, CASE WHEN {L.strip("line")} <> '' THEN {L.squeeze("line")} END AS h FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
    c AS (SELECT h FROM l WHERE h IS NOT NULL GROUP BY h HAVING count(DISTINCT doc_id) >= 20), m AS (SELECT *, h IS NOT NULL AND h IN (SELECT h FROM c) AS gone FROM l)
    SELECT doc_id, count(*) FILTER (gone) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text FROM m GROUP BY doc_id""")
def boilerplate_stripped(spark: SparkSession, d: str) -> DataFrame:
    return signals.boilerplate(_documents(spark, d).where("text is not null"), "doc_id", "text").withColumn("text", F.md5("text"))


_RUNS = "list_distinct(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) ELSE [] END)"


@query(f"""
    WITH d AS (SELECT doc_id, unnest({_RUNS}) AS g FROM (SELECT doc_id, list_filter(string_split({L.form("text")}, ' '), lambda x: x <> '') AS w FROM documents)),
    b AS (SELECT item_id, unnest({_RUNS}) AS g FROM (SELECT item_id, list_filter(string_split({L.form("text")}, ' '), lambda x: x <> '') AS w FROM benchmark))
    SELECT doc_id, item_id AS bench_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY ALL""")
def ngram_contamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.ngram_matches(_documents(spark, d), table(spark, d, "benchmark"), key="doc_id", text="text")


@query(_URL_SQL.replace("SELECT doc_id, text, regexp_replace(trim(url)", "SELECT doc_id, text, source, lang, fetched_at, regexp_replace(trim(url)").replace("p AS (SELECT doc_id, text, u,", "p AS (SELECT doc_id, text, source, lang, fetched_at, u,").replace("c AS (SELECT doc_id, text,", "c AS (SELECT doc_id, text, source, lang, fetched_at,") + """
    SELECT nullif(regexp_replace(lower(coalesce(source, '')), '[^\\p{L}\\p{N}]', '', 'g'), '') AS source, count(DISTINCT source) AS names, count(*) AS n_docs, coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes,
        count(DISTINCT nullif(regexp_extract(url, '^[^/?]*', 0), '')) AS n_hosts, count(DISTINCT lower(trim(lang))) AS n_langs, epoch_us(min(fetched_at)) AS first_fetched, epoch_us(max(fetched_at)) AS last_fetched FROM c GROUP BY 1""")
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    made = signals.source_registry(_documents(spark, d), "source", "text", "url", "fetched_at", "lang")
    return made.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_fetched", "last_fetched")})


@query("SELECT doc_id, n FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) ORDER BY n DESC, doc_id LIMIT 20")
def longest_slice(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows are the feature: a slice to look at."""
    return signals.inspection_slice(_documents(spark, d).select("doc_id", F.length("text").cast("long").alias("n")), "n", "doc_id", largest=True)


@query("SELECT doc_id, n FROM (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL) ORDER BY n, doc_id LIMIT 20")
def shortest_slice(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows are the feature: a slice to look at."""
    return signals.inspection_slice(_documents(spark, d).select("doc_id", F.length("text").cast("long").alias("n")), "n", "doc_id", largest=False)


@query(f"""
    WITH m AS (SELECT doc_id, {L.text("text")} AS t FROM documents), s AS (SELECT doc_id, CASE WHEN length(t) > 0 THEN (length(t) - length(regexp_replace(t, '<[A-Za-z/!][^<>]*>', '', 'g'))) / length(t) ELSE 0.0 END AS markup FROM m)
    SELECT doc_id, markup FROM s ORDER BY markup DESC, doc_id LIMIT 20""")
def markup_slice(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rows are the feature: a slice to look at."""
    return signals.inspection_slice(_documents(spark, d).select("doc_id", signals.markup_share("text").alias("markup")), "markup", "doc_id", largest=True)


@query(f"""
    WITH g AS (SELECT regexp_replace(lower(coalesce(source, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS g FROM documents), p AS (SELECT g, {L.partition_of("g", chr(39) * 2)} AS part FROM g)
    SELECT g AS name, part, count(*) AS n FROM p GROUP BY ALL""")
def group_partitions(spark: SparkSession, d: str) -> DataFrame:
    """All documents of one source, in any spelling, in one partition."""
    name = F.regexp_replace(F.lower(X.text_of("source")), r"[^\p{L}\p{N}]", "")
    return _documents(spark, d).select(name.alias("name")).withColumn("part", splits.partition_of("name", F.lit(""))).groupBy("name", "part").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE len(" + L.words("text") + ") >= 2")
def short_documents_dropped(spark: SparkSession, d: str) -> DataFrame:
    return tokens.drop_short(_documents(spark, d).withColumn("ids", X.words("text")), "ids").select("doc_id", "lang")


@query(f"SELECT seq_id, entry_point, 'User: ' || {L.text('instruction')} || chr(10) || 'Assistant: ' || {L.text('output')} AS wrapped, {L.text('instruction')} || chr(10) || 'Assistant: ' || {L.text('output')} AS plain FROM raw_opencoder")
def wrapped_dialogs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_opencoder")
    return rows.select("seq_id", "entry_point", normalize.wrap_dialog("instruction", "output").alias("wrapped"), normalize.wrap_dialog("instruction", "output", plain=True).alias("plain"))


@query(f"SELECT doc_id, contains(lower(coalesce({L.words('text')}[1], '')), lower(coalesce(lang, 'en'))) AS follows FROM documents")
def instruction_first_word(spark: SparkSession, d: str) -> DataFrame:
    """The label stands for the word that an answer was to begin with."""
    return _documents(spark, d).select("doc_id", S.first_word_matches("text", F.coalesce("lang", F.lit("en"))).alias("follows"))


@query(f"SELECT sum(len({L.words('text')})) / sum((1 + doc_id % 7)::DOUBLE) AS tokens_per_second FROM documents")
def token_throughput(spark: SparkSession, d: str) -> DataFrame:
    """The documents' numbers stand for the seconds that their words took."""
    return stats.throughput(_documents(spark, d).select(X.word_count("text").alias("n"), (1 + F.col("doc_id") % 7).cast("double").alias("s")), "n", "s")


@query("SELECT 'exp_' || doc_id AS id, source AS name, n_chars AS steps, 'checkpoint-' || doc_id AS checkpoint FROM documents")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """The documents stand for experiments."""
    none = lambda *names: [F.lit(None).cast("double").alias(n) for n in names]
    rows = _documents(spark, d).select(
        F.concat(F.lit("exp_"), F.col("doc_id")).alias("experiment_id"), F.col("source").alias("name"), F.col("fetched_at").alias("timestamp"), F.lit(None).cast("string").alias("parent_checkpoint"), F.col("n_chars").alias("training_steps"),
        F.concat(F.lit("checkpoint-"), F.col("doc_id")).alias("checkpoint_path"), *none("tokens_processed", "learning_rate", "batch_size", "training_loss", "validation_loss", "evaluation_scores"),
    )
    return lineage.summary(rows).select("id", "name", "steps", "checkpoint")


def _public_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_documents(spark, d).select("doc_id", "lang", "text"), "text", tokens.PUBLIC)


@query()
def encoded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of a public tokenizer; a test holds them against the tokenizer itself."""
    return _public_tokens(spark, d).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids"))


@query()
def public_tokenizer_report(spark: SparkSession, d: str) -> DataFrame:
    """Characters a token and tokens a word of a public tokenizer, which knows every byte: nothing is unknown to it."""
    return stats.tokenizer_report(_public_tokens(spark, d).select("text", F.size("ids").alias("n")), "text", "n")
