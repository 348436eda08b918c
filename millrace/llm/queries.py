"""Queries of this package's operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.leaks import leak_report, leaked_pairs, leaks, scrub
from millrace.llm.mixing import Mixture, mix
from millrace.llm.neardup import similar_conversations
from millrace.llm.packing import fill_report, pack_conversations, packing_faults
from millrace.llm.pairs import broken_pairs
from millrace.llm.spam import line_kinds, spam_pages
from millrace.llm.splits import grouped_split, split_report, splits_by_tie, tied_values
from millrace.llm.tokens import token_budget
from millrace.llm.words import LanguageModel, fit_languages, language_report
from millrace.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def _languages(spark: SparkSession, sf_dir: str) -> LanguageModel:
    """The records name no language; the documents do."""
    return fit_languages(table(spark, sf_dir, "documents"))


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(table(spark, sf_dir, "raw_seed_records"), languages=_languages(spark, sf_dir))


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model held against the labels of all documents, of which some are wrong."""
    return language_report(table(spark, sf_dir, "documents"), _languages(spark, sf_dir))


def _capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    """The plan table has a row per permitted capacity."""
    return [r[0] for r in table(spark, sf_dir, "pack_plan").where("capacity > 0").select("capacity").distinct().orderBy("capacity").collect()]


def p2_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_conversations(table(spark, sf_dir, "raw_seed_records"), _capacities(spark, sf_dir))


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p2_packed(spark, sf_dir))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every record whether p2_packed keeps what it promises; the SQL says that it does."""
    return packing_faults(materialize(p2_packed(spark, sf_dir), "packed"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tied_values(table(spark, sf_dir, "raw_seed_records"))


def _shares(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    """The plan table has a row per split."""
    rows = table(spark, sf_dir, "split_plan").where("split_name is not null").groupBy("split_name").agg({"share": "max"}).collect()
    return sorted(((r[0], r[1]) for r in rows if r[1]), key=lambda r: (-r[1], r[0]))


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split(table(spark, sf_dir, "raw_seed_records"), _shares(spark, sf_dir))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_report(p3_split(spark, sf_dir), _shares(spark, sf_dir))


def p3_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many splits p3_split puts the records of each source and case."""
    return splits_by_tie(table(spark, sf_dir, "raw_seed_records"), p3_split(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_conversations(table(spark, sf_dir, "raw_seed_records")).pairs().toDF("row_id_a", "row_id_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_conversations(table(spark, sf_dir, "raw_seed_records")).groups().withColumnRenamed("id", "row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "raw_seed_records"), languages=_languages(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def p6_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return scrub(docs, materialize(leaks(docs, table(spark, sf_dir, "benchmark")), "leaks"))


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every leaking document how much leaked, and whether p6_scrubbed leaves it out."""
    return leak_report(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    """The target table has a row per source."""
    targets = table(spark, sf_dir, "mix_targets").where("source is not null").orderBy("source").select("source", "target_share", "max_repeats").collect()
    return mix(table(spark, sf_dir, "documents"), [tuple(r) for r in targets])


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).rows


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report()


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target source whether p7_mixture keeps what it promises; the SQL says that it does."""
    return _mixture(spark, sf_dir).kept()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


def p8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_kinds(table(spark, sf_dir, "documents"))


_ALL = (p1_token_budget, p1_languages, p2_packed, p2_fill, p2_kept, p3_found, p3_split, p3_shares, p3_together, p4_found, p4_groups, p5_found, p6_found, p6_scrubbed, p6_coverage, p7_mixture, p7_shares, p7_kept, p8_found, p8_lines)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _key(col: str) -> str:
    return f"regexp_replace(lower(translate({col}, '{_WIDE}', '{_PLAIN}')), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"


_P4 = """
        WITH RECURSIVE t AS (
            SELECT row_id, list_filter(regexp_extract_all(lower(array_to_string(list_transform(list_filter(coalesce(messages, []),
                lambda m: coalesce(lower(trim(m.role)), '') <> 'system'), lambda m: coalesce(m.content, '')), ' ')), '[\\p{L}\\p{N}]+'), lambda w: w <> '') AS w
            FROM raw_seed_records),
        s AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t),
        n AS (SELECT row_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.row_id < b.row_id GROUP BY 1, 2),
        f AS (SELECT row_id_a, row_id_b FROM p JOIN n x ON x.row_id = row_id_a JOIN n y ON y.row_id = row_id_b WHERE k >= 0.6 * (x.n + y.n - k))"""

ORACLE = {
    "p2_kept": "SELECT row_id, true AS whole, true AS fits FROM raw_seed_records",
    "p3_together": f"""
        WITH t AS (SELECT 'source' AS kind, {_key("source")} AS name FROM raw_seed_records WHERE source IS NOT NULL AND length(regexp_replace(source, '[\\s\\p{{Z}}]', '', 'g')) > 0
            UNION ALL SELECT 'case', {_key("category")} FROM raw_seed_records WHERE regexp_matches({_key("category")}, '^case.*\\p{{Nd}}$'))
        SELECT kind, name, count(*) AS n_records, 1::BIGINT AS n_splits FROM t GROUP BY kind, name""",
    "p4_groups": _P4
    + """, both_ways AS (SELECT row_id_a AS a, row_id_b AS b FROM f UNION SELECT x.row_id, y.row_id FROM t x JOIN t y ON x.w = y.w AND x.row_id < y.row_id),
        link AS (SELECT a, b FROM both_ways UNION SELECT b, a FROM both_ways),
        reach(a, b) AS (SELECT row_id, row_id FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT row_id, (SELECT min(b) FROM reach WHERE a = row_id) AS group_id, (SELECT count(*) FROM link WHERE a = row_id) AS n_links FROM t""",
    "p7_kept": "SELECT source, true AS share_met, true AS uses_met, true AS slots_full FROM mix_targets",
    "p3_found": f"""
        WITH RECURSIVE r AS (
            SELECT source AS v, {_key("source")} AS s, CASE WHEN regexp_matches({_key("category")}, '^case.*\\p{{Nd}}$') THEN {_key("category")} END AS c
            FROM raw_seed_records WHERE source IS NOT NULL AND length(regexp_replace(source, '[\\s\\p{{Z}}]', '', 'g')) > 0),
        link AS (SELECT DISTINCT x.s AS a, y.s AS b FROM (SELECT DISTINCT s, c FROM r) x JOIN (SELECT DISTINCT s, c FROM r) y ON x.c = y.c),
        reach(a, b) AS (SELECT DISTINCT s, s FROM r UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        val AS (SELECT DISTINCT v, s FROM r)
        SELECT x.v AS source_a, y.v AS source_b FROM val x JOIN reach ON x.s = reach.a JOIN val y ON y.s = reach.b AND x.v < y.v""",
    "p4_found": _P4 + " SELECT row_id_a, row_id_b FROM f",
    "p6_coverage": """
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
        bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b),
        hit AS (SELECT doc_id, i, item_id FROM dg JOIN bg USING (g)),
        gone AS (SELECT doc_id, count(DISTINCT place) AS leaked_words FROM (SELECT doc_id, unnest(range(i, i + 13)) AS place FROM hit) GROUP BY doc_id),
        n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items FROM hit GROUP BY doc_id)
        SELECT doc_id, n_items, len(w)::BIGINT AS n_words, leaked_words, leaked_words > 0.5 * len(w) AS dropped FROM gone JOIN n USING (doc_id) JOIN w USING (doc_id)""",
    "p6_found": """
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM w),
        bg AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)""",
}
