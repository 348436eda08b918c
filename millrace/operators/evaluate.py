"""Tables of scored responses: by category, in all, weighed together, and before against after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scoring import code_of, concept_score, matched
from millrace.functions.text import delta_text, drifts_to_dialog, echoes_plain, echoes_wrapped, first_words, has_all_keywords, has_keyword, score_text, title, unigram_repetition


def score_concepts(df: DataFrame, response: str = "response", required: str = "required_concepts", forbidden: str = "forbidden_concepts") -> DataFrame:
    """``df`` with score, matched_required, missing_required and matched_forbidden."""
    req = F.coalesce(F.col(required), F.array().cast("array<string>"))
    hit = matched(response, req)
    return df.withColumns({
        "score": concept_score(response, req, F.col(forbidden)), "matched_required": hit,
        "missing_required": F.filter(req, lambda c: ~F.array_contains(hit, c)), "matched_forbidden": matched(response, F.col(forbidden)),
    })


def score_keywords(df: DataFrame, prompt: str = "prompt", answer: str = "answer", keywords: str = "keywords") -> DataFrame:
    """``df`` with strict (a keyword within the first eight words), loose (anywhere), all_keywords, echo and echo_plain."""
    ks = F.col(keywords)
    return df.withColumns({
        "strict": has_keyword(first_words(answer), ks), "loose": has_keyword(answer, ks), "all_keywords": has_all_keywords(answer, ks),
        "echo": echoes_wrapped(prompt, answer), "echo_plain": echoes_plain(prompt, answer),
    })


def score_generation(df: DataFrame, prompt: str = "prompt", answer: str = "answer", topics: str = "topics") -> DataFrame:
    """``df`` with topic_hit (null without topics), repetition_ratio, dialog_drift and echo."""
    return df.withColumns({
        "topic_hit": F.when(F.size(topics) > 0, has_keyword(answer, F.col(topics))), "repetition_ratio": unigram_repetition(answer),
        "dialog_drift": drifts_to_dialog(answer), "echo": F.startswith(F.lower(answer), F.lower(prompt)),
    })


def _rate(c: Column | str) -> Column:
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("int"))


def category_accuracy(scored: DataFrame, category: str = "category", flags: Sequence[str] = ("strict", "loose", "echo")) -> DataFrame:
    """By category: n and the rate of each flag."""
    return scored.groupBy(category).agg(F.count("*").alias("n"), *[_rate(f).alias(f + "_rate") for f in flags])


def prompt_accuracy(scored: DataFrame, category: str, wrapped: str, correct: str, strict: str) -> DataFrame:
    """By category and way of asking (``wrapped`` as a dialog or plain), and by way of asking in all: n, correct, strict, accuracy."""
    rows = scored.select(F.col(category).alias("category"), F.col(wrapped).alias("wrapped"), F.col(correct).alias("c"), F.col(strict).alias("s"))
    by = rows.groupingSets([["category", "wrapped"], ["wrapped"]], "category", "wrapped")
    return by.agg(F.count("*").alias("n"), F.count_if("c").alias("correct"), F.count_if("s").alias("strict"), _rate("c").alias("accuracy"), F.grouping("category").cast("int").alias("is_total"))


def weighted_overall(categories: DataFrame, rate: str, n: str = "n") -> DataFrame:
    """The rate over all rows, from rates by category."""
    return categories.agg((F.sum(F.col(rate) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))).alias(rate))


def category_means(scored: DataFrame, category: str = "category", score: str = "score") -> DataFrame:
    """The mean score by category, and over all rows (not over categories) under a null category, to four digits."""
    return scored.rollup(category).agg(F.count("*").alias("n"), F.bround(F.avg(score), 4).alias("mean_score"), F.grouping(category).cast("int").alias("is_total"))


def diagnostics(scored: DataFrame, category: str, correct: str) -> DataFrame:
    """By category, and in all: n, correct and accuracy."""
    return scored.rollup(category).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct"), _rate(correct).alias("accuracy"), F.grouping(category).cast("int").alias("is_total"))


def composite(qa: DataFrame, generation: DataFrame) -> DataFrame:
    """One row: the weighed composite of strict and loose accuracy, topics hit, dialog drift and repetition.

    Rows without topics count for drift and repetition only.
    """
    a = qa.agg(_rate("strict").alias("strict"), _rate("loose").alias("loose"))  # one row
    b = generation.agg(_rate("topic_hit").alias("topic"), _rate("dialog_drift").alias("drift"), F.avg("repetition_ratio").alias("rep"))  # one row
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # The weights of the parts.
    whole = 0.55 * z("strict") + 0.15 * z("loose") + 0.15 * z("topic") + 0.10 * (1 - z("drift")) + 0.05 * (1 - z("rep"))
    return a.join(F.broadcast(b)).select("strict", "loose", "topic", "drift", "rep", whole.alias("composite"))


def compare(before: DataFrame, after: DataFrame, category: str = "category", score: str = "score") -> DataFrame:
    """By category: both scores and the change, as numbers and as text; what is missing on a side is null and N/A."""
    b, a = before.select(category, F.col(score).alias("before")), after.select(category, F.col(score).alias("after"))
    delta = F.col("after") - F.col("before")
    return b.join(a, category, "full_outer").select(
        category, title(category).alias("title"), "before", "after", delta.alias("delta"), score_text(F.col("before")).alias("before_text"), score_text(F.col("after")).alias("after_text"), delta_text(delta).alias("delta_text")
    )


def comparison_report(compared: DataFrame, overall_before: float | None, overall_after: float | None, *, limit: int = 1000) -> str:
    """The comparison as Markdown, a category per row; more than ``limit`` of them are refused."""
    rows = compared.orderBy("category").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories are no report")
    num = lambda x: "N/A" if x is None else f"{x:.4f}"
    diff = None if None in (overall_before, overall_after) else overall_after - overall_before
    lines = ["| Category | Before | After | Delta |", "|---|---:|---:|---:|"]
    lines += [f"| {r['title']} | {r['before_text']} | {r['after_text']} | {r['delta_text']} |" for r in rows]
    lines.append(f"| **Overall** | **{num(overall_before)}** | **{num(overall_after)}** | **{'N/A' if diff is None else ('+' if diff > 0 else '') + num(diff)}** |")
    return "\n".join(lines) + "\n"


def pass_at_1(results: DataFrame, passed: str = "passed") -> DataFrame:
    """Tasks, passed ones, and their share in per cent to two digits; 0 of none."""
    return results.agg(F.count("*").alias("n_tasks"), F.count_if(passed).alias("n_passed"), F.bround(F.coalesce(_rate(passed) * 100.0, F.lit(0.0)), 2).alias("pass_at_1"))


def prepare_code(df: DataFrame, completion: str, entry_point: str, prompt: str) -> DataFrame:
    """``df`` with generated_code; the prompt goes before a completion that gives only the body."""
    code = code_of(completion, F.col(entry_point))
    whole = F.contains(code, F.concat(F.lit("def "), F.col(entry_point)))
    return df.withColumn("generated_code", F.when(whole, code).otherwise(F.concat(F.col(prompt), F.lit("\n"), code)))


def best_candidate(df: DataFrame, by: Sequence[str], candidate: str, probability: str, valid: str | None = None) -> DataFrame:
    """The likeliest candidate of each group; of equal ones the first by name. ``valid`` leaves others out."""
    rows = df if valid is None else df.where(F.col(valid))
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(probability)).alias("p"), F.col(candidate)))
    return rows.where(F.col(probability).isNotNull()).groupBy(*by).agg(best.alias("__best")).select(*by, *[F.col("__best")[c].alias(c) for c in rest])
