"""Rows of differing instruction sets as chat records: id, messages, source, category, difficulty, metadata.

Every record has a system, a user and an assistant message. Rows without an instruction or a reply are left out, or with
``drop=False`` kept with blank ones, for a filter that counts what it rejects. Nulls count as empty. Each function adds nothing but the record's columns; ``keep`` carries others along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip, text_of

# Fixed value: the system message of records that bring none.
SYSTEM_PROMPT = "You are a precise, capable coding and cybersecurity assistant."


def content_id(source: str, prompt: Column, response: Column) -> Column:
    """A stable id from the source and a hash of both texts."""
    return F.concat(F.lit(source + "_"), F.substring(F.sha2(F.concat_ws("::", F.lit(source), strip(prompt), strip(response)), 256), 1, 16))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _contents(messages: Column, role: str) -> Column:
    """The non-blank contents of a role, stripped."""
    return F.filter(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: strip(m["content"])), lambda c: c != "")


def first_content(messages: Column, role: str) -> Column:
    return F.coalesce(F.get(_contents(messages, role), F.lit(0)), F.lit(""))


def user_prompt(messages: Column) -> Column:
    """The first user message, stripped, though it be blank; empty without one."""
    return strip(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"])


def _record(df: DataFrame, keep: Sequence[str], id: Column, system: Column, user: Column, reply: Column, source: Column, category: Column, difficulty: Column, metadata: Column, when: Column | None = None, drop: bool = True) -> DataFrame:  # noqa: A002
    if when is not None:
        user, reply = (F.when(when, c).otherwise(F.lit("")) for c in (user, reply))
    out = df.where((user != "") & (reply != "")) if drop else df
    return out.select(
        *keep,
        id.alias("id"),
        F.array(message("system", system), message("user", user), message("assistant", reply)).alias("messages"),
        source.alias("source"), category.alias("category"), difficulty.alias("difficulty"), metadata.alias("metadata"),
    )


def _map(**of: Column) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))])


def normalize_opencoder(df: DataFrame, *, system: str = SYSTEM_PROMPT, keep: Sequence[str] = (), drop: bool = True) -> DataFrame:
    i, r = strip("instruction"), strip("output")
    name = F.coalesce(F.concat(F.lit("opencoder_"), F.col("seq_id").cast("string")), content_id("opencoder", i, r))
    meta = _map(code=F.col("code"), entry_point=F.col("entry_point"), testcase=F.col("testcase"), seq_id=F.col("seq_id"))
    return _record(df, keep, name, F.lit(system), i, r, F.lit("opencoder_educational_instruct"), F.lit("coding_educational"), F.lit("intermediate"), meta, drop=drop)


def normalize_bigcode(df: DataFrame, *, system: str = SYSTEM_PROMPT, keep: Sequence[str] = (), drop: bool = True) -> DataFrame:
    i, r = strip("instruction"), strip("response")
    own = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.nullif(F.col("sha1").cast("string"), F.lit("")))
    name = F.coalesce(F.concat(F.lit("bigcode_"), own), content_id("bigcode", i, r))
    meta = _map(id=F.col("id"), concepts=F.to_json("concepts"), seed=F.col("seed"), sha1=F.col("sha1"))
    return _record(df, keep, name, F.lit(system), i, r, F.lit("bigcode_self_oss_instruct_sc2"), F.lit("coding_exec_validated"), F.lit("advanced"), meta, drop=drop)


def normalize_smoltalk(df: DataFrame, *, system: str = SYSTEM_PROMPT, keep: Sequence[str] = (), drop: bool = True) -> DataFrame:
    ms = F.col("messages")
    i, r = first_content(ms, "user"), first_content(ms, "assistant")
    category, difficulty = F.coalesce("category", F.lit("general_instruction")), F.coalesce("difficulty", F.lit("intermediate"))
    meta = _map(category=category, difficulty=difficulty, quality=F.col("quality"), reward_model_score=F.col("reward_model_score"), conversation_tokens=F.col("conversation_tokens"))
    return _record(df, keep, content_id("smoltalk", i, r), F.lit(system), i, r, F.lit("smoltalk_magpie_ultra"), category, difficulty, meta, F.coalesce(F.size(ms) >= 2, F.lit(False)), drop)


def normalize_cybersecurity(df: DataFrame, *, system: str = SYSTEM_PROMPT, keep: Sequence[str] = (), drop: bool = True) -> DataFrame:
    """Rows with messages, or with user/assistant/system or instruction/response columns; the last system message holds."""
    col = lambda *names: F.coalesce(*[F.nullif(strip(n), F.lit("")) for n in names if n in df.columns], F.lit(""))
    flat_i, flat_r = col("user", "instruction"), col("assistant", "response")
    flat_s = F.coalesce(F.nullif(strip("system"), F.lit("")), F.lit(system)) if "system" in df.columns else F.lit(system)
    if "messages" in df.columns:
        ms = F.col("messages")
        listed = ms.isNotNull()
        i = F.when(listed, first_content(ms, "user")).otherwise(flat_i)
        r = F.when(listed, first_content(ms, "assistant")).otherwise(flat_r)
        s = F.when(listed, F.coalesce(F.try_element_at(_contents(ms, "system"), F.lit(-1)), F.lit(system))).otherwise(flat_s)
    else:
        i, r, s = flat_i, flat_r, flat_s
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)
    name = F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), content_id("cyber", i, r)) if "id" in df.columns else content_id("cyber", i, r)
    meta = F.create_map(F.lit("tags"), F.to_json(F.coalesce("tags", F.array().cast("array<string>")))) if "tags" in df.columns else F.create_map(F.lit("tags"), F.lit("[]"))
    return _record(df, keep, name, s, i, r, has("source", "cybersecurity_stream"), has("category", "cybersecurity"), has("difficulty", "intermediate"), meta, drop=drop)


def alpaca(df: DataFrame, n: int, *, order: str) -> DataFrame:
    """The first ``n`` source rows as dialogs; blank instructions and outputs are left out after counting."""
    i, inp, r = strip("instruction"), strip("input") if "input" in df.columns else F.lit(""), strip("output")
    text = F.concat(F.lit("User: "), i, F.when(inp != "", F.concat(F.lit("\n"), inp)).otherwise(F.lit("")), F.lit("\nAssistant: "), r)
    return df.orderBy(order).limit(n).where((i != "") & (r != "")).select(text.alias("text"))


def render_chat(messages: Column, *, generate: bool = False) -> Column:
    """Messages in the chat template; with ``generate``, the assistant's turn is opened."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), text_of(m["role"]), F.lit("\n"), text_of(m["content"]), F.lit("<|im_end|>\n"))
    text = F.array_join(F.transform(messages, turn), "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generate else text


# What the chat template says about tools.
TOOLS_BEFORE = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_BEHIND = "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call><|im_end|>\n"


def render_agent_chat(messages: Column, *, tools: Column | None = None, calls: bool = False, generate: bool = False) -> Column:
    """Messages in the chat template with its branches for reasoning, tools, tool calls and tool results.

    Roles are system, user, assistant and tool; others have no place in the template and are left out, and so is a system
    message with ``tools`` (an array of JSON texts) but for the first message. Reasoning is what stands before
    ``</think>``: it is shown in replies behind the last question only, where the last reply shows it even if empty. Runs
    of tool results make one user turn. With ``calls``, messages have tool_calls, an array of name and arguments (JSON).
    Null contents are empty, null messages give a null.
    """
    n, edges = F.size(messages), F.lit("\n")
    said = lambda m: text_of(m["content"])
    role = lambda i: F.coalesce(F.get(messages, i)["role"], F.lit(""))
    asks = F.transform(messages, lambda m, i: F.when((m["role"] == "user") & ~(F.startswith(said(m), F.lit("<tool_response>")) & F.endswith(said(m), F.lit("</tool_response>"))), i))
    last_query = F.coalesce(F.array_max(asks), n - 1)

    def reply(m: Column, i: Column) -> Column:
        thinks = F.contains(said(m), F.lit("</think>"))
        parts = F.split(said(m), "</think>")
        before = F.ltrim(F.element_at(F.split(F.rtrim(F.get(parts, F.lit(0)), edges), "<think>"), -1), edges)
        reasoning = F.when(thinks, before).otherwise(F.lit(""))
        content = F.when(thinks, F.ltrim(F.element_at(parts, -1), edges)).otherwise(said(m))
        shown = (i > last_query) & ((i == n - 1) | (reasoning != ""))
        head = F.when(shown, F.concat(F.lit("<think>\n"), F.btrim(reasoning, edges), F.lit("\n</think>\n\n"), F.ltrim(content, edges))).otherwise(content)
        if calls:
            call = lambda c, k: F.concat(F.when((k > 0) | (content != ""), "\n").otherwise(""), F.lit('<tool_call>\n{"name": "'), text_of(c["name"]), F.lit('", "arguments": '), text_of(c["arguments"]), F.lit("}\n</tool_call>"))
            head = F.concat(head, F.coalesce(F.array_join(F.transform(m["tool_calls"], call), ""), F.lit("")))
        return F.concat(F.lit("<|im_start|>assistant\n"), head, F.lit("<|im_end|>\n"))

    def turn(m: Column, i: Column) -> Column:
        plain = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), said(m), F.lit("<|im_end|>\n"))
        opens, closes = (i == 0) | (role(i - 1) != "tool"), (i == n - 1) | (role(i + 1) != "tool")
        result = F.concat(F.when(opens, "<|im_start|>user").otherwise(""), F.lit("\n<tool_response>\n"), said(m), F.lit("\n</tool_response>"), F.when(closes, "<|im_end|>\n").otherwise(""))
        shown = (m["role"] == "user") | ((m["role"] == "system") & ((i > 0) | F.lit(tools is None)))
        return F.when(shown, plain).when(m["role"] == "assistant", reply(m, i)).when(m["role"] == "tool", result).otherwise("")

    text = F.array_join(F.transform(messages, turn), "")
    if tools is not None:
        first = F.when(role(F.lit(0)) == "system", F.concat(said(F.get(messages, F.lit(0))), F.lit("\n\n"))).otherwise("")
        listed = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), t)), "")
        text = F.concat(F.lit("<|im_start|>system\n"), first, F.lit(TOOLS_BEFORE), listed, F.lit(TOOLS_BEHIND), text)
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generate else text


def wrap_dialog(question: Column | str, answer: Column | str, *, plain: bool = False) -> Column:
    return F.concat(F.lit("" if plain else "User: "), text_of(question), F.lit("\nAssistant: "), text_of(answer))


def assemble(turns: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    """Rows of turns as one row of ordered messages per conversation."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(conversation).agg(rows.alias("r")).select(conversation, F.transform("r", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
