"""Broken prompt and response pairs (problem 5).

A reply is held against its question: shingle containment and the longest common subsequence, sentence by sentence, tell
copies, however reordered; sentences aligned to refusal templates tell refusals; a language model tells languages; open
fences, dangling marks and counts of how list items end tell truncation. How items end is counted over all conversations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.words import ASKERS, CJK, REPLIERS, LanguageModel, prose, role, seeded
from millrace.session import materialize

#: An ending is complete if it ends at least this share of its occurrences in list items.
ENDS = 0.02
#: Doubtful endings up to this number are sent along to be counted; more are joined to the counts of all endings.
MAX_SENT = 200_000
#: Endings that a task counts before it hands them on.
COUNTED = 200_000
#: A reply is a copy if this share of it lies in the question.
COPIED = 0.78
#: A sentence of more than four words with less than this share in the question is the reply's own.
OWN = 0.65
#: Words beside the refusing sentence from which on a reply counts as help.
HELP = 40
#: Share of a template that a sentence must hold, in order.
ALIGNED = 0.8
#: A question and a reply are in two languages if each is likelier in its own by so much, in all and a word.
MARGIN, MARGIN_A_WORD = 30.0, 3.0

# Sentences that decline, by their words.
REFUSALS = """
sorry i can t help with
sorry i cannot help with that
sorry i am unable to assist
i can t assist with that
i cannot assist with this request
i won t be able to help
i will not assist with
that falls outside what i m allowed to do
i must decline to discuss
i must decline this request
i have to decline
i would rather not answer that
this is not a topic i can engage with
i am not in a position to advise on
i have no permission to comment on
i am not able to provide
i m not able to help with
i can t discuss that
i am not allowed to help with
i am not permitted to discuss
i can t share information about
dabei darf ich nicht helfen
darf ich leider nicht helfen
dabei kann ich nicht helfen
diese anfrage muss ich ablehnen
muss ich leider ablehnen
dazu kann ich nichts sagen
kann ich zu nichts sagen
dazu darf ich keine auskunft geben
ich möchte darauf nicht antworten
über gebe ich keine auskunft
dazu gebe ich keine auskunft
es ist mir nicht erlaubt zu helfen
lo siento no puedo hablar de
lo siento no puedo ayudar con
no puedo ayudarte con eso
debo rechazar esta petición
tengo que rechazar esta solicitud
prefiero no responder sobre
no estoy autorizado a hablar de
no se me permite ayudar con
no me está permitido ayudar
je dois refuser cette demande
je suis obligé de refuser
désolé je ne peux rien dire sur
désolé je ne peux pas aider
je ne peux pas vous aider avec
je préfère ne pas répondre
je ne suis pas autorisé à parler de
il ne m est pas permis d aider
je ne suis pas en mesure d aider
抱歉 关于的问题我不能回答
抱歉 我不能回答
抱歉 我无法提供帮助
对不起 我不能帮助
这个请求我必须拒绝
我必须拒绝这个请求
我不便回答
我不便讨论
我不能讨论
我无法讨论
我不被允许讨论
"""
# How the languages are called in one another.
NAMES = {
    "en": "english|englisch|inglés|ingles|anglais|英语|英文",
    "de": "german|deutsch|alemán|aleman|allemand|德语|德文",
    "es": "spanish|spanisch|español|espanol|castellano|espagnol|西班牙",
    "fr": "french|französisch|francés|frances|français|francais|法语|法文",
    "zh": "chinese|mandarin|chinesisch|chino|chinois|中文|汉语|普通话|华语",
}
_ASKED = {k: re.compile(v) for k, v in NAMES.items()}
_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？])|\n+")
_TEMPLATES = [_TOKEN.findall(t) for t in REFUSALS.strip().lower().split("\n")]
_ITEM = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+(\S.*)")
_ENDED = re.compile(r"[.!?。！？](?:[\"'”’»)）\]*_]*)$")
_SHAPES = ((re.compile(r"\b[\w-]+(?:\.[\w-]+)+\b"), "H"), (re.compile(r"\d+"), "0"), (re.compile(r"\b[A-ZÄÖÜÉ][a-zäöüßéèáíóúñ]{2,}\b"), "X"))
DEFECTS = ("empty", "copied", "refusal", "language", "truncated")


def tokens(text: str) -> list[str]:
    """Words in lower case; Han characters one by one."""
    return _TOKEN.findall(text.lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all of ``b`` at once in the bits of a number."""
    at: dict[str, int] = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        m = at.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def containment(reply: list[str], question: list[str], k: int = 2) -> float:
    """Share of the reply's distinct k-word sequences that the question holds."""
    k = min(k, len(reply))
    own = set(zip(*(reply[i:] for i in range(k)), strict=False)) if k else set()
    return len(own.intersection(zip(*(question[i:] for i in range(k)), strict=False))) / len(own) if own else 0.0


def _without_intro(reply: str) -> str:
    """Without a few words and a colon that introduce a quotation."""
    head, colon, rest = reply.partition(":")
    if not colon:
        head, colon, rest = reply.partition("：")
    return rest if colon and rest.strip() and len(tokens(head)) <= 5 else reply


def _run_within(said: list[str], asked: list[str]) -> bool:
    return any(asked[i : i + len(said)] == said for i in range(len(asked) - len(said) + 1))


def is_copy(question: str, reply: str) -> bool:
    """Whether the reply is the question or a part of it, perhaps reordered, altered or introduced, and nothing else.

    Where either has less than four words, the reply must be a run of the question's words and at least half of it: a
    short answer may well repeat a word of the question.
    """
    asked, said = tokens(question), tokens(reply)
    if len(said) < 4 or len(asked) < 4:
        return any(0 < len(x) and 2 * len(x) >= len(asked) and _run_within(x, asked) for x in (said, tokens(_without_intro(reply))))
    if containment(said, asked) < 0.3:
        return False
    for text in (reply, _without_intro(reply)):
        sentences = [s for s in map(tokens, _SENTENCE.split(text)) if s]
        kept = [common_subsequence(s, asked) for s in sentences]
        whole = sum(map(len, sentences))
        own = any(len(s) > 4 and k < OWN * len(s) for s, k in zip(sentences, kept, strict=True))
        if whole > 3 and not own and (sum(kept) >= COPIED * whole or containment(tokens(text), asked, 3) >= COPIED):
            return True
    return False


def is_refusal(reply: str) -> bool:
    """Whether any sentence declines, with hardly a word of help beside it."""
    if "```" in reply:
        return False
    sentences = [s for s in map(tokens, _SENTENCE.split(reply)) if s]
    whole = sum(map(len, sentences))
    help_ = HELP * (2 if CJK.search(reply) else 1)
    return any(whole - len(s) <= help_ and any(common_subsequence(s, t) >= ALIGNED * len(t) for t in _TEMPLATES) for s in sentences)


def is_foreign(question: str, reply: str, model: LanguageModel) -> bool:
    """Whether the reply's prose is in another language than the question, which doesn't name it."""
    (q, nq), (r, nr) = model.evidence(prose(question)), model.evidence(prose(reply))
    lq, lr = q.index(max(q)), r.index(max(r))
    if lq == lr or min(q[lq] - q[lr] - MARGIN_A_WORD * nq, r[lr] - r[lq] - MARGIN_A_WORD * nr) < 0 or min(q[lq] - q[lr], r[lr] - r[lq]) < MARGIN:
        return False
    asked = _ASKED.get(model.languages[lr])
    return not (asked and asked.search(question.lower()))


Ending = tuple[str, str]


def item_endings(item: str) -> list[Ending]:
    """The shapes of the last two words of a list item, after each of its words: the last is the item's own ending."""
    for pattern, shape in _SHAPES:
        item = pattern.sub(shape, item)
    out, last = [], ("", "")
    for word in item.split():
        for w in _TOKEN.findall(word):
            last = (last[1], w)
        out.append(last)
    return out


def count_endings(reply: str, ended: Counter, inner: Counter) -> None:
    """Count how list items end that a further line follows, and what stands within them; single last words under a None."""
    lines = reply.split("\n")
    for line, after in zip(lines, lines[1:], strict=False):
        m = _ITEM.match(line)
        if m and after.strip():
            *within, end = item_endings(m[1]) or [("", "")]
            for e, of in ((end, ended), *((e, inner) for e in within)):
                of[e] += 1
                of[None, e[1]] += 1


def is_truncated(reply: str) -> bool | Ending:
    """Whether the reply breaks off; of a list item without a mark the ending, which the counts of endings decide on."""
    text = reply.rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith(("…", "...", "……")):
        return True
    if _ENDED.search(text) or text.endswith(("`", "|", "**", ">")):
        return False
    if text[-1] in ",;:，；：、-–—(（[{/&+=":
        return True
    lines = text.split("\n")
    item = _ITEM.match(lines[-1])
    if item:
        others = [m[1].rstrip() for m in map(_ITEM.match, lines[:-1]) if m]
        if others and all(_ENDED.search(o) for o in others):
            return True
        return (item_endings(item[1]) or [("", "")])[-1]
    if not text[-1].isalnum():
        return False
    return len(tokens(text)) > 3


def defect_of(messages: list[dict], model: LanguageModel) -> tuple[str | None, list[Ending]]:
    """The first defect, in the order of DEFECTS, of any reply in a conversation of {role: u or a, content}.

    Without one, the endings of replies that may be truncated.
    """
    found, doubtful = set(), []
    i, n = 0, len(messages)
    while i < n:
        if messages[i]["role"] != "u":
            i += 1
            continue
        question = messages[i]["content"] or ""
        j = i + 1
        while j < n and messages[j]["role"] == "a":
            j += 1
        reply = "\n".join(m["content"] or "" for m in messages[i + 1 : j])
        i = j
        if not any(map(str.isalnum, reply)):
            return "empty", []
        if is_copy(question, reply):
            found.add("copied")
        elif is_refusal(reply):
            found.add("refusal")
        elif is_foreign(question, reply, model):
            found.add("language")
        else:
            cut = is_truncated(reply)
            if cut is True:
                found.add("truncated")
            elif cut:
                doubtful.append(cut)
    first = next((d for d in DEFECTS if d in found), None)
    return first, [] if first else doubtful


_ENDING = pa.struct([("first", pa.string()), ("last", pa.string())])


def _endings(turns: DataFrame, wanted: DataFrame) -> DataFrame:
    """first, last, ended, inner: how often list items of all replies end so, and how often that stands within them.

    ``wanted`` is a table of the endings (first, last) that are asked for; first is null for the last word alone.
    """
    only: frozenset | None = None
    if wanted.limit(MAX_SENT + 1).count() <= MAX_SENT:
        only = frozenset((r[0], r[1]) for r in wanted.collect())  # MAX_SENT endings at the most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended: Counter = Counter()
        inner: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = [e for e in {*ended, *inner} if only is None or e in only]
            made = pa.RecordBatch.from_arrays([pa.array([e[0] for e in keys], pa.string()), pa.array([e[1] for e in keys], pa.string()), pa.array([ended[e] for e in keys], pa.int64()), pa.array([inner[e] for e in keys], pa.int64())], names=["first", "last", "ended", "inner"])
            ended.clear()
            inner.clear()
            return made

        for batch in batches:
            for reply in batch.column(0).to_pylist():
                count_endings(reply, ended, inner)
                if len(ended) + len(inner) > COUNTED:
                    yield out()
        yield out()

    items = turns.select(F.explode("turns").alias("m")).where((F.col("m.role") == "a") & F.col("m.content").rlike(r"(?m)^\s*(?:[-*•+]|\d+[.)])\s")).select("m.content")
    return items.mapInArrow(run, "first string, last string, ended long, inner long").groupBy("first", "last").agg(F.sum("ended").alias("ended"), F.sum("inner").alias("inner"))


def broken_pairs(df: DataFrame, *, messages: str = "messages", key: str = "row_id", languages: LanguageModel | None = None) -> DataFrame:
    """Rows with a defective reply: key, defect. A row has one defect at most, the first in the order of DEFECTS.

    A reply is all that repliers say between two questions; messages of other roles are passed over. Null messages, and
    conversations without a question, have no defect; a null reply is ``empty``; a null question has only defects that
    need none. An empty table gives no rows. Without a model of ``languages``, function words tell them. ``key`` is
    unique: it brings a doubtful reply together with the counts of its ending.
    """
    side = lambda m: F.when(role(m["role"]).isin(*ASKERS), "u").when(role(m["role"]).isin(*REPLIERS), "a")
    said = F.filter(F.transform(F.col(messages), lambda m: F.struct(side(m).alias("role"), m["content"].alias("content"))), lambda m: m["role"].isNotNull())
    turns = df.select(key, said.alias("turns"))
    model = languages or seeded()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defect_of(ms or [], model) for ms in batch.column(1).to_pylist()]
            doubtful = pa.array([[{"first": a, "last": b} for a, b in d] for _, d in found], pa.list_(_ENDING))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in found], pa.string()), doubtful], names=[key, "defect", "doubtful"])

    schema = df.select(key).schema.add("defect", "string").add("doubtful", T.ArrayType(T.StructType().add("first", "string").add("last", "string")))
    judged = materialize(turns.mapInArrow(run, schema).where("defect is not null or size(doubtful) > 0"), "judged")
    sure = judged.where("defect is not null").select(key, "defect")
    open_ = judged.where("defect is null").select(key, F.explode("doubtful").alias("e")).select(key, "e.first", "e.last")
    wanted = open_.select("first", "last").unionByName(open_.select(F.lit(None).cast("string").alias("first"), "last")).distinct()
    if wanted.isEmpty():
        return sure
    counts = materialize(_endings(turns, materialize(wanted, "wanted")), "endings")
    pair = counts.where("first is not null")
    word = counts.where("first is null").select(F.col("last").alias("word"), F.col("ended").alias("word_ended"), F.col("inner").alias("word_inner"))
    both = open_.join(pair, ["first", "last"], "left").join(word, F.col("last") == F.col("word"), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    usual = lambda ended, inner: (n(ended) > 0) & (n(ended) >= ENDS * n(inner))
    # An ending that no other list item has is judged by its last word; a word that none has is a piece of a longer one.
    complete = F.when(n("ended") + n("inner") > 0, usual("ended", "inner")).otherwise(usual("word_ended", "word_inner"))
    cut = both.where(~complete).select(key, F.lit("truncated").alias("defect")).distinct()
    return sure.unionByName(cut)
