"""Keyword-stuffed and link-list pages (problem 8).

A page is a sequence of lines (long lines are cut at sentence ends). Each line shows one of a few signs; a hidden Markov
model reads the signs as prose, link list, tag list or menu, so that a doubtful line is taken for what surrounds it. A
page is flagged if more than half of its words lie in lines that are not prose.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import FUNCTION
from millrace.operators.splits import bounded_sample

STATES = ("prose", "links", "tags", "menu")
SIGNS = ("sentence", "code", "log", "link", "hash", "product", "list", "repeat", "bar", "short", "other")
#: Share of words outside prose from which on a page is flagged.
SHARE = 0.5
#: Words that a link's address counts as, beside the words that it shows.
ADDRESS_WORDS = 2
#: Words of short lines that are judged together for stuffing.
WINDOW_WORDS = 40
#: Words of a line of usual length.
LINE_WORDS = 30
#: Pages, chosen by hash, that the model's probabilities are fitted on, the rounds of fitting, and how many observations
#: the starting values weigh in each state.
SAMPLE, ROUNDS, WEIGHT = 2000, 4, 400.0

# Starting values: chances in per cent of the SIGNS in each state, and of staying in a state.
START = {
    "prose": (60.9, 14, 8, 1.5, 0.3, 0.3, 0.6, 0.4, 1, 9, 4),
    "links": (1, 0.2, 0.2, 75, 1, 3, 3, 1, 2, 10, 3.6),
    "tags": (1, 0.2, 0.2, 3, 22, 22, 24, 16, 4, 5, 2.6),
    "menu": (1, 0.2, 0.2, 10, 2, 1, 12, 2, 42, 26, 3.6),
}
STAY = 0.8

_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_CUT = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+(?=\S)|(?<=[。！？])")
_LINK = re.compile(r"<a\s[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w.@-])[\w-]+(?:\.[\w-]+)+/[^\s<>\"')\]]*|^\W*[\w-]+(?:\.[a-z][\w-]+)+\W*$", re.I)
#: What a link shows: the text of an anchor, nothing of a bare address.
_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>|!?\[([^\]\n]*)\]\([^)\n]*\)", re.I)
_LOG = re.compile(r"\s*(?:\[?\d{4}-\d\d-\d\d[T ])?\[?\d\d:\d\d(?::\d\d)?")
_SENTENCE_END = re.compile(r"[.!?。！？:：][\"'”’»)）\]*_]*$")
_PARTS = re.compile(r"\s*[,，、|·•;；»>]\s*|\s+/\s+|\s+[-–—]\s+")
_BARS = re.compile(r"[|·•»]")
_PRICE = re.compile(r"(?:^|[^\d.])[$€£¥]?\s?\d+[.,]\d\d(?:\s?[$€£¥]|\s*$|\s*\|)")
#: An amount with its currency, which needs no other mark to be a price.
_MONEY = re.compile(r"[$€£¥]\s?\d+[.,]\d\d(?!\d)|(?<![\d.])\d+[.,]\d\d\s?[$€£¥]")
#: What is seldom missing in a line of code, and is hardly met in keywords, links or tags.
_CODE = re.compile(r"[=;{}()<>\\$%]|^\s*[-\w]+:(?:\s|$)|^\s{2,}|\s--?\w")
#: What a sentence that is not just prose may hold.
_MARKED = re.compile(r"[/|·•»#]|www\.|\]\(")
_HASH = re.compile(r"#[^\s#]+")


def stuffed(words: list[str]) -> bool:
    """Whether few words recur with hardly a function word between them, whatever the punctuation.

    Prose has at least one function word in five; Han characters recur more than words, and have none.
    """
    n = len(words)
    if n < 12:
        return False
    content = [w for w in words if w not in FUNCTION]
    if n - len(content) > 0.18 * n:
        return False
    han = sum("㐀" <= w <= "鿿" for w in content) > len(content) / 2
    return len(set(content)) <= (0.3 if han else 0.5) * len(content)


def segments(text: str) -> Iterator[tuple[str, bool]]:
    """The page's lines and whether they stand in a code fence; blank lines and fences are left out. Lines outside are
    cut at sentence ends, unless they are stuffed: those stay whole."""
    fenced = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not line.strip():
            continue
        elif fenced or len(line) < 40 or (not _MARKED.search(line) and stuffed(_TOKEN.findall(line.lower()))):
            yield line, fenced
        else:
            start = 0
            for m in _CUT.finditer(line):
                if m.end() - start > 24:
                    yield line[start : m.end()], False
                    start = m.end()
            if line[start:].strip():
                yield line[start:], False


def sign(line: str, *, fenced: bool = False) -> tuple[str, list[str]]:
    """The sign that a line shows, and its words in lower case; an address counts as ADDRESS_WORDS.

    What a line is made of goes before how it ends, and before a fence around it: keywords, tags, products and links stay
    what they are with a full stop behind them or within a fence. Other lines in a fence are code.
    """
    text = line.strip()
    words = _TOKEN.findall(text.lower())
    n = len(words)
    if not n:
        return "other", words
    if fenced and _CODE.search(line) and not _LINK.match(text):
        return "code", words
    ended = bool(_SENTENCE_END.search(text))
    marked = bool(_MARKED.search(text))
    function_words = sum(w in FUNCTION for w in words) / n
    links = _LINK.findall(text) if marked or " " not in text else ()
    if links:
        rest = _LINK.sub(" ", text)
        outside = len(_TOKEN.findall(rest))
        if outside <= (0 if fenced else 3 + 3 * len(links)) and not (function_words > 0.15 and _SENTENCE_END.search(rest.strip())):
            # An address counts alike, however long it is, beside the words that the link shows.
            shown = [w for a in _ANCHOR.findall(text) for w in _TOKEN.findall((a[0] or a[1]).lower())]
            return "link", _TOKEN.findall(rest.lower()) + shown + ["@"] * ADDRESS_WORDS * len(links)
    if ended and not marked and function_words >= 0.2:
        return "sentence", words
    if not ended and _LOG.match(text):
        return "log", words
    if marked:
        tags = _HASH.findall(text)
        if len(tags) >= 2 and sum(map(len, tags)) >= 0.5 * len(text):
            return "hash", words
    parts = [p for p in _PARTS.split(text) if p]
    if len(parts) > 2:
        sizes = [len(_TOKEN.findall(p)) for p in parts]
        bars = bool(_BARS.search(text))
        if max(sizes) <= 8 and function_words < 0.12 and (_MONEY.search(text) or (bars and _PRICE.search(text))):
            return "product", words
        han = sum("㐀" <= w <= "鿿" for w in words) > n / 2
        # Ended with a mark, a list of names may belong to prose: only long ones without function words are tags.
        if sum(sizes) / len(parts) <= (6 if han else 4) and function_words < 0.12 and (not ended or (len(parts) >= 6 and function_words < 0.05 and not han)):
            return ("list" if len(parts) >= 8 or not (bars or "/" in text) else "bar"), words
    if stuffed(words):
        return "repeat", words
    if fenced:
        return "code", words
    if ended or function_words >= 0.12:
        return "sentence", words
    return ("short" if n <= 6 else "other"), words


def _judge_short_lines(lines: list[list]) -> None:
    """Mark stuffed runs of lines that are too short to be judged one by one. A line is [sign, words, fenced]."""
    run: list[list] = []
    held: list[str] = []
    for line in [*lines, None]:
        short = line is not None and len(line[1]) < 12 and line[0] in ("sentence", "short", "other") and not line[2]
        if short:
            run.append(line)
            held += line[1]
        if run and (not short or len(held) >= WINDOW_WORDS):
            if len(run) > 2 and stuffed(held):
                for x in run:
                    x[0] = "repeat"
            run, held = [], []


def observe(text: str | None) -> tuple[list[int], list[int]]:
    """The page's signs (numbers in SIGNS) and word counts. A long line shows its sign once for every LINE_WORDS words."""
    signs, counts = [], []
    lines = [[*sign(line, fenced=fenced), fenced] for line, fenced in segments(text or "")]
    _judge_short_lines(lines)
    for s, words, _ in lines:
        n = len(words)
        if n:
            times = -(-n // LINE_WORDS)
            signs += [SIGNS.index(s)] * times
            counts += [n // times + (i < n % times) for i in range(times)]
    return signs, counts


class LineModel:
    """A hidden Markov model over signs, fitted by Viterbi training from the starting values."""

    def __init__(self) -> None:
        k = len(STATES)
        self.emit = [[x / sum(START[s]) for x in START[s]] for s in STATES]
        self.move = [[STAY if i == j else (1 - STAY) / (k - 1) for j in range(k)] for i in range(k)]
        self.first = [0.85, 0.05, 0.05, 0.05]
        self._logs()

    def _logs(self) -> None:
        log = lambda rows: [[math.log(max(x, 1e-12)) for x in r] for r in rows]
        self._emit, self._move, self._first = list(zip(*log(self.emit), strict=True)), list(zip(*log(self.move), strict=True)), log([self.first])[0]
        # Where prose is likeliest to begin and to stay, pages with only signs that prose shows most are all prose.
        steady = self.first[0] >= max(self.first) and self.move[0][0] >= max(max(r) for r in self.move)
        self._prose = frozenset(o for o in range(len(SIGNS)) if steady and self.emit[0][o] >= max(r[o] for r in self.emit))

    def label(self, signs: list[int]) -> list[int]:
        """The likeliest states; of equal ones the first in STATES."""
        if self._prose.issuperset(signs):
            return [0] * len(signs)
        score = [f + e for f, e in zip(self._first, self._emit[signs[0]], strict=True)]
        back = []
        for o in signs[1:]:
            best = []
            new = []
            for into, e in zip(self._move, self._emit[o], strict=True):
                ways = [s + m for s, m in zip(score, into, strict=True)]
                top = max(ways)
                best.append(ways.index(top))
                new.append(top + e)
            back.append(best)
            score = new
        state = score.index(max(score))
        out = [state]
        for best in reversed(back):
            state = best[state]
            out.append(state)
        return out[::-1]

    def fit(self, pages: list[list[int]], rounds: int = ROUNDS, weight: float = WEIGHT) -> LineModel:
        start = LineModel()
        for _ in range(rounds):
            emit = [[weight * x for x in r] for r in start.emit]
            move = [[weight * x for x in r] for r in start.move]
            first = [weight * x for x in start.first]
            for signs in pages:
                states = self.label(signs)
                for s, o in zip(states, signs, strict=True):
                    emit[s][o] += 1
                for s, t in zip(states, states[1:], strict=False):
                    move[s][t] += 1
                if states:
                    first[states[0]] += 1
            self.emit = [[x / sum(r) for x in r] for r in emit]
            self.move = [[x / sum(r) for x in r] for r in move]
            self.first = [x / sum(first) for x in first]
            self._logs()
        return self

    def words(self, text: str | None) -> list[int]:
        """The page's words by state."""
        signs, counts = observe(text)
        out = [0] * len(STATES)
        for s, n in zip(self.label(signs), counts, strict=True):
            out[s] += n
        return out


def fit_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> LineModel:
    """A model fitted on about ``sample`` pages, twice as many at the most; without pages it keeps the starting values."""
    pages = bounded_sample(df.select(key, F.col(text).alias("t")), key, sample).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([observe(t)[0] for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["signs"])

    return LineModel().fit([r[0] for r in pages.select("t").mapInArrow(run, "signs array<int>").collect()])  # signs of a bounded sample


def line_kinds(df: DataFrame, *, key: str = "doc_id", text: str = "text", model: LineModel | None = None) -> DataFrame:
    """One row per page: key, words in prose, links, tags and menu, and spam_share (null without a word)."""
    model = model or fit_lines(df, key=key, text=text)
    names = [f"{s}_words" for s in STATES]
    schema = df.select(key).schema
    for c in names:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.words(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATES)))], names=[key, *names])

    kinds = df.select(key, text).mapInArrow(run, schema)
    whole = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return kinds.withColumn("spam_share", (whole - F.col(names[0])) / F.nullif(whole, F.lit(0)))


def spam_pages(df: DataFrame, *, key: str = "doc_id", text: str = "text", share: float = SHARE, model: LineModel | None = None) -> DataFrame:
    """Keys of the pages of which more than ``share`` of the words are not prose.

    Null and blank texts are never flagged; copies are flagged each. An empty table gives no rows.
    """
    return line_kinds(df, key=key, text=text, model=model).where(F.col("spam_share") > share).select(key)
