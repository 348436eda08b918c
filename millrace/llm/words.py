"""Words, roles and languages of texts, shared by the operators of this package.

A word is a longest run of Unicode letters and digits, in lower case. The language of a text is told by a naive Bayes
model over character sequences, fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.splits import bounded_sample

WORD = re.compile(r"[^\W_]+")
FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
CJK = re.compile(r"[㐀-鿿]")

# Frequent function words by language. Words that are also keywords of programming languages are left out.
FUNCTION_WORDS = {
    "en": "the a an of to and are was were that this be by on it its before when how which why what where would could should has have had they their at into we you your our please can does did been more than whenever",
    "de": "der die das den dem des und ist nicht mit für auf ein eine einen einer zu bei nach hat wird werden sich wir von im zum zur als auch dass wie wenn kann soll sollte seit über wirkt bitte ich muss",
    "es": "el los las del que y una con se por al su sin más para es está sobre cuando qué cómo desde hace hasta hay este esta nos después antes lo fue entre debe puede si",
    "fr": "le les des et un une pour avec sur est dans du au aux ne pas que qui ce cette il elle nous vous je sans chez après avant depuis semble peut faut plus quand sont mieux vaut reste",
}
#: Roles that name the asking and the answering side.
ASKERS, REPLIERS = ("user", "human"), ("assistant", "bot")
LANGUAGES = ("en", "de", "es", "fr", "zh")
_LANGS_OF: dict[str, tuple[int, ...]] = {}
for _i, _l in enumerate(LANGUAGES[:4]):
    for _w in FUNCTION_WORDS[_l].split():
        _LANGS_OF[_w] = (*_LANGS_OF.get(_w, ()), _i)
#: Function words of any of the languages.
FUNCTION = frozenset(_LANGS_OF)
#: Labelled documents that a language model is fitted on, about; twice as many at the most.
LANGUAGE_SAMPLE = 2000
#: Longest character sequence of the model, the numbers that sequences are hashed to, and what is added to their counts.
LONGEST, BUCKETS, SMOOTHING = 4, 1 << 16, 0.3
#: Bits of a language's weight in a word's packed weights, and words whose weights a process keeps before it starts anew.
SHIFT, WORDS_KEPT = 40, 300_000
#: Labels that name no language, and how many documents of the sample a language must have.
NO_LANGUAGE, LEAST_DOCUMENTS = ("und", "unknown", "none", "mul", "zxx"), 5

def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def prose(text: str) -> str:
    """``text`` without fenced code."""
    return FENCED.sub(" ", text) if "```" in text else text


#: Words that are no part of an address, a path or a name with digits, and no longer than words are; Han characters one by one.
_PLAIN = re.compile(r"(?<![\w.@/-])[^\W\d_㐀-鿿]{1,64}(?![\w@/-]|\.\w|://)|[㐀-鿿]")


def sequences_of(word: str) -> list[int]:
    """Numbers of the sequences of up to LONGEST characters within and at the ends of a word."""
    w = f" {word} ".encode("utf-32-le", "surrogatepass")
    return [crc32(w[i : i + 4 * n]) % BUCKETS for n in range(1, LONGEST + 1) for i in range(0, len(w) - 4 * n + 1, 4)]


def counted(text: str, into: np.ndarray) -> None:
    """Add the sequences of the text's plain words to the counts."""
    for word, n in Counter(_PLAIN.findall(text.lower())).items():
        np.add.at(into, sequences_of(word), n)


class LanguageModel:
    """Log-probabilities of character sequences in each language. A process keeps the weights of the words it met."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = tuple(sorted(counts))
        smooth = np.stack([counts[x] + SMOOTHING for x in self.languages], axis=1)
        self.weights = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self._by_word: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_by_word": {}}

    def _weight(self, word: str) -> int:
        """The word's weight by language over its least one, in 16ths, packed into one number."""
        if len(self._by_word) > WORDS_KEPT:
            self._by_word.clear()
        w = self.weights[sequences_of(word)].sum(axis=0)
        packed = sum(int(x) << (SHIFT * i) for i, x in enumerate(np.rint((w - w.min()) * 16)))
        self._by_word[word] = packed
        return packed

    def evidence(self, text: str) -> tuple[list[float], int]:
        """The text's log-likelihood by language, on a scale of its own, and the number of plain words."""
        known, words = self._by_word, _PLAIN.findall(text.lower())
        total = sum([known.get(w) or self._weight(w) for w in words])
        return [((total >> (SHIFT * i)) & ((1 << SHIFT) - 1)) / 16 for i in range(len(self.languages))], len(words)

    def language(self, text: str | None) -> str:
        """The likeliest language, ``und`` for a text without plain words; fenced code counts only if there is nothing else."""
        for t in (prose(text), text) if text else ():
            weight, n = self.evidence(t)
            if n:
                return self.languages[weight.index(max(weight))]
        return "und"


def seeded() -> LanguageModel:
    """A model of the function words alone, for want of labelled documents; Han characters are Chinese."""
    text = {**FUNCTION_WORDS, "zh": " ".join(chr(c) for c in range(0x4E00, 0x9FA6))}
    counts = {k: np.zeros(BUCKETS) for k in text}
    for k, t in text.items():
        counted(t, counts[k])
    return LanguageModel(counts)


def fit_languages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = LANGUAGE_SAMPLE) -> LanguageModel:
    """A model of the languages that ``lang`` names, fitted on whole texts of a bounded sample of labelled rows.

    Labels differ neither by case nor by a region behind a hyphen. Languages with fewer than LEAST_DOCUMENTS rows in the
    sample are left out; without any other than one, the model is that of :func:`seeded`. Sequences are counted where
    the rows are: the driver gets one number for each sequence and language.
    """
    label = F.lower(F.regexp_extract(F.trim(F.col(lang)), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    rows = docs.select(key, F.col(text).alias("t"), label.alias("label")).where((F.col("label") != "") & ~F.col("label").isin(*NO_LANGUAGE) & F.col("t").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counted(prose(t), counts.setdefault(name, np.zeros(BUCKETS, np.int64)))
                docs_of[name] = docs_of.get(name, 0) + 1
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[docs_of[name], c[at]])], names=["label", "at", "n"])

    found = bounded_sample(rows, key, sample).select("t", "label").mapInArrow(run, "label string, at long, n long").groupBy("label", "at").agg(F.sum("n").alias("n"))
    table: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    got = found.toArrow()  # BUCKETS numbers a language at the most
    names = np.array(got.column("label").to_pylist(), dtype=object)
    at, n = (got.column(c).to_numpy() for c in ("at", "n"))
    for name in set(names):
        mine = names == name
        documents[name] = int(n[mine & (at < 0)].sum())
        table[name] = np.zeros(BUCKETS)
        table[name][at[mine & (at >= 0)]] = n[mine & (at >= 0)]
    kept = {k: v for k, v in table.items() if documents.get(k, 0) >= LEAST_DOCUMENTS}
    return LanguageModel(kept) if len(kept) > 1 else seeded()


def language_report(docs: DataFrame, model: LanguageModel, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """By label, in one spelling, and language found: documents. Null labels count as ``(none)``."""
    label = F.coalesce(F.lower(F.trim(F.col(lang))), F.lit("(none)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.language(t) for t in batch.column(1).to_pylist()], pa.string())], names=["label", "language"])

    return docs.select(label.alias("label"), F.col(text).alias("t")).mapInArrow(run, "label string, language string").groupBy("label", "language").agg(F.count("*").alias("n_docs"))


def role(col: Column) -> Column:
    """A role in one spelling; null stays null."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def name_key(col: Column) -> Column:
    """A name's letters and digits in order, without case and character width; null if it has none."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.nullif(F.regexp_replace(F.lower(F.translate(col, wide, plain)), r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def contents(messages: Column, *, without: tuple[str, ...] = (), sep: str = " ") -> Column:
    """All contents of a conversation in order, null contents as empty; an empty text for null messages."""
    kept = F.filter(messages, lambda m: ~F.coalesce(role(m["role"]).isin(*without), F.lit(False))) if without else messages
    return F.coalesce(F.array_join(F.transform(kept, lambda m: F.coalesce(m["content"], F.lit(""))), sep), F.lit(""))
