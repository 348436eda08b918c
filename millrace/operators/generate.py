"""Synthetic dialogs: tables made of a range of numbers, a category by weight, and pools of words.

Every choice is a hash of the row's number and a seed, so that a table is the same on any number of partitions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.prefix import ROWS_A_BUCKET, bits_for, prefix
from millrace.operators.splits import weighted_choice
from millrace.session import materialize

# Categories of the two generators and their weights.
SEMANTIC = (
    ("relation", 12), ("chase", 6), ("state", 8), ("state_adj", 6), ("why", 8), ("why_animal", 6), ("negation", 6), ("implied", 5), ("transitive", 10), ("arithmetic", 16),
    ("complete", 6), ("say_word", 6), ("sound", 5), ("single_fact", 6), ("location", 4), ("identity", 4), ("sun", 18), ("owns", 8), ("comparison", 5), ("is_animal", 5),
)
BINDING = (
    ("single_fact", 14), ("multi_fact", 14), ("distractor", 12), ("relation_reversal", 12), ("paraphrase", 12), ("pronoun", 10),
    ("multi_hop", 10), ("sentence_order", 8), ("generalization", 8), ("negation", 6), ("contrastive_binding", 12), ("location_state", 6),
)
BENCHMARK = ("single_fact", "multi_fact", "distractor", "relation_reversal", "paraphrase", "pronoun", "multi_hop", "sentence_order", "entity_generalization", "distractor_binding")

#: Pools of names for training and for the benchmark; no name stands in both, which :func:`guard_names` sees to.
NAMES = {
    "name": "Ada Bruno Celia Dario Edith Fadil Greta Hugo Ines Jonas Kaja Lorenz Mina Nils Oda Pavel".split(),
    "other": "Quentin Rosa Selim Tilda Ursin Vera Wim Xenia Yannis Zelda".split(),
    "third": "Anouk Bela Cosima Dorian Elva Falk Gesa Henrik".split(),
}
HELD_NAMES = {
    "name": "Alba Boris Clea Dunja Emil Frida Goran Hilde".split(),
    "other": "Ivo Jana Kilian Luzia Marek Nadja Orla Piet".split(),
    "third": "Romy Sven Thekla Ulf Viola Wanda".split(),
}
_THINGS = {
    "object": "lantern ladder kettle basket violin compass blanket mirror hammer satchel".split(),
    "second": "bucket teapot scarf drum ruler umbrella".split(),
    "color": "red blue green yellow black white purple orange".split(),
    "place": ["the garden", "the kitchen", "the workshop", "the cellar", "the yard", "the attic"],
    "animal": "fox heron otter badger hare owl".split(),
    "prey": "mouse frog moth beetle".split(),
    "sound": "barks howls hoots squeaks".split(),
    "state": "asleep awake hungry calm tired".split(),
    "weather": "windy cold warm foggy".split(),
    "reason": ["it was raining", "the door was shut", "the lamp was broken", "they were late"],
    "when": ["In the morning", "After lunch", "Before dinner", "Late at night", "At noon", "On the way home"],
}
POOLS = {**NAMES, **_THINGS}
HELD_OUT = {**HELD_NAMES, **_THINGS}

# Sentence patterns by category: context and question, and answer. {x} is drawn from pool x, {an x} and {An x} put the
# article before it; {n} and {m} are numbers, {n+m} their sum, and {more} is who of name and other has more.
PATTERNS = {
    "relation": (("{name} is the teacher of {other}. Who is the teacher of {other}?", "{name}."), ("{other} has a teacher, and it is {name}. Who teaches {other}?", "{name}.")),
    "chase": (("The {animal} chased the {prey}. What did the {animal} chase?", "The {prey}."), ("{when} the {animal} ran behind the {prey}. What ran behind the {prey}?", "The {animal}.")),
    "state": (("{name} is {state}. How is {name}?", "{name} is {state}."), ("{when} {name} was {state}. Was {name} {state}?", "Yes.")),
    "state_adj": (("The {object} is {color}. What color is the {object}?", "{color}."), ("Somebody painted the {object} {color}. Which color has it now?", "{color}.")),
    "why": (("{name} stayed at home because {reason}. Why did {name} stay at home?", "Because {reason}."), ("As {reason}, {name} turned back. What made {name} turn back?", "That {reason}.")),
    "why_animal": (("The {animal} hid because {reason}. Why did the {animal} hide?", "Because {reason}."), ("As {reason}, the {animal} slept in {place}. Why did it sleep there?", "Because {reason}.")),
    "negation": (("{name} does not own {an object}. Does {name} own {an object}?", "No."), ("{name} has no {second}, only {an object}. Does {name} have {an object}?", "Yes.")),
    "implied": (("{name} left {place} with the {object}. Is the {object} in {place}?", "No."), ("{name} put the {object} in {place} and went away. Is the {object} in {place}?", "Yes.")),
    "transitive": (("{name} is taller than {other}, and {other} is taller than {third}. Is {name} taller than {third}?", "Yes."), ("{name} is older than {other}, and {other} is older than {third}. Who is the youngest?", "{third}.")),
    "arithmetic": (("What is {n} + {m}?", "{n+m}"), ("{name} has {n} coins and finds {m} more. How many are there now?", "{n+m}")),
    "complete": (("Complete: the {color} {object} is in", "{place}."), ("Complete: {name} carried the {object} to", "{place}.")),
    "say_word": (("Say the word {object}.", "{object}"), ("Repeat after me: {object}.", "{object}")),
    "sound": (("The {animal} {sound}. Which animal {sound}?", "The {animal}."), ("{when} the {animal} {sound}. What does the {animal} do?", "It {sound}.")),
    "single_fact": (("{name} has {an color} {object}. What does {name} have?", "{An color} {object}."), ("There is {an color} {object} with {name}. Who has the {object}?", "{name}.")),
    "location": (("The {object} is in {place}. Where is the {object}?", "In {place}."), ("{when} the {object} was seen in {place}. Where was it seen?", "In {place}.")),
    "identity": (("My name is {name}. What is my name?", "{name}."), ("I am {name} and you are {other}. Who are you?", "{other}.")),
    "sun": (("{when} {name} asked where the sun rises. Where does it rise?", "In the east."), ("{when} {name} asked where the sun sets. Where does it set?", "In the west."), ("{name} looks at the rising sun. Which way does {name} look?", "East."), ("{name} walks towards the setting sun. Which way does {name} walk?", "West.")),
    "owns": (("The {object} belongs to {name}. Who owns the {object}?", "{name}."), ("{name} owns the {object}, {other} the {second}. Who owns the {second}?", "{other}.")),
    "comparison": (("{name} has {n} coins and {other} has {m}. Who has more coins?", "{more}"), ("{other} counted {m} steps, {name} counted {n}. Who counted more?", "{more}")),
    "is_animal": (("Is {an animal} an animal?", "Yes."), ("Is {an object} an animal?", "No.")),
    "multi_fact": (("{name} has {an color} {object}. {other} has {an second}. What does {other} have?", "{An second}."), ("{other} brought {an second}, and {name} brought {an object}. What did {name} bring?", "{An object}.")),
    "distractor": (("{name} has {an object}. It was {weather} outside. What does {name} have?", "{An object}."), ("{when} it was {weather}. {name} found {an second}. What did {name} find?", "{An second}.")),
    "relation_reversal": (("{name} gave {other} {an object}. Who got the {object}?", "{other}."), ("{other} got {an second} from {name}. Who gave the {second}?", "{name}.")),
    "paraphrase": (("The owner of the {color} {object} is {name}. Who has the {color} {object}?", "{name}."), ("It is {name} to whom the {second} belongs. Whose {second} is it?", "{name}.")),
    "pronoun": (("{name} bought {an object}. They put it in {place}. Who bought the {object}?", "{name}."), ("{name} met {other} in {place} and gave them {an second}. Who has the {second} now?", "{other}.")),
    "multi_hop": (("{name} gave the {object} to {other}. {other} took it to {place}. Where is the {object}?", "In {place}."), ("{name} lent the {object} to {other}, who lent it to {third}. Who has the {object}?", "{third}.")),
    "sentence_order": (("{other} came after {name}. Who came first?", "{name}."), ("Before {name} arrived, {other} had left. Who was there earlier?", "{other}.")),
    "generalization": (("{name} keeps {an second} in {place}. What is in {place}?", "{An second}."), ("In {place} stands {an second} of {name}. Whose {second} is it?", "{name}.")),
    "contrastive_binding": (("{name} has the {color} {object}; {other} has the {second}. Who has the {second}?", "{other}."), ("Not {other} but {name} has the {object}. Who has it?", "{name}.")),
    "location_state": (("{name} left the {color} {object} in {place}. Where is the {object}?", "In {place}."), ("{name} is {state} in {place}. Where is {name}?", "In {place}.")),
    "entity_generalization": (("{name} keeps {an object} in {place}. Who keeps {an object}?", "{name}."), ("In {place} {other} stores {an second}. Who stores {an second}?", "{other}.")),
    "distractor_binding": (("{name} has {an object} and {other} has {an second}. What does {name} have?", "{An object}."), ("It was {weather}. {other} has {an second}, {name} {an object}. What does {other} have?", "{An second}.")),
}


def uniform(key: Column, choice: str, seed: int) -> Column:
    """A number in [0, 1) by row and choice."""
    return F.pmod(F.xxhash64(key, F.lit(choice), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def pick(pool: Sequence[str], key: Column, choice: str, seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (F.floor(uniform(key, choice, seed) * len(pool)) + 1).cast("int"))


def number(low: int, high: int, key: Column, choice: str, seed: int) -> Column:
    return (F.floor(uniform(key, choice, seed) * (high - low + 1)) + low).cast("int")


def _fill(pattern: str, words: dict[str, Column]) -> Column:
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"[{}]", pattern)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
            continue
        article, _, pool = piece.rpartition(" ")
        if article:
            vowel = F.lower(F.substring(words[pool], 1, 1)).isin(*"aeiou")
            parts.append(F.when(vowel, F.lit(article + " ")).otherwise(F.lit(article[:1] + " ")))
        parts.append(words[pool])
    return F.concat(*parts)


def _words(pools: dict[str, list[str]], key: Column, seed: int) -> dict[str, Column]:
    words = {p: pick(v, key, p, seed) for p, v in pools.items()}
    n, m = number(10, 89, key, "a", seed), number(10, 89, key, "b", seed)
    more = F.when(n > m, F.concat(words["name"], F.lit("."))).when(n < m, F.concat(words["other"], F.lit("."))).otherwise(F.lit("They are even."))
    return words | {"n": n.cast("string"), "m": m.cast("string"), "n+m": (n + m).cast("string"), "more": more}


def _said(categories: Sequence[str], category: Column, words: dict[str, Column], key: Column, seed: int) -> tuple[Column, Column]:
    """Question and answer of the row's category, in one of its phrasings."""
    u = uniform(key, "phrasing", seed)
    question, answer = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in categories:
        ways = PATTERNS[c]
        for i, (q, r) in enumerate(ways):
            mine = (category == c) & (F.floor(u * len(ways)) == i)
            question, answer = F.when(mine, _fill(q, words)).otherwise(question), F.when(mine, _fill(r, words)).otherwise(answer)
    return question, answer


def dialogs(spark: SparkSession, n: int, weights: Sequence[tuple[str, int]], *, seed: int = 42, plain: float = 0.0, attempts: int = 4, pools: dict[str, list[str]] | None = None) -> DataFrame:
    """At most ``n`` distinct dialogs: category, question, answer, text.

    ``attempts`` times as many are drawn, repeated texts dropped and the first ``n`` by number kept. A share of ``plain``
    texts goes without the speaker's mark before the question. Pools that share a name with the benchmark's are refused.
    """
    pools = pools or POOLS
    guard_names(pools, HELD_NAMES)
    key = F.col("id")
    rows = spark.range(n * attempts).withColumn("category", weighted_choice(weights, uniform(key, "category", seed)))
    question, answer = _said([c for c, _ in weights], F.col("category"), _words(pools, key, seed), key, seed)
    rows = rows.select("id", "category", question.alias("question"), answer.alias("answer"))
    text = F.concat(F.when(uniform(key, "plain", seed) < plain, "").otherwise("User: "), "question", F.lit("\nAssistant: "), "answer")
    distinct = rows.withColumn("text", text).groupBy("text").agg(F.min(F.struct("id", "category", "question", "answer")).alias("r"))
    rows = distinct.select("r.*", "text")
    if n > ROWS_A_BUCKET:  # a rank in buckets, for a limit would gather all rows in one task
        rows = materialize(rows, "dialogs")
        bits = bits_for(n)
        bucket = (F.col("id") * (1 << bits) / F.lit(n * attempts)).cast("int")
        return prefix(rows, [], bucket, ["id"], rank="__rank").where(F.col("__rank") <= n).drop("__rank")
    return rows.orderBy("id").limit(n)


def binding_benchmark(spark: SparkSession, per_category: int = 60, *, seed: int = 7, pools: dict[str, list[str]] | None = None) -> DataFrame:
    """``per_category`` rows of each benchmark category, with held-out names: category, prompt, keywords.

    Pools that share a name with the training's are refused.
    """
    pools, key = pools or HELD_OUT, F.col("id")
    guard_names(NAMES, {p: v for p, v in pools.items() if p in HELD_NAMES})
    rows = spark.range(per_category * len(BENCHMARK)).withColumn("category", F.element_at(F.array(*[F.lit(c) for c in BENCHMARK]), (F.expr(f"id div {per_category}") + 1).cast("int")))
    prompt, said = _said(BENCHMARK, F.col("category"), _words(pools, key, seed), key, seed)
    keys = F.filter(F.split(F.lower(F.regexp_replace(said, r"[.]", "")), " "), lambda w: ~w.isin("a", "an", "in", "the"))
    return rows.select("id", "category", prompt.alias("prompt"), keys.alias("keywords"))


def arithmetic(spark: SparkSession, n: int, *, seed: int = 42) -> DataFrame:
    """``n`` additions and ``n`` subtractions of two-digit numbers."""
    key = F.col("id")
    a, b, c, d = number(10, 89, key, "a", seed), number(10, 89, key, "b", seed), number(20, 98, key, "c", seed), number(10, 19, key, "d", seed)
    say = lambda x, op, y, z: F.concat(F.lit("User: What is "), x.cast("string"), F.lit(f" {op} "), y.cast("string"), F.lit("?\nAssistant: "), z.cast("string"))
    both = F.array(F.struct(F.lit("addition").alias("kind"), say(a, "+", b, a + b).alias("text")), F.struct(F.lit("subtraction").alias("kind"), say(c, "-", d, c - d).alias("text")))
    return spark.range(n).select("id", F.inline(both))


def guard_names(training: dict[str, list[str]], held: dict[str, list[str]]) -> None:
    """Raise if a training pool and one of the benchmark's share a name."""
    both = {n for p in NAMES for n in training.get(p, ())} & {n for v in held.values() for n in v}
    if both:
        raise ValueError(f"names of the benchmark in the training pools: {sorted(both)}")


def names_in(df: DataFrame, text: str) -> DataFrame:
    """The distinct names of any pool that a column of generated texts holds."""
    known = sorted({n for pools in (NAMES, HELD_NAMES) for v in pools.values() for n in v})
    found = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\p{Lu}\p{Ll}+"), 0)).alias("name"))
    return found.where(F.col("name").isin(*known)).distinct()


def shared_names(training: DataFrame, held: DataFrame, text: str = "text", prompt: str = "prompt") -> DataFrame:
    """Names that generated training texts and benchmark prompts both hold; there must be none."""
    return names_in(training, text).intersect(names_in(held, prompt))


def category_counts(generated: DataFrame) -> DataFrame:
    return generated.groupBy("category").agg(F.count("*").alias("n"))


def teach(df: DataFrame, prompt: str, answer: Callable[[str], str], *, out: str = "response") -> DataFrame:
    """``df`` with the replies of a teacher: a function from prompt to reply that runs on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [answer(p or "") for p in pdf[prompt]]})

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"]))


def replay(replies: Sequence[str]) -> Callable[[int], Column]:
    """A teacher that gives recorded replies in turn, by row number from 0."""
    pool = F.array(*[F.lit(r) for r in replies])
    return lambda i: F.element_at(pool, (F.pmod(i, F.lit(len(replies))) + 1).cast("int"))
