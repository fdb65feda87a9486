"""Cache-first scoring: each question is asked once, in packs, and a refusal is an answer that is kept as well.

Questions (input, type, instructions, choices) have a key: of a predicate the given text and the instructions, of a choice
its type and choices too, in their order. Keys that the cache holds are answered from it. Of the others one question for
each key is dealt by ranges of (input, key), so that an input with any number of questions spreads over tasks, and a task
asks consecutive questions of one input together, at most `pack` in a request. Answers are staged, put in the cache once,
and joined back to all questions of their key.

The scorer is called in tasks: scorer(input, [question, ...]) -> [answer, ...], where a question is a dict of type,
instructions and choices, and an answer is a probability (predicate), a list of them (choice) or None (refused). A lost
task's requests are sent again; what is cached is one answer for each key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.text import question_key, sha256_hex
from lumenlog.sources.commits import KeyedTable
from lumenlog.sources.staging import staged

PACK = 200
CACHE_SCHEMA = "key string, p array<double>"


def key() -> Column:
    """The cache key of rows (input, type, instructions, choices); another type is an error."""
    body = F.to_json(F.struct("input", "type", "instructions", "choices"))
    wrong = F.raise_error(F.concat(F.lit("unsupported question type "), F.col("type"))).cast("string")
    return F.when(F.col("type") == "predicate", question_key(F.col("input"), F.col("instructions"))).when(F.col("type") == "choice", sha256_hex(body)).otherwise(wrong)


def _checked(question: dict, answer: object) -> list[float] | None:
    """An answer as probabilities; one of another shape or range is an error."""
    if answer is None:
        return None
    got = [float(x) for x in (answer if question["type"] == "choice" else [answer])]
    if question["type"] == "choice" and len(got) != len(question["choices"]) or not all(math.isfinite(x) and 0 <= x <= 1 for x in got):
        raise ValueError(f"invalid answer {answer!r} to {question}")
    return got


def _asked(scorer: Callable, pack: int):
    def ask(rows: list) -> pd.DataFrame:
        questions = [{"type": r.type, "instructions": r.instructions, "choices": None if r.choices is None else list(r.choices)} for r in rows]
        answers = list(scorer(rows[0].input, questions))
        if len(answers) != len(questions):
            raise ValueError(f"{len(answers)} answers to {len(questions)} questions")
        return pd.DataFrame({"key": [r.key for r in rows], "p": [_checked(q, a) for q, a in zip(questions, answers, strict=True)], "asked_with": len(rows)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for b in batches:
            for r in b.itertuples(index=False):
                if held and (held[0].input != r.input or len(held) == pack):
                    yield ask(held)
                    held = []
                held.append(r)
        if held:
            yield ask(held)

    return run


def score(questions: DataFrame, cache: KeyedTable, scorer: Callable, pack: int = PACK) -> DataFrame:
    """questions with key, p (the probabilities; null: refused), cached (whether the answer was held before) and asked_with, its request's questions."""
    if not 1 <= pack <= PACK:
        raise ValueError(f"pack must be in [1, {PACK}]")
    keyed = staged(questions.withColumn("key", key()), "questions")
    base = cache.snapshot().version
    held = cache.read(base) if base else cache.read()
    first = F.min(F.struct("input", "type", "instructions", "choices")).alias("q")
    pending = keyed.groupBy("key").agg(first).join(held.select("key"), "key", "left_anti").select("key", "q.*")
    dealt = pending.repartitionByRange("input", "key").sortWithinPartitions("input", "key")
    new = staged(dealt.mapInPandas(_asked(scorer, pack), "key string, p array<double>, asked_with int"), "answers")
    cache.insert_or_ignore(new.select("key", "p"), value="p")
    answers = held.select("key", "p", F.lit(True).alias("cached"), F.lit(None).cast("int").alias("asked_with")).union(new.select("key", "p", F.lit(False), "asked_with"))
    return keyed.join(answers, "key")
