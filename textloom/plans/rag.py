"""Prompts and answers from search results (rank, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview

# The wording of answers and prompts.
EMPTY = "I couldn't find any relevant information in the knowledge base."
NOTHING = "I couldn't find any relevant information about that topic in the knowledge base."
HEAD = "Based on the knowledge base, here's what I found:\n\n"
LEAST_BYTES = 50
TOP = 3


def _ordered(results: DataFrame, make: Callable[[Column, Column], Column], joiner: str, top: int = TOP) -> Column:
    """The first top results' strings in order of rank, joined."""
    picked = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "text"))))
    return F.array_join(F.transform(picked, lambda x: make(x["rank"], x["text"])), joiner)


def context(results: DataFrame) -> DataFrame:
    """One row: the top results as context paragraphs."""
    return results.where(F.col("rank") <= TOP).agg(_ordered(results, lambda _, t: F.concat(F.lit("[Context]: "), t), "\n\n").alias("context"))


def context_only(results: DataFrame) -> DataFrame:
    """One row: an answer made of the top results' previews."""
    listed = _ordered(results, lambda r, t: F.concat(r.cast("string"), F.lit(". "), preview(t, 200)), "\n\n")
    return results.where(F.col("rank") <= TOP).agg(F.trim(F.concat(F.lit(HEAD), listed)).alias("answer"))


def gate(results: DataFrame) -> DataFrame:
    """One row: whether there is anything to answer from: results, of 50 bytes or more on average."""
    mean = F.avg(F.octet_length("text"))
    return results.agg(F.count("*").alias("n"), F.coalesce(mean, F.lit(0.0)).alias("avg_bytes"), F.coalesce(mean >= LEAST_BYTES, F.lit(False)).alias("relevant"))


def prompt(question: str, context_text: str) -> str:
    return f"Context from knowledge base:\n{context_text}\n\nUser question: {question}" if context_text.strip() else question


def answer(results: DataFrame, question: str, model: Callable[[str], str] | None = None) -> str:
    """The answer to a question from at most a few results: the model's, or the results themselves without one."""
    state = gate(results).first()
    if not state["n"]:
        return EMPTY
    if not state["relevant"]:
        return NOTHING
    fallback = context_only(results).first()["answer"]
    if model is None:
        return fallback
    try:
        return model(prompt(question, context(results).first()["context"]))
    except Exception:  # the model is a plug-in: whatever it raises, the results are the answer
        return fallback
