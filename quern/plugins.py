"""What can be exchanged: counters, embedders, rerankers, parsers, providers. The defaults are deterministic and stay in the JVM.

A part is a function over columns or DataFrames, found by name. One that needs a model registers a function that maps over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval as R
from quern.sources import trees


class TokenCounter(Protocol):
    def __call__(self, text: Column) -> Column: ...


class EmbeddingModel(Protocol):
    def __call__(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, bucket, weight): vectors of length one, sparse."""


class Reranker(Protocol):
    def __call__(self, query: Column, text: Column) -> Column: ...


class DocumentParser(Protocol):
    def __call__(self, sources: DataFrame) -> DataFrame:
        """Nodes of source rows."""


class AnswerProvider(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame:
        """prompts (…, prompt, evidence) with response, tokens_in, tokens_cached and tokens_out."""


class BenchmarkDataset(Protocol):
    def questions(self) -> DataFrame: ...

    def documents(self) -> DataFrame: ...


def stub_provider(prompts: DataFrame) -> DataFrame:
    """Answers with the first words of the first item, or the marker without evidence: for tests and dry runs."""
    words = F.array_join(F.slice(F.filter(F.split(F.regexp_replace("evidence", "<[^>]*>", " "), r"\s+"), lambda w: w != ""), 1, 5), " ")
    answer = F.when(words == "", "INSUFFICIENT_EVIDENCE").otherwise(words)
    cited = F.when(words == "", F.array().cast("array<string>")).otherwise(F.array(F.lit("E1")))
    response = F.to_json(F.struct(answer.alias("answer"), cited.alias("citations")))
    return prompts.withColumns({"response": response, "tokens_in": T.word_count(F.col("prompt")), "tokens_cached": F.lit(0).cast("long"), "tokens_out": T.word_count(response)})


_PARTS: dict[str, dict[str, Callable]] = {
    "counter": {"words-v1": T.word_count, "characters-v1": lambda text: F.length(F.coalesce(text, F.lit(""))).cast("long")},
    "embedder": {"hash-256": R.hash_vectors, "hash-64": lambda texts, key, text: R.hash_vectors(texts, key, text, 64)},
    "reranker": {"lexical-overlap-v1": R.lexical},
    "parser": {"lines-v1": trees.document_nodes, "html-v1": trees.page_nodes, "turns-v1": trees.conversation_nodes},
    "provider": {"stub-v1": stub_provider},
}


def register(kind: str, name: str, part: Callable) -> None:
    if name in _PARTS[kind]:
        raise ValueError(f"there is a {kind} named {name}")
    _PARTS[kind][name] = part


def get(kind: str, name: str) -> Callable:
    try:
        return _PARTS[kind][name]
    except KeyError:
        raise ValueError(f"no {kind} is named {name}; there are {', '.join(sorted(_PARTS.get(kind, {})))}") from None
