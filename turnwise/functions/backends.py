"""Seams for models: scoring and splitting functions that run in Arrow batches, with a stated fallback.

A backend is any object with the methods named here; its absence never fails a query, it fills `fallback_reason`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class TextEmbedder(Protocol):
    """Embeds texts; `available` is asked once on the driver."""

    def available(self) -> bool: ...

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class PairScorer(Protocol):
    """Scores (query, passage) pairs between 0 and 1."""

    def available(self) -> bool: ...

    def score(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


class SentenceSplitter(Protocol):
    def split(self, text: str, language: str | None) -> Sequence[str]: ...


def embedded(df: DataFrame, text: str, backend: TextEmbedder | None) -> DataFrame:
    """Adds `embedding` and `fallback_reason`. Equal texts are embedded once and joined back."""
    if backend is None or not backend.available():
        return df.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("fallback_reason", F.lit("embedding_backend_unavailable"))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([list(map(float, v)) for v in backend.embed(texts.tolist())])

    once = df.select(F.col(text).alias("_text")).filter("_text is not null").distinct().withColumn("embedding", run("_text"))
    return df.join(once, F.col(text) == F.col("_text"), "left").drop("_text").withColumn("fallback_reason", F.lit(None).cast("string"))


def pair_scored(df: DataFrame, query: str, passage: str, backend: PairScorer | None) -> DataFrame:
    """Adds `semantic_score` and `fallback_reason`."""
    if backend is None or not backend.available():
        return df.withColumn("semantic_score", F.lit(None).cast("double")).withColumn("fallback_reason", F.lit("reranker_unavailable"))

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in parts:
            yield pd.Series(backend.score(list(zip(q.fillna(""), p.fillna("")))), dtype="float64")

    return df.withColumn("semantic_score", run(query, passage)).withColumn("fallback_reason", F.lit(None).cast("string"))


def register_splitter(spark: SparkSession, name: str, splitter: SentenceSplitter) -> None:
    """Registers a table function `name(text, language)` that returns a text's pieces with their numbers."""

    class Split:
        def eval(self, text: str, language: str):
            for k, piece in enumerate(splitter.split(text, language) if text else ()):
                yield k, piece

    spark.udtf.register(name, F.udtf(Split, returnType="piece_no: int, piece: string"))


Strategy = Callable[[DataFrame], DataFrame]


def first_available(*strategies: tuple[str, bool, Strategy]) -> tuple[str, Strategy]:
    """The first of (name, available, strategy) that is available; the last one must always be."""
    for name, available, strategy in strategies:
        if available:
            return name, strategy
    raise ValueError("the last strategy must be available")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, on the JVM; null for null or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
