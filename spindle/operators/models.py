"""Model interfaces, stand-ins without a network, and query rewriting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class Rewriter(Protocol):
    def rewrite(self, query: str) -> list[str]: ...


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class DocParser(Protocol):
    def parse(self, name: str, content: bytes) -> str: ...


class HashEmbedder:
    """Vectors from a 64-bit string hash, for tests."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    @staticmethod
    def _wrap(x: int) -> int:
        x &= (1 << 64) - 1
        return x - (1 << 64) if x >> 63 else x

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            h = 5381
            for c in text:
                h = self._wrap(h * 33 + ord(c))
            vector = []
            for j in range(self.dim):
                vector.append((abs(h) % 256) * (-1 if h < 0 else 1) / 256)
                h = self._wrap(h * 31 + j)
            out.append(vector)
        return out


class OverlapReranker:
    """Share of the query's distinct words that a text contains, for tests."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [sum(w in t.lower() for w in words) / len(words) if words else 0.0 for t in texts]


def overlap_score(query: Column, text: Column) -> Column:
    """OverlapReranker as an expression."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    inside = F.filter(words, lambda w: F.contains(F.lower(text), w))
    return F.when(F.size(words) > 0, F.size(inside) / F.size(words)).otherwise(F.lit(0.0))


def embedded(rows: DataFrame, embedder: Embedder, text: str = "content", batch_tokens: int = 6000) -> DataFrame:
    """Adds vector. Texts go to the model in batches of about batch_tokens (four characters a token)."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            batch: list[str] = []
            size = 0
            for t in texts.fillna(""):
                if batch and size + len(t) // 4 > batch_tokens:
                    out += embedder.embed(batch)
                    batch, size = [], 0
                batch.append(t)
                size += len(t) // 4
            yield pd.Series(out + (embedder.embed(batch) if batch else []))

    return rows.withColumn("vector", run(F.col(text)))


def embedded_new(texts: DataFrame, embedder: Embedder, batch_tokens: int = 6000) -> DataFrame:
    """(digest, vector) of texts (digest, text). Requests of about batch_tokens are filled across a partition's Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str]] = []
        size = 0

        def asked() -> pd.DataFrame:
            vectors = embedder.embed([t for _, t in held])
            if len(vectors) != len(held):
                raise ValueError("the model gave another number of vectors")
            return pd.DataFrame({"digest": [d for d, _ in held], "vector": [list(map(float, v)) for v in vectors]})

        for part in parts:
            for digest, text in zip(part["digest"], part["text"], strict=True):
                if held and size + len(text) // 4 > batch_tokens:
                    yield asked()
                    held, size = [], 0
                held.append((digest, text))
                size += len(text) // 4
        if held:
            yield asked()

    return texts.select("digest", "text").mapInPandas(run, "digest string, vector array<double>")


class VectorCache:
    """Vectors by the SHA-256 of their text, in folders below path that a commit log names. A text is asked for once, whatever document it stands in."""

    def __init__(self, spark, path: str):
        from spindle.sources.commits import CommitLog

        self.spark, self.path, self.log = spark, path, CommitLog(spark, f"{path}/_versions")

    def vectors(self) -> DataFrame:
        """(digest, vector). Where two writers asked for one text at once, one of its vectors."""
        folders = self.log.read()[1].get("folders", [])
        if not folders:
            return self.spark.createDataFrame([], "digest string, vector array<double>")
        rows = self.spark.read.schema("digest string, vector array<double>").parquet(*[f"{self.path}/{f}" for f in folders])
        return rows if len(folders) == 1 else rows.groupBy("digest").agg(F.min("vector").alias("vector"))

    def embedded(self, rows: DataFrame, embedder: Embedder, text: str = "content", batch_tokens: int = 6000) -> DataFrame:
        """Adds vector (null for a null text). Only texts that no stored vector has go to the model; the first answer sets the dimension, and another one is an error."""
        digest = F.sha2(F.col(text), 256)
        asked = rows.where(F.col(text).isNotNull()).groupBy(digest.alias("digest")).agg(F.first(text).alias("text"))
        missing = asked.join(self.vectors(), "digest", "left_anti")
        folder = uuid.uuid4().hex
        embedded_new(missing, embedder, batch_tokens).write.parquet(f"{self.path}/{folder}")
        sizes = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if sizes[0]:
            def change(_: int, state: dict) -> dict:
                dim = state.setdefault("dim", sizes[1])
                if (dim, dim) != (sizes[1], sizes[2]):
                    raise ValueError(f"vectors of {sizes[1]} to {sizes[2]} numbers, not {dim}")
                return {**state, "folders": [*state.get("folders", []), folder]}

            self.log.update(change)
        key = "_digest"
        held = self.vectors().withColumnRenamed("digest", key)
        return rows.withColumn(key, digest).join(held, key, "left").drop(key)


def candidates(limit: int, asked: int = 0) -> int:
    """Hits that a reranker sees: as many as asked for, else twice the limit and 20 at least."""
    return asked if asked > 0 else max(2 * limit, 20)


def reranked(hits: DataFrame, reranker: Reranker, query: str = "query", text: str = "text", tie: list[str] = (), n: int = 100, batch: int = 20,
             vector: str | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """The n best hits of each query with the model's scores, best first. If the model fails: their vectors' cosine with query_vector where there are some, else
    the scores they had. One query's hits, n at most, are a group."""
    goal = None if query_vector is None else np.array(query_vector, np.float64)

    def cosine(v: object) -> float:
        v = np.zeros(0) if v is None else np.asarray(v, np.float64)
        length = np.linalg.norm(v) * np.linalg.norm(goal) if len(v) == len(goal) else 0.0
        return float(v @ goal / length) if length > 0 else 0.0

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", *tie], ascending=[False, *[True] * len(tie)], kind="stable").head(n)
        try:
            new: list[float] = []
            for i in range(0, len(group), batch):
                part = group.iloc[i : i + batch]
                got = reranker.rerank(part[query].iloc[0], part[text].fillna("").tolist())
                if len(got) != len(part):
                    raise ValueError("the model gave another number of scores")
                new += got
            group = group.assign(score=new)
        except Exception:  # any failure of an outside model
            if goal is not None and group[vector].notna().any():
                group = group.assign(score=[cosine(v) for v in group[vector]])
        return group.sort_values(["score", *tie], ascending=[False, *[True] * len(tie)], kind="stable")

    return hits.groupBy("query_id").applyInPandas(run, hits.schema)


#: Synonyms by term.
SYNONYMS = {
    "rag": ["retrieval augmented generation", "retrieval-augmented generation"],
    "retrieval": ["search", "retrieve"],
    "bm25": ["bm-25", "bm 25"],
    "reranker": ["re-ranker", "cross-encoder", "re-ranking"],
    "embedding": ["vector", "embed", "dense retrieval"],
    "chunk": ["segment", "fragment", "passage"],
    "chunking": ["segmentation", "splitting", "text splitting"],
    "llm": ["large language model", "language model"],
    "machine learning": ["ml"],
    "neural": ["neural network", "deep learning"],
    "knowledge": ["know"],
}


class SynonymRewriter:
    """The query, then variants with one term replaced, in the order of terms and synonyms."""

    def __init__(self, synonyms: dict[str, list[str]] | None = None):
        self.synonyms = {k: list(v) for k, v in (SYNONYMS if synonyms is None else synonyms).items()}

    def add(self, term: str, synonym: str) -> None:
        self.synonyms.setdefault(term.lower(), []).append(synonym.lower())

    def rewrite(self, query: str) -> list[str]:
        query = query.strip()
        if not query:
            return []
        swap = lambda old, new: re.sub(re.escape(old), lambda _: new, query, count=1, flags=re.I)
        out = [query]
        for term in sorted(t for t in self.synonyms if t in query.lower()):
            for other in self.synonyms[term]:
                out.append(swap(term, other))
                if other in query.lower():
                    out.append(swap(other, term))
        return list(dict.fromkeys(out))


class CompletionRewriter:
    """Variants from a language model, one a line; synonyms if it fails or gives none."""

    PROMPT = "Write three other ways to ask this search query, one per line:\n"

    def __init__(self, completer: Completer, fallback: Rewriter | None = None, prompt: str | None = None):
        self.completer, self.fallback, self.prompt = completer, fallback or SynonymRewriter(), prompt or self.PROMPT

    def rewrite(self, query: str) -> list[str]:
        try:
            lines = self.completer.complete(self.prompt + query).splitlines()
        except Exception:  # any failure of an outside model
            return self.fallback.rewrite(query)
        clean = [re.sub(r"^\s*(?:[-*•]|\d+[.)])?\s*|\s+$", "", x).strip("\"'“”") for x in lines]
        out = list(dict.fromkeys([query.strip(), *[c for c in clean if c]]))
        return out if len(out) > 1 else self.fallback.rewrite(query)


def merged_query(query: str, rewriter: Rewriter | None) -> str:
    return " ".join(rewriter.rewrite(query)) if rewriter else query


def variants(queries: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS, query: str = "query", reverse: bool = False) -> DataFrame:
    """(columns, variant): synonym variants of many queries; the table of synonyms is a constant. reverse: where a query holds a term
    and its synonym, also the synonym replaced by the term, as in SynonymRewriter."""
    low = F.lower(F.col(query))
    swap = lambda old, new: F.regexp_replace(F.col(query), F.concat(F.lit("(?is)^(.*?)"), F.lit(re.escape(old))), F.concat(F.lit("$1"), F.lit(new)))
    found = []
    for t in sorted(synonyms):
        for o in synonyms[t]:
            found.append(F.when(F.contains(low, F.lit(t)), swap(t, o)))
            if reverse:
                found.append(F.when(F.contains(low, F.lit(t)) & F.contains(low, F.lit(o)), swap(o, t)))
    every = F.array_distinct(F.array_compact(F.array(F.col(query), *found)))
    return queries.withColumn("variant", F.explode(every))

