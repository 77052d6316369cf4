"""Scores as Column expressions. All arithmetic is in doubles; results are rounded to DIGITS so that ties are ties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K, DIGITS = 1.2, 0.75, 60, 9
#: Words that speak for a conceptual query.
VERBS = (
    "is", "are", "was", "were", "has", "have", "had", "do", "does", "did", "can", "could", "will", "would", "shall", "should",
    "may", "might", "need", "want", "know", "use", "how", "why", "what", "which", "explain", "describe", "compare", "define",
    "list", "find", "show", "tell", "give", "write", "make", "get", "set", "create", "build", "generate", "implement", "configure",
)
ALPHA = {"conceptual": 0.4, "factual": 0.6, "balanced": 0.5}


def idf(df: Column, n: Column) -> Column:
    """A term's weight; above 0, as df is at most n."""
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column) -> Column:
    """A term's part of a BM25 score without its weight: below K1 + 1."""
    norm = F.when(average > 0, length / average).otherwise(F.lit(1.0))
    return F.when(length > 0, tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * norm))).otherwise(F.lit(0.0))


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """One term's part of a BM25 score."""
    idf = F.log(1.0 + (n - df + 0.5) / (df + 0.5))
    norm = F.when(average > 0, length / average).otherwise(F.lit(1.0))
    return F.when(length > 0, idf * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * norm))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if their sizes differ, or one is empty or all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def rrf(alpha: Column, sparse_rank: Column, dense_rank: Column) -> Column:
    """Reciprocal rank fusion; ranks count from 0, null adds nothing."""
    part = lambda w, r: F.coalesce(w / (RRF_K + r.cast("double")), F.lit(0.0))
    return part(alpha, sparse_rank) + part(1.0 - alpha, dense_rank)


def query_type(query: Column) -> Column:
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    n = F.size(words)
    verbs = F.size(F.filter(words, lambda w: w.isin(*VERBS)))
    nouns = F.size(F.filter(words, lambda w: ~w.isin(*VERBS) & (F.octet_length(w) > 3)))
    return (
        F.when(n < 2, F.lit("factual"))
        .when(F.rtrim(query).endswith("?"), F.lit("conceptual"))
        .when(verbs / n >= 0.25, F.lit("conceptual"))
        .when(nouns / n >= 0.6, F.lit("factual"))
        .otherwise(F.lit("balanced"))
    )


def alpha_of(kind: Column) -> Column:
    return F.when(kind == "conceptual", 0.4).when(kind == "factual", 0.6).otherwise(0.5)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays, as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
