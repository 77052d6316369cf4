"""The k best of a group of vectors for a group of queries: one matrix product finds what can be among them, and only that is compared exactly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spindle.functions import score as S

#: Rounding to S.DIGITS and the order of a product's sums move a cosine by less than this; queries that are compared at once; most vectors and queries of a group.
OFF, AT_ONCE, ROWS, ASKED = 1e-8, 256, 20_000, 8192


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines row by row, summed from the first element on as `score.dot` does."""
    total = lambda a, b: np.add.accumulate(a * b, axis=1)[:, -1]
    return total(x, q) / (np.sqrt(total(x, x)) * np.sqrt(total(q, q)))


def best_in_group(vectors: pd.DataFrame, queries: pd.DataFrame, key: list[str], k: int, able: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pd.DataFrame:
    """(query_id, key, score) among which are the k best of each query in the group, ties by key; scores aren't rounded. vectors: key, embedding; queries: query_id, vector.
    able(rows of queries, rows of vectors): which pairs count."""
    sizes, asked_sizes = (c.map(len).to_numpy() for c in (vectors["embedding"], queries["vector"]))
    found = [pd.DataFrame({"query_id": queries["query_id"][:0], **{c: vectors[c][:0] for c in key}, "score": np.zeros(0)})]
    for size in np.intersect1d(sizes, asked_sizes):
        own, asked = np.flatnonzero(sizes == size), np.flatnonzero(asked_sizes == size)
        x = np.stack(vectors["embedding"].to_numpy()[own]).astype(float)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for at in range(0, len(asked), AT_ONCE):
            some = asked[at : at + AT_ONCE]
            q = np.stack(queries["vector"].to_numpy()[some]).astype(float)
            near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T
            near[np.isnan(near)] = np.inf  # not a number is above all numbers
            if able:
                near[~able(some, own)] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(some), -np.inf)
            i, j = np.nonzero(near >= np.maximum(least - OFF, -OFF)[:, None])
            hits = pd.DataFrame({"query_id": queries["query_id"].to_numpy()[some[i]], **{c: vectors[c].to_numpy()[own[j]] for c in key}})
            hits["score"] = np.concatenate([np.zeros(0), *[_exact(x[j[n : n + ROWS]], q[i[n : n + ROWS]]) for n in range(0, len(i), ROWS)]])
            if len(hits) > 4 * k * len(some):  # of copies, the first by key
                hits = hits.sort_values(key).groupby(["query_id", "score"], dropna=False).head(k)
            found.append(hits)
    return pd.concat([f for f in found if len(f)] or found)


def hits_schema(queries: DataFrame, vectors: DataFrame, key: list[str]) -> StructType:
    return StructType([queries.schema["query_id"], *[vectors.schema[c] for c in key], StructField("score", DoubleType())])


def rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", S.DIGITS)).where("score > 0")


def dense_best(vectors: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """The rows of `search.dense` (query_id, key, score) among which are the k best of each query. Groups of both tables are compared with each other, so
    a task holds ROWS vectors and ASKED queries, whatever the tables' sizes. vectors: key, embedding; queries: query_id, vector."""
    length = lambda c: F.sqrt(S.dot(F.col(c), F.col(c)))
    vectors = vectors.select(*key, "embedding").where(length("embedding") > 0)
    queries = queries.select("query_id", "vector").where(length("vector") > 0)
    parts, blocks = (max(1, -(-n // most)) for n, most in ((vectors.count(), ROWS), (queries.count(), ASKED)))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("part", own(parts, *key)).withColumn("block", every(blocks))
    right = queries.withColumn("block", own(blocks, "query_id")).withColumn("part", every(parts))
    compare = lambda v, q: best_in_group(v, q, key, k)
    hits = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(compare, hits_schema(queries, vectors, key))
    return rounded(hits)
