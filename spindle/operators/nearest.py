"""The k best by cosine, exactly, without comparing every vector.

When vectors are stored, each goes to the nearest of some centres, and by its angle to that centre into a ring. Cells (a ring of a centre) keep the least and the largest angle in them.
Angles obey the triangle inequality: a vector at angle a to a centre and a query at angle t to it are at least |t - a| apart. A search first looks
into the cells that can hold the best, until they have enough vectors; the k-th best score there is a threshold. Then it looks into the other cells that can reach it, and compares of
their vectors those that can. Centres come from k-means over a bounded sample; where they lie changes how much is skipped, not what is found. In data without
any clusters little is skipped.

Large cells are dealt into parts by key, so that no task gets all of one, whatever a third of all vectors look like. Vectors of other sizes than most lie in a cell of their own, into
which every search looks. Null, empty and zero vectors, and those with null, NaN or infinite elements, have no cosine and are left out."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import score as S
from spindle.operators.search import top
from spindle.operators.vectors import best_in_group, hits_schema, rounded
from spindle.sources.store import kept

#: Most centres (else the root of the number of vectors), vectors that centres are fitted to for each, rings of a centre, vectors of a part; first cells hold FIRST * k vectors.
CLUSTERS, SAMPLE, RINGS, PART_ROWS, FIRST = 1024, 100, 8, 20_000, 4
#: The cell of vectors of other sizes; what angles may be off by.
LOOSE, SLACK = -1, 1e-6


def _length(c: str) -> Column:
    return F.sqrt(S.dot(F.col(c), F.col(c)))


def _centres(rows: DataFrame, key: list[str], clusters: int) -> tuple[int, np.ndarray]:
    """The size of most vectors, and unit vectors of the centres."""
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    if most is None:
        return 0, np.zeros((0, 0))
    k = max(2, min(clusters, math.isqrt(most.n)))
    draw = F.pmod(F.xxhash64(*key, F.lit("centres")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where((F.size("embedding") == most["size"]) & (draw <= max(SAMPLE * k, 2) / most.n))
    features = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if features.isEmpty():
        return most["size"], np.zeros((0, most["size"]))
    found = np.array(KMeans(k=k, seed=1, maxIter=10, distanceMeasure="cosine").fit(features).clusterCenters())
    norms = np.linalg.norm(found, axis=1)
    return most["size"], found[norms > 0] / norms[norms > 0, None]


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of vectors (rows of x, of any length above 0) to the centres."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.arccos(np.clip(x @ centres.T / np.linalg.norm(x, axis=1, keepdims=True), -1, 1))


def _widest(least: np.ndarray | float) -> np.ndarray:
    """The widest angle to a vector that can have a cosine of least."""
    return np.arccos(np.clip(least - SLACK, -1, 1)) + 1e-9


def write_cells(vectors: DataFrame, key: list[str], path: str, clusters: int = CLUSTERS) -> None:
    """Below path: centres (cluster, centre), rows (key, embedding, v_length, cell, part, angle) in the order of cells, and cells (cell, cluster, n, low, high, parts). vectors: (key, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(*key, "embedding").withColumn("v_length", _length("embedding")).where("v_length > 0 AND v_length < double('Infinity')")
    size, centres = _centres(rows, key, clusters)
    spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    @F.pandas_udf("cluster int, angle double")
    def place(found: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cluster": np.full(len(found), LOOSE, np.int32), "angle": np.zeros(len(found))})
        own = np.flatnonzero([len(v) == size and len(centres) > 0 for v in found])
        if len(own):
            angles = _angles(np.stack(found.to_numpy()[own]).astype(float), centres)
            out.loc[own, "cluster"] = angles.argmin(axis=1).astype(np.int32)
            out.loc[own, "angle"] = angles.min(axis=1)
        return out

    placed = kept(rows.withColumn("at", place("embedding")).select(*key, "embedding", "v_length", "at.cluster", "at.angle"), "placed")
    # a row a cluster
    cuts = placed.groupBy("cluster").agg(F.percentile_approx("angle", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("angle")))
    ringed = placed.join(F.broadcast(cuts), "cluster").withColumn("cell", F.when(F.col("cluster") == LOOSE, F.lit(LOOSE)).otherwise(F.col("cluster") * RINGS + ring)).drop("cuts")
    cells = ringed.groupBy("cell", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    cells.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")).coalesce(1).write.parquet(f"{path}/cells")
    parts = spark.read.parquet(f"{path}/cells").select("cell", "parts")
    dealt = ringed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(*key), F.col("parts")).cast("int")).drop("parts", "cluster")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartitionByRange(n, "cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/rows")


@dataclass(frozen=True)
class Cells:
    rows: DataFrame
    cells: DataFrame
    centres: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Cells:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("rows", "cells", "centres")])

    def chooser(self, k: int) -> Callable[[Column, Column], Column]:
        """Of a query vector and a threshold (null: the first cells), the cells to look into, best first: (cell, parts, t), t the angle of query and centre. What it knows of the cells
        goes along with it: at most CLUSTERS centres and CLUSTERS * RINGS cells."""
        centres = np.array([r.centre for r in self.centres.orderBy("cluster").collect()])
        known = self.cells.orderBy("cell").toPandas()
        cell, cluster, n, low, high, parts = (known[c].to_numpy() for c in ("cell", "cluster", "n", "low", "high", "parts"))
        size = centres.shape[1] if len(centres) else -1
        loose = cell == LOOSE

        def one(v: np.ndarray, least: float) -> list[dict]:
            t, bound = np.zeros(len(cell)), np.where(loose, 1.0, -2.0)
            if len(v) == size:
                t[~loose] = _angles(v[None], centres)[0][cluster[~loose]]
                gap = np.maximum(0, np.maximum(t - high, low - t))
                bound = np.where(loose, 1.0, np.cos(np.minimum(gap, np.pi)))
            order = np.argsort(-bound, kind="stable")
            if math.isnan(least):
                order = order[: np.searchsorted(np.cumsum(n[order]), FIRST * k) + 1]
                order = order[bound[order] > -2]
            else:
                order = order[bound[order] >= least - SLACK]
            return [{"cell": int(cell[i]), "parts": int(parts[i]), "t": float(t[i])} for i in order]

        @F.pandas_udf("array<struct<cell: int, parts: int, t: double>>")
        def choose(vectors: pd.Series, least: pd.Series) -> pd.Series:
            return pd.Series([one(np.asarray(v, float), float(x)) for v, x in zip(vectors, least.astype(float), strict=True)], dtype=object)

        return lambda vector, least: choose(vector, least)

    def met(self, asked: DataFrame, key: list[str]) -> DataFrame:
        """Pairs that are compared: asked (query_id, vector, q_length, least, look) with the vectors of the cells to look into, but for those whose angle says that they can't reach `least`."""
        pairs = asked.select("query_id", "vector", "q_length", "least", F.inline("look")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        able = F.col("least").isNull() | (F.col("cell") == LOOSE) | (F.cos(F.col("t") - F.col("angle")) >= F.col("least") - SLACK)
        # a query may look into all cells, so the pairs are far more than what is asked: they are never sent to all tasks
        return self.rows.join(pairs.hint("merge"), ["cell", "part"]).where(able)

    def best_met(self, asked: DataFrame, key: list[str], k: int) -> DataFrame:
        """(query_id, key, score) of the pairs of `met`, among which are the k best of each query. Cells are taken together to groups of about as many vectors as a part, and a
        query goes to a group once, with the cells of it that it looks into."""
        groups = max(1, -(-(self.cells.agg(F.sum("n")).first()[0] or 0) // PART_ROWS))
        of = F.pmod(F.col("cell"), F.lit(groups)).alias("of")
        looked = asked.select("query_id", F.inline("look")).select("query_id", of, "cell", "t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        looked = looked.groupBy("query_id", "of", "part").agg(F.collect_list("cell").alias("cells"), F.collect_list("t").alias("ts"))
        right = looked.join(asked.select("query_id", "vector", "least"), "query_id")
        left = self.rows.select(*key, "embedding", "cell", "part", "angle", of)

        def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            names, place = np.unique(v["cell"].to_numpy(), return_inverse=True)
            angle, loose = v["angle"].to_numpy(), v["cell"].to_numpy() == LOOSE
            t = np.full((len(q), len(names)), np.nan)
            for i, (cells, ts) in enumerate(zip(q["cells"], q["ts"], strict=True)):
                there = np.isin(cells, names)
                t[i, np.searchsorted(names, np.asarray(cells)[there])] = np.asarray(ts)[there]
            least = q["least"].astype(float).to_numpy()

            def able(asked_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
                to, low = t[asked_rows][:, place[rows]], least[asked_rows][:, None]
                return ~np.isnan(to) & (np.isnan(low) | loose[rows] | (np.cos(to - angle[rows]) >= low - SLACK))

            return best_in_group(v, q, key, k, able)

        hits = left.groupBy("of", "part").cogroup(right.groupBy("of", "part")).applyInPandas(compare, hits_schema(asked, self.rows, key))
        return rounded(hits)

    def best_rest(self, known: DataFrame, key: list[str], k: int) -> DataFrame:
        """`best_met` of all cells that a query (query_id, vector, seen, least) has not seen and that can reach `least`. A query may look into all cells, so they are never listed: it names the groups
        that have such a cell, a few numbers, and what it compares there is found in the group from the centres."""
        centres = np.array([r.centre for r in self.centres.orderBy("cluster").collect()])
        cells = self.cells.orderBy("cell").toPandas()
        cell, cluster, low, high, parts = (cells[c].to_numpy() for c in ("cell", "cluster", "low", "high", "parts"))
        size = centres.shape[1] if len(centres) else -1
        groups, most = max(1, -(-int(cells["n"].sum()) // PART_ROWS)), max(1, int(parts.max(initial=1)))
        loose = cell == LOOSE
        places = np.concatenate([np.zeros(0, int), *[c % groups * most + np.arange(p) for c, p in zip(cell, parts, strict=True)]]).astype(int)
        owner = np.repeat(np.arange(len(cell)), parts)

        def one(v: np.ndarray, least: float, seen: np.ndarray) -> list[int]:
            able = loose.copy()
            if len(v) == size:
                t = _angles(v[None], centres)[0][cluster[~loose]]
                able[~loose] = np.maximum(0, np.maximum(t - high[~loose], low[~loose] - t)) <= _widest(least)
            able &= ~np.isin(cell, seen)
            return np.unique(places[able[owner]]).tolist()

        @F.pandas_udf("array<int>")
        def places_of(vectors: pd.Series, least: pd.Series, seen: pd.Series) -> pd.Series:
            return pd.Series([one(np.asarray(v, float), x, np.asarray(s, int)) for v, x, s in zip(vectors, least, seen, strict=True)], dtype=object)

        def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            names, place = np.unique(v["cell"].to_numpy(), return_inverse=True)
            angle, single = v["angle"].to_numpy(), names == LOOSE
            seen = np.array([np.isin(names, np.asarray(s, int)) for s in q["seen"]], bool).reshape(len(q), len(names))
            wide = _widest(q["least"].to_numpy())

            def able(asked_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
                own = place[rows]
                if single[own].all():
                    return ~seen[asked_rows][:, own]
                # those of the size of the centres, as sizes are compared apart
                t = np.zeros((len(asked_rows), len(names)))
                t[:, ~single] = _angles(np.stack(q["vector"].to_numpy()[asked_rows]).astype(float), centres[names[~single] // RINGS])
                t[seen[asked_rows]] = np.inf
                return np.abs(t[:, own] - angle[rows]) <= wide[asked_rows][:, None]

            return best_in_group(v, q, key, k, able)

        at = F.explode(places_of("vector", "least", "seen"))
        right = known.select("query_id", "vector", "least", "seen", at.alias("at")).withColumns({"of": F.expr(f"at div {most}").cast("int"), "part": (F.col("at") % most).cast("int")}).drop("at")
        left = self.rows.select(*key, "embedding", "cell", "part", "angle", F.pmod(F.col("cell"), F.lit(groups)).alias("of"))
        hits = left.groupBy("of", "part").cogroup(right.groupBy("of", "part")).applyInPandas(compare, hits_schema(known, self.rows, key))
        return rounded(hits)


def _found(index: Cells, queries: DataFrame, key: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best of the first cells (query_id, key, score), what the first pass asks (see `Cells.met`), and the queries with the score that they have to reach from then on:
    (query_id, vector, q_length, seen, least)."""
    choose = index.chooser(k)
    able = queries.withColumn("q_length", _length("vector")).where("q_length > 0 AND q_length < double('Infinity')")
    none = F.lit(None).cast("double")
    # models and cells may be far apart: what is asked is written once, and so are the first hits
    first = kept(able.withColumns({"least": none, "look": choose("vector", none)}), "asked")
    hits = kept(top(index.best_met(first, key, k), k, key).drop("rank"), "first")
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("worst"))
    known = first.drop("least").withColumn("look", F.transform("look", lambda x: x["cell"])).withColumnRenamed("look", "seen").join(found, "query_id", "left")
    least = F.when(F.col("found") >= k, F.col("worst")).otherwise(F.lit(0.0))
    return hits, first, known.withColumn("least", least).drop("found", "worst")


def passes(index: Cells, queries: DataFrame, key: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best of the first cells (query_id, key, score), and the pairs that the first and the second pass compare, as rows: to see how many they are. queries: (query_id, vector), ids distinct."""
    hits, first, known = _found(index, queries, key, k)
    more = known.withColumn("all", index.chooser(k)("vector", "least"))
    second = more.withColumn("look", F.filter("all", lambda x: ~F.array_contains("seen", x["cell"])))
    return hits, index.met(first, key), index.met(second, key)


def best(index: Cells, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query_id, key, score) of vectors among which are the k best of each query, those of a score above 0 as `search.dense` gives them."""
    hits, _, known = _found(index, queries, key, k)
    return hits.unionByName(index.best_rest(known, key, k))
