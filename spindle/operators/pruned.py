"""The k best by BM25 with statistics of the corpus, without scoring every match.

When an index is made, each posting gets its part of a score (without the term's weight, which every document of a term shares) and one of LEVELS
levels of it; a small table says how many postings of a term each level has and the largest part among them. A search scores first the documents in the top levels of its terms: the k-th best
score is a threshold. A document that reaches it has, of T terms, at least one whose part is a T-th of it, so only levels whose largest part can be that are
looked into, and only documents found there are scored. The result is exact; how much is left out depends on how far scores spread.

Levels need no order of a term's postings, so a term that all documents have is never in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.functions import score as S
from spindle.operators.search import query_table, top

LEVELS, FIRST = 64, 4


def write_impacts(postings: DataFrame, entries: DataFrame, key: list[str], path: str) -> None:
    """Below path: impacts (key, term, part, level) sorted by term and level, levels (term, level, n, most), and the number of entries. postings: (key, term, tf);
    entries: (key, length)."""
    stats = entries.agg(F.count(F.lit(1)).cast("double").alias("entries"), F.avg("length").alias("average"))
    part = S.saturation(F.col("tf").cast("double"), F.col("length"), F.col("average"))
    rows = postings.join(entries.select(*key, "length"), key).crossJoin(F.broadcast(stats)).select(*key, "term", part.alias("part"))
    level = F.least(F.floor(F.col("part") / (S.K1 + 1.0) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.withColumn("level", level).repartitionByRange(n, "term", "level").sortWithinPartitions("term", "level").write.parquet(f"{path}/impacts")
    made = postings.sparkSession.read.parquet(f"{path}/impacts")
    made.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("most")).write.parquet(f"{path}/levels")
    stats.write.parquet(f"{path}/stats")


@dataclass(frozen=True)
class Impacts:
    impacts: DataFrame
    levels: DataFrame
    stats: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Impacts:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("impacts", "levels", "stats")])

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, idf, parts, level, n, most) for each level of the queries' terms; parts: terms of the query."""
        by_term = Window.partitionBy("query_id", "term")
        rows = self.levels.join(F.broadcast(queries), "term").crossJoin(F.broadcast(self.stats.select("entries")))
        rows = rows.withColumn("df", F.sum("n").over(by_term).cast("double"))
        parts = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"))
        return rows.withColumn("idf", S.idf(F.col("df"), F.col("entries"))).join(F.broadcast(parts), "query_id").drop("df", "entries")

    def candidates(self, levels: DataFrame, key: list[str]) -> DataFrame:
        """(query_id, key) of documents in the given levels (query_id, term, level), which are at most LEVELS for a term of a query."""
        return self.impacts.join(F.broadcast(levels.select("query_id", "term", "level")), ["term", "level"]).select("query_id", *key).distinct()

    def scored(self, candidates: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
        """(query_id, key, score, rows): whole scores of candidates; rows: postings that were added up."""
        weights = asked.groupBy("query_id", "term").agg(F.first("idf").alias("idf"))
        rows = self.impacts.join(F.broadcast(weights), "term").join(candidates, ["query_id", *key])
        return rows.groupBy("query_id", *key).agg(F.round(F.sum(F.col("idf") * F.col("part")), S.DIGITS).alias("score"), F.count(F.lit(1)).alias("rows"))


def thresholds(index: Impacts, asked: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query_id, least): a score that the k best of each query reach; 0 where the top levels have fewer documents."""
    above = Window.partitionBy("query_id", "term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    first = asked.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("above") < FIRST * k)
    best = top(index.scored(index.candidates(first, key), asked, key), k, key)
    found = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    return found.select("query_id", F.when(F.col("found") >= k, F.col("least")).otherwise(F.lit(0.0)).alias("least"))


def best(index: Impacts, queries: DataFrame | dict[int, str], key: list[str], k: int) -> DataFrame:
    """(query_id, key, score, rows) of documents among which are the k best of each query. queries: texts by id, or `search.query_table`'s rows."""
    queries = query_table(index.impacts.sparkSession, queries) if isinstance(queries, dict) else queries
    asked = index.asked(queries)
    least = thresholds(index, asked, key, k)
    # scores are rounded: what a threshold was rounded up by stays in
    reach = F.col("idf") * F.col("most") * F.col("parts") >= F.col("least") - 1e-8
    return index.scored(index.candidates(asked.join(F.broadcast(least), "query_id").where(reach), key), asked, key)
