"""Ranked search. A batch of queries is one job: every key has a query id.

Statistics (N, document frequency, mean length) are by default those of a query's candidates, the entries that match and
pass the filter. Query tables come from a request, so they are small and broadcast; their size is
checked in `query_table`."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.functions import score as S
from spindle.functions.text import query_terms
from spindle.sources.store import kept

TRIM, BOOST, MAX_QUERY_TERMS = 0.15, 1.1, 200_000
#: Terms up to which a lookup names them in its filter; query vectors up to which they are broadcast; score ranges that ranks are counted in.
MAX_NAMED_TERMS, MAX_SENT_VECTORS, RANGES = 1000, 10_000, 1024
#: Scores of a batch that a task makes at most, about.
TASK_SCORES = 1 << 20


@dataclass(frozen=True)
class SearchFilter:
    """Conditions that all hold; one that is None or empty is not applied."""

    doc: object = None
    source_type: str | None = None
    section: str | None = None
    tags: tuple[str, ...] = field(default_factory=tuple)
    added_after: str | None = None
    added_before: str | None = None

    def column(self, doc: str = "doc_id", source_type: str = "source_type", section: str = "section", tags: str = "tags", added_at: str = "added_at") -> Column:
        out = F.lit(True)
        if self.doc is not None:
            out = out & (F.col(doc) == F.lit(self.doc))
        if self.source_type:
            out = out & (F.col(source_type) == self.source_type)
        if self.section:
            out = out & F.col(section).contains(self.section)
        if self.tags:
            wanted = F.array(*[F.lit(t.lower()) for t in self.tags])
            out = out & F.arrays_overlap(F.transform(tags, F.lower), wanted)
        if self.added_after:
            out = out & (F.col(added_at) >= F.lit(self.added_after).cast("timestamp"))
        if self.added_before:
            out = out & (F.col(added_at) <= F.lit(self.added_before).cast("timestamp"))
        return out


def query_table(spark: SparkSession, queries: dict[int, str] | Iterable[tuple[int, str]]) -> DataFrame:
    """(query_id, term) of queries by id."""
    items = queries.items() if isinstance(queries, dict) else queries
    rows = [(q, t) for q, text in items for t in query_terms(text)]
    if len(rows) > MAX_QUERY_TERMS:
        raise ValueError("too many query terms for one batch")
    return spark.createDataFrame(rows, "query_id long, term string")


def bm25(postings: DataFrame, entries: DataFrame, queries: DataFrame, key: list[str], scope: list[str] = (), corpus: bool = False, boost: Column | None = None, small: bool = True) -> DataFrame:
    """(query_id, key, score). entries: key, scope columns, length and what boost needs. scope: columns, such as a
    collection, within which statistics are separate. corpus: statistics of all entries, not of candidates only. small: queries come from
    `query_table`, whose size is checked, so they and their statistics are broadcast, and their terms prune the scan of postings that are sorted by
    term; for a table of queries of any size, False. Entries with a column query_id are candidates of that query only."""
    if not (small or corpus or scope or boost is not None or "query_id" in entries.columns):
        asked = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        if asked.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS:
            return _bm25_by_entry(postings, entries, asked, key)
    by = ["query_id", *scope]
    hint = F.broadcast if small else (lambda df: df)
    if small:
        terms = sorted({r.term for r in queries.select("term").collect()})
        if len(terms) <= MAX_NAMED_TERMS:
            postings = postings.where(F.col("term").isin(*terms))
    own_entries = [*key, "query_id"] if "query_id" in entries.columns else key
    matched = postings.join(hint(queries), "term").join(entries, own_entries)
    if corpus:
        stats = entries.groupBy(*scope).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("average"))
        df = postings.join(hint(queries.select("term").distinct()), "term", "left_semi").join(entries.select(*key, *[c for c in scope if c not in key]), key)
        df = df.groupBy(*scope, "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        # with a scope, statistics grow with the number of collections, and are joined as they come
        matched = matched.join(df if scope else hint(df), [*scope, "term"])
        matched = matched.join(stats, list(scope)) if scope else matched.crossJoin(F.broadcast(stats))
    else:
        # one row a candidate, then one row a query: both sums start on the map side
        own = matched.groupBy(*by, *[k for k in key if k not in scope]).agg(F.first("length").alias("length"))
        stats = own.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("average"))
        df = matched.groupBy(*by, "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
        sent = hint if not scope else (lambda x: x)
        matched = matched.join(sent(df), [*by, "term"]).join(sent(stats), by)
    part = S.bm25_term(F.col("tf").cast("double"), F.col("df"), F.col("n"), F.col("length"), F.col("average"))
    more = [F.first(boost).alias("boost")] if boost is not None else []
    out = matched.groupBy(*by, *[k for k in key if k not in scope]).agg(F.sum(part).alias("score"), *more).where("score > 0")
    scored = F.col("score") * F.col("boost") if boost is not None else F.col("score")
    return out.withColumn("score", F.round(scored, S.DIGITS)).drop("boost")


def _bm25_by_entry(postings: DataFrame, entries: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """`bm25` of a batch of many queries, asked (query_id, term, times), which is sent to all tasks. Postings are dealt by entry, once, so what a query finds in an entry is summed where the
    entry lies: rows of (query, entry, term), which are many times the postings, are never shuffled. Tasks are as many as keep their scores in memory."""
    scores = entries.count() * asked.select("query_id").distinct().count()
    n = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scores // TASK_SCORES))
    held = postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select(*key, "term", "tf").repartition(n, *key)
    held = held.join(entries.select(*key, "length").repartition(n, *key), key)
    own = held.join(F.broadcast(asked.select("query_id", "term")), "term").groupBy("query_id", *key).agg(F.first("length").alias("length"))
    stats = own.groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("average"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(df, "term").join(stats, "query_id").withColumn("df", (F.col("df") * F.col("times")).cast("double"))
    part = F.col("times") * S.bm25_term(F.col("tf").cast("double"), F.col("df"), F.col("n"), F.col("length"), F.col("average"))
    out = held.join(F.broadcast(known), "term").groupBy("query_id", *key).agg(F.sum(part).alias("score")).where("score > 0")
    return out.withColumn("score", F.round("score", S.DIGITS))


def trimmed(hits: DataFrame, ratio: float = TRIM, by: list[str] = ("query_id",), small: bool = True) -> DataFrame:
    """Hits of at least ratio times the best score of their query. small: the queries are few enough to broadcast a row each."""
    best = hits.groupBy(*by).agg(F.max("score").alias("best"))
    return hits.join(F.broadcast(best) if small else best, list(by)).where((F.col("score") >= ratio * F.col("best")) | (F.col("best") <= 0)).drop("best")


def top(hits: DataFrame, k: int, tie: list[str], by: list[str] = ("query_id",), rank: str = "rank") -> DataFrame:
    """The k best of each query, with their rank from 1; each task keeps k rows a query before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *tie)
    return hits.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(hits: DataFrame, tie: list[str], rank: str, by: str = "query_id") -> DataFrame:
    """Adds the rank from 0 of each hit, best first. Hits are counted in RANGES ranges of their score (a part of the query's best), so that no task
    sorts all hits of a query: ranks are those within a range, plus the hits in better ranges."""
    best = hits.groupBy(by).agg(F.max("score").alias("best"))
    at = hits.join(best, by).withColumn("range", F.floor((1 - F.col("score") / F.col("best")) * RANGES)).drop("best")
    counts = at.groupBy(by, "range").agg(F.count(F.lit(1)).alias("n"))
    better = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    before = counts.select(by, "range", F.coalesce(F.sum("n").over(better), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(by, "range").orderBy(F.desc("score"), *tie))
    return at.withColumn(rank, nth).join(before, [by, "range"]).withColumn(rank, F.col(rank) - 1 + F.col("before")).drop("range", "before")


def dense(vectors: DataFrame, queries: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, key, score): cosine of every vector with every query vector (query_id, vector). Up to MAX_SENT_VECTORS queries are sent to all
    tasks; more are compared in blocks of both tables."""
    length = lambda c: F.sqrt(S.dot(F.col(c), F.col(c)))
    asked = queries.withColumn("q_length", length("vector"))
    asked = F.broadcast(asked) if queries.limit(MAX_SENT_VECTORS + 1).count() <= MAX_SENT_VECTORS else asked
    both = vectors.withColumn("v_length", length("embedding")).crossJoin(asked)
    fits = (F.size("embedding") == F.size("vector")) & (F.col("v_length") * F.col("q_length") > 0)
    near = F.when(fits, S.dot(F.col("embedding"), F.col("vector")) / (F.col("v_length") * F.col("q_length"))).otherwise(F.lit(0.0))
    return both.select("query_id", *key, F.round(near, S.DIGITS).alias("score")).where("score > 0")


def cosines(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, key, score): those rows of `dense` whose query and entry are among pairs (query_id, key)."""
    length = lambda c: F.sqrt(S.dot(F.col(c), F.col(c)))
    asked = queries.withColumn("q_length", length("vector"))
    met = pairs.select("query_id", *key).join(vectors.withColumn("v_length", length("embedding")), key).join(asked, "query_id")
    fits = (F.size("embedding") == F.size("vector")) & (F.col("v_length") * F.col("q_length") > 0)
    near = F.when(fits, S.dot(F.col("embedding"), F.col("vector")) / (F.col("v_length") * F.col("q_length"))).otherwise(F.lit(0.0))
    return met.select("query_id", *key, F.round(near, S.DIGITS).alias("score")).where("score > 0")


def candidate_dense(sparse: DataFrame, vectors: DataFrame, queries: DataFrame, key: list[str]) -> DataFrame:
    """(query_id, key, score): cosine of each query (query_id, vector) with the entries that its keyword search found, whose vectors are joined before anything is compared;
    only a query that found none is compared with all vectors. sparse: stored hits, which are read several times."""
    out = cosines(sparse, vectors, queries, key)
    lone = queries.join(sparse.select("query_id").distinct(), "query_id", "left_anti")
    return out if lone.isEmpty() else out.unionByName(dense(vectors, lone, key))


def hybrid(sparse: DataFrame, dense_hits: DataFrame, alpha: Column | float, key: list[str], candidates_only: bool = True) -> DataFrame:
    """(query_id, key, score, sparse_rank, dense_rank): fusion of two rankings. candidates_only: the dense side ranks entries
    that the sparse side found; for a query for which it found none, all entries."""
    if candidates_only:
        found = sparse.select("query_id").distinct().withColumn("found", F.lit(True))
        in_sparse = sparse.select("query_id", *key).withColumn("mine", F.lit(True))
        dense_hits = dense_hits.join(found, "query_id", "left").join(in_sparse, ["query_id", *key], "left")
        dense_hits = dense_hits.where(F.col("found").isNull() | F.col("mine")).drop("found", "mine")
    a = ranked(sparse, key, "sparse_rank").drop("score")
    b = ranked(dense_hits, key, "dense_rank").drop("score")
    return _fusion(a, b, alpha, key)


def _fusion(sparse: DataFrame, dense_hits: DataFrame, alpha: Column | float, key: list[str]) -> DataFrame:
    both = sparse.join(dense_hits, ["query_id", *key], "full_outer")
    weight = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return both.withColumn("score", F.round(S.rrf(weight, F.col("sparse_rank"), F.col("dense_rank")), S.DIGITS)).where("score > 0")


def ranks_among(some: DataFrame, hits: DataFrame, tie: list[str], rank: str, small: bool = True) -> DataFrame:
    """(query_id, tie, score, rank): the ranks by `ranked` of some rows of hits, a few hundred a query. Only those are numbered: hits in better ranges of the score are counted by range, and those of a
    row's own range by comparing them with the row, both first within each task; nothing is sorted, and no task holds a query's hits. small: the queries are few enough to broadcast their rows."""
    hint = F.broadcast if small else (lambda df: df)
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    part = F.floor((1 - F.col("score") / F.col("best")) * RANGES)
    ranged = lambda df: df.select("query_id", *tie, "score").join(hint(best), "query_id").withColumn("range", part).drop("best")
    at, by = ranged(hits), ["query_id", "range"]
    better = Window.partitionBy("query_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    before = at.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.coalesce(F.sum("n").over(better), F.lit(0)).alias("before"))
    named = ranged(some).groupBy(*by, F.struct(*tie).alias("own"), F.col("score").alias("own_score")).agg(F.count(F.lit(1)).alias("times"))
    first = (F.col("score") > F.col("own_score")) | ((F.col("score") == F.col("own_score")) & (F.struct(*tie) < F.col("own")))
    within = at.join(hint(named), by).groupBy(*by, "own", "own_score", "times").agg(F.sum(F.when(first, 1).otherwise(0)).alias("within"))
    nth = F.col("before") + F.col("within")
    return within.join(hint(before), by).select("query_id", "own.*", F.col("own_score").alias("score"), F.explode(F.sequence(nth, nth + F.col("times") - 1)).alias(rank))


def hybrid_best(sparse: DataFrame, dense_hits: DataFrame, alpha: Column | float, key: list[str], k: int, small: bool = True) -> DataFrame:
    """Rows of `hybrid` (query_id, key, score, sparse_rank, dense_rank) with the k best of each query among them, for weights alpha from 0 to 1 and k up to 10,000. Both tables are stored, as they are read several
    times; dense_hits are of `candidate_dense`. Of the k first of the heavier ranking each has at least 0.5 / (RRF_K + k - 1); what is not among the first RRF_K + 2k of either has at most 1 / (2 RRF_K + 2k), which
    is less, so only the rest is ranked. Of a heavier ranking that has fewer rows all are, and the lighter one alone gives the order of what it adds."""
    first = S.RRF_K + 2 * k
    names = top(sparse, first, key).select("query_id", *key).unionByName(top(dense_hits, first, key).select("query_id", *key)).distinct()
    names = kept(names.select(F.col("query_id").alias("q"), *[F.col(c).alias(f"k_{n}") for n, c in enumerate(key)]), "first")
    same = F.col("query_id").eqNullSafe(F.col("q"))
    for n, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"k_{n}"))
    own = lambda hits: hits.join(F.broadcast(names) if small else names, same, "left_semi")
    a = ranks_among(own(sparse), sparse, key, "sparse_rank", small).drop("score")
    b = ranks_among(own(dense_hits), dense_hits, key, "dense_rank", small).drop("score")
    return _fusion(a, b, alpha, key)


def max_passage(hits: DataFrame, doc: str, tie: list[str], limit: int, per_doc: int = 3) -> DataFrame:
    """Documents by their best chunk, with up to per_doc chunks: (query_id, doc, score, chunks)."""
    ranked = top(hits, per_doc, tie, ["query_id", doc], "nth")
    chunk = F.struct("nth", "score", *tie)
    docs = ranked.groupBy("query_id", doc).agg(F.max("score").alias("score"), F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return top(docs, limit, [doc])


def search_all(postings: DataFrame, entries: DataFrame, queries: DataFrame, key: list[str], kb: str, dedup: list[str], limit: int) -> DataFrame:
    """Search in every collection with its own statistics, trim and limit; a hit in several counts for the first collection by name."""
    own = bm25(postings, entries, queries, key, [kb])
    own = top(trimmed(own, by=["query_id", kb]), limit, [k for k in key if k != kb], ["query_id", kb], "own_rank")
    w = Window.partitionBy("query_id", *dedup).orderBy(kb)
    once = own.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "own_rank")
    return top(once, limit, [*dedup, kb])


def in_top_sections(entries: DataFrame, sections: DataFrame, queries: DataFrame, doc: str, section: str, keep: int = 3, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, entry columns): coarse to fine. entries pass if their section is empty or among the query's `keep` best.
    sections: (doc, section, text); stored: their postings and entries, where there is an index. The sections that hit, a few a query, are joined to their entries; only
    entries without a section meet every query."""
    from spindle.operators.index import index

    postings, lens = stored or index(sections, [doc, section])
    best = top(bm25(postings, lens, queries, [doc, section]), keep, [doc, section]).where(F.col(section) != "").select("query_id", doc, section)
    loose = entries.where(F.col(section) == "").crossJoin(F.broadcast(queries.select("query_id").distinct()))
    return entries.join(best, [doc, section]).select("query_id", *entries.columns).unionByName(loose.select("query_id", *entries.columns))
