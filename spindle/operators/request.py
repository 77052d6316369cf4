"""One search as a caller asks for it: arguments as text, a catalog of tables, ranked and decorated hits."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import score as S
from spindle.functions.text import query_terms
from spindle.operators import models, present
from spindle.operators import search as se

DEFAULT_LIMIT, MAX_LIMIT, OVERFETCH, LOGGED = 8, 20, 3, 3
KEY = ["doc_id", "chunk_no"]


def limit_of(asked: object) -> int:
    """A whole number from 1 to MAX_LIMIT; DEFAULT_LIMIT for what is no positive number."""
    n = int(asked) if isinstance(asked, (int, float)) and not isinstance(asked, bool) and asked > 0 else DEFAULT_LIMIT
    return min(n, MAX_LIMIT)


def parse_tags(raw: str | None) -> tuple[str, ...]:
    """The parts between commas, without blanks around them; empty ones are left out."""
    return tuple(t for part in (raw or "").split(",") if (t := part.strip()))


def parse_time(raw: str | None) -> str | None:
    """A date (YYYY-MM-DD) or a full RFC 3339 time as a UTC time stamp; None for all else."""
    raw = raw or ""
    try:
        if re.fullmatch(r"\d{4}-\d\d-\d\d", raw):
            return f"{date.fromisoformat(raw)} 00:00:00"
        if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", raw):
            return datetime.fromisoformat(raw).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    except ValueError:
        pass
    return None


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int = DEFAULT_LIMIT
    filter: se.SearchFilter = se.SearchFilter()
    coarse: bool = False

    @classmethod
    def of(cls, query: str, limit: object = None, doc: object = None, source_type: str | None = None, section: str | None = None, tags: str | None = None,
           added_after: str | None = None, added_before: str | None = None, coarse: bool = False) -> SearchRequest:
        if not query.strip():
            raise ValueError("a query is needed")
        found = se.SearchFilter(doc, source_type or None, section or None, parse_tags(tags), parse_time(added_after), parse_time(added_before))
        return cls(query, limit_of(limit), found, coarse)


@dataclass(frozen=True)
class Catalog:
    """postings (doc_id, chunk_no, term, tf), entries (doc_id, chunk_no, length, section, section_role), documents (doc_id, source_type, tags, added_at,
    is_paper), chunks (doc_id, chunk_no, content), sections (doc_id, section, text) for coarse searches, vectors (doc_id, chunk_no, embedding), section_index: postings
    and entries of the sections, made for each search where they are not stored."""

    postings: DataFrame
    entries: DataFrame
    documents: DataFrame
    chunks: DataFrame
    sections: DataFrame | None = None
    vectors: DataFrame | None = None
    section_index: tuple[DataFrame, DataFrame] | None = None


def search(catalog: Catalog, asked: SearchRequest, rewriter: models.Rewriter | None = None, embedder: models.Embedder | None = None, reranker: models.Reranker | None = None) -> DataFrame:
    """(rank, doc_id, chunk_no, score, section, snippet, section_hint, duplicate_of). With an embedder and vectors the search is hybrid; abstracts of papers get
    a boost before scores are fused. A reranker sees at most max(2 * limit, 20) hits."""
    spark = catalog.postings.sparkSession
    terms = se.query_table(spark, {1: models.merged_query(asked.query, rewriter)})
    entries = catalog.entries.join(catalog.documents, "doc_id").where(asked.filter.column())
    if asked.coarse and catalog.sections is not None:
        entries = se.in_top_sections(entries, catalog.sections, terms, "doc_id", "section", stored=catalog.section_index)
    boost = F.when(F.col("is_paper") & (F.col("section_role") == "abstract"), F.lit(se.BOOST)).otherwise(F.lit(1.0))
    hits = se.bm25(catalog.postings, entries, terms, KEY, boost=boost)
    vector = embedder.embed([asked.query])[0] if embedder is not None and catalog.vectors is not None else None
    if vector is not None:
        query = spark.createDataFrame([(1, [float(x) for x in vector])], "query_id long, vector array<double>")
        near = se.dense(catalog.vectors.join(entries.select(*KEY), KEY, "left_semi"), query, KEY)
        alpha = S.alpha_of(S.query_type(F.lit(asked.query)))
        hits = se.hybrid(hits, near, alpha, KEY).select("query_id", *KEY, "score")
    best = se.top(se.trimmed(hits), models.candidates(asked.limit), KEY).join(catalog.chunks.select(*KEY, F.col("content").alias("text")), KEY, "left")
    if reranker is not None:
        best = best.withColumn("query", F.lit(asked.query))
        if vector is not None:
            best = best.join(catalog.vectors, KEY, "left")
        best = models.reranked(best, reranker, tie=KEY, n=models.candidates(asked.limit), vector="embedding" if vector is not None else None, query_vector=vector)
    kept = se.top(best.drop("rank"), asked.limit, KEY).join(catalog.entries.select(*KEY, "section"), KEY)
    shown = present.snippets(kept, F.lit(asked.query), F.array(*[F.lit(t) for t in query_terms(asked.query)]))
    shown = present.section_hints(shown, ["query_id", "doc_id"], "section")
    marks = present.duplicate_marks(shown, ["query_id", "doc_id"], "rank", "chunk_no", "snippet").drop("chunk_no")
    return shown.join(marks, ["query_id", "doc_id", "rank"], "left").select("rank", *KEY, "score", "section", "snippet", "section_hint", "duplicate_of").orderBy("rank")


def _logged(used: se.SearchFilter) -> Column:
    """The filter of a search as its log entry keeps it; null where none was asked for."""
    if used == se.SearchFilter():
        return F.lit(None).cast("struct<doc: string, source_type: string, section: string, tags: array<string>, added_after: string, added_before: string>")
    parts = [F.lit(None if getattr(used, n) is None else str(getattr(used, n))).cast("string").alias(n) for n in ("doc", "source_type", "section", "added_after", "added_before")]
    tags = F.array(*[F.lit(t) for t in used.tags]).cast("array<string>").alias("tags")
    return F.struct(*parts[:3], tags, *parts[3:])


def log_entry(hits: DataFrame, asked: SearchRequest, name: str = "chunk_no") -> DataFrame:
    """What a search log keeps of one search: number of hits, ids and scores of the first LOGGED, and the filter."""
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", F.col(name).cast("string").alias("id"), "score"))), 1, LOGGED), lambda x: x)
    rows = hits.agg(F.count(F.lit(1)).cast("int").alias("hit_count"), first.alias("first"))  # at most MAX_LIMIT hits
    return rows.select(
        F.lit(asked.query).alias("query"), "hit_count", F.transform("first", lambda x: x["id"]).alias("hit_ids"), F.transform("first", lambda x: x["score"]).alias("top_scores"),
        F.lit(None).cast("array<string>").alias("judged_hits"), F.current_timestamp().alias("timestamp"), _logged(asked.filter).alias("filter"),
    )
