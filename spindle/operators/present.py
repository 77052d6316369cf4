"""What a hit is shown with: snippet, duplicate marks, section hints, context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.score import jaccard
from spindle.functions.text import compact

SNIPPET, DUPLICATE = 200, 0.6
ENDS = ".!?。！？"


def _window(text: str, pos: int, size: int) -> tuple[int, int]:
    """Whole sentences around pos that fit size: to the left as far as they fit, then to the right; else size characters around pos."""
    edges, start = [], 0
    for i, c in enumerate(text):
        if c in ENDS:
            edges.append((start, i + 1))
            start = i + 1
    if start < len(text):
        edges.append((start, len(text)))
    spans = [(a + len(text[a:b]) - len(text[a:b].lstrip(" ")), b) for a, b in edges if text[a:b].strip(" ")]
    own = next((i for i, (a, b) in enumerate(spans) if a <= pos < b), None)
    if own is not None and spans[own][1] - spans[own][0] <= size:
        lo = hi = own
        while lo > 0 and spans[hi][1] - spans[lo - 1][0] <= size:
            lo -= 1
        while hi + 1 < len(spans) and spans[hi + 1][1] - spans[lo][0] <= size:
            hi += 1
        return spans[lo][0], spans[hi][1]
    end = min(len(text), max(0, pos - size // 2) + size)
    return max(0, end - size), end


def snippet_of(text: str, query: str, terms: list[str], size: int = SNIPPET) -> str:
    """text: compacted. The place is that of the whole query, else of the first term found (single letters are skipped), else the start."""
    if len(text) <= size:
        return text
    low = text.lower()
    query = query.strip().lower()
    pos = low.find(query) if query else -1
    for t in terms if pos < 0 else ():
        if len(t) > 1 or ord(t) > 0x2E7F:
            pos = low.find(t)
            if pos >= 0:
                break
    a, b = _window(text, min(max(pos, 0), len(text) - 1), size)
    return "..." * (a > 0) + text[a:b] + "..." * (b < len(text))


def snippets(hits: DataFrame, query: Column, terms: Column, text: str = "text", size: int = SNIPPET) -> DataFrame:
    """Adds snippet. Meant for hits after the cut to the best k."""

    @F.pandas_udf("string")
    def make(texts: pd.Series, queries: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(t, q, list(ts), size) for t, q, ts in zip(texts, queries, lists, strict=True)], dtype=object)

    return hits.withColumn("snippet", make(compact(F.coalesce(F.col(text), F.lit(""))), query, terms))


def words(text: Column | str) -> Column:
    """Distinct words between white space, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"\s+"), lambda w: w != ""))


def similar_pairs(hits: DataFrame, group: list[str], rank: str, text: str, at_least: float = DUPLICATE) -> DataFrame:
    """(group, rank_a, rank_b, similarity) of hits in a group (query and document) whose word sets are alike. Groups are what a query shows of a document."""
    a = hits.select(*group, F.col(rank).alias("rank_a"), words(text).alias("wa"))
    b = hits.select(*group, F.col(rank).alias("rank_b"), words(text).alias("wb"))
    near = F.round(jaccard(F.col("wa"), F.col("wb")), 9)
    return a.join(b, group).where("rank_a < rank_b").withColumn("similarity", near).where(F.col("similarity") >= at_least).drop("wa", "wb")


def duplicate_marks(hits: DataFrame, group: list[str], rank: str, name: str, text: str, at_least: float = DUPLICATE) -> DataFrame:
    """(group, rank, name, duplicate_of): in rank order a hit is marked with the first unmarked hit before it that is alike; a fold over
    the group's few hits."""
    item = F.struct(F.col(rank).alias("rank"), F.col(name).cast("string").alias("name"), words(text).alias("w"))
    lists = hits.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("all"))
    empty = F.array().cast("array<struct<rank:bigint,name:string,w:array<string>,of:string>>")

    def add(out, x):
        first = F.filter(out, lambda y: y["of"].isNull() & (F.round(jaccard(y["w"], x["w"]), 9) >= at_least))
        row = F.struct(x["rank"].cast("long").alias("rank"), x["name"].alias("name"), x["w"].alias("w"), F.try_element_at(first, F.lit(1))["name"].alias("of"))
        return F.concat(out, F.array(row))

    marked = lists.select(*group, F.explode(F.aggregate("all", empty, add)).alias("m"))
    return marked.select(*group, F.col("m.rank").alias(rank), F.col("m.name").alias(name), F.col("m.of").alias("duplicate_of"))


def section_hints(hits: DataFrame, by: list[str], section: str) -> DataFrame:
    """Adds section_hint where two or more hits of a query share document and section."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, section))
    hint = F.format_string("%d hits in section %s; read the whole section", n, F.col(section))
    return hits.withColumn("section_hint", F.when((F.col(section) != "") & (n >= 2), hint).otherwise(F.lit("")))


def context(chunked: DataFrame, key: list[str], order: str, content: str, around: int) -> DataFrame:
    """Adds context: each chunk with up to `around` chunks on either side, joined by a rule."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-around, around)
    return chunked.withColumn("context", F.array_join(F.collect_list(content).over(w), "\n---\n"))


def rendered(chunked: DataFrame, key: list[str], chunk_no: int, around: int, order: str = "chunk_no") -> DataFrame:
    """(key, text): a chunk with up to `around` neighbours on either side. Where the document has sections, chunks of one section follow each other under one
    heading; else each is headed by its number in brackets. around 0: the chunk alone."""
    if around <= 0:
        return chunked.where(F.col(order) == chunk_no).select(*key, F.col("content").alias("text"))
    named = chunked.groupBy(*key).agg(F.bool_or(F.col("section") != "").alias("named"))
    near = chunked.where(F.col(order).between(chunk_no - around, chunk_no + around))
    rows = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("no"), "section", "content"))).alias("c")).join(named, key)
    before = lambda i: F.when(i == 0, F.lit("")).otherwise(F.get(F.col("c"), i - 1)["section"])
    head = lambda x, i: F.when((x["section"] != before(i)) & (x["section"] != ""), F.concat(F.lit("## "), x["section"], F.lit("\n"))).otherwise(F.lit(""))
    sectioned = F.array_join(F.transform("c", lambda x, i: F.concat(head(x, i), x["content"])), "\n\n")
    number = lambda x: F.when(x["no"] < 1000, F.lpad(x["no"].cast("string"), 3, "0")).otherwise(x["no"].cast("string"))
    plain = F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), number(x), F.lit("]\n"), x["content"])), "\n\n---\n\n")
    return rows.select(*key, F.when(F.col("named"), sectioned).otherwise(plain).alias("text"))


def read_section(section_rows: DataFrame, doc: Column, section_id: str) -> DataFrame:
    """One section of a document, from `chunk.sections`."""
    return section_rows.where(doc & (F.col("section_id") == section_id))


def first_with(chunked: DataFrame, kb: str, doc: Column, chunk_no: int, order: str = "chunk_no") -> DataFrame:
    """A chunk from the first collection by name that has it."""
    return chunked.where(doc & (F.col(order) == chunk_no)).orderBy(kb).limit(1)


def read_chunk(chunked: DataFrame, doc: Column, chunk_no: int, around: int = 0, order: str = "chunk_no") -> DataFrame:
    """The rows of one chunk and its neighbours; around is at most 5."""
    c = max(0, min(5, around))
    return chunked.where(doc & F.col(order).between(chunk_no - c, chunk_no + c)).orderBy(order)
