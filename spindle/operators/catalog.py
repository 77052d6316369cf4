"""Collections and document listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORT_KEYS = {"name": "original_name", "chunkCount": "chunk_count", "sourceType": "source_type", "addedAt": "added_at"}


def list_kbs(kbs: DataFrame) -> DataFrame:
    text = F.when(F.coalesce(F.col("description"), F.lit("")) == "", F.lit("(no description)")).otherwise(F.col("description"))
    return kbs.select("kb", text.alias("description")).orderBy("kb")


def with_kb_tag(documents: DataFrame) -> DataFrame:
    """Listing over all collections: tags also name the collection."""
    return documents.withColumn("tags", F.array_append("tags", F.concat(F.lit("kb:"), F.col("kb"))))


def page(documents: DataFrame, sort: Column, tie: str, descending: bool = False, offset: int = 0, limit: int = 20, where: Column | None = None) -> DataFrame:
    """One page of a listing, with the total of rows that fit; limits are 1 to 500."""
    found = documents if where is None else documents.where(where)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    rows = found.orderBy(sort.desc() if descending else sort.asc(), tie).offset(max(0, offset)).limit(min(500, max(1, limit)))
    return rows.crossJoin(F.broadcast(total))


def upload_summary(files: DataFrame, ext: str, ok: Column) -> DataFrame:
    """By extension: files, and how many were read."""
    return files.groupBy(ext).agg(F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def checksum(chunked: DataFrame, key: list[str], order: str, name: Column, content: str) -> DataFrame:
    """SHA-256 over id and content of a document's chunks, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.concat(name, F.col(content)).alias("s"))))
    return chunked.groupBy(*key).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["s"]), ""), 256).alias("checksum"))


def preview(chunked: DataFrame, doc: Column, order: str = "chunk_no", chunks: int = 3) -> DataFrame:
    """The first chunks of a document."""
    return chunked.where(doc).orderBy(order).limit(chunks)


def snapshot(documents: DataFrame, chunked: DataFrame, key: list[str]) -> DataFrame:
    """Documents with the number of their chunks and characters; those without chunks count 0."""
    sizes = chunked.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("content")).alias("chars"))
    return documents.join(sizes, key, "left").fillna(0, ["chunks", "chars"])


def _row_digest(columns: list[str]) -> Column:
    shown = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown]), 256)


def listing_tree(documents: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """(prefix, rows, digest): checksums of a listing as a tree. A document's place is the SHA-256 of its key; leaves (prefixes of `depth` hexadecimal digits)
    digest their rows in the order of places, nodes their children in order; the empty prefix has the checksum of the whole list. Sixteen times as many documents want one
    level more, so that a leaf stays small. Equal listings have equal trees, and a change shows in one node a level."""
    rows = documents.select(F.sha2(F.col(key).cast("string"), 256).alias("place"), _row_digest(sorted(documents.columns)).alias("d"))
    joined = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "d"))), lambda x: x["d"]), ""), 256)
    level = rows.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), joined("place").alias("digest"))
    out = level
    for k in range(depth - 1, -1, -1):
        below = level.withColumnRenamed("digest", "d")
        level = below.groupBy(F.substring("prefix", 1, k).alias("up")).agg(F.sum("rows").alias("rows"), joined("prefix").alias("digest")).withColumnRenamed("up", "prefix")
        out = out.unionByName(level)
    return out


def listing_changes(old: DataFrame, new: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """(key, change): documents that are added, removed or changed between two listings. Their trees are compared level by level, only below nodes that
    differ; rows are compared only in leaves that do."""
    a, b = listing_tree(old, key, depth), listing_tree(new, key, depth)
    differ = None
    for k in range(depth + 1):
        own = lambda t, d, k=k: t.where(F.length("prefix") == k).select("prefix", F.col("digest").alias(d))
        both = own(a, "x").join(own(b, "y"), "prefix", "full")
        if differ is not None:
            both = both.withColumn("up", F.substring("prefix", 1, k - 1)).join(differ.withColumnRenamed("prefix", "up"), "up", "left_semi")
        differ = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix")
    leaf = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth)
    side = lambda t, d: t.select(key, leaf.alias("prefix"), _row_digest(sorted(t.columns)).alias(d)).join(differ, "prefix", "left_semi").drop("prefix")
    rows = side(old, "x").join(side(new, "y"), key, "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return rows.select(key, F.when(F.col("x").isNull(), F.lit("added")).when(F.col("y").isNull(), F.lit("removed")).otherwise(F.lit("changed")).alias("change"))
