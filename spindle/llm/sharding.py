"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group, and a group stays in one shard. Only a group of more bytes, tokens or rows than a shard's fair share is split, by
document id, since these could not be balanced otherwise. Groups are hashed to a fixed number of buckets; a group that holds more than
1/BUCKETS of all bytes, tokens or rows stands apart from its bucket. Buckets, and groups that stand apart, are the items that are
packed: largest first, each into the shard where the dot product of its
(bytes, tokens, rows) vector with the shard's residual capacity is highest. Their number is bounded by
parameters, so the packing runs on the driver over at most a few thousand vectors at any input size.
Law `bytes`: sizes are near equal. A last pass moves items while that narrows the spread of bytes. Slots follow `order`
where it is given, and else a hash of the ids.

Nulls and ties: a null text is a group of its own, of no bytes and no tokens. Rows that repeat each keep a
slot; their order among equal ids is by text hash and otherwise free. A null id sorts first. An empty
table gives an empty result. Other columns are kept by `shard`; clashing names are kept under `_name`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, require, table, utf8_length, written

#: Rows that share a window when slots are numbered, about.
SHARDS, BUCKETS, WINDOW_ROWS = 16, 4096, 50_000
DIMS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. vectors: items by dimensions, non-negative."""
    share = vectors / np.maximum(vectors.sum(0), 1e-12)
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(share), np.int64)
    order = np.argsort(-share.max(1), kind="stable")
    for i in order:
        out[i] = best = int(np.argmax(residual @ share[i]))
        residual[best] -= share[i]
    # the greedy's last items decide how even it is: move small items from the fullest shard to the emptiest
    for _ in range(4 * len(share)):
        hi, lo = int(np.argmin(residual[:, 0])), int(np.argmax(residual[:, 0]))
        gap = residual[lo, 0] - residual[hi, 0]
        mine = np.flatnonzero((out == hi) & (share[:, 0] > 0) & (share[:, 0] < gap))
        if gap <= 1e-4 / shards or not len(mine):
            break
        pick = mine[int(np.argmin(np.abs(share[mine, 0] - gap / 2)))]
        out[pick] = lo
        residual[hi] += share[pick]
        residual[lo] -= share[pick]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS, id_col: str = "doc_id", text: str = "text", order: tuple[str, str] | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the rows of docs. order: two columns, which are dropped: rows take slots
    by the first (long; some WINDOW_ROWS rows for each value) and then the second."""
    require(docs, id_col, text, *(order or ()))
    spark = docs.sparkSession
    names = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    for c in [c for c in docs.columns if c.lower() in names and c not in (order or ())]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    grp, parts, block, place, offset = fresh(docs, "grp", "parts", "block", "place", "offset")
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.withColumns({
        "size": utf8_length(F.col(text)) + 1,
        grp: F.when(F.col(text).isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.md5(body))),
    })
    dims = (F.sum("size").alias("bytes"), F.sum("toks").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    spread = F.pmod(F.xxhash64(id_col), F.lit(64 * shards)).alias("spread")  # chunks of split groups are made of these
    tokens = sized.select(grp, "size", spread, F.regexp_count(body, F.lit(WORD)).cast("long").alias("toks"))
    groups = written(tokens.groupBy(grp, "spread").agg(*dims), "groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS]).first()
    whole = groups.groupBy(grp).agg(*[F.sum(d).alias(d) for d in DIMS])
    apart = F.lit(False)
    for d in DIMS:  # each limit is passed by fewer than `buckets` groups
        apart = apart | (F.col(d) * buckets > (total[d] or 0))
    shares = F.greatest(*[F.col(d) * shards / F.lit(max(1, total[d] or 0)) for d in DIMS])
    pieces = F.when(shares <= 1, F.lit(1)).otherwise(F.ceil(shares * 4))  # chunks of a quarter of a shard
    big = written(whole.where(apart).select(grp, pieces.cast("int").alias(parts)), "big")

    def item(spread: Column) -> Column:
        """Name of a row's item: its group's bucket, or its group, or that group's chunk."""
        bucket = F.pmod(F.xxhash64(grp), F.lit(buckets)).cast("string")
        chunk = F.pmod(spread, F.coalesce(F.col(parts), F.lit(1))).cast("string")
        return F.when(F.col(parts).isNull(), bucket).otherwise(F.concat_ws("/", F.hex(grp), chunk))

    named = groups.join(F.broadcast(big), grp, "left").withColumn("item", item(F.col("spread")))
    items = sorted(named.groupBy("item").agg(*[F.sum(d).alias(d) for d in DIMS]).collect())  # bounded: buckets, big groups and their chunks
    placed = pack(np.array([r[1:] for r in items], np.float64).reshape(-1, 3), shards)
    (at,) = fresh(sized, "at")
    where = spark.createDataFrame([(r[0], s) for r, s in zip(items, placed.tolist(), strict=True)], f"`{at}` string, shard int")
    blocks = max(1, -(-(total["rows"] or 0) // WINDOW_ROWS))
    rows = sized.join(F.broadcast(big), grp, "left").withColumn(at, item(F.pmod(F.xxhash64(id_col), F.lit(64 * shards)))).join(F.broadcast(where), at)
    if order:
        rows = rows.withColumnsRenamed({order[0]: block, order[1]: place})
    else:
        rows = rows.withColumns({block: F.pmod(F.xxhash64(id_col, F.lit("slot")), F.lit(blocks)), place: F.lit(0).cast("long")})
    rows = rows.drop(at, parts)
    sums = rows.groupBy("shard", block).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = sums.select("shard", block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    nth = F.row_number().over(Window.partitionBy("shard", block).orderBy(place, id_col, grp))
    return (
        rows.withColumn("slot", nth)
        .join(offsets, ["shard", block])
        .withColumns({
            "slot": (F.col(offset) + F.col("slot") - 1).cast("long"),
            "law": F.lit("bytes"),
            "text_crc32": F.crc32(F.encode(body, "UTF-8")).cast("long"),
            "grown_shard": F.lit(None).cast("int"),
        })
        .select(*[c for c in docs.columns if c not in (order or ())], *names)
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
