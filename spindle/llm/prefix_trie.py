r"""Prefix trie of conversations as a burst trie.

Equal conversations become one class first, with its size, smallest id and a digest of its ids. A container holds the classes whose turns start alike, as sorted rest
of the trie not built yet; its head is the node that they share. All classes begin in the root's container. A container of more than `limit` classes bursts: its head moves down over the turns that all its classes
share (found from the least and the greatest of them) and each class goes into the container of its next turn's id. What is left is dealt by head, sorted,
and swept: the common prefix with the row before closes and opens nodes. Totals of burst heads (leaves, saved tokens) come from the tops of what is below, a
join a round.

A first turn that a third of all conversations share is one burst head: its size is summed on the map side, and its classes meet their head's row by a salted join. Of a conversation that a third of all are copies of, the sorted ids are joined in pieces of
PIECE ids; only these pieces meet in one task, which digests them one by one. A container and one conversation are held in memory, nothing else is.

Nulls and ties: a null role or text is empty. Turns are ordered by turn (null first), then role, then a digest of role and text; repeated rows are turns each. Rows without a
conv_id belong to no conversation and are left out. A conversation without turns ends at the root. An empty table has no nodes, not even a root. Extra columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, require, shuffle_partitions, written

#: LIMIT: classes of a container. PIECE: ids of a class in one row. SALTS: parts of a container that meet its head's row apart.
LIMIT, PIECE, SALTS = 4096, 50_000, 64
NO_IDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def short(text: Column) -> Column:
    """16 bytes of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as id (of role and text) and chars (code points of the text)."""
    require(turns, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", role.alias("role"), short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.length(text).alias("chars"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 100 in place of its own first h; h = crc32(c) % 6."""
    first = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("first"))
    rows = own.withColumns({"base": F.expr("conv_id - conv_id % 100"), "h": (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")}).join(first, "base", "left")
    taken = F.when(F.col("first").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("first", F.lit(1), F.col("h")))
    return rows.select("conv_id", F.concat(taken, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, conv_id), sorted: (key, low, n, ids) for at most PIECE ids of a key; ids joined by commas."""
    key, ids = None, []
    row = lambda: (key, ids[0], len(ids), ",".join(map(str, ids)))
    kinds = pa.schema([("key", pa.binary()), ("low", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) >= PIECE):
                out.append(row())
                ids = []
            key = k
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), kinds, strict=True)], schema=kinds)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, low, n, ids), sorted: (key, lo, n, ends) for each key; ends is the SHA-256 (hex) of all its ids joined by commas."""
    kinds = pa.schema([("key", pa.binary()), ("lo", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    now = None
    for batch in batches:
        out = []
        for key, low, n, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if now and now[0] == key:
                now[2] += n
                now[3].update(b"," + ids.encode())
                continue
            if now:
                out.append(now)
            now = [key, low, n, hashlib.sha256(ids.encode())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*[(*o[:3], o[3].hexdigest()) for o in out], strict=True), kinds, strict=True)], schema=kinds)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now[:3], now[3].hexdigest()), kinds, strict=True)], schema=kinds)


def classes(sequences: DataFrame) -> DataFrame:
    """(lo, n, ends, ids, chars): one row for equal turns; smallest conv_id, how many, digest of their ids."""
    n = shuffle_partitions(sequences.sparkSession)
    keyed = sequences.withColumn("key", short(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")))
    keyed = written(keyed, "sequences")
    ids = keyed.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ids.mapInArrow(_joined, "key binary, low long, n long, ids string")
    found = pieces.repartition(n, "key").sortWithinPartitions("key", "low").mapInArrow(_digested, "key binary, lo long, n long, ends string").drop("key")
    rows = keyed.select(F.col("conv_id").alias("lo"), F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))
    return found.join(rows, "lo")


def burst(rows: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Containers of at most `limit` classes, a row a class with head, pos (turns that the head stands for), parent (head) and parent_lo; and for each round the heads
    that burst: head, parent, parent_lo, top (depth of its first node), bottom, n, lo, chars (of its first to its last turn), ends."""
    first = rows.withColumns({"head": F.lit(b""), "pos": F.lit(0), "parent": F.lit(None).cast("binary"), "parent_lo": F.lit(None).cast("long")})
    opened, settled, heads = written(first, "open"), [], []
    while True:
        same = [F.first(c).alias(c) for c in ("pos", "parent", "parent_lo")]
        stats = opened.groupBy("head").agg(
            F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.min(F.struct("ids", "chars")).alias("least"), F.max("ids").alias("greatest"), *same
        )
        alike = F.expr("array_position(zip_with(least.ids, greatest, (a, b) -> a <=> b), false)")
        large = stats.where(F.col("n_classes") > limit).withColumn("bottom", F.when(alike > 0, alike - 1).otherwise(F.size("greatest")).cast("int"))
        large = written(large.withColumn("chars", F.expr("least.chars")).drop("least", "greatest", "n_classes").withColumnRenamed("pos", "top"), "heads")
        if large.isEmpty():
            settled.append(opened)
            break
        salted = opened.withColumn("salt", F.pmod(F.xxhash64("lo"), F.lit(SALTS)))
        sides = large.select("head", "bottom", F.col("lo").alias("head_lo"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
        met = written(salted.join(sides, ["head", "salt"], "left").drop("salt"), "burst")
        ended = met.where("size(ids) = bottom").select("head", "ends")
        heads.append(written(large.join(ended, "head", "left"), "heads"))
        settled.append(met.where("bottom IS NULL").drop("bottom", "head_lo"))
        below = met.where("size(ids) > bottom")
        opened = below.select(
            *rows.columns, short(F.concat(F.hex("head"), F.hex(F.element_at("ids", F.col("bottom") + 1)))).alias("head"), (F.col("bottom") + 1).alias("pos"), F.col("head").alias("parent"), F.col("head_lo").alias("parent_lo"),
        )
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out, heads


class _Node:
    __slots__ = ("depth", "lo", "n", "children", "leaves", "saved", "chars", "ends", "parent")

    def __init__(self, depth: int, chars: int, parent: _Node | None):
        self.depth, self.chars, self.parent = depth, chars, parent
        self.lo, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, NO_IDS

    def close(self) -> None:
        """All below is closed; adds itself to its parent."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars
        if (up := self.parent) is not None:
            up.lo = self.lo if up.lo is None else min(up.lo, self.lo)
            up.n, up.children, up.leaves, up.saved = up.n + self.n, up.children + 1, up.leaves + self.leaves, up.saved + self.saved


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of containers, from rows sorted by head and ids; `above` is the head over a container's top node, else null."""
    kinds = pa.schema([*[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("above", pa.binary())])
    head, before, opened, nodes, over, over_lo = None, [], [], [], None, None

    def container() -> Iterator[pa.RecordBatch]:
        for node in reversed(opened):
            node.close()
        for i in range(0, len(nodes), 10_000):
            some = nodes[i : i + 10_000]
            yield pa.RecordBatch.from_pylist([
                {"conv_id": x.lo, "depth": x.depth, "parent_conv_id": over_lo if x.parent is None else x.parent.lo, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "ends_sha256": x.ends, "above": over if x.parent is None else None}
                for x in some
            ], schema=kinds)

    for batch in batches:
        for row in batch.to_pylist():
            ids, chars = row["ids"], row["chars"]
            if row["head"] != head:
                yield from container()
                head, over, over_lo, at = row["head"], row["parent"], row["parent_lo"], row["pos"]
                opened = [_Node(at, chars[at - 1] if at else 0, None)]
                nodes = [opened[0]]
            else:
                at = next((i for i, (a, b) in enumerate(zip(ids, before, strict=False)) if a != b), min(len(ids), len(before)))
                while opened[-1].depth > at:
                    opened.pop().close()
            for depth in range(at + 1, len(ids) + 1):
                opened.append(_Node(depth, chars[depth - 1], opened[-1]))
                nodes.append(opened[-1])
            end = opened[-1]
            end.n, end.ends, end.lo = end.n + row["n"], row["ends"], row["lo"] if end.lo is None else min(end.lo, row["lo"])
            before = ids
    yield from container()


def trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of sequences (conv_id: long, distinct; turns: array of id and chars): see NODES for the columns."""
    containers, heads = burst(classes(sequences), max(limit, 2))
    dealt = containers.select("head", "ids", "chars", "n", "lo", "ends", "pos", "parent", "parent_lo").repartition(shuffle_partitions(sequences.sparkSession), "head")
    nodes = written(dealt.sortWithinPartitions("head", "ids").mapInArrow(_swept, f"{NODES}, above binary"), "nodes")
    out, tops = nodes.drop("above"), nodes.where("above IS NOT NULL").select(F.col("above").alias("head"), "n_leaves", "saved_tokens")
    for large in reversed(heads):
        below = tops.groupBy("head").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        depth = F.explode(F.sequence("top", "bottom")).alias("depth")
        # turns from this node to the head's last; the root has none of its own
        turns = F.slice("chars", F.greatest(F.col("depth"), F.lit(1)), F.greatest(F.col("bottom") - F.greatest(F.col("depth"), F.lit(1)) + 1, F.lit(0)))
        saved = F.col("below") + (F.col("n") - 1) * F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a + x)
        last = F.col("depth") == F.col("bottom")
        rows = large.join(below, "head").select("*", depth).select(
            F.col("lo").alias("conv_id"),
            F.col("depth").cast("long").alias("depth"),
            F.when(F.col("depth") == F.col("top"), F.col("parent_lo")).otherwise(F.col("lo")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"),
            "n_leaves",
            saved.alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(NO_IDS))).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
            F.when(F.col("depth") == F.col("top"), F.col("parent")).alias("above"),
        )
        rows = written(rows, "nodes")
        out = out.union(rows.drop("above"))
        tops = tops.union(rows.where("above IS NOT NULL").select(F.col("above").alias("head"), "n_leaves", "saved_tokens"))
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = f"""
WITH {CRC32_SQL.format(of="SELECT DISTINCT conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL")},
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS id, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(id := id, chars := chars) ORDER BY turn NULLS FIRST, role, id) AS turns FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:crc % 6], []), o.turns[crc % 6 + 1:]) AS turns
  FROM own o JOIN crcs ON s = o.conv_id::VARCHAR LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (
  SELECT conv_id, depth, len(turns) AS size, array_to_string(list_transform(turns[1:depth], lambda t: t.id), ',') AS node,
    array_to_string(list_transform(turns[1:depth - 1], lambda t: t.id), ',') AS above, CASE WHEN depth > 0 THEN turns[depth].chars ELSE 0 END AS chars
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT node, depth, min(above) AS above, min(conv_id) AS lo, count(*) AS n, (count(*) - 1) * max(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends
  FROM prefixes GROUP BY node, depth),
families AS (
  SELECT p.node, p.depth, count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes c WHERE c.above = n.node AND c.depth = n.depth + 1)) AS leaves, sum(n.saved)::BIGINT AS saved,
    count(*) FILTER (n.depth = p.depth + 1) AS children
  FROM nodes n JOIN prefixes p ON p.conv_id = n.lo AND p.depth <= n.depth GROUP BY p.node, p.depth)
SELECT n.lo AS conv_id, n.depth, u.lo AS parent_conv_id, n.n AS n_convs, f.children AS n_children, f.leaves AS n_leaves, f.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN families f ON f.node = n.node AND f.depth = n.depth LEFT JOIN nodes u ON u.node = n.above AND u.depth = n.depth - 1
"""
