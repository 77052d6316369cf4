r"""Merkle manifest of a dataset: digests of all rows, of trees over them, and proofs, by sibling-shift self-joins.

Rows of one key (a language, say) are the leaves of a tree, in order; `fan_out` consecutive nodes make a run and have one parent. On every level each node computes the
slots of its siblings (its own, shifted by 1 to fan_out - 1, modulo fan_out; with two slots that is XOR 1) and equijoins the level with itself on run and slot. That gives
each node what stands left and right of it in its run; the rows in slot zero, which have the whole run, emit the parents. Both sides of the join are dealt by
run alone, so a level is shuffled once, whatever the fan-out. The trees' roots are the leaves of one more tree.

On the way down each node gets its path, the siblings of all levels to the root, by a join with its parent on the run number, so a parent's path
is shuffled once for fan_out children. No key is hot: runs hold fan_out rows, and a tree of a third of all rows has as many runs. Leaves are numbered by a sort over all
partitions and the counts of each key in each. To the driver go the largest tree's size and the root.

Nulls and ties: a null key is a key of its own, before all others; null fields of a record are `-`; a null id sorts first in its tree. Rows of equal id are ordered by leaf, and
repeated rows are leaves each. Texts of any length are hashed whole. An empty table has no rows and no root. A tree of one leaf is that leaf. Extra columns are not read; so names don't clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, held, require, shuffle_partitions, table, written

FAN_OUT = 8
#: Both sides of a join on run and slot may stay dealt by run alone.
BY_RUN = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def record_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of a record: each field as `-` if null, else its UTF-8 byte count, a colon and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in shown]), 256)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, ..., digest) with idx, from 0 in the tree's order, and the tree's size."""
    n = shuffle_partitions(leaves.sparkSession)
    sort = ["tree", *[F.asc_nulls_first(c) for c in order], "digest"]
    placed = written(leaves.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("row", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    of = Window.partitionBy("tree")  # a row for each partition
    counts = counts.withColumns({"size": F.sum("n").over(of), "before": F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = placed.join(counts.drop("n"), ["tree", "part"])
    return rows.withColumn("idx", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "first", "before")


def siblings(nodes: DataFrame, fan_out: int, carry: list[str] = ()) -> DataFrame:
    """nodes (tree, idx, size, digest, carry) with run and slot, and left and right: the siblings' digests before and after the node, one after another. A tree's
    last node (size 1) has none."""
    placed = nodes.withColumns({"run": F.expr(f"idx div {fan_out}"), "slot": (F.col("idx") % fan_out).cast("int")}).repartition("tree", "run")
    asking = placed.withColumn("want", F.explode(F.sequence(F.lit(1), F.lit(fan_out - 1)))).withColumn("want", F.pmod(F.col("slot") + F.col("want"), F.lit(fan_out)))
    there = placed.select("tree", "run", F.col("slot").alias("want"), F.col("digest").alias("other"))
    met = asking.join(there, ["tree", "run", "want"], "left")
    found = F.sort_array(F.collect_list(F.when(F.col("other").isNotNull(), F.struct("want", "other"))))
    rows = met.groupBy("tree", "run", "slot", "idx", "size", "digest", *carry).agg(found.alias("found"))
    side = lambda keep: F.aggregate(F.filter("found", keep), F.lit(b""), lambda a, x: F.concat(a, x["other"]))
    return rows.withColumns({"left": side(lambda x: x["want"] < F.col("slot")), "right": side(lambda x: x["want"] > F.col("slot"))}).drop("found")


def levels(nodes: DataFrame, fan_out: int = FAN_OUT, carry: list[str] = ()) -> list[DataFrame]:
    """The levels of all trees from the leaves up, each as `siblings` gives it. A tree ends on the level where its size is 1."""
    out, nodes = [], written(nodes, "leaves")
    size = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        with held(nodes.sparkSession, BY_RUN):
            out.append(written(siblings(nodes, fan_out, carry if not out else []), "level"))
        if size <= 1:
            return out
        parent = F.unhex(F.sha2(F.concat(hex_of("digest"), hex_of("right")), 256))
        nodes = out[-1].where("slot = 0 AND size > 1").select("tree", F.col("run").alias("idx"), F.expr(f"(size + {fan_out - 1}) div {fan_out}").alias("size"), parent.alias("digest"))
        size = -(-size // fan_out)


def roots(of: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the trees."""
    ends = [x.where("size = 1").select("tree", "digest") for x in of]
    out = ends[0]
    for x in ends[1:]:
        out = out.union(x)
    return out


def with_paths(of: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves' level with the columns of tops (tree, path, ...): path gets each node's siblings, level by level from the leaf's, before what tops has."""
    beside = [c for c in tops.columns if c not in ("tree", "path")]
    upper = None
    for k in range(len(of) - 1, -1, -1):
        here = of[k].withColumn("step", F.struct("left", "right")).drop("left", "right", "slot")
        rows = here.where("size = 1").join(tops, "tree")
        if upper is not None:
            above = upper.select("tree", F.col("idx").alias("run"), F.col("path").alias("rest"), *beside)
            inner = here.where("size > 1").join(above, ["tree", "run"])
            rows = inner.withColumn("path", F.concat(F.array("step"), "rest")).drop("rest").unionByName(rows)
        rows = rows.drop("step", "run")
        upper = written(rows, "paths") if k else rows
    return upper


def manifest(leaves: DataFrame, order: list[str], fan_out: int = FAN_OUT, carry: list[str] = ()) -> DataFrame:
    """leaves (tree: text or null, digest: 32 bytes, order and carry columns) with subroot (bytes), path (array of left and right, bytes) and root (hex)."""
    keyed = leaves.withColumn("tree", F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "tree")))
    kept = list(dict.fromkeys([*order, *carry]))
    of = levels(numbered(keyed.select("tree", "digest", *kept), order), fan_out, kept)
    subs = roots(of).select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest")
    top = levels(numbered(subs, ["name"]), fan_out, ["name"])
    root = roots(top).first()
    end = top[-1].select("tree").limit(0).select("tree", F.lit(None).cast("array<struct<left:binary,right:binary>>").alias("path"))
    end = end.union(leaves.sparkSession.createDataFrame([("all", [])], end.schema))
    tops = written(with_paths(top, end).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"), "tops")
    return with_paths(of, tops).withColumn("root", F.lit(root.digest.hex() if root else None).cast("string")).drop("tree", "idx", "size")


def proof(path: Column) -> Column:
    """SHA-256 (hex) of all siblings, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hex_of(s["left"]), hex_of(s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and a path give."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(hex_of(s["left"]), a, hex_of(s["right"])), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    require(docs, "doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: F.unhex(record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    ascii_lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col("lang").alias("tree"), "doc_id", leaf(F.col("text")).alias("digest"), F.when(tampered, leaf(ascii_lower)).alias("tampered"))
    out = manifest(written(rows, "hashed"), ["doc_id"], carry=["tampered"])
    again = folded(hex_of(F.coalesce("tampered", "digest")), F.col("path"))
    out = out.select("doc_id", hex_of("digest").alias("leaf"), hex_of("subroot").alias("subroot"), "root", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _digest(text: str) -> str:
    return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


_CLIMB = """
{level} AS (
  SELECT 0::BIGINT AS l, tree, idx, n, h FROM {leaves}
  UNION ALL
  SELECT l + 1, tree, idx // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM {level} WHERE n > 1 GROUP BY l, tree, idx // 8),
{level}_sides AS (
  SELECT a.l, a.tree, a.idx,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lefts, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rights
  FROM {level} a JOIN {level} b ON a.l = b.l AND a.tree = b.tree AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.l, a.tree, a.idx),
{level}_tall AS (SELECT tree, max(l) AS tall FROM {level} GROUP BY tree),
"""
SQL = f"""
WITH RECURSIVE {CRC32_SQL.format(of="SELECT DISTINCT doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL")},
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_digest("text")} AS h,
    CASE WHEN crc % 3 = 0 THEN {_digest("low")} END AS t
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents) LEFT JOIN crcs ON s = doc_id::VARCHAR),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_CLIMB.format(level="low", leaves="leaves").strip()}
subs AS (SELECT 'all' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_CLIMB.format(level="top", leaves="subs").strip()}
fold AS (
  SELECT tree, idx AS leaf_idx, 0::BIGINT AS l, idx, coalesce(t, h) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.tree, f.leaf_idx, f.l + 1, f.idx // 8, sha256(lefts || f.h || rights), proof || lefts || rights FROM fold f JOIN low_sides s ON f.l = s.l AND f.tree = s.tree AND f.idx = s.idx),
risen AS (
  SELECT f.tree, leaf_idx, 0::BIGINT AS l, s.idx, f.h, proof FROM fold f JOIN low_tall t ON f.tree = t.tree AND f.l = t.tall JOIN subs s ON s.name = f.tree
  UNION ALL
  SELECT f.tree, f.leaf_idx, f.l + 1, f.idx // 8, sha256(lefts || f.h || rights), proof || lefts || rights FROM risen f JOIN top_sides s ON f.l = s.l AND f.idx = s.idx)
SELECT doc_id, leaves.h AS leaf, subs.h AS subroot, root, sha256(proof) AS proof_sha256, risen.h AS folded_root, risen.h = root AS verified
FROM leaves JOIN subs ON subs.name = leaves.tree CROSS JOIN (SELECT h AS root FROM top WHERE n = 1) CROSS JOIN top_tall
JOIN risen ON risen.tree = leaves.tree AND risen.leaf_idx = leaves.idx AND risen.l = tall
"""
