"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order that depends on ids only, fill blocks of `block_bytes`. With target weight w, block j of a source is
released at slot floor(j / w) and due at slot ceil((j + 1) / w); in every slot the released block with the
earliest deadline goes next. So at every slot each source is less than one block from its weight. When a
source has run out, a new phase begins: the others' weights are scaled up and counting starts again.
Weights are taken exactly, as ratios of whole numbers. The driver deals the blocks one by one (some microseconds each, none for a document) and writes the
schedule to the shared folder as it goes, HELD blocks at a time, so its memory grows with the number of sources only; a join gives each document its slot.

Nulls and ties: null is a source of its own. A null or empty text has size 1. Repeated rows follow one another. A null id is
ordered first. A weight for an unknown source is ignored; a source without a weight, or weight 0,
comes after all others. An empty table gives an empty result. Extra columns are kept; clashing names are
kept under `_name`.
"""

from __future__ import annotations

import heapq
import math
import uuid
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, require, shared_dir, table, utf8_length, written

#: Blocks that the driver holds at a time.
HELD = 1 << 20
PERIOD, BLOCK_BYTES, BUCKETS, BUCKET_BYTES, TEMPERATURE = 4096, 64 * 1024, 256, 256 << 20, 0.7


def whole(weights: dict) -> dict:
    """The weights as whole numbers in exactly the same ratios."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[x.denominator for x in exact.values()])
    return {s: int(x * unit) for s, x in exact.items()}


def dealt(left: dict, weights: dict) -> Iterator[tuple]:
    """One phase, up to the last block of the first source that runs out: (source, slot, release, deadline) of its blocks in the order of slots. weights: whole
    numbers; left: blocks, 1 at least. What is held is a few numbers a source."""
    total = sum(weights.values())
    ready = [(-(-total // w), str(s), s, 0, 0) for s, w in weights.items()]  # deadline, name, source, block, release
    heapq.heapify(ready)
    later: list = []
    t = 0
    while True:
        while later and later[0][0] <= t:
            release, due, name, s, j = heapq.heappop(later)
            heapq.heappush(ready, (due, name, s, j, release))
        due, name, s, j, release = heapq.heappop(ready)
        if due < t + 1:
            raise ArithmeticError("a deadline was missed")
        yield s, t, release, due
        t, j = t + 1, j + 1
        if j == left[s]:
            return
        heapq.heappush(later, (j * total // weights[s], -(-(j + 1) * total // weights[s]), name, s, j))


def scheduled(blocks: dict, weights: dict, period: int = PERIOD, most: int = HELD) -> Iterator[tuple]:
    """(source, phase, first block, slots, releases, deadlines) of neighbouring blocks of a source, none across a multiple of `period`, over all phases. At most `most` blocks
    are held, however many there are."""
    left, done, slot, phase = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, 0
    exact = whole({s: weights[s] for s in left if weights.get(s, 0) > 0})
    while left:
        live = {s: w for s, w in exact.items() if s in left} or dict.fromkeys(left, 1)
        held: dict = {}
        count = 0
        for s, t, release, due in dealt(dict(left), live):
            row = held.get(s)
            if row is None:
                row = held[s] = (done[s], array("q"), array("q"), array("q"))
            for part, x in zip(row[1:], (t, release, due), strict=True):
                part.append(slot + x)
            done[s] += 1
            left[s] -= 1
            count += 1
            if done[s] % period == 0:
                count -= len(row[1])
                yield (s, phase, *held.pop(s))
            elif count >= most:
                for other, row in held.items():
                    yield (other, phase, *row)
                held, count = {}, 0
            last = t
        for s, row in held.items():
            yield (s, phase, *row)
        left = {s: n for s, n in left.items() if n}
        slot += last + 1
        phase += 1


def phases(blocks: dict, weights: dict, period: int = PERIOD) -> list[dict]:
    """The whole of a small schedule. For each phase: first slot, number of slots (its period), and for each source that has blocks in it their number, first block,
    end block and slots."""
    out: list[dict] = []
    for s, phase, first, slots, _, _ in scheduled(blocks, weights, period):
        if phase == len(out):
            out.append({"slot": sum(p["period"] for p in out), "period": 0, "sources": {}})
        part = out[phase]
        n, begin, _, at = part["sources"].get(s, (0, first, first, []))
        part["sources"][s] = (n + len(slots), begin, first + len(slots), at + [t - part["slot"] for t in slots])
        part["period"] += len(slots)
    return out


def stored(spark: SparkSession, rows: Iterator[tuple], columns: list[str], path: str, most: int = HELD) -> DataFrame:
    """Rows of `scheduled` as a table in the shared folder, written in pieces of about `most` blocks: neither the driver nor a plan holds all of them."""
    kinds = [pa.string(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * 3
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(columns, ["string", "int", "long", *["array<long>"] * 3], strict=True))

    def write(piece: list[tuple]) -> None:
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([np.frombuffer(y, np.int64) for y in x] or [np.zeros(0, np.int64)]))) for x in ([r[k] for r in piece] for k in (3, 4, 5))]
        flat = [pa.array([r[k] for r in piece], kinds[k]) for k in range(3)]
        spark.createDataFrame(pa.Table.from_arrays([*flat, *lists], columns), schema).write.mode("append").option("compression", "zstd").parquet(path)

    piece, count = [], 0
    for row in rows:
        piece.append(row)
        count += len(row[3])
        if count >= most:
            write(piece)
            piece, count = [], 0
    write(piece)
    return spark.read.schema(schema).parquet(path)


def mix(docs: DataFrame, weights: dict | None = None, block_bytes: int = BLOCK_BYTES, source: str = "source", id_col: str = "doc_id", text: str = "text", period: int = PERIOD) -> DataFrame:
    """Adds mix_block (the source's block in which the document begins), mix_phase, mix_slot, mix_release and mix_deadline (both in slots).

    weights: by source; where None, a source's share of all bytes to the power TEMPERATURE. The running size of a source is summed in
    two steps, within hash buckets and over their totals, so no task holds a whole source: BUCKETS of them, and more once one
    would hold over BUCKET_BYTES (which changes no result). period: blocks in a row of the
    table of slots; without effect on the result."""
    require(docs, source, id_col, text)
    spark = docs.sparkSession
    names = ("mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline")
    for c in [c for c in docs.columns if c.lower() in names]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    size, bucket, src, before, piece, first, end, slots, releases, dues = fresh(docs, "size", "bucket", "src", "before", "piece", "first", "end", "slots", "releases", "dues")
    order = F.xxhash64(id_col, F.lit("mix"))
    # null and text sources apart, as one never-null key
    key = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    sized = docs.withColumns({size: utf8_length(F.col(text)) + 1, src: key})
    buckets, largest = BUCKETS, None
    while largest is None or largest > BUCKET_BYTES and buckets < 1 << 24:
        buckets = buckets if largest is None else buckets * 2 ** math.ceil(math.log2(largest / BUCKET_BYTES))
        # by the top bits, so that more buckets keep the order of documents
        rows = sized.withColumn(bucket, F.shiftrightunsigned(order, 64 - int(math.log2(buckets))).cast("int"))
        totals = written(rows.groupBy(src, bucket).agg(F.sum(size).alias("total"), F.max(size).alias("one")), "totals")
        # buckets that one document fills can't be split
        largest = totals.agg(F.max(F.col("total") - F.col("one"))).first()[0] or 0
    sizes = {s: n for s, n in sorted(totals.groupBy(src).agg(F.sum("total")).collect())}  # a row a source
    given = {s: float(n) ** TEMPERATURE for s, n in sizes.items()} if weights is None else {("" if s is None else f"={s}"): w for s, w in weights.items()}
    blocks = {s: -(-n // block_bytes) for s, n in sizes.items()}
    path = f"{shared_dir(spark)}/spindle-{uuid.uuid4().hex}/schedule"
    lookup = stored(spark, scheduled(blocks, given, period), [src, "mix_phase", first, slots, releases, dues], path)
    lookup = lookup.withColumns({piece: F.expr(f"`{first}` div {period}"), end: F.col(first) + F.size(slots)})
    sofar = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    offsets = totals.select(src, bucket, F.coalesce(F.sum("total").over(sofar), F.lit(0)).alias(before))
    within = Window.partitionBy(src, bucket).orderBy(order, id_col, size).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_block", F.coalesce(F.sum(size).over(within), F.lit(0)))
    rows = rows.join(offsets, [src, bucket])
    rows = rows.withColumn("mix_block", F.expr(f"(mix_block + `{before}`) div {block_bytes}"))
    rows = rows.withColumn(piece, F.expr(f"mix_block div {period}"))
    inside = (rows[src] == lookup[src]) & (rows[piece] == lookup[piece]) & (F.col("mix_block") >= F.col(first)) & (F.col("mix_block") < F.col(end))
    rows = rows.join(lookup, inside).drop(lookup[src], lookup[piece])
    at = (F.col("mix_block") - F.col(first)).cast("int") + 1
    rows = rows.withColumns({"mix_slot": F.element_at(slots, at), "mix_release": F.element_at(releases, at), "mix_deadline": F.element_at(dues, at)})
    return rows.select(*docs.columns, *names)


def in_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows by slot over the partitions, so that files written from it hold the mixture in its order."""
    n = max(1, int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mixed.repartitionByRange(n, "mix_slot", id_col).sortWithinPartitions("mix_slot", id_col)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).drop("text")


#: The constants of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _hashed() -> str:
    """SQL of documents with x: xxhash64(doc_id, 'mix') as Spark has it, unsigned; a null id is passed over."""
    p1, p2, p3, p4, p5 = _PRIMES
    wrap = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    times = lambda x, by: wrap(f"({x})::UHUGEINT * {by}::UHUGEINT")
    plus = lambda x, y: wrap(f"({x})::UHUGEINT + {y}::UHUGEINT")
    turned = lambda x, by: plus(times(x, 1 << by), f"({x} >> {64 - by})")
    spread = ["xor(x, x >> 33)", times("x", p2), "xor(x, x >> 29)", times("x", p3), "xor(x, x >> 32)"]
    unsigned = wrap("CASE WHEN doc_id < 0 THEN 18446744073709551616::UHUGEINT - (-doc_id)::UHUGEINT ELSE doc_id::UHUGEINT END")
    steps = [unsigned, times("x", p2), turned("x", 31), times("x", p1), f"xor(x, {(42 + p5 + 8) % (1 << 64)}::UBIGINT)", turned("x", 27), plus(times("x", p1), p4), *spread]
    steps += ["coalesce(x, 42::UBIGINT)", plus("x", (p5 + 3) % (1 << 64))]
    for byte in b"mix":
        steps += [f"xor(x, {byte * p5 % (1 << 64)}::UBIGINT)", turned("x", 11), times("x", p1)]
    sql = "SELECT *, NULL::UBIGINT AS x FROM documents"
    for step in [*steps, *spread]:
        sql = f"SELECT * REPLACE ({step} AS x) FROM ({sql})"
    return sql


#: As doubles, weights are near enough to tell deadlines of few thousand blocks. One row a slot: the released block of the earliest deadline, ties by source.
SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src, coalesce(strlen(text), 0) + 1 AS size,
    x AS nth FROM ({_hashed()})),
placed AS (SELECT *, (coalesce(sum(size) OVER (PARTITION BY src ORDER BY nth, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_BYTES})::BIGINT AS block FROM sized),
sources AS (SELECT src, pow(sum(size)::DOUBLE, {TEMPERATURE}::DOUBLE) AS w, (sum(size)::BIGINT + {BLOCK_BYTES - 1}) // {BLOCK_BYTES} AS blocks FROM sized GROUP BY src),
state AS (
  SELECT 0::BIGINT AS slot, 0 AS phase, 0::BIGINT AS since, list({{'src': src, 'w': w, 'done': 0::BIGINT, 'gone': 0::BIGINT, 'left': blocks::BIGINT}} ORDER BY src) AS s,
    NULL::VARCHAR AS src, NULL::BIGINT AS block, NULL::BIGINT AS release, NULL::BIGINT AS due FROM sources
  UNION ALL
  SELECT slot + 1, CASE WHEN ends THEN phase + 1 ELSE phase END, CASE WHEN ends THEN slot + 1 ELSE since END,
    list_filter(list_transform(s, lambda x: {{'src': x.src, 'w': x.w, 'done': CASE WHEN ends THEN 0 WHEN x.src = pick.src THEN x.done + 1 ELSE x.done END,
      'gone': CASE WHEN x.src = pick.src THEN x.gone + 1 ELSE x.gone END, 'left': CASE WHEN x.src = pick.src THEN x.left - 1 ELSE x.left END}}), lambda x: x.left > 0),
    pick.src, pick.gone, since + pick.release, since + pick.due
  FROM (
    SELECT *, pick.left = 1 AS ends FROM (
      SELECT slot, phase, since, s, list_sort(list_filter(list_transform(s, lambda x: {{'due': ceil((x.done + 1) * total / x.w)::BIGINT, 'src': x.src, 'release': floor(x.done * total / x.w)::BIGINT, 'gone': x.gone, 'left': x.left}}),
        lambda x: x.release <= slot - since))[1] AS pick
      FROM (SELECT slot, phase, since, s, list_sum(list_transform(s, lambda x: x.w)) AS total FROM state WHERE len(s) > 0))))
SELECT doc_id, source, block AS mix_block, mix_phase, slot - 1 AS mix_slot, release AS mix_release, due AS mix_deadline
FROM placed JOIN (SELECT *, phase - CASE WHEN since = slot THEN 1 ELSE 0 END AS mix_phase FROM state WHERE src IS NOT NULL) USING (src, block)
"""
