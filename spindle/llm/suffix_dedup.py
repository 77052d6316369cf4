r"""Removal of repeated 100-byte strings by a distributed sort of suffixes.

Suffixes are sorted where they can matter. Each window of SPAN bytes has an anchor: the position of its least K-byte
hash, which depends on the window's bytes only; equal windows have equal anchors. Then:
1. Anchors whose K bytes occur once in the corpus are dropped: hashes are counted with a map-side sum.
2. The rest of the anchors cut their texts into pieces, the windows that share an anchor. Equal pieces are grouped by digest: all but
   the first are repeats as a whole. An anchor string with one kind of piece is done.
3. Where one anchor string has several pieces, the suffixes that begin at the anchors are sorted (front_coded), and windows
   are equal if their suffixes share what lies right of the anchor and their bytes left of it are the same.
   Anchor strings with more than MAX_KINDS kinds of piece are compared window by window through a shuffle on the window instead, so no
   task holds an unbounded group.

A byte goes if it is in a window that starts earlier elsewhere: in a smaller id, or in the same document further left. Equal texts are
one text from the start, at the smallest id; its copies at larger ids lose all bytes if they have SPAN or more.
Nulls and ties: a null text is empty. Rows with equal id and text are one document and lose the same bytes; different texts under one id are
ordered by text hash. A null id comes last. Texts under SPAN bytes keep all. An empty table gives an empty
result. Extra columns are kept by `deduplicated`; clashing names are kept under `_name`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, require, shuffle_partitions, table, written
from .front_coded import common_prefix, sorted_groups

SPAN, K, SEGMENT, MAX_KINDS = 100, 32, 1 << 20, 20_000
#: Windows that are hashed at once; suffixes of a batch.
BLOCK, ROWS = 1 << 15, 10_000
#: Bytes of suffixes, and of what stands left of them, that one task merges, about.
PART_BYTES = 64 << 20
NO_ID = (1 << 63) - 1
_U = np.uint64
_TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=_U)


def anchors(data: bytes, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Anchors of the texts data[a:b] for ascending (a, b) in bounds: position, first and last window (starts), and hash.
    Positions are in data. Windows are hashed BLOCK at a time, so that what is computed stays in the processor's cache."""
    texts = np.array([x for x in bounds if x[1] - x[0] >= SPAN], np.int64).reshape(-1, 2)
    begins, stops = texts[:, 0], texts[:, 1] - SPAN + 1
    if not len(texts):
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, _U)
    raw, windows = np.frombuffer(data, np.uint8), len(data) - SPAN + 1
    found = []
    for lo in range(0, windows, BLOCK):
        hi = min(lo + BLOCK, windows)
        h, width = _TABLE[raw[lo : hi + SPAN - 1]], 1
        while width < K:
            h = h[:-width] * _U((0x9E3779B97F4A7C15 ^ (width * 0x1003F)) | 1) + h[width:]
            width *= 2
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        span, width = SPAN - K + 1, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        edges = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] - lo for x in (begins, stops)]
        starts = np.unique(np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, *edges]))
        at = (low[starts] & _U(0xFFFFFFFF)).astype(np.int64)
        found.append((starts + lo, at + lo, h[at]))
    first, at, h = (np.concatenate(c) for c in zip(*found, strict=True))
    after, text = np.append(first[1:], windows), np.searchsorted(begins, first, "right") - 1
    own = (text >= 0) & (first < stops[text])
    first, at, h, after, text = first[own], at[own], h[own], after[own], text[own]
    # what only a block's edge parts is one
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    return at[new], first[new], after[np.append(new[1:], len(first)) - 1] - 1, h[new]


def segments(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Texts joined into data of about SEGMENT bytes: (data, [(text number, its offset in the text, from, to)]). A longer text
    is cut into overlapping segments, so that each of its windows is in one."""
    parts: list[bytes] = []
    where: list[tuple[int, int, int, int]] = []
    size = 0
    for n, t in enumerate(texts):
        for a in range(0, max(len(t) - SPAN + 1, 0), SEGMENT):
            piece = t[a : a + SEGMENT + SPAN - 1]
            where.append((n, a, size, size + len(piece)))
            parts.append(piece)
            size += len(piece)
            if size >= SEGMENT:
                yield b"".join(parts), where
                parts, where, size = [], [], 0
    if where:
        yield b"".join(parts), where


def _anchor_hashes(texts: DataFrame) -> DataFrame:
    """(h, t) for the anchors of texts (t, body), once for each text or segment; for one that repeats within a text, be it in
    another segment, also (h, ~t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, bodies = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            text, before = -1, np.zeros(0, _U)  # the last segment's last text, and its hashes so far
            for data, where in segments(bodies):
                at, _, _, h = anchors(data, [(a, b) for _, _, a, b in where])
                number = np.array([w[0] for w in where])[np.searchsorted(np.array([w[2] for w in where]), at, "right") - 1]
                met = (number == text) & np.isin(h, before) if where[0][0] == text else np.zeros(len(h), bool)
                last = h[number == where[-1][0]]
                text, before = where[-1][0], np.union1d(before, last) if where[-1][0] == text else last
                # one text's anchors stand together
                own = t[number]
                order = np.lexsort((h, own))
                h, own, met = h[order], own[order], met[order]
                again = met | np.concatenate([[False], (h[1:] == h[:-1]) & (own[1:] == own[:-1])]) if len(h) else np.zeros(0, bool)
                own = np.where(again, ~own, own)
                keep = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else again
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(own[keep])], ["h", "t"])

    return texts.select("t", "body").mapInArrow(run, "h long, t long")


def _pieces(live: DataFrame) -> DataFrame:
    """Pieces of live texts (tie, t, body, hs): the windows first..last of each anchor in hs, the anchor's place, and a digest of the
    piece's bytes and of the anchor's place in it. With h, the hash of the anchor's bytes, that names a piece by 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tie, t = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            bodies = batch.column(2).to_pylist()
            wanted = [np.sort(np.asarray(x.values)) for x in batch.column(3)]
            for data, where in segments(bodies):
                at, first, last, h = anchors(data, [(a, b) for _, _, a, b in where])
                h = h.view(np.int64)
                seg = np.searchsorted(np.array([w[2] for w in where]), at, "right") - 1
                keep = np.zeros(len(at), bool)
                edges = np.searchsorted(seg, np.arange(len(where) + 1))
                for k, (n, *_) in enumerate(where):
                    own = slice(edges[k], edges[k + 1])
                    keep[own] = np.isin(h[own], wanted[n])
                at, first, last, h, seg = at[keep], first[keep], last[keep], h[keep], seg[keep]
                number = np.array([w[0] for w in where])[seg]
                shift = np.array([w[1] - w[2] for w in where])[seg]
                digest = [xxhash.xxh3_64_intdigest(data[a : b + SPAN], p) for a, b, p in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)]
                columns = (h, np.array(digest, _U).view(np.int64), tie[number], t[number], first + shift, last + shift, at + shift)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "digest", "tie", "t", "first", "last", "at"])

    return live.select("tie", "t", "body", "hs").mapInArrow(run, "h long, digest long, tie long, t long, first long, last long, at long")


def _suffixes(live: DataFrame, several: DataFrame) -> DataFrame:
    """The bytes of pieces (tie, t, first, last, at, n): left of the anchor, and the suffix that begins there."""
    wanted = several.groupBy("tie", "t").agg(F.collect_list(F.struct("first", "last", "at", "n")).alias("pieces"))
    names = ["tie", "t", "first", "last", "at", "n", "left", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, pieces = batch.column(2).to_pylist(), batch.column(3).flatten()
            rows = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
            for i in range(0, len(rows), ROWS):
                row, own = rows[i : i + ROWS], pieces.slice(i, ROWS)
                first, last, at, n = own.flatten()
                places = list(zip(row.tolist(), first.to_pylist(), at.to_pylist(), last.to_pylist(), strict=True))
                left = pa.array([bodies[k][f:a] for k, f, a, _ in places], pa.binary())
                suffix = pa.array([bodies[k][a : b + SPAN] for k, _, a, b in places], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), first, last, at, n, left, suffix], names)

    joined = live.join(wanted, ["tie", "t"]).select("tie", "t", "body", "pieces")
    return joined.mapInArrow(run, "tie long, t long, first long, last long, at long, n long, left binary, suffix binary")


def _runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """Bytes that windows at these ascending starts cover, consecutive starts as one run."""
    a = b = -2
    for s in starts:
        if s != b + 1:
            if a >= 0:
                yield a, b + SPAN
            a = s
        b = s
    if a >= 0:
        yield a, b + SPAN


def _sorted_repeats(entries: Iterator[tuple[int, bytes, tuple]]) -> Iterator[pa.RecordBatch]:
    """Covered bytes (tie, t, lo, hi) from suffixes in order: groups share K bytes; payload: tie, t, first, last, at, left."""
    out: list[tuple[int, int, int, int]] = []

    def pair(a: tuple, b: tuple, shared: int) -> None:
        """Of two suffixes the equal windows begin at neighbouring places: as far left of the anchors as the bytes there are the same."""
        least = max(SPAN - shared, a[4] - a[3], b[4] - b[3])
        if least <= min(len(a[5]), len(b[5])):
            most = common_prefix(a[5][::-1], b[5][::-1])
            if least <= most:
                tie, t, at = max((a[0], a[1], a[4]), (b[0], b[1], b[4]))
                out.append((tie, t, at - most, at - least + SPAN))

    def close(group: list[tuple[int, bytes, tuple]]) -> None:
        if len(group) < 2:
            return
        if len(group) == 2:
            pair(*[p for _, _, p in group], group[1][0])
            return
        repeats: list[list[int]] = [[] for _ in group]
        reach = [(at - last, at - first) for _, _, (_, _, first, last, at, _) in group]  # bytes of a window left of the anchor
        for d in range(min(r[0] for r in reach), max(r[1] for r in reach) + 1):
            run, best, members = 0, {}, []
            for k, (shared, _, (tie, t, _, _, at, left)) in enumerate(group):
                if shared < SPAN - d:
                    run += 1
                if reach[k][0] <= d <= reach[k][1]:
                    key = (run, left[len(left) - d :])
                    place = (tie, t, at - d)
                    members.append((k, key, place))
                    if key not in best or place < best[key]:
                        best[key] = place
            for k, key, place in members:
                if best[key] != place:
                    repeats[k].append(place[2])
        for (_, _, p), starts in zip(group, repeats, strict=True):
            out.extend((p[0], p[1], a, b) for a, b in _runs(sorted(starts)))

    group: list[tuple[int, bytes, tuple]] = []
    for entry in entries:
        if entry[0] < K:
            close(group)
            group = []
            if len(out) > 10_000:
                yield _covered(out)
                out = []
        group.append(entry)
    close(group)
    yield _covered(out)


def _covered(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4, ["tie", "t", "lo", "hi"])


def _window_repeats(kinds: DataFrame) -> DataFrame:
    """Covered bytes for anchor strings with very many kinds of piece: each window is a row, summed first on the map side."""
    start = F.explode(F.sequence("first", "last"))
    body = F.concat("left", "suffix")
    windows = kinds.select("tie", "t", body.alias("body"), "first", F.explode(F.sequence("first", "last")).alias("start"))
    windows = windows.select("tie", "t", "start", F.sha2(F.expr(f"substring(body, cast(start - first + 1 AS int), {SPAN})"), 256).alias("w"))
    best = windows.groupBy("w").agg(F.min(F.struct("tie", "t", "start")).alias("best"))
    again = windows.join(best, "w").where(F.struct("tie", "t", "start") != F.col("best"))
    return again.select("tie", "t", F.col("start").alias("lo"), (F.col("start") + SPAN).alias("hi"))


def covered_bytes(docs: DataFrame, firsts: DataFrame, max_kinds: int = MAX_KINDS) -> tuple[DataFrame, DataFrame]:
    """Covered runs (tie, t, lo, hi) of texts, and those texts that may have some (tie, t, body).
    docs: tie, t, body; firsts: (t, tie) of each text's first document."""
    hashes = _anchor_hashes(docs)
    repeated = written(hashes.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("h"), "repeated")
    by_text = hashes.join(repeated, "h", "left_semi").groupBy("t").agg(F.collect_set("h").alias("hs"))
    live = written(docs.join(by_text.join(firsts, "t"), ["t", "tie"]).select("tie", "t", "body", "hs"), "live")
    pieces = written(_pieces(live), "pieces")
    kinds = pieces.groupBy("h", "digest").agg(F.min(F.struct("tie", "t", "first", "last", "at")).alias("x"))
    kinds = written(kinds.select("h", "digest", "x.*"), "kinds")
    best = kinds.select("h", "digest", F.struct("tie", "t", "first").alias("best"))
    again = pieces.select("h", "digest", "tie", "t", "first", "last").join(best, ["h", "digest"]).where(F.struct("tie", "t", "first") != F.col("best"))
    out = again.select("tie", "t", F.col("first").alias("lo"), (F.col("last") + SPAN).alias("hi"))
    many = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = written(_suffixes(live, kinds.join(many, "h")), "several")
    suffixes = several.where(F.col("n") <= max_kinds)
    size = several.agg(F.sum(F.octet_length("suffix") + F.octet_length("left"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), size // PART_BYTES)
    merged = sorted_groups(suffixes, "suffix", ["tie", "t", "first", "last", "at", "left"], K, parts, _sorted_repeats, "tie long, t long, lo long, hi long")
    return out.union(merged).union(_window_repeats(several.where(F.col("n") > max_kinds))), live.select("tie", "t", "body")


def union_of(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, ascending runs; runs that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def kept_bytes(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, end = [], 0
    for a, b in runs:
        out.append(body[end:a])
        end = b
    return b"".join([*out, body[end:]])


def _named(docs: DataFrame, text_hash: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """docs (tie, body) with the texts' names t, and (t, tie) of each name's first document. A name is a hash of 64 bits; names that texts
    of different MD5 share, some tens of them among 10^10 texts, are replaced by a hash of the MD5."""
    digest = F.md5("body")
    check = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    docs = docs.withColumn("t", text_hash(F.col("body")))

    def firsts() -> DataFrame:
        return written(docs.groupBy("t").agg(F.min("tie").alias("tie"), F.min(check).alias("lo"), F.max(check).alias("hi")), "firsts")

    found = firsts()
    shared = [r.t for r in found.where("lo <> hi").select("t").collect()]
    if shared:
        docs = docs.withColumn("t", F.when(F.col("t").isin(shared), F.xxhash64(digest)).otherwise(F.col("t")))
        found = firsts()
    return docs.select("tie", "t", "body"), found.select("t", "tie")


def _cut(docs: DataFrame, firsts: DataFrame, max_kinds: int) -> tuple[DataFrame, DataFrame]:
    """Texts' first documents (t, first_tie), and (t, n_removed, n_spans, kept) of those texts that lose bytes but not all."""
    runs, live = covered_bytes(docs, firsts, max_kinds)
    by_text = runs.groupBy("tie", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, bodies, runs = batch.columns
            removed, spans, kept = [], [], []
            for body, own in zip(bodies.to_pylist(), runs, strict=True):
                merged = union_of(list(zip(own.values.field("lo").to_pylist(), own.values.field("hi").to_pylist(), strict=True)))
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
                kept.append(kept_bytes(body, merged))
            yield pa.RecordBatch.from_arrays([t, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["t", "n_removed", "n_spans", "kept"])

    cut = live.join(by_text, ["tie", "t"]).select("t", "body", "runs").mapInArrow(run, "t long, n_removed long, n_spans long, kept binary")
    return firsts.select("t", F.col("tie").alias("first_tie")), cut


def _slim(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("tie"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_kinds: int = MAX_KINDS, text_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the bytes that stay; they may cut a character)."""
    require(docs, id_col, text)
    for c in [c for c in docs.columns if c.lower() in ("n_bytes", "n_removed", "n_spans", "kept")]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    slim, first = _named(_slim(docs, id_col, text), text_hash)
    firsts, cut = _cut(slim, first, max_kinds)
    # by text: its SHA-256 stands for it where rows get their verdict
    digest, t, tie, body, first_tie = fresh(docs, "digest", "t", "tie", "body", "first_tie")
    by_text = slim.select(F.sha2("body", 256).alias(digest), F.col("t").alias(t)).distinct()
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.withColumns({body: raw, digest: F.sha2(raw, 256), tie: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))}).join(by_text, digest)
    rows = rows.join(firsts.toDF(t, first_tie), t).join(cut.dropDuplicates(["t"]).withColumnRenamed("t", t), t, "left").withColumn("n_bytes", F.octet_length(body).cast("long"))
    return _verdict(rows, F.col(tie) > F.col(first_tie), F.col("kept"), F.col(body), F.lit(b"")).select(*docs.columns, "n_bytes", "n_removed", "n_spans", "kept")


def _verdict(rows: DataFrame, copy: Column, kept: Column, whole: Column, nothing: Column) -> DataFrame:
    """Removal of copies (all bytes, if a window fits), of cut texts, and of the rest (none)."""
    gone = copy & (F.col("n_bytes") >= SPAN)
    return rows.withColumns({
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.when(copy, F.lit(0)).otherwise(F.coalesce("n_removed", F.lit(0)))).cast("long"),
        "n_spans": F.when(gone, F.lit(1)).otherwise(F.when(copy, F.lit(0)).otherwise(F.coalesce("n_spans", F.lit(0)))).cast("long"),
        "kept": F.when(gone, nothing).otherwise(F.when(copy, whole).otherwise(F.coalesce(kept, whole))),
    })


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = _named(_slim(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"))
    firsts, cut = _cut(docs, first, MAX_KINDS)
    rows = docs.select("tie", "t", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    cut = cut.select("t", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).dropDuplicates(["t"])
    rows = rows.join(firsts.join(cut, "t", "left"), "t")
    out = _verdict(rows, F.col("tie") > F.col("first_tie"), F.col("kept"), F.col("whole"), F.sha2(F.lit(b""), 256))
    return out.select(F.nullif("tie", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
first AS (SELECT s, min({'doc_id': doc_id, 'i': i}) AS f FROM w GROUP BY s HAVING count(*) > 1),
again AS (SELECT doc_id, i FROM w JOIN first USING (s) WHERE {'doc_id': doc_id, 'i': i} <> f),
marked AS (SELECT *, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(i, 1, -101) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM marked GROUP BY doc_id, run),
gaps AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM runs),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
