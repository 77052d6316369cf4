"""Distributed merge sort of byte strings that never compares a known common prefix again.

Each task sorts its rows into runs and front-codes them: a string is stored as the length it shares with the one
before it, and the rest. Runs are cut at splitters, exchanged by a Spark shuffle, and merged with a loser tree whose nodes keep
the common prefix with the last string put out; the front coding gives that length for each run's next string for free.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_ROWS, CHUNK_ROWS = 200_000, 4096


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be start at least."""
    lo, hi = start, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class LoserTree:
    """Merges sorted streams of (shared, string, payload), where shared is the common prefix with the string before in its stream.
    Iteration gives (shared, string, payload) with shared against the string given before. compared counts the
    comparisons that had to look at bytes."""

    def __init__(self, streams: list[Iterator[tuple[int, bytes, object]]]):
        self.streams, self.compared = streams, 0
        self.width = 1
        while self.width < len(streams):
            self.width *= 2
        self.head: list = [next(s, None) for s in streams] + [None] * (self.width - len(streams))
        self.loser = [0] * self.width
        self.shared = [0] * self.width
        self.top, self.top_shared = self._play(1) if self.width > 1 else (0, 0 if self.head[0] is not None else -1)

    def _beats(self, c: int, cl: int, s: int, sl: int) -> tuple[bool, int]:
        """Whether stream c's head goes before s's, and the common prefix of the two."""
        if cl != sl:
            return cl > sl, min(cl, sl)
        if cl < 0:
            return c < s, -1
        a, b = self.head[c][1], self.head[s][1]
        self.compared += 1
        n = common_prefix(a, b, cl)
        if n == len(a) or n == len(b):
            return (len(a), c) < (len(b), s), n
        return a[n] < b[n], n

    def _play(self, node: int) -> tuple[int, int]:
        if node >= self.width:
            k = node - self.width
            return k, 0 if self.head[k] is not None else -1
        a, al = self._play(2 * node)
        b, bl = self._play(2 * node + 1)
        first, n = self._beats(a, al, b, bl)
        if first:
            self.loser[node], self.shared[node] = b, n if bl >= 0 else -1
            return a, al
        self.loser[node], self.shared[node] = a, n if al >= 0 else -1
        return b, bl

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.top_shared >= 0:
            c = self.top
            _, string, payload = self.head[c]
            yield self.top_shared, string, payload
            self.head[c] = new = next(self.streams[c], None)
            cl = new[0] if new is not None else -1
            node = (c + self.width) >> 1
            while node:
                s, sl = self.loser[node], self.shared[node]
                if sl > cl:
                    self.loser[node], self.shared[node] = c, cl
                    c, cl = s, sl
                elif sl == cl:
                    first, n = self._beats(c, cl, s, sl)
                    if first:
                        self.shared[node] = n
                    else:
                        self.loser[node], self.shared[node] = c, n
                        c = s
                node >>= 1
            self.top, self.top_shared = c, cl


def splitters(strings: DataFrame, column: str, parts: int, prefix: int, sample: int = 16) -> list[bytes]:
    """At most parts - 1 ascending prefixes, from a sample of about sample strings for each part."""
    drawn = strings.select(F.substring(F.col(column), 1, prefix).alias("s"), F.xxhash64(column).alias("h"))
    found = sorted(bytes(r.s) for r in drawn.orderBy("h").limit(parts * sample).collect())
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def sorted_groups(
    rows: DataFrame, column: str, payload: list[str], prefix: int, parts: int,
    handle: Callable[[Iterator[tuple[int, bytes, tuple]]], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """Sorts rows by a binary column and gives each part, in order, to handle as (shared, string, payload). Strings with the same first
    prefix bytes are in one part. Payload columns are int64 or binary."""
    cuts = splitters(rows, column, parts, prefix)
    binary = [c for c in payload if dict(rows.dtypes)[c] == "binary"]
    fields = [("shared", "binary"), ("size", "binary"), ("tail", "binary")] + [(f"p_{c}", "binary") for c in payload] + [(f"n_{c}", "binary") for c in binary]
    kinds = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("seq", pa.int32())] + [(n, pa.binary()) for n, _ in fields])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= RUN_ROWS:
                yield from run(held, number)
                number, held, count = number + 1, [], 0
        if count:
            yield from run(held, number)

    def run(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        data = pa.Table.from_batches(held).combine_chunks()
        strings = data.column(column).to_pylist()
        order = sorted(range(len(strings)), key=strings.__getitem__)
        columns = {c: data.column(c).to_pylist() for c in payload}
        part = [bisect.bisect_right(cuts, strings[i][:prefix]) for i in order]
        start = seq = 0
        while start < len(order):
            end = min(start + CHUNK_ROWS, len(order))
            if part[end - 1] != part[start]:
                end = bisect.bisect_right(part, part[start], start, end)
            own = order[start:end]
            before, shared, tails = b"", [], []
            for i in own:
                s = strings[i]
                n = common_prefix(before, s)
                shared.append(n)
                tails.append(s[n:])
                before = s
            values = [np.array(shared, np.uint16).tobytes(), np.array([len(x) for x in tails], np.uint16).tobytes(), b"".join(tails)]
            for c in payload:
                v = [columns[c][i] for i in own]
                values.append(b"".join(v) if c in binary else np.array(v, np.int64).tobytes())
            values += [np.array([len(columns[c][i]) for i in own], np.uint16).tobytes() for c in binary]
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([part[start], number, seq, *values], kinds, strict=True)], schema=kinds)
            start, seq = end, seq + 1

    def decoded(chunks: list[dict]) -> Iterator[tuple[int, bytes, tuple]]:
        last = b""
        for chunk in chunks:
            shared = np.frombuffer(chunk["shared"], np.uint16).tolist()
            size = np.frombuffer(chunk["size"], np.uint16).tolist()
            columns = []
            for c in payload:
                if c in binary:
                    ends = np.cumsum(np.frombuffer(chunk[f"n_{c}"], np.uint16).astype(np.int64)).tolist()
                    raw = chunk[f"p_{c}"]
                    columns.append([raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
                else:
                    columns.append(np.frombuffer(chunk[f"p_{c}"], np.int64).tolist())
            at, tail, first = 0, chunk["tail"], True
            before = b""
            for n, k, *own in zip(shared, size, *columns, strict=True):
                string = before[:n] + tail[at : at + k]
                at += k
                # a chunk is coded on its own; its first string is compared with the last of the chunk before
                yield common_prefix(last, string) if first else n, string, tuple(own)
                before = last = string
                first = False

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(own: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
            yield from handle(iter(LoserTree([decoded(chunks) for _, chunks in sorted(own.items())])))

        part, own = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if own:
                        yield from finish(own)
                    part, own = row["part"], {}
                own.setdefault(row["run"], []).append(row)
        if own:
            yield from finish(own)

    coded = rows.select(column, *payload).mapInArrow(runs, "part int, run long, seq int, " + ", ".join(f"{n} {t}" for n, t in fields))
    dealt = coded.repartition(parts, "part").sortWithinPartitions("part", "run", "seq")
    return dealt.mapInArrow(merge, schema)
