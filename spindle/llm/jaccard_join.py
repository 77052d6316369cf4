r"""Jaccard join on word n-grams with PartEnum signatures, and the components of its links.

Sets of about equal size share a band; in it two linked sets differ in at most h elements. The hash domain is cut
into n1 partitions of n2 cells. Of any floor(h / (k2+1)) + 1 partitions one has at most k2 differing cells, so some
choice of n2 - k2 of its cells is equal in both sets: a signature is the content of such a choice, and all
choices are enumerated. A set goes to the bands in which a partner can lie and emits as many
partitions, in a fixed order, as its own h asks for. Every pair of linked sets shares a signature; sets with
too many empty cells also emit their h + 1 smallest elements, as prefix filtering does.

Four steps keep groups from being squared, and lose no link:
1. Equal sets are one class from the start.
2. Signatures in at most SMALL classes give all their pairs. Classes of larger groups are crowded. Of two linked sets each has at most
   h elements that the other lacks, so a crowded class with more than h elements that no other crowded class has is linked
   with none of them (documents that merely share a passage go here).
3. The crowded classes that are left get a second, finer enumeration, with pairs of small groups as before.
4. Groups that are large even then hold mostly near copies. Their members are compared with a centre M: one member r, with the elements
   flipped in which most members differ from r. With D(x) = x ^ M, n(x) = |x| and c = (1 - J) / (1 + J), x and y are linked if and only if
   2 |D(x) & D(y)| >= w(x) + w(y), where w(x) = |D(x)| - c n(x). If that sum is 0 or less, then both are linked with the
   member of the least w, so links with it are all that is needed. Else x and y share elements of D, which few members have by
   the choice of M, and are found by a join on the rarest of them; how many of them is given by the overlap that a link needs. The join compares sketches of D
   too: pairs in which D(x) and D(y) differ too much for a link are not made. What is left of order m^2 is that comparison, among members that share one rare element.

Signatures and elements travel packed: a task sends, for each part of the hash domain, the low halves of its hashes by
class in one row. What a task holds more than SMALL times goes on without being gathered again, so no part grows with a group.

Nulls and ties: null, empty and blank texts have an empty set and link with nothing; their component is their own id.
Fewer than n words are one shingle. Repeated texts and ids keep their rows. A null id has a component: the smallest id of its class
or links, null if there is none. An empty table gives an empty result. Extra columns are kept
by `with_components`; clashing names are kept under `_name`.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, forget, fresh, require, shuffle_partitions, table, written
from .components import components, contracted

#: Cells a partition and cells left out: first and second enumeration.
COARSE, FINE = (2, 1), (5, 2)
BAND_RATIO, SMALL = 2.0, 16
#: Bytes that are hashed together; least number of longs of the parity words that rule pairs out; longs of the sketches that a join compares.
BLOCK, PARITY, SKETCH = 1 << 18, 16, 16
#: Values that a task packs at a time (more where there are very many parts), and classes that it remembers; values of one part of the domain;
#: least number of parts; parts that one task merges, one after the other; values of a direct row.
FLUSH, MET, PART_VALUES, MIN_PARTS, PARTS_A_TASK, CHUNK = 1 << 18, 50_000, 1 << 20, 16, 4, 1 << 16
NO_ID = (1 << 63) - 1
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and shift, twice)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.random.default_rng(3).integers(0, 1 << 64, 256, dtype=_U)
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


class Shingler:
    """Sets of n-word shingles of texts, as sorted and distinct 64-bit hashes. A word's hash is a polynomial in its bytes, all words of
    a block at once: a difference of running sums, shifted back by the inverse of the base."""

    def __init__(self, n: int):
        self.n = n
        self.up = self.down = np.zeros(0, _U)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of data."""
        raw = np.frombuffer(data.translate(_FOLD), np.uint8)
        if len(self.up) <= len(raw):
            self.up, self.down = _powers(_P, len(raw) + 1), _powers(_INVERSE, len(raw) + 1)
        blank = np.concatenate([[True], _BLANK[raw], [True]])
        edge = blank[1:] != blank[:-1]
        at = np.flatnonzero(edge)
        start, end = at[::2], at[1::2]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_LETTER[raw] * self.up[: len(raw)])])
        return start, _mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(_U))

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The sets of the texts, in their order."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        i = 0
        while i < len(raw):
            j, size = i, 0
            while j < len(raw) and (j == i or size + len(raw[j]) < BLOCK):
                size += len(raw[j]) + 1
                j += 1
            start, h = self.words(b" ".join(raw[i:j]))
            begin = np.cumsum([0, *[len(r) + 1 for r in raw[i:j]]])
            cut = np.searchsorted(start, begin)
            n = min(self.n, len(h))
            g = h[: len(h) - n + 1].copy() if n else h
            for k in range(1, n):
                g = g * _U(_P) + h[k : len(h) - n + 1 + k]
            g = _mixed(g + _U(n))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a >= self.n:
                    yield np.unique(g[a : b - self.n + 1])
                elif b > a:
                    one = h[a : a + 1].copy()
                    for x in h[a + 1 : b]:
                        one = one * _U(_P) + x
                    yield _mixed(one + _U(b - a))
                else:
                    yield h[:0]
            i = j


def allowed(size: int, percent: int) -> int:
    """Elements in which a set of this size can differ from a linked one, at most."""
    return (100 - percent) * size // percent


def signatures(grams: np.ndarray, percent: int, shape: tuple[int, int]) -> np.ndarray:
    """Signatures (64-bit) of one set. shape: cells a partition, cells left out."""
    size = len(grams)
    h = allowed(size, percent)
    if not h:
        return np.zeros(0, _U)  # linked sets are equal sets here
    cells, out_of = shape
    bound = lambda b: int(BAND_RATIO**b)
    home = int(np.log2(size) / np.log2(BAND_RATIO) + 1e-9)
    while bound(home + 1) <= size:
        home += 1
    while bound(home) > size:
        home -= 1
    need, out = h // (out_of + 1) + 1, []
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_mixed(grams))])
    keep = [c for c in itertools.combinations(range(cells), cells - out_of)]
    choose = np.zeros((cells, len(keep)), _U)
    for i, c in enumerate(keep):
        choose[list(c), i] = 1
    for band in range(home, home + 64):
        if bound(band) > size * 100 // percent:
            break  # no partner is that large
        most = allowed(bound(band + 1), percent) // (out_of + 1) + 1
        n1 = most + most // 8 + 1
        cut = (((grams >> _U(32)) * _U(n1 * cells)) >> _U(32)).astype(np.int64)
        edge = np.searchsorted(cut, np.arange(n1 * cells + 1))
        count = np.diff(edge).reshape(n1, cells)
        good = np.cumsum((count > 0).sum(1) > out_of)
        upto = int(np.searchsorted(good, need)) + 1
        if upto > n1:  # too many empty cells
            upto = n1
            out.append(_mixed(grams[: h + 1] + _U(band * 2 + 1)))
        cell = (sums[edge[1:]] - sums[edge[:-1]]).reshape(n1, cells)[:upto]
        content = cell @ choose
        filled = (count[:upto].astype(_U) @ choose) > 0
        salt = np.arange(upto * len(keep), dtype=_U).reshape(upto, -1) * _U(2) + _U(band << 40)
        out.append(_mixed(_mixed(content) + salt)[filled])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def parity(grams: np.ndarray) -> np.ndarray:
    """A power of two of bits, as many as elements or more, each the parity of the elements that fall on it: two sets differ in at least as many
    elements as bits. Of sizes that allow a link one has at most twice the bits of the other; its halves, xored, are its parity over half the bits."""
    bits = max(64 * PARITY, 1 << (len(grams) - 1).bit_length()) if len(grams) else 64 * PARITY
    odd = (np.bincount((grams & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(_U)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _ints(chunks: list[np.ndarray]) -> pa.Array:
    sizes = np.array([0, *map(len, chunks)]).cumsum()
    flat = np.concatenate([np.zeros(0, _U), *chunks]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(flat))


@dataclass(frozen=True)
class Names:
    """Names of sets: signed 64-bit hashes. Those that two different sets of the corpus share, some tens of them among 10^10 sets, are replaced by a
    second hash, so a name stands for 128 bits. bits: of the first hash; fewer of them in tests."""

    shared: frozenset[int] = frozenset()
    bits: int = 64

    def check(self, grams: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(grams.tobytes(), 1) - (1 << 63)

    def of(self, grams: np.ndarray) -> int:
        name = (xxhash.xxh3_64_intdigest(grams.tobytes()) >> (64 - self.bits)) - (1 << 63)
        return self.check(grams) if name in self.shared else name


def _blocks(batch: pa.RecordBatch, step: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def named_rows(docs: DataFrame, n: int, bits: int = 64) -> tuple[DataFrame, Names]:
    """(key, tie, class, n_shingles) by row of docs (key, tie, text), written once: class is null for an empty set; and what classes are named by."""

    def rows(names: Names) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = Shingler(n)
            for whole in batches:
                for batch in _blocks(whole):
                    grams = list(shingle(batch.column(2).to_pylist()))
                    named = pa.array([names.of(g) if len(g) else None for g in grams], pa.int64())
                    check = pa.array([names.check(g) if len(g) else None for g in grams], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), named, check, pa.array([len(g) for g in grams], pa.int64())], ["key", "tie", "class", "check", "n_shingles"])

        return written(docs.select("key", "tie", "text").mapInArrow(run, "key long, tie long, class long, check long, n_shingles long"), "named")

    names = Names(bits=bits)
    named = rows(names)
    ends = named.where("class IS NOT NULL").groupBy("class").agg(F.min("check").alias("lo"), F.max("check").alias("hi"))
    shared = [r["class"] for r in ends.where("lo <> hi").select("class").collect()]
    if shared:
        forget(named)
        names = Names(frozenset(shared), bits)
        named = rows(names)
    return named.drop("check"), names


Values = Callable[[np.ndarray], np.ndarray]
_PACKED = pa.schema([("part", pa.int32()), ("direct", pa.bool_()), *[(c, pa.binary()) for c in ("classes", "counts", "low", "marks")]])


def _gathered(batches: Iterator[pa.RecordBatch], n: int, names: Names, values: Values, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """About `most` values at a time: classes, and for each value, ascending, it and its class's place. Column 0 holds texts; a class
    that the task has met lately is left out."""
    shingle, met, held, size = Shingler(n), {}, [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = np.concatenate([v for _, v in held])
        of = np.repeat(np.arange(len(held)), [len(v) for _, v in held])
        order = np.argsort(value, kind="stable")
        return np.array([c for c, _ in held], np.int64), value[order], of[order]

    for whole in batches:
        for batch in _blocks(whole):
            for grams in shingle(batch.column(0).to_pylist()):
                if not len(grams) or (name := names.of(grams)) in met:
                    continue
                if len(met) >= MET:
                    met.clear()
                met[name] = None
                own = values(grams)
                if len(own):
                    held.append((name, own))
                    size += len(own)
                if size >= most:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _packed(texts: DataFrame, n: int, names: Names, values: Values, parts: int, most: int, tell: bool) -> DataFrame:
    """Rows of _PACKED, dealt and sorted by part: classes and how many values each has in this part, the values' low halves, and marks,
    values that more than `most` classes of a task have: with tell these go on as direct rows (class and value), else as marks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for classes, value, of in _gathered(batches, n, names, values, max(FLUSH, min(8 * parts, 8 * FLUSH))):
            edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            size = np.diff(np.append(edge, len(value)))
            often = np.repeat(size > most, size)
            part = (((value >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
            low = (value & _U(0xFFFFFFFF)).astype(np.uint32)
            rows = []
            if tell:
                whole, who = (part[often] << 32) | low[often], classes[of[often]]
                rows += [(int(i // CHUNK % parts), True, who[i : i + CHUNK].tobytes(), b"", whole[i : i + CHUNK].tobytes(), b"") for i in range(0, len(who), CHUNK)]
            first = edge[size > most]
            marked, marks = part[first], low[first]
            few = np.flatnonzero(~often)
            few = few[np.lexsort((of[few], part[few]))]
            at, own, low = part[few], of[few], low[few]
            begin, end = np.searchsorted(at, np.arange(parts)), np.searchsorted(at, np.arange(parts), "right")
            m_begin, m_end = np.searchsorted(marked, np.arange(parts)), np.searchsorted(marked, np.arange(parts), "right")
            for p in np.flatnonzero((end > begin) | (m_end > m_begin)).tolist():
                o = own[begin[p] : end[p]]
                new = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else o
                counts = np.diff(np.append(new, len(o))).astype(np.uint32)
                rows.append((p, False, classes[o[new]].tobytes(), counts.tobytes(), low[begin[p] : end[p]].tobytes(), marks[m_begin[p] : m_end[p]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

    packed = texts.select("text").mapInArrow(run, "part int, direct boolean, classes binary, counts binary, low binary, marks binary")
    return packed.repartition(max(parts // PARTS_A_TASK, shuffle_partitions(texts.sparkSession)), "part").sortWithinPartitions("part")


def _by_part(batches: Iterator[pa.RecordBatch], direct: Callable, finish: Callable) -> Iterator[pa.RecordBatch]:
    """finish(part, values' low halves, their classes, marks) for each part, of (value, class) once each and sorted; direct(classes, values)."""

    def close(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
        own = np.concatenate([np.repeat(np.frombuffer(r["classes"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in rows])
        marks = np.unique(np.concatenate([np.frombuffer(r["marks"], np.uint32) for r in rows]))
        order = np.lexsort((own, low))
        low, own = low[order], own[order]
        once = np.concatenate([[True], (low[1:] != low[:-1]) | (own[1:] != own[:-1])]) if len(low) else np.zeros(0, bool)
        return finish(part, low[once], own[once], marks)

    part, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["direct"]:
                yield from direct(np.frombuffer(r["classes"], np.int64), np.frombuffer(r["low"], np.int64))
                continue
            if r["part"] != part:
                if rows:
                    yield from close(part, rows)
                part, rows = r["part"], []
            rows.append(r)
    if rows:
        yield from close(part, rows)


def _longs(*columns: np.ndarray | None) -> pa.RecordBatch:
    """A batch of long columns a, b, sig; None: nulls."""
    n = max(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["a", "b", "sig"])


def _parts(values: int) -> int:
    return max(MIN_PARTS, values // PART_VALUES)


def shared_signatures(texts: DataFrame, n: int, names: Names, percent: int, shape: tuple[int, int], total: int, small: int) -> DataFrame:
    """From the texts' classes: pairs (a, b, null) of classes that share a signature of at most `small` classes, and (class, null, sig) for each
    signature of more classes. total: elements of all sets, about."""

    def finish(part: int, low: np.ndarray, own: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(low)))
        large = (size > small) | np.isin(low[edge], marks)
        inside = np.repeat(large, size)
        if inside.any():
            yield _longs(own[inside], None, (part << 32) | low[inside].astype(np.int64))
        pairs = []
        for k in range(2, small + 1):
            start = edge[(size == k) & ~large]
            if len(start):
                group = own[start[:, None] + np.arange(k)]
                pairs += [np.stack([group[:, i], group[:, j]]) for i, j in itertools.combinations(range(k), 2)]
        if pairs:
            both = np.unique(np.concatenate(pairs, 1), axis=1)
            yield _longs(both[0], both[1], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_part(batches, lambda classes, sigs: [_longs(classes, None, sigs)], finish)

    parts = _parts(total * (100 - percent) // percent * len(list(itertools.combinations(range(shape[0]), shape[1]))) // (shape[1] + 1))
    return _packed(texts, n, names, lambda g: signatures(g, percent, shape), parts, small, True).mapInArrow(run, "a long, b long, sig long")


def own_elements(texts: DataFrame, n: int, names: Names, total: int) -> DataFrame:
    """(class, own): how many elements of each class of the texts no other of them has; classes without any are left out. Counts by part of the
    elements travel packed by part of the classes, and are summed there."""
    parts = _parts(total)

    def finish(part: int, low: np.ndarray, own: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        alone = np.concatenate([[True], low[1:] != low[:-1]]) & np.concatenate([low[1:] != low[:-1], [True]]) if len(low) else np.zeros(0, bool)
        classes, counts = np.unique(own[alone & ~np.isin(low, marks)], return_counts=True)
        to = ((((classes.view(_U) ^ _U(1 << 63)) >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int32)  # ascending, as classes are
        begin, end = np.searchsorted(to, np.arange(parts)), np.searchsorted(to, np.arange(parts), "right")
        some = np.flatnonzero(end > begin).tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()),
            pa.array([classes[begin[p] : end[p]].tobytes() for p in some], pa.binary()),
            pa.array([counts[begin[p] : end[p]].astype(np.uint32).tobytes() for p in some], pa.binary()),
        ], ["part", "classes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_part(batches, lambda classes, values: [], finish)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, own in itertools.groupby(rows, lambda r: r["part"]):
            held = [(np.frombuffer(r["classes"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in own]
            classes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([k for _, k in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sums, pa.int64())], ["class", "own"])

    counted = _packed(texts, n, names, lambda g: g, parts, 1, False).mapInArrow(run, "part int, classes binary, counts binary")
    dealt = counted.repartition(max(parts // PARTS_A_TASK, shuffle_partitions(texts.sparkSession)), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(summed, "class long, own long")


def _near(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parity words don't rule out."""
    side = lambda k: profiles.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    m = F.least(F.size("pa"), F.size("pb"))
    folded = lambda p: F.when(F.size(p) == m, F.col(p)).otherwise(xor(F.slice(p, F.lit(1), m), F.slice(p, m + 1, m)))
    unlike = F.aggregate(xor(folded("pa"), folded("pb")), F.lit(0), lambda s, v: s + F.bit_count(v))
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (unlike * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb")))
    return written(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b").distinct(), "near")


def _compared(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole):
                a, b, x, y = batch.columns
                ok = [linked(np.asarray(p.values).view(_U), np.asarray(q.values).view(_U), percent) for p, q in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("class").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    return near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _stars(large: DataFrame) -> DataFrame:
    """(r, x, strength): in groups that stay large (sig, class), each member x with one r, the member that is in most of these groups: of near copies
    the one with fewest changes of its own. r is a member too. strength: groups that r is in."""
    counted = large.join(large.groupBy("class").agg(F.count(F.lit(1)).alias("shared")), "class")
    first = counted.groupBy("sig").agg(F.max(F.struct("shared", "class")).alias("top"))
    stars = large.join(first, "sig").select(F.col("top.class").alias("r"), F.col("class").alias("x"), F.col("top.shared").alias("strength"))
    return written(stars.distinct(), "stars")


def _fewer_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(r, x) with fewer centres: one that is linked with a stronger centre, whose member it is, gives it its own members. So a group of near copies that
    picks a centre for each of its signatures is compared with few of them; centres that are not linked keep apart."""
    own = stars.where("r = x").select(F.col("r").alias("c"), F.col("strength").alias("s"))
    met = stars.where("r <> x").join(own, F.col("x") == F.col("c")).where("struct(strength, r) > struct(s, c)")
    tied = written(_compared(met.select(F.col("r").alias("a"), F.col("x").alias("b")), sets, percent), "centres")
    best = tied.join(own, F.col("a") == F.col("c")).groupBy(F.col("b").alias("r")).agg(F.max(F.struct("s", "a")).alias("to")).select("r", F.col("to.a").alias("to"))
    for _ in range(2):
        best = best.join(best.toDF("to", "next"), "to", "left").select("r", F.coalesce("next", "to").alias("to"))
    merged = stars.join(best, "r", "left").select(F.coalesce("to", "r").alias("r"), "x")
    return written(merged.distinct(), "stars")


def _differences(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each (r, x): linked or not, and x ^ r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole):
                r, x, p, q = batch.columns
                both = [(np.asarray(a.values).view(_U), np.asarray(b.values).view(_U)) for a, b in zip(p, q, strict=True)]
                ok = pa.array([linked(a, b, percent) for a, b in both], pa.bool_())
                size = pa.array([len(b) for _, b in both], pa.int64())
                unlike = _ints([np.setxor1d(a, b, assume_unique=True) for a, b in both])
                yield pa.RecordBatch.from_arrays([r, x, ok, size, unlike], ["r", "x", "ok", "n", "d"])

    p = sets.select(F.col("class").alias("r"), F.col("grams").alias("p"))
    q = sets.select(F.col("class").alias("x"), F.col("grams").alias("q"))
    seen = stars.join(p, "r").join(q, "x").select("r", "x", "p", "q")
    return written(seen.mapInArrow(run, "r long, x long, ok boolean, n long, d array<long>"), "differences")


def _centred(seen: DataFrame, percent: int) -> DataFrame:
    """(r, x, n, d, w, sketch of d): d = x ^ M with the centre M, which is r with the elements flipped in which more than half of its members differ from it
    (fewer than twice the mean size of d), and w times 100 + percent."""
    members = seen.groupBy("r").agg(F.count(F.lit(1)).alias("members"))
    often = seen.select("r", F.explode("d").alias("e")).groupBy("r", "e").agg(F.count(F.lit(1)).alias("k"))
    flips = often.join(members, "r").where("2 * k > members").groupBy("r").agg(F.collect_list("e").alias("flip"))
    none = F.array().cast("array<long>")
    at = seen.join(flips, "r", "left").withColumn("flip", F.coalesce("flip", none))
    d = F.when(F.size("flip") == 0, F.col("d")).otherwise(F.concat(F.array_except("d", "flip"), F.array_except("flip", "d")))
    at = at.select("r", "x", "n", d.alias("d"))
    return written(_sketched(at.withColumn("w", F.size("d") * (100 + percent) - F.col("n") * (100 - percent))), "centred")


def _sketched(centred: DataFrame) -> DataFrame:
    """Adds s0, s1, ...: SKETCH longs of the parities of d, in which two differ in no more bits than their d in elements."""
    names = [f"s{i}" for i in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [np.asarray(x.values).view(_U) for x in batch.column(0)]
            bits = np.array([np.packbits((np.bincount((_mixed(x) & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64) for x in d]).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(bits[:, i]) for i in range(SKETCH)]], [*batch.schema.names, *names])

    kinds = ", ".join(f"{c} {t}" for c, t in centred.select("d", "r", "x", "n", "w").dtypes)
    return centred.select("d", "r", "x", "n", "w").mapInArrow(run, kinds + "".join(f", {c} long" for c in names))


def _centre_links(centred: DataFrame) -> DataFrame:
    """(u, v): each member whose w and the least one sum to 0 or less, with the member of that least w. They are linked."""
    least = centred.groupBy("r").agg(F.min(F.struct("w", "x")).alias("least"))
    return centred.join(least, "r").where("w + least.w <= 0 AND x <> least.x").select(F.col("least.x").alias("u"), F.col("x").alias("v")).distinct()


def _hidden_pairs(centred: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one centre's members that may be linked and are not in one component (node, component) yet. Members that share a rare element are
    many where copies of a text are changed in few ways; the join itself compares their sketches, so that pairs whose D differ too much aren't made."""
    sketch = [f"s{i}" for i in range(SKETCH)]
    at = centred.join(joined.withColumnRenamed("node", "x"), "x", "left").withColumn("in", F.coalesce("component", "x"))
    # where one component holds all members there is nothing left to find
    split = at.groupBy("r").agg(F.min("in").alias("lo"), F.max("in").alias("hi"), F.min("w").alias("low")).where("lo <> hi").select("r", "low")
    # common elements of D that a link needs: half of w(x) + w(y), and 1. For a far member (w(x) + low > 0) w(y) is low at least; a near one is
    # in a component with all near ones, so only far partners matter, with w(y) > -low
    unit = 2 * (100 + percent)
    far = F.col("w") + F.col("low") > 0
    needs = F.greatest(F.lit(1), F.when(far, F.ceil((F.col("w") + F.col("low")) / unit)).otherwise(F.floor((F.col("w") - F.col("low")) / unit) + 1))
    able = at.join(split, "r").withColumns({"needs": needs, "far": far}).where(F.size("d") >= F.col("needs"))
    parts = able.select("r", "x", "in", "n", "w", "needs", "far", F.explode("d").alias("e"))
    often = parts.groupBy("r", "e").agg(F.min("in").alias("lo"), F.max("in").alias("hi"), F.count(F.lit(1)).alias("df"))
    shared = parts.join(often.where("lo <> hi").select("r", "e", "df"), ["r", "e"])
    order = Window.partitionBy("r", "x").orderBy("df", "e")
    ranked = shared.withColumns({"nth": F.row_number().over(order), "left": F.count(F.lit(1)).over(Window.partitionBy("r", "x"))})
    prefix = ranked.where(F.col("nth") <= F.col("left") - F.col("needs") + 1).join(able.select("r", "x", *sketch), ["r", "x"])
    # elements from this one on; at the first that two members share, no more than that can be shared
    rest = F.col("left") - F.col("nth") + 1
    mine = prefix.select("r", "e", F.col("x").alias("a"), "in", "n", "w", "far", rest.alias("rest"), *sketch)
    other = prefix.where("far").select("r", "e", F.col("x").alias("b"), F.col("in").alias("in_b"), F.col("n").alias("n_b"), F.col("w").alias("w_b"), rest.alias("rest_b"), *[F.col(c).alias(f"{c}_b") for c in sketch])
    # of linked sets |x ^ y| = |D(x) ^ D(y)| <= c (n(x) + n(y))
    unlike = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in sketch), F.lit(0))
    alike = unlike * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("n_b"))
    near = unit * F.least("rest", "rest_b") >= F.col("w") + F.col("w_b")
    found = mine.join(other, ["r", "e"]).where(near & F.expr("in <> in_b AND (NOT far OR a < b)") & alike)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts(docs: DataFrame, named: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted class (and its columns), written."""
    picked = named.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.min(F.struct("tie", "key")).alias("x"))
    picked = picked.select("class", "x.tie", "x.key").join(wanted, "class")
    # rows that repeat id and text are one
    return written(docs.join(picked, ["key", "tie"]).dropDuplicates(["key", "tie"]).drop("key", "tie"), "texts")


def _profiles(texts: DataFrame, n: int) -> DataFrame:
    """(class, n, parity): size and parity words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for whole in batches:
            for batch in _blocks(whole):
                grams = list(shingle(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in grams], pa.int64()), _ints([parity(g) for g in grams])], ["class", "n", "parity"])

    return texts.select("class", "text").mapInArrow(run, "class long, n long, parity array<long>")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(class, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for whole in batches:
            for batch in _blocks(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), _ints(list(shingle(batch.column(1).to_pylist())))], ["class", "grams"])

    return texts.select("class", "text").mapInArrow(run, "class long, grams array<long>")


def class_components(docs: DataFrame, named: DataFrame, names: Names, n: int, percent: int) -> DataFrame:
    """(node, component) of classes that have links. docs: key, tie and text; named: `named_rows` of them. Wide tables go as soon
    as what follows has been written."""
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    coarse = written(shared_signatures(docs, n, names, percent, COARSE, total, SMALL), "coarse")
    pairs = coarse.where("b IS NOT NULL").select("a", "b")
    live = pairs.select(F.col("a").alias("class"), F.lit(False).alias("crowded")).union(pairs.select("b", F.lit(False)))
    live = live.union(coarse.where("b IS NULL").select("a", F.lit(True))).groupBy("class").agg(F.bool_or("crowded").alias("crowded"))
    texts = _texts(docs, named, live)
    profiles = written(_profiles(texts, n), "profiles")
    crowd, size = texts.where("crowded"), profiles.select("class", "n")
    total = crowd.select("class").join(size, "class").agg(F.sum("n")).first()[0] or 0
    alone = own_elements(crowd, n, names, total).join(size, "class").where(F.col("own") > F.floor(F.col("n") * (100 - percent) / percent))
    dense = written(crowd.join(alone, "class", "left_anti").select("class", "text"), "dense")
    fine = written(shared_signatures(dense, n, names, percent, FINE, total, SMALL), "fine")
    near = _near(pairs.union(fine.where("b IS NOT NULL").select("a", "b")).distinct(), profiles, percent)
    stars = _stars(fine.where("b IS NULL").select("sig", F.col("a").alias("class")))
    used = near.select(F.col("a").alias("class")).union(near.select("b")).union(stars.select("x")).distinct()
    sets = written(_sets(texts.join(used, "class", "left_semi"), n), "sets")
    forget(texts, dense, coarse, fine)
    seen = _differences(_fewer_stars(stars, sets, percent), sets, percent)
    centred = _centred(seen, percent)
    direct = _compared(near, sets, percent).union(seen.where("ok AND r <> x").select(F.col("r").alias("a"), F.col("x").alias("b"))).union(_centre_links(centred))
    hubs, joined = contracted(written(direct.toDF("u", "v"), "direct"), 2)
    forget(seen)
    more = _compared(_near(_hidden_pairs(centred, joined, percent), profiles, percent), sets, percent).toDF("u", "v")
    linked_classes = written(hubs.union(more), "linked")
    forget(sets, centred, profiles)
    return components(linked_classes)


def _named(docs: DataFrame, n: int, percent: int, id_col: str, text: str, bits: int = 64) -> DataFrame:
    """(key, tie, n_shingles, component, low) by row of docs: hash of the text, id (nulls last), size of the set, the component's class (null
    for an empty set) and smallest id."""
    tie = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    slim = docs.select(F.xxhash64(text).alias("key"), tie.alias("tie"), F.col(text).alias("text"))
    named, names = named_rows(slim, n, bits)
    joined = class_components(slim, named, names, n, percent)
    filled = named.where("class IS NOT NULL")
    ids = filled.groupBy("class").agg(F.min("tie").alias("first"))
    ids = ids.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = ids.groupBy("component").agg(F.min("first").alias("low"))
    by_class = ids.join(lowest, "component").select("class", "component", "low")
    return named.join(by_class, "class", "left").withColumn("low", F.coalesce("low", "tie")).drop("class")


def with_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """Adds n_shingles and component_id, the smallest id among documents that links and equal sets reach."""
    require(docs, id_col, text)
    for c in [c for c in docs.columns if c.lower() in ("n_shingles", "component_id")]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    key, tie, low = fresh(docs, "key", "tie", "low")
    named = _named(docs, n, percent, id_col, text, bits).drop("component").distinct().toDF(key, tie, "n_shingles", low)
    rows = docs.withColumns({key: F.xxhash64(text), tie: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))})
    return rows.join(named, [key, tie]).withColumn("component_id", F.nullif(low, F.lit(NO_ID))).select(*docs.columns, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id. Texts without words are all kept. Of rows that repeat
    both id and text one stays; where ids repeat under different texts of a component, that with the lowest text hash does."""
    require(docs, id_col, text)
    key, tie = fresh(docs, "key", "tie")
    named = _named(docs, n, percent, id_col, text)
    best = named.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("tie", "key")).alias("x"))
    best = best.select(F.col("x.key").alias(key), F.col("x.tie").alias(tie))
    rows = docs.withColumns({key: F.xxhash64(text), tie: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))})
    blank = ~F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    with_words = rows.where(~blank).join(best, [key, tie], "left_semi").dropDuplicates([key, tie])
    return with_words.select(*docs.columns).union(docs.where(blank))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, "doc_id", "text")
    return named.select(F.nullif("tie", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("low", F.lit(NO_ID)).alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, link.b FROM reach r JOIN link ON r.to_id = link.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(to_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY ALL
"""
