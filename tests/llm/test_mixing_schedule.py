"""The schedule of blocks: bounded memory, pieces, the same rows however it is cut."""

import tracemalloc
from fractions import Fraction

from spindle.llm import mixing as M


def peak(blocks):
    tracemalloc.start()
    n = sum(len(r[3]) for r in M.scheduled(blocks, {"a": 3.5, "b": 1.25, "c": 0.7}, 64, 5000))
    out = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, out


def test_memory_stays_flat():
    few, many = ({s: n * k for s, n in {"a": 300, "b": 200, "c": 100}.items()} for k in (30, 600))
    (n, low), (m, high) = peak(few), peak(many)
    assert (n, m) == (18_000, 360_000) and high < 1.2 * low + 100_000


def test_pieces_don_t_change_the_schedule():
    blocks, weights = {"a": 500, "b": 900, "": 77, "d": 5}, {"a": 0.3, "b": 0.45, "": 0.2}
    whole = {}
    for period, most in ((4096, 1 << 20), (64, 1 << 20), (64, 13), (7, 1)):
        got = {}
        for s, phase, first, slots, releases, dues in M.scheduled(blocks, weights, period, most):
            assert first // period == (first + len(slots) - 1) // period
            got |= {(s, first + i): (phase, *x) for i, x in enumerate(zip(slots, releases, dues, strict=True))}
        whole = whole or got
        assert got == whole and len(got) == sum(blocks.values())


def test_lag_is_below_one_block_in_every_slot():
    weights = {"a": 0.31, "b": 0.45, "c": 0.24}
    total = sum(map(Fraction, weights.values()))
    counts, order = dict.fromkeys(weights, 0), []
    for s, phase, _, slots, _, _ in M.scheduled(dict.fromkeys(weights, 4000), weights, 100, 50):
        order += [(t, s) for t in slots] if phase == 0 else []
    for t, s in sorted(order):
        counts[s] += 1
        assert all(abs(counts[x] - Fraction(w) / total * (t + 1)) < 1 for x, w in weights.items())


def test_a_schedule_in_many_pieces(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id AS doc_id", "substr('abcd', cast(id % 4 AS int) + 1, 1) AS source", "repeat('x', 50) AS text")
    want = sorted(map(tuple, M.mix(docs, block_bytes=200, period=8).collect()))
    for piece in (1, 30):
        pieces = M.stored.__defaults__
        monkeypatch.setattr(M.stored, "__defaults__", (piece * 8,))
        assert sorted(map(tuple, M.mix(docs, block_bytes=200, period=8).collect())) == want
        monkeypatch.setattr(M.stored, "__defaults__", pieces)
        if piece == 1:
            docs = docs.repartition(3)
