"""Burst trie of conversations against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindle.llm import prefix_trie as T


def plain(rows):
    """Nodes from rows (conv_id, turn, role, text), by the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-1 if turn is None else turn, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32], text or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, m in members.items():
        family = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in family if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in family)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in family if x)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in family), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, n=160):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, 6)):
            first = draw.random() < 0.5 and t < 3
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "shared é" if first else draw.choice(["a", "bb", "", "ccc"])))
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 2), (2, 7), (3, 4096)])
def test_nodes(spark, seed, limit):
    rows = made(seed) + [(200, 0, None, None), (200, None, "user", "first"), (200, None, "user", "first"), (300, 1, "x", "tie"), (300, 1, "x", "eit"), (None, 0, "user", "lost"), (777, 0, "u", "y" * 50_000)]
    convs = spark.createDataFrame(rows, SCHEMA).withColumns({"head": F.lit(1), "ids": F.lit("x")}).repartition(4)
    got = found(T.trie(T.rebuilt(T.conversations(convs)), limit))
    assert got == plain(rows)


def test_copies_and_a_long_shared_start(spark, monkeypatch):
    """One conversation in many copies, in several pieces; and containers that share forty turns burst in a round, not in forty."""
    monkeypatch.setattr(T, "PIECE", 7)
    same = [(c, t, "u", f"turn {t}") for c in range(1000, 1100, 3) for t in range(8)]
    shared = [(c, t, "u", f"long {t}" if t < 40 else f"own {c % 9} {t}") for c in range(2000, 2060) for t in range(42)]
    rows = same + shared
    sequences = T.rebuilt(T.conversations(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert found(T.trie(sequences, 3)) == plain(rows)
    assert len(T.burst(T.classes(sequences), 3)[1]) < 9


def test_turnless_and_empty(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "u", "gone")]
    assert found(T.trie(T.rebuilt(T.conversations(spark.createDataFrame(rows, SCHEMA))))) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert T.trie(T.rebuilt(T.conversations(spark.createDataFrame([], SCHEMA)))).count() == 0
