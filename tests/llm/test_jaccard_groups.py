"""Jaccard join on groups that must not be squared."""

import random
from itertools import combinations

import pytest

from spindle.llm import jaccard_join as J


def _changed(draw, template, places):
    words = list(template)
    for p in draw.sample(range(len(words)), places):
        words[p] = f"v{p}x{draw.randrange(3)}"
    return " ".join(words)


def _recorded(monkeypatch, name):
    counts, plain = [], getattr(J, name)

    def wrapped(*args):
        out = plain(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(J, name, wrapped)
    return counts


@pytest.mark.parametrize("copies", [400, 1600])
def test_unlinked_near_copies_of_one_template(spark, monkeypatch, copies):
    """Eight of 400 words changed, in one of three ways each: hardly any two are linked, all share rare elements with many."""
    draw = random.Random(copies)
    template = [f"w{i}" for i in range(400)]
    texts = [_changed(draw, template, 8) for _ in range(copies)]
    counts = _recorded(monkeypatch, "_hidden_pairs")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in J.with_components(docs, 4, 85).collect()}
    assert sum(counts) <= 10 * copies
    sets = [{hash(tuple(w[i : i + 4])) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    want = list(range(copies))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for a, b in combinations(range(copies), 2):
        same = len(sets[a] & sets[b])
        if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((root(a), root(b)))
            want[y] = x
    assert got == {i: root(i) for i in range(copies)}


def test_sketches_rule_out_no_linked_pair(spark):
    """Groups with many links that centres don't show: the same components without sketches."""
    draw = random.Random(5)
    texts = []
    for g in range(6):
        template = [f"g{g}w{i}" for i in range(90)]
        bases = [_changed(draw, template, 3) for _ in range(12)]
        texts += [_changed(draw, b.split(), 1) for b in bases for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in J.with_components(docs, 4, 85).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    reach = {i: {i} for i in range(len(texts))}
    for a, b in combinations(range(len(texts)), 2):
        same = len(sets[a] & sets[b])
        if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same) and reach[a] is not reach[b]:
            reach[a] |= reach[b]
            for x in list(reach[b]):
                reach[x] = reach[a]
    assert got == {i: min(reach[i]) for i in range(len(texts))}


def test_rows_that_repeat_are_one_text(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2 + "end")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    slim = docs.select(J.F.xxhash64("text").alias("key"), J.F.col("doc_id").alias("tie"), "text")
    named, _ = J.named_rows(slim, 4)
    texts = J._texts(slim, named, named.select("class").distinct().withColumn("crowded", J.F.lit(False)))
    assert texts.count() == 2
    got = J.with_components(docs, 4, 85).groupBy("doc_id").agg(J.F.min("component_id"), J.F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 300), (2, 1, 300)]
