"""Exact top k from cells: the rows that comparing everything gives, in clustered data with few comparisons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import nearest
from spindle.operators import search as se

KEY = ["doc_id"]


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def both(spark, vectors, asked, path, k):
    nearest.write_cells(vectors, KEY, path)
    cells = nearest.Cells.read(spark, path)
    got = se.top(nearest.best(cells, asked, KEY, k), k, KEY)
    return cells, rows(got), rows(se.top(se.dense(vectors, asked, KEY), k, KEY))


def table(spark, pairs):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in pairs], "doc_id long, embedding array<double>")


def of(vectors, condition):
    return vectors.where(condition).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))


def test_clusters_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "PART_ROWS", 40)
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 16))
    pairs = [(i, middle[i % 20] + 0.1 * rng.normal(size=16)) for i in range(2000)]
    pairs += [(i, pairs[0][1]) for i in range(2000, 3000)]  # a third of all are one vector
    vectors = table(spark, pairs)
    asked = of(vectors, "doc_id % 50 = 0 AND doc_id < 2000")
    cells, got, want = both(spark, vectors, asked, str(tmp_path / "cells"), 10)
    assert got == want and len(got) == 400
    assert cells.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 80
    _, first, second = nearest.passes(cells, asked, KEY, 10)
    # all pairs are 40 * 3000; copies of one vector can't be told apart by angles, so a query like them meets them all
    assert first.count() + second.count() < 0.35 * 40 * 3000


@pytest.mark.parametrize("seed", range(3))
def test_vectors_without_clusters(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    vectors = table(spark, [(i, rng.normal(size=6) * 10.0 ** rng.integers(-3, 4)) for i in range(400)])
    _, got, want = both(spark, vectors, of(vectors, "doc_id % 20 = 0"), str(tmp_path / "cells"), 7)
    assert got == want


def test_edges(spark, tmp_path):
    """Null, empty, zero and partly null vectors are no hits; other sizes meet their own size; ties go by id; fewer positive scores than k; a query that is nothing has no hits."""
    pairs = [(1, [1, 0]), (2, [1, 0]), (3, [0, 1]), (4, [-1, 0]), (5, [0, 0]), (6, []), (7, None), (8, [1, 2, 3]), (9, [1, None]), (10, [3, 2, 1]), (11, [1, 1]), (12, [2, 0])]
    vectors = table(spark, pairs)
    _, got, want = both(spark, vectors, of(vectors, "doc_id <> 9"), str(tmp_path / "cells"), 5)
    assert got == want
    assert [g[2] for g in got if g[0] == 1] == [1, 2, 12, 11] and {g[2] for g in got if g[0] == 8} == {8, 10} and not [g for g in got if g[0] in (5, 6, 7)]
    infinite = table(spark, [(1, [1, 0]), (2, [float("nan"), 1]), (3, [float("inf"), 1])])
    nearest.write_cells(infinite, KEY, str(tmp_path / "infinite"))
    assert [r.doc_id for r in nearest.best(nearest.Cells.read(spark, str(tmp_path / "infinite")), of(infinite, "true"), KEY, 5).collect()] == [1]


def test_no_vectors(spark, tmp_path):
    empty = table(spark, [])
    asked = of(table(spark, [(1, [1, 0])]), "true")
    _, got, want = both(spark, empty, asked, str(tmp_path / "cells"), 3)
    assert got == want == []
    vectors = table(spark, [(1, [1, 0])])
    _, got, want = both(spark, vectors, of(vectors, "false"), str(tmp_path / "one"), 3)
    assert got == want == []


@pytest.mark.parametrize("copies", [0, 300])
def test_groups_give_what_all_pairs_give(spark, monkeypatch, copies):
    """From groups of both tables, with copies, zero vectors, nulls and other sizes; nothing is crossed pair by pair."""
    from spindle.operators import vectors as ve

    monkeypatch.setattr(ve, "ROWS", 100)
    monkeypatch.setattr(ve, "ASKED", 7)
    rng = np.random.default_rng(3)
    pairs = [(i, rng.normal(size=5)) for i in range(300)] + [(i, [1, 2, 3, 4, 5]) for i in range(300, 300 + copies)]
    pairs += [(1000, [0] * 5), (1001, None), (1002, [1, 2]), (1003, [2, 1]), (1004, [1, None]), (1005, [])]
    vectors = table(spark, pairs)
    asked = of(vectors, "doc_id % 20 = 0 OR doc_id > 999")
    got = se.top(ve.dense_best(vectors, asked, KEY, 4), 4, KEY)
    assert rows(got) == rows(se.top(se.dense(vectors, asked, KEY), 4, KEY))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_cells_are_not_broadcast(spark, tmp_path):
    """However small the table of queries seems: each looks into many cells."""
    rng = np.random.default_rng(1)
    vectors = table(spark, [(i, rng.normal(size=6)) for i in range(300)])
    nearest.write_cells(vectors, KEY, str(tmp_path / "cells"))
    cells = nearest.Cells.read(spark, str(tmp_path / "cells"))
    _, first, second = nearest.passes(cells, of(vectors, "doc_id % 10 = 0"), KEY, 5)
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0] for df in (first, second))
    assert "SortMergeJoin" in second._jdf.queryExecution().executedPlan().toString()


def test_cells_that_can_reach_a_score_are_not_listed(spark, tmp_path, monkeypatch):
    """Of vectors without clusters a query may look into all cells: only its first ones are made rows, the others are named by the groups that they lie in, 20 at most here."""
    monkeypatch.setattr(nearest, "PART_ROWS", 50)
    asked_for, own = [], nearest.Cells.chooser
    monkeypatch.setattr(nearest.Cells, "chooser", lambda self, k: lambda vector, least: asked_for.append(least) or own(self, k)(vector, least))
    rng = np.random.default_rng(2)
    vectors = table(spark, [(i, rng.normal(size=6)) for i in range(1000)])
    cells, got, want = both(spark, vectors, of(vectors, "doc_id % 20 = 0"), str(tmp_path / "cells"), 7)
    assert got == want and cells.cells.count() > 200
    assert len(asked_for) == 1 and not isinstance(asked_for[0], str)  # null: the first cells
