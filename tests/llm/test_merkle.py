"""Merkle manifest against a plain version."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import rows
from spindle.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climbed(leaves, fan_out):
    """The root, and each leaf's (left, right) per level."""
    paths = [[] for _ in leaves]
    level, under = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [list(range(i, min(i + fan_out, len(level)))) for i in range(0, len(level), fan_out)]
        for run in runs:
            for j in run:
                for leaf in under[j]:
                    paths[leaf].append(("".join(level[x] for x in run if x < j), "".join(level[x] for x in run if x > j)))
        level, under = [sha("".join(level[j] for j in run)) for run in runs], [[x for j in run for x in under[j]] for run in runs]
    return level[0], paths


@pytest.mark.parametrize("fan_out", [2, 3, 8])
def test_trees_and_proofs(spark, fan_out):
    sizes = {"a": 67, None: 9, "b": 1, "": 2, "é": 8, "z": 65}
    data = [(tree, (None if tree == "b" else i // 2), sha(f"{tree} {i}")) for tree, n in sizes.items() for i in range(n)]
    data += [("dup", 5, sha("same"))] * 11
    df = spark.createDataFrame(data, "tree string, id long, h string").select("tree", "id", F.unhex("h").alias("digest")).repartition(5)
    got = M.manifest(df, ["id"], fan_out)
    names = ["", *sorted(("=" + t for t in {t for t, _, _ in data} if t is not None), key=str.encode)]
    leaves = {n: [h for _, _, h in sorted(((t, -1 if i is None else i, h) for t, i, h in data if ("" if t is None else "=" + t) == n), key=lambda r: r[1:])] for n in names}
    built = {n: climbed(x, fan_out) for n, x in leaves.items()}
    root, tops = climbed([built[n][0] for n in names], fan_out)
    want = []
    for k, n in enumerate(names):
        for leaf, path in zip(leaves[n], built[n][1], strict=True):
            want.append((leaf, built[n][0], root, sha("".join(a + b for a, b in path + tops[k])), root))
    found = got.select(M.hex_of(F.col("digest")), M.hex_of(F.col("subroot")), "root", M.proof(F.col("path")), M.folded(M.hex_of(F.col("digest")), F.col("path"))).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_odd_documents_match_the_sql(spark, tmp_path):
    docs = [(None, None, None, None, None), (1, "", "en", "web", 0), (1, "", "en", "web", 0), (2, "ÀB" * 50_000, "en", None, 5), (3, "X", None, "a:b", -1), (-4, "x", "", "A", 2)]
    docs += [(i, f"Text {i}", ["en", "de"][i % 3 == 0], "s", i) for i in range(10, 90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"tree": F.lit(1), "path": F.lit("x")}).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = M.op11_merkle_manifest(spark, str(tmp_path)).toPandas(), con.execute(M.SQL).fetchdf()
    # DuckDB has no row for a null id's fold where ids are compared; leaves, roots and proofs are those of all rows
    assert len(got) == len(docs) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert set(got["verified"]) == {True, False}


def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert M.op11_merkle_manifest(spark, str(tmp_path)).count() == 0


def test_a_level_is_shuffled_by_run_alone(spark):
    """Both sides of the sibling join keep the partitioning by tree and run: one exchange for each side, none after."""
    nodes = spark.range(200).select((F.col("id") % 2).cast("string").alias("tree"), (F.col("id") / 2).cast("long").alias("idx"), F.lit(200).alias("size"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    with M.held(spark, {**M.BY_RUN, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = M.siblings(nodes, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("ReusedExchange") == 2


def test_query_columns(spark, sf):
    assert entry.queries()["op11_merkle_manifest"](spark, sf).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
