"""Vectors kept by content, listing trees, logged filters, terms counted within rows, headings as of a paragraph."""

import json

import pytest
from pyspark.sql import functions as F

from spindle.operators import catalog, chunk, index, pruned, request, search
from spindle.operators.models import VectorCache
from spindle.sources import files


class Asked:
    """Counts its requests in a file, since tasks run elsewhere."""

    dim = 3

    def __init__(self, path, dim=3):
        self.path, self.dim = path, dim

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write(json.dumps(list(texts)) + "\n")
        return [[float(len(t))] * self.dim for t in texts]


def requests(path):
    return [json.loads(x) for x in open(path)] if path.exists() else []


def test_a_text_is_embedded_once(spark, tmp_path):
    cache, log = VectorCache(spark, str(tmp_path / "v")), tmp_path / "asked"
    rows = spark.createDataFrame([(1, "one"), (2, "two!"), (3, "one"), (4, None), (5, "")], "id long, content string")
    want = {1: [3.0] * 3, 2: [4.0] * 3, 3: [3.0] * 3, 4: None, 5: [0.0] * 3}
    assert {r.id: r.vector for r in cache.embedded(rows, Asked(str(log))).collect()} == want
    assert sorted(t for r in requests(log) for t in r) == ["", "one", "two!"]
    # again, by another object: nothing is asked
    assert {r.id: r.vector for r in VectorCache(spark, cache.path).embedded(rows, Asked(str(log))).collect()} == want and len(sum(requests(log), [])) == 3
    more = rows.unionByName(spark.createDataFrame([(6, "six")], "id long, content string"))
    assert cache.embedded(more, Asked(str(log))).count() == 6 and requests(log)[-1] == ["six"] and cache.vectors().count() == 4
    with pytest.raises(ValueError):
        cache.embedded(spark.createDataFrame([(7, "seven")], "id long, content string"), Asked(str(log), 4))


def test_requests_are_filled_across_batches(spark, tmp_path):
    log = tmp_path / "asked"
    rows = spark.createDataFrame([(i, "x" * 36 + f"{i:04d}") for i in range(300)], "id long, content string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        VectorCache(spark, str(tmp_path / "v")).embedded(rows, Asked(str(log)), batch_tokens=500).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sizes = [len(r) for r in requests(log)]
    assert sum(sizes) == 300 and max(sizes) == 50 and len(sizes) <= 6 + 4


def test_listing_changes(spark):
    old = spark.createDataFrame([(i, f"name {i}", i * 2) for i in range(400)], "id long, name string, size long")
    new = old.where("id <> 17").withColumn("size", F.when(F.col("id") == 99, F.lit(None)).otherwise(F.col("size"))).unionByName(spark.createDataFrame([(500, None, 1)], old.schema))
    found = sorted(map(tuple, catalog.listing_changes(old, new.repartition(3), "id").collect()))
    assert found == [(17, "removed"), (99, "changed"), (500, "added")]
    assert catalog.listing_changes(old, old.repartition(5), "id").count() == 0
    root = lambda df: [r.digest for r in catalog.listing_tree(df, "id", 3).where("prefix = ''").collect()]
    assert root(old) == root(old.repartition(7)) != root(new) and root(old.limit(0)) == []


def test_logs_keep_the_filter(spark, tmp_path):
    hits = spark.createDataFrame([(1, 4, 0.5), (2, 9, 0.25)], "rank int, chunk_no int, score double")
    asked = request.SearchRequest.of("fox", doc=7, tags="a, b", added_after="2024-01-05")
    files.append_search_log(request.log_entry(hits, asked).unionByName(request.log_entry(hits, request.SearchRequest.of("hound"))), str(tmp_path / "log"))
    got = {r.query: r for r in files.read_search_log(spark, str(tmp_path / "log")).collect()}
    assert got["hound"].filter is None and got["fox"].hit_ids == ["4", "9"]
    assert got["fox"].filter.asDict() == {"doc": "7", "source_type": None, "section": None, "tags": ["a", "b"], "added_after": "2024-01-05 00:00:00", "added_before": None}


def test_counting_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, None), (4, "...")], "d long, text string")
    rows = index.counted(docs, ["d"], n=2)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r.d, r.length, [(x.term, x.tf) for x in r.top]) for r in rows.collect()] == [(1, 6.0, [("b", 3), ("a", 2)])]


def test_headings_as_of_a_paragraph(spark):
    text = "lead é\r\n\r\n  \r\n# One\r\nbody of one\r\n### Two\r\n\r\n\r\n \tafter two\n\n####### no heading\n\n##nor this\n\n## Three"
    rows = chunk.paragraphs(spark.createDataFrame([(1, text)], "d long, text string"), ["d"]).orderBy("nth").collect()
    plain = text.replace("\r\n", "\n")
    assert [(r.content, r.section) for r in rows] == [("lead é", ""), ("# One\nbody of one\n### Two", "# One"), ("after two", "### Two"), ("####### no heading", "### Two"), ("##nor this", "### Two"), ("## Three", "## Three")]
    assert all(plain.encode()[r.offset :].startswith(r.content.encode()) for r in rows)


def test_ten_thousand_headings(spark):
    text = "\n\n".join(f"## Heading {i}\n\n" + "word " * 50 for i in range(10_000))
    got = chunk.chunks(spark.createDataFrame([(1, text)], "d long, text string"), ["d"])
    # a heading is short, so it ends the chunk before it; the first one stands alone
    assert got.count() == 10_001 and got.where("chunk_id = '10000'").first().section == "## Heading 9999"


def test_candidates_are_compared_first(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "d long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    sparse = spark.createDataFrame([(1, 2, 1.0), (1, 5, 0.5), (1, 77, 0.4)], "query_id long, d long, score double")
    got = search.candidate_dense(sparse, v, q, ["d"]).collect()
    assert sorted((r.query_id, r.d) for r in got) == [(1, 2), (1, 5), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5)]
    assert next(r.score for r in got if (r.query_id, r.d) == (1, 2)) == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_is_exact_and_scores_less(spark, tmp_path, seed):
    """The same best rows as scoring every match; and a smaller share of the matches is scored where there are more documents."""
    import random

    draw, shares = random.Random(seed), []
    for n in (300, 3000):
        docs = spark.createDataFrame([(i, " ".join(["fox"] * int(draw.paretovariate(1.2)) + ["hound"] * (draw.random() < 0.4) + ["hen"] * (draw.random() < 0.02) + ["x"] * draw.randint(1, 30))) for i in range(n)], "d long, text string")
        postings, entries = index.index(docs, ["d"])
        queries = search.query_table(spark, {1: "fox", 2: "fox hound", 3: "hen fox hound", 4: "nosuch"})
        path = str(tmp_path / str(n))
        pruned.write_impacts(postings, entries, ["d"], path)
        hits = pruned.best(pruned.Impacts.read(spark, path), queries, ["d"], 10)
        every = search.bm25(postings, entries, queries, ["d"], corpus=True)
        rows = lambda df: [(r.query_id, r.d, round(r.score, 6)) for r in search.top(df, 10, ["d"]).orderBy("query_id", "rank").collect()]
        assert rows(hits) == rows(every) and len(rows(every)) == 30
        matches = postings.join(queries, "term").count()
        shares.append(hits.agg(F.sum("rows")).first()[0] / matches)
    assert shares[1] < shares[0] and shares[1] < 0.3


def test_term_counts_are_made_within_a_row(spark):
    """Counts of a table of one text a key are not shuffled; several texts of one key are one text."""
    docs = spark.createDataFrame([(1, "b A b"), (2, "é_1 知识 x"), (3, None), (4, "..")], "d long, text string")
    rows = index.term_counts(docs, ["d"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "é_1", 1), (2, "知", 1), (2, "知识", 1), (2, "识", 1)]
    twice = docs.unionByName(spark.createDataFrame([(1, "b c")], "d long, text string"))
    assert sorted(tuple(r) for r in index.term_counts(twice, ["d"]).where("d = 1").collect()) == [(1, "a", 1), (1, "b", 3), (1, "c", 1)]


def test_a_text_without_empty_lines_is_one_row(spark):
    """It isn't taken apart into lines, and has the paragraph that its lines give."""
    texts = ["# A \r\nb\n \nc", "#  \nx", "one", " \n# B\nb", "x\n", "a\n\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    rows = chunk.paragraphs(docs, ["d"])
    got = sorted((r.d, r.nth, r.content, r.section, r.offset) for r in rows.collect())
    assert got == [(0, 0, "# A \nb\n \nc", "# A", 0), (1, 0, "#  \nx", "", 0), (2, 0, "one", "", 0), (3, 0, "# B\nb", "# B", 2), (4, 0, "x", "", 0), (5, 0, "a", "", 0), (5, 1, "b", "", 3)]
    assert "_all#" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_packed_by_length(spark):
    docs = spark.createDataFrame([("aa. bb.  cc! d",), (" one ",), ("..x",), ("a" * 9 + ". b. c.",), ("",)], "text string")
    got = [r.p for r in docs.select(chunk.packed(F.col("text"), 6).alias("p")).collect()]
    assert got == [["aa. bb.", "cc! d"], [" one "], [". . x"], ["a" * 9 + ".", "b. c."], [""]]
