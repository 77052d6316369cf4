"""Worked examples of text functions, scores, chunking, presentation, models, sources and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spindle.functions import score as S
from spindle.functions import text as T
from spindle.operators import catalog, chunk, evaluate, models, paper, present
from spindle.operators import index as ix
from spindle.operators import search as se
from spindle.plans import registry
from spindle.sources import files
from spindle.streaming.ingest import ingest_stream


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert sorted(one(spark, "知识库", T.tokens)) == sorted(["知", "识", "知识", "库", "识库"])
    assert T.query_terms("知识库") == ["知", "识", "知识", "库", "识库"]
    assert one(spark, "Foo_Bar9 é", T.tokens) == ["foo_bar9", "é"] and one(spark, "!!!", T.tokens) == []
    assert sorted(one(spark, "船A舶", T.tokens)) == sorted(["船", "a", "舶"]) and T.query_terms("船A舶") == ["船", "a", "舶"]
    with pytest.raises(ValueError):
        T.query_terms("!!!")


def small(spark):
    return spark.createDataFrame([("A", 0, "red fox fox"), ("A", 1, "red hen"), ("B", 0, "fox den den den"), ("B", 1, "owl")], "doc string, no int, text string")


@pytest.mark.parametrize("corpus,want", [(False, (1.116259, 0.544215, 0.413603)), (True, (1.543046, 0.754913, 0.556542))])
def test_bm25(spark, corpus, want):
    postings, lens = ix.index(small(spark), ["doc", "no"])
    hits = se.bm25(postings, lens, se.query_table(spark, {1: "red fox"}), ["doc", "no"], corpus=corpus)
    got = {(r.doc, r.no): r.score for r in se.trimmed(hits).collect()}
    assert [got[k] for k in (("A", 0), ("A", 1), ("B", 0))] == pytest.approx(want, abs=1e-6) and len(got) == 3


def test_bm25_of_nothing(spark):
    postings, lens = ix.index(small(spark).limit(0), ["doc", "no"])
    assert se.bm25(postings, lens, se.query_table(spark, {1: "red"}), ["doc", "no"]).count() == 0


def test_fusion(spark):
    rank = lambda rows: spark.createDataFrame([(1, n, float(s)) for n, s in rows], "query_id long, d string, score double")
    sparse, dense = rank([("x", 3), ("y", 2), ("z", 1)]), rank([("y", 0.9), ("w", 0.8)])
    got = se.top(se.hybrid(sparse, dense, 0.5, ["d"], candidates_only=False), 9, ["d"]).orderBy("rank").collect()
    assert [r.d for r in got] == ["y", "x", "w", "z"]
    assert [r.score for r in got] == pytest.approx([0.01653005, 0.00833333, 0.00819672, 0.00806452], abs=1e-8)
    assert [r.d for r in se.hybrid(sparse, dense, 0.5, ["d"]).collect() if r.d == "w"] == []
    assert se.hybrid(sparse.limit(0), dense, 0.5, ["d"]).count() == 2


@pytest.mark.parametrize("small,alpha", [(True, "0.4"), (False, "CASE query_id WHEN 1 THEN 0.7 ELSE 0.0 END")])
def test_best_of_fusion_is_that_of_all_ranks(spark, small, alpha):
    # ties of score on both sides, one query of few hits, one without keyword hits, one row twice; n % 7 == 3 has no dense score
    rows = spark.range(700).select(F.col("id").alias("n"), F.explode(F.expr("sequence(1L, 3L)")).alias("query_id"))
    sparse = rows.where("query_id = 1 or (query_id = 2 and n < 5)").select("query_id", F.col("n").alias("d"), (F.expr("n * 7919 % 101") + 1.0).alias("score"))
    dense = rows.where("n % 7 <> 3 and (query_id <> 2 or n < 4)").select("query_id", F.col("n").alias("d"), (F.expr("n * 104729 % 37") / 40 + 0.01).alias("score"))
    dense = dense.unionByName(dense.where("d = 8"))
    want, got = (se.top(se.trimmed(f), 5, ["d"]) for f in (se.hybrid(sparse, dense, F.expr(alpha), ["d"]), se.hybrid_best(sparse, dense, F.expr(alpha), ["d"], 5, small)))
    found = [sorted(map(str, x.select("query_id", "rank", "d", "score", "sparse_rank", "dense_rank").collect())) for x in (got, want)]
    assert found[0] == found[1] and len(found[0]) > 10


@pytest.mark.parametrize("name", ["hybrid_alpha_by_query_type", "hybrid_rrf"])
def test_fusion_reads_and_ranks_what_is_stored_only(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "FullOuter" not in plan and plan.count("Relation") <= 2


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.8, 0, 0, 0])


@pytest.mark.parametrize("query,kind", [("bm25", "factual"), ("what?", "factual"), ("what is rag?", "conceptual"), ("how to chunk documents", "conceptual"), ("chunk overlap parameters", "factual"), ("red fox hen", "balanced"), ("知识 检索", "factual")])
def test_query_types(spark, query, kind):
    assert one(spark, query, S.query_type) == kind


def test_evaluation(spark):
    log = spark.createDataFrame([("q", ["c1", "c2", "c3", "c4"])], "query string, hits array<string>")
    judged = spark.createDataFrame([("q", ["c2", "c4", "c9"])], "query string, relevant array<string>")
    r = evaluate.metrics(log, judged).first()
    assert (r.mrr, r.ndcg_5, r.recall_10) == pytest.approx((0.5, 0.650921, 0.666667), abs=1e-6)


def test_hash_embedder():
    a, b = models.HashEmbedder(4).embed(["abc", "知识"])
    assert a == [0.54296875, 0.83203125, 0.796875, 0.7109375] and b == [0.5625, 0.4375, 0.56640625, 0.56640625]


def test_sentences_and_overlap(spark):
    assert one(spark, "One. Two! Three? 四。tail", T.sentences) == ["One.", " Two!", " Three?", " 四。", "tail"]
    lap = lambda items: one(spark, items, chunk.overlapped, "array<string>")
    assert [len(x) for x in lap(["a" * 150 + ". " + "b" * 98, "c" * 70, "d" * 70])] == [250, 171, 243]
    assert [len(x) for x in lap(["a" * 249 + ".", "c" * 70])] == [250, 70]


def test_chunks(spark):
    text = "\n\n".join(["p" * 300, "q" * 50, "r" * 250, "s" * 199])
    docs = spark.createDataFrame([(1, text), (2, "  "), (3, None), (4, "# Introduction\n\n" + "t" * 300), (5, "#Title\r\n\r\n" + "u" * 2500)], "doc_id long, text string")
    rows = chunk.chunks(docs, ["doc_id"]).orderBy("doc_id", "chunk_no").collect()
    of = lambda d: [r for r in rows if r.doc_id == d]
    assert len(of(1)) == 2 and of(1)[0].content == "p" * 300 + "\n\n" + "q" * 50 and not of(2) and not of(3)
    assert [(r.section, r.section_role, r.offset) for r in of(4)] == [("# Introduction", "introduction", 0), ("# Introduction", "introduction", 16)]
    assert of(5)[0].section == "" and of(5)[1].chunk_id == "001"
    parts = chunk.sections(chunk.chunks(docs, ["doc_id"]), ["doc_id"]).where("doc_id = 4").collect()
    assert len(parts) == 1 and parts[0].section_id == "S00" and parts[0].content.startswith("# Introduction\n\n# Introduction")
    more = chunk.appended(chunk.chunks(docs, ["doc_id"]), spark.createDataFrame([(1, "z" * 30), (9, "n" * 10)], "doc_id long, text string"), ["doc_id"])
    assert sorted(r.chunk_no for r in more.where("doc_id = 1").collect()) == [0, 1, 2] and more.where("doc_id = 9").count() == 1


def test_metrics_of_ranked_hits_match_those_of_lists(spark, sf):
    lists = {1: [5, 6, 7], 2: [8], 3: [9, 5, 1, 2, 3, 6, 7, 4, 8, 10, 11, 12], 4: [20]}
    hits = spark.createDataFrame([(q, r, x) for q, own in lists.items() for r, x in enumerate(own, 1)], "query_id long, rank long, doc_id long")
    log = spark.createDataFrame(list(lists.items()), "query long, hits array<long>")
    for good in ([6, 7, 8, 12, 99, 6, None], [None]):
        judged = spark.createDataFrame([(q, sorted({x for x in good if x})) for q in lists], "query long, relevant array<long>")
        assert evaluate.metrics_of_ranked(hits, spark.createDataFrame([(x,) for x in good], "doc_id long")).first() == evaluate.metrics(log, judged).first()
    plan = registry.eval_metrics(spark, sf)._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_append_document_takes_all_documents_and_turns(spark, tmp_path):
    spark.createDataFrame([(1, "s" * 300), (2, "l" * 3000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    turns = [(1, 1, "user", "b" * 250), (1, 0, "user", "a" * 250), (3, 0, "user", "c" * 9)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.doc_id: (r.chunks, r.last_no) for r in registry.append_document(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 2), 2: (1, 0), 3: (1, 0)}


def test_reverse_variants_match_the_rewriter(spark):
    synonyms = {"the": ["ze"], "and": ["plus", "with"]}
    texts = ["the ze", "Plus AND with the", "none", "ze only"]
    got = models.variants(spark.createDataFrame([(t,) for t in texts], "query string"), synonyms, reverse=True).collect()
    want = {(t, v) for t in texts for v in models.SynonymRewriter(synonyms).rewrite(t)}
    assert {(r.query, r.variant) for r in got} == want and len(got) == len(want)


def test_section_roles(spark):
    for heading, role in (("## 2.1 Related Work", "related_work"), ("# Abstract", "abstract"), ("结论", "conclusion"), ("Other", ""), ("3. Experimental results", "experiments")):
        assert one(spark, heading, T.section_role) == role


def test_paper_meta():
    text = "# A Study\n\nJane Doe, John Roe\n\n# Abstract\nWe test.\n\n# Introduction\nx"
    assert paper.paper_meta(text) == ("A Study", ["Jane Doe", "John Roe"], "We test.", True)
    assert paper.paper_meta(None) == paper.paper_meta("plain") == ("", [], "", False)


def test_snippets():
    assert present.snippet_of("short text", "x", ["x"]) == "short text"
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    s = present.snippet_of(text, "number 20", ["number"])
    assert s.startswith("...Sentence") and s.endswith("here....") and "number 20 " in s and len(s) <= 206
    assert len(present.snippet_of("a" * 1000, "zz", ["a"])) == 203


def test_duplicates(spark):
    hits = spark.createDataFrame([(1, "A", 1, "a b c d"), (1, "A", 2, "b c d e"), (1, "A", 3, "x"), (1, "B", 4, "a b c d")], "query_id long, doc string, rank int, text string").withColumn("id", F.col("rank"))
    got = {r["rank"]: r.duplicate_of for r in present.duplicate_marks(hits, ["query_id", "doc"], "rank", "id", "text").collect()}
    assert got == {1: None, 2: "1", 3: None, 4: None}
    assert present.similar_pairs(hits, ["query_id", "doc"], "rank", "text").count() == 1


def test_filters(spark):
    df = spark.createDataFrame([("d", "pdf", "# Intro", ["RAG"], "2024-01-01 00:00:00")], "doc_id string, source_type string, section string, tags array<string>, added_at string").withColumn("added_at", F.to_timestamp("added_at"))
    for f, n in ((se.SearchFilter(tags=("rag",)), 1), (se.SearchFilter(section="intro"), 0), (se.SearchFilter(section="Intro", doc="d"), 1), (se.SearchFilter(added_after="2024-01-01", added_before="2024-01-01"), 1), (se.SearchFilter(source_type="PDF"), 0)):
        assert df.where(f.column()).count() == n


def test_rewriting(spark):
    r = models.SynonymRewriter()
    assert r.rewrite("RAG chunk") == ["RAG chunk", "RAG segment", "RAG fragment", "RAG passage", "retrieval augmented generation chunk", "retrieval-augmented generation chunk"]
    assert r.rewrite("  ") == []

    class Completer:
        def complete(self, prompt):
            return '1. "first way"\n- second way\n'

    class Broken:
        def complete(self, prompt):
            raise OSError

    assert models.CompletionRewriter(Completer()).rewrite("q") == ["q", "first way", "second way"]
    assert models.CompletionRewriter(Broken()).rewrite("plain") == ["plain"]


def test_reranking_and_its_fallback(spark):
    hits = spark.createDataFrame([(1, "a", 3.0, "red fox", "nothing"), (1, "b", 2.0, "red fox", "a red fox")], "query_id long, d string, score double, query string, text string")
    assert [r.d for r in models.reranked(hits, models.OverlapReranker(), tie=["d"]).collect()] == ["b", "a"]

    class Broken:
        def rerank(self, query, texts):
            raise OSError

    assert [r.score for r in models.reranked(hits, Broken(), tie=["d"]).collect()] == [3.0, 2.0]


def test_collections(spark):
    kbs = spark.createDataFrame([("b", ""), ("a", "text")], "kb string, description string")
    assert [tuple(r) for r in catalog.list_kbs(kbs).collect()] == [("a", "text"), ("b", "(no description)")]
    docs = small(spark).withColumn("tags", F.array(F.lit("t"))).withColumn("kb", F.lit("k"))
    assert catalog.with_kb_tag(docs).first().tags == ["t", "kb:k"]
    page = catalog.page(small(spark), F.col("text"), "no", True, 1, 2).collect()
    assert [r.text for r in page] == ["red fox fox", "owl"] and page[0].total == 4
    assert ix.without_documents(small(spark), small(spark).where("doc = 'A'"), ["doc"]).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a b.md").write_text("# Hi\n\nétext")
    (tmp_path / "in" / "deep" / "p.html").write_text("<html><script>x</script><p>Hello &amp; bye</p></html>")
    (tmp_path / "in" / "skip.bin").write_bytes(b"1")
    (tmp_path / "in" / "bad.docx").write_bytes(b"not a zip")
    with zipfile.ZipFile(tmp_path / "in" / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>')
    rows = {r.original_name: r for r in files.read_files(spark, str(tmp_path / "in"), stamp="s1").collect()}
    assert set(rows) == {"a b.md", "p.html", "bad.docx", "w.docx"}
    assert rows["a b.md"].doc_slug == "a-b-s1" and rows["a b.md"].total_chars == 12 and rows["p.html"].text == "Hello & bye"
    assert rows["w.docx"].text == "One\n\nTwo" and rows["bad.docx"].error and rows["bad.docx"].text is None


def test_logs_and_judgments(spark, tmp_path):
    log = spark.createDataFrame([("q", 1, ["005"], [1.0])], "query string, hit_count int, hit_ids array<string>, top_scores array<double>")
    files.append_search_log(log, str(tmp_path / "log"))
    files.append_search_log(log, str(tmp_path / "log"))
    assert files.read_search_log(spark, str(tmp_path / "log")).count() == 2
    (tmp_path / "j.json").write_text(json.dumps({"q": ["a", "b"], "r": []}))
    assert {r.query: r.relevant for r in files.read_judgments(spark, str(tmp_path / "j.json")).collect()} == {"q": ["a", "b"], "r": []}


def test_stream_ingest_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} shared text. " * 20) for i in range(12)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    ingest_stream(spark, str(tmp_path / "in"), "doc_id long, text string", ["doc_id"], str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    want = chunk.chunks(docs, ["doc_id"])
    got = spark.read.parquet(str(tmp_path / "out/chunks")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(str(tmp_path / "out/postings")).count() > 0


def test_postings_prune_by_term(spark, tmp_path):
    postings, _ = ix.index(small(spark), ["doc", "no"])
    ix.write_postings(postings, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("term = 'fox'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,fox)" in plan


def test_a_batch_of_queries_is_summed_by_entry(spark):
    """Rows of a query, an entry and a term are summed where the entry lies, and give the scores that a few queries get."""
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1, 12) if i % j == 0)) for i in range(1, 60)], "d long, text string")
    postings, entries = ix.index(texts, ["d"])
    queries = spark.createDataFrame([(q, f"w{j}") for q in range(1, 6) for j in range(q, 12, 2)], "query_id long, term string")
    got = se.bm25(postings, entries, queries, ["d"], small=False)
    want = se.bm25(postings, entries, queries, ["d"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    last = got._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert "BroadcastHashJoin" in last and last.count("HashAggregate") == 2  # both halves of the sum before any exchange
