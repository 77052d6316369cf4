"""Requests as a whole, what they are decorated with, stored indexes and readers."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import catalog, chunk, models, paper, present, request
from spindle.operators import index as ix
from spindle.operators import search as se
from spindle.sources import files, store

TEXTS = {
    (1, 0): "red fox in the snow", (1, 1): "the fox runs. A red fox", (1, 2): "snow and ice", (2, 0): "blue whale and fox", (2, 1): "deep sea whale", (3, 0): "red red red wine",
}


@pytest.fixture(scope="module")
def shelf(spark):
    chunks = spark.createDataFrame([(d, n, t, "Abstract" if n == 0 else "1. Body", "abstract" if n == 0 else "") for (d, n), t in TEXTS.items()], "doc_id long, chunk_no int, content string, section string, section_role string")
    postings, lens = ix.index(chunks, request.KEY, "content")
    documents = spark.createDataFrame([(1, "pdf", ["A", "b"], "2024-01-05 00:00:00", True), (2, "txt", ["b"], "2024-02-01 00:00:00", False), (3, "pdf", [], "2024-03-01 00:00:00", False)], "doc_id long, source_type string, tags array<string>, added_at string, is_paper boolean")
    documents = documents.withColumn("added_at", F.col("added_at").cast("timestamp"))
    vectors = spark.createDataFrame([(d, n, [float(d), float(n + 1)]) for d, n in TEXTS], "doc_id long, chunk_no int, embedding array<double>")
    sections = chunks.groupBy("doc_id", "section").agg(F.array_join(F.collect_list("content"), " ").alias("text"))
    return request.Catalog(postings, lens.join(chunks.drop("content"), request.KEY), documents, chunks, sections, vectors)


def names(hits):
    return [(r.doc_id, r.chunk_no) for r in hits.collect()]


def test_arguments():
    assert [request.limit_of(x) for x in (None, 0, -3, 5, 5.9, 21, "7", True)] == [8, 8, 8, 5, 5, 20, 8, 8]
    assert request.parse_tags(" a, ,b ,") == ("a", "b") and request.parse_tags(None) == ()
    assert request.parse_time("2024-02-30") is None and request.parse_time("soon") is None and request.parse_time("") is None
    assert request.parse_time("2024-02-03") == "2024-02-03 00:00:00" and request.parse_time("2024-02-03T10:00:00+02:00").startswith("2024-02-03 08:00:00")
    with pytest.raises(ValueError):
        request.SearchRequest.of("  ")


def test_search_filters_boosts_and_decorates(spark, shelf):
    hits = request.search(shelf, request.SearchRequest.of("red fox"))
    rows = hits.collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and {r.doc_id for r in rows} == {1, 2, 3}
    assert all(("fox" in r.snippet or "red" in r.snippet) for r in rows)
    plain = se.bm25(shelf.postings, shelf.entries, se.query_table(spark, {1: "red fox"}), request.KEY)
    score = {(r.doc_id, r.chunk_no): r.score for r in plain.collect()}
    got = {(r.doc_id, r.chunk_no): r.score for r in rows}
    assert got[1, 0] == pytest.approx(score[1, 0] * se.BOOST) and got[2, 0] == pytest.approx(score[2, 0])
    assert {d for d, _ in names(request.search(shelf, request.SearchRequest.of("red fox", source_type="pdf", tags="a, zz")))} == {1}
    assert {d for d, _ in names(request.search(shelf, request.SearchRequest.of("red fox", added_after="2024-01-31")))} == {2, 3}
    assert names(request.search(shelf, request.SearchRequest.of("nothing here")))  == []
    assert set(names(request.search(shelf, request.SearchRequest.of("fox", section="Body", coarse=True)))) == {(1, 1)}
    assert len(names(request.search(shelf, request.SearchRequest.of("red fox", 1)))) == 1
    entry = request.log_entry(hits, request.SearchRequest.of("red fox")).first()
    assert entry.hit_count == len(rows) and entry.hit_ids == [str(r.chunk_no) for r in rows[:3]] and entry.top_scores == [r.score for r in rows[:3]]


class Towards:
    dim = 2

    def embed(self, texts):
        return [[2.0, 1.0] for _ in texts]


class Broken:
    def rerank(self, query, texts):
        raise RuntimeError("down")


class Short:
    def rerank(self, query, texts):
        return [1.0]


def test_hybrid_search_and_reranking(spark, shelf):
    asked = request.SearchRequest.of("red fox")
    hybrid = request.search(shelf, asked, embedder=Towards())
    assert set(names(hybrid)) == {k for k, t in TEXTS.items() if "red" in t or "fox" in t}
    assert names(request.search(shelf, asked, reranker=models.OverlapReranker()))[0] in {(1, 0), (1, 1)}
    # a model that fails, or gives too few scores: by the vectors' cosine, and by the scores where there are no vectors
    near = lambda k: np.dot([2, 1], [k[0], k[1] + 1]) / np.linalg.norm([2, 1]) / np.linalg.norm([k[0], k[1] + 1])
    for model in (Broken(), Short()):
        got = names(request.search(shelf, asked, embedder=Towards(), reranker=model))
        assert got == sorted(got, key=lambda k: (-round(near(k), 9), k))
        assert names(request.search(shelf, asked, reranker=model)) == names(request.search(shelf, asked))
    assert models.candidates(5) == 20 and models.candidates(30) == 60 and models.candidates(5, 100) == 100


def test_ranks_over_ranges_are_plain_ranks(spark, monkeypatch):
    monkeypatch.setattr(se, "RANGES", 7)
    rng = np.random.default_rng(1)
    rows = [(int(q), int(i), float(np.round(rng.exponential(), 1) + 0.1)) for q in (1, 2, 3) for i in range(200)]
    got = se.ranked(spark.createDataFrame(rows, "query_id long, doc_id long, score double"), ["doc_id"], "r").collect()
    want = {(q, x[1]): n for q in (1, 2, 3) for n, x in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])))}
    assert {(r.query_id, r.doc_id): r["r"] for r in got} == want


def test_sections_of_one_query_do_not_serve_another(spark):
    entries = spark.createDataFrame([(1, 0, 2.0, 1), (2, 0, 2.0, 2)], "doc_id long, chunk_no int, length double, query_id long")
    postings = spark.createDataFrame([(d, 0, "fox", 1) for d in (1, 2)], "doc_id long, chunk_no int, term string, tf long")
    got = se.bm25(postings, entries, se.query_table(spark, {1: "fox", 2: "fox"}), request.KEY).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(1, 1), (2, 2)}


def test_runs_in_arrays(spark):
    items = [None, [], ["a"], ["aaaa", "b", "cccc", "d", "e"], ["b", "cccc"]]
    got = spark.createDataFrame([(x,) for x in items], "p array<string>").select(chunk.merged_short(F.col("p"), 3)).collect()
    assert [r[0] for r in got] == [None, [], ["a"], ["aaaa\n\nb", "cccc\n\nd\n\ne"], ["b", "cccc"]]


def test_index_is_made_once(spark, tmp_path):
    path, calls = str(tmp_path / "t.parquet"), []
    spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "doc_id long, text string").write.parquet(path)
    make = lambda out: (calls.append(out), ix.write_index(spark.read.parquet(path), ["doc_id"], out))
    postings, entries = ix.read_index(spark, store.made_once(spark, path, "index", make))
    assert store.made_once(spark, path, "index", make) == calls[0] and len(calls) == 1
    assert sorted(map(tuple, postings.collect())) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)] and sorted(map(tuple, entries.collect())) == [(1, 3.0), (2, 1.0)]
    spark.createDataFrame([(4, "c d e f g")], "doc_id long, text string").write.mode("append").parquet(path)
    store.made_once(spark, path, "index", make)
    assert len(calls) == 2


def test_reading_chunks_with_their_neighbours(spark):
    rows = [(1, n, t, s) for n, (t, s) in enumerate([("a", "X"), ("b", "X"), ("c", ""), ("d", "Y")])] + [(2, n, t, "") for n, t in enumerate("pqr")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, content string, section string")
    read = lambda n, around: {r.doc_id: r.text for r in present.rendered(chunks, ["doc_id"], n, around).collect()}
    assert read(1, 0) == {1: "b", 2: "q"}
    assert read(2, 1) == {1: "b\n\nc\n\n## Y\nd".replace("b\n", "## X\nb\n", 1), 2: "[001]\nq\n\n---\n\n[002]\nr"}
    kbs = chunks.withColumn("kb", F.lit("z")).union(chunks.where("doc_id = 2").withColumn("kb", F.lit("a")))
    assert [r.kb for r in present.first_with(kbs, "kb", F.col("doc_id") == 2, 1).collect()] == ["a"]
    assert [r.content for r in catalog.preview(chunks, F.col("doc_id") == 1).collect()] == ["a", "b", "c"]
    sizes = {r.doc_id: (r.chunks, r.chars) for r in catalog.snapshot(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), chunks, ["doc_id"]).collect()}
    assert sizes == {1: (4, 4), 2: (3, 3), 3: (0, 0)}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files_keep_repeats_numbers_and_order(spark, tmp_path):
    word = lambda *ps: f'<w:d xmlns:w="w"><w:body>{"".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in ps)}</w:body></w:d>'
    sheet = '<s xmlns="m"><sheetData><row><c t="s"><v>1</v></c><c><v>42</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c><c t="s"><v>0</v></c></row><row><c><v>42</v></c></row></sheetData></s>'
    package = '<p><manifest><item id="one" href="b.xhtml"/><item id="two" href="a.xhtml"/></manifest><spine><itemref idref="one"/><itemref idref="two"/></spine></p>'
    made = {
        "yes.docx": zipped({"word/document.xml": word("yes", "no", "yes")}),
        "list.odt": zipped({"content.xml": '<o xmlns:t="t"><t:li><t:p>one</t:p></t:li><t:li><t:p>one</t:p></t:li></o>'}),
        "cells.XLSX": zipped({"xl/sharedStrings.xml": "<s><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></s>", "xl/worksheets/sheet1.xml": sheet}),
        "book.epub": zipped({"OEBPS/c.opf": package, "OEBPS/a.xhtml": "<h><p>second</p></h>", "OEBPS/b.xhtml": "<h><p>first</p></h>"}),
        "good.txt": "fine é".encode(), "bad.txt": b"caf\xe9", "broken.docx": b"no zip", "skip.exe": b"x", "no.md.bak": b"x",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.original_name: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == set(made) - {"skip.exe", "no.md.bak"}
    assert rows["yes.docx"].text == "yes\n\nno\n\nyes" and rows["list.odt"].text == "one\n\none"
    assert rows["cells.XLSX"].text == "one\t42\n\nin\tzero\n\n42" and rows["book.epub"].text == "first\n\nsecond"
    assert rows["good.txt"].text == "fine é" and rows["good.txt"].error is None
    assert rows["bad.txt"].text is None and rows["bad.txt"].error == "not UTF-8" and rows["broken.docx"].error and json.dumps(rows["broken.docx"].error)


def test_abstracts_keep_their_breaks():
    text = "A Title\n\nJane Roe\n\n# Abstract\n\nFirst line\nsecond line.\n\nNew part.\n\n\nLast part.\n\n# 1. Introduction\nText"
    assert paper.paper_meta(text)[2] == "First line second line.\n\nNew part.\n\n\n\nLast part."


def test_shared_folder(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
