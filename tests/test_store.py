"""The segmented store: commits, removals, appends, merges, damage; and the commit log with several writers."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from spindle.operators import chunk, index, request
from spindle.sources import segments, store
from spindle.sources.commits import Collections, CommitLog, Conflict
from spindle.sources.segments import Store

LONG = " ".join(f"Sentence number {i} about topic {i % 7} goes on for a while." for i in range(60))


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture
def held(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.ingest(texts(spark, [(1, f"# Abstract\n\n{LONG}", "en"), (2, "fox and hound " * 30, "en"), (3, "", "de"), (4, None, None)]))
    return made


def chunks_of(made, doc):
    return [r.content for r in made.table("chunks").where(F.col("doc_id") == doc).orderBy("chunk_no").collect()]


def test_two_writers_lose_nothing(spark, tmp_path):
    log, errors = CommitLog(spark, str(tmp_path / "log")), []

    def write(name):
        try:
            for i in range(6):
                log.update(lambda _, s, i=i: {**s, f"{name}{i}": i})
        except Exception as e:  # shown by the assertion below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    version, state = log.read()
    assert not errors and version == 12 and len(state) == 12
    assert not log.put(12, {}) and log.read(1)[1].keys() <= {"a0", "b0"} and log.read(0) == (0, {})


def test_collections(spark, tmp_path):
    kbs = Collections(spark, str(tmp_path))
    kbs.create("notes", "about notes")
    kbs.create("papers")
    kbs.describe("papers", "read")
    first = kbs.log.latest()
    kbs.delete("notes")
    assert [tuple(r) for r in kbs.table().collect()] == [("papers", "read")] and kbs.table(first).count() == 2
    for wrong in (lambda: kbs.create("papers"), lambda: kbs.delete("notes")):
        with pytest.raises(KeyError):
            wrong()


def test_changes_write_only_new_segments(spark, held):
    first = held.log.latest()
    before = {f for d, _, names in os.walk(held.path) for f in (os.path.join(d, n) for n in names)}
    held.ingest(texts(spark, [(2, "entirely new words", "fr"), (9, "ninth", "fr")]))
    held.remove(spark.createDataFrame([(1,)], "doc_id long"))
    assert before <= {f for d, _, names in os.walk(held.path) for f in (os.path.join(d, n) for n in names)}
    assert sorted(r.doc_id for r in held.table("documents").collect()) == [2, 3, 4, 9] and chunks_of(held, 2) == ["entirely new words"]
    assert {r.term for r in held.table("postings").where("doc_id = 2").collect()} == {"entirely", "new", "words"}
    # a reader that keeps to its version sees what was there
    assert held.table("documents", first).count() == 4 and held.table("postings", first).where("term = 'hound'").count() == 1
    # another session: nothing is made again
    other = Store(spark, held.path)
    assert other.table("entries").count() == 2 and other.log.latest() == first + 2


def test_rows_are_those_of_the_parts(spark, held):
    docs = texts(spark, [(1, f"# Abstract\n\n{LONG}", "en"), (2, "fox and hound " * 30, "en")])
    want = chunk.chunks(docs, ["doc_id"])
    assert sorted(map(tuple, held.table("chunks").collect())) == sorted(map(tuple, want.collect()))
    postings, entries = index.index(want, ["doc_id", "chunk_no"], "content")
    assert sorted(map(tuple, held.table("postings").select(postings.columns).collect())) == sorted(map(tuple, postings.collect()))
    assert sorted(map(tuple, held.table("entries").select(entries.columns).collect())) == sorted(map(tuple, entries.collect()))
    meta = {r.doc_id: r for r in held.table("documents").collect()}
    assert meta[3].chunk_count == meta[4].chunk_count == 0 and meta[1].chunk_count == want.where("doc_id = 1").count() and meta[1].is_paper and not meta[4].is_paper


def test_a_job_that_dies_leaves_the_last_version(spark, held, monkeypatch):
    before = sorted(map(str, held.table("chunks").collect()))
    for name in ("_derived", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(Store, name, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                held.ingest(texts(spark, [(1, "half", "en")]))
        assert sorted(map(str, held.table("chunks").collect())) == before
    held.ingest(texts(spark, [(1, "whole", "en")]))
    assert chunks_of(held, 1) == ["whole"]


def test_files_that_fail_are_rows(spark, tmp_path):
    from spindle.sources.files import read_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.md").write_text("# Title\n\nbody text")
    (tmp_path / "in/bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "in/odd.pdf").write_bytes(b"%PDF")
    made = Store(spark, str(tmp_path / "s"), ("doc_slug",))
    made.ingest(read_files(spark, str(tmp_path / "in"), stamp="1").drop("total_chars"))
    assert [r.doc_slug for r in made.table("documents").collect()] == ["good-1"]
    assert {r.original_name for r in made.table("failed").collect()} == {"bad.txt", "odd.pdf"}


def test_merge_keeps_what_is_live(spark, held):
    for i in range(4):
        held.ingest(texts(spark, [(10 + i, f"small text {i}", "en"), (10, f"tenth {i}", "en")]))
    held.remove(spark.createDataFrame([(11,)], "doc_id long"))
    want = {n: sorted(map(str, held.table(n).collect())) for n in ("documents", "chunks", "postings", "entries", "sections")}
    pinned = held.log.latest()
    n = len(held.log.read()[1]["segments"])
    while held.merge(2):
        pass
    version, state = held.log.read()
    assert version > pinned and len(state["segments"]) < n and all(sorted(map(str, held.table(t).collect())) == rows for t, rows in want.items())
    assert sorted(map(str, held.table("documents", pinned).collect())) == want["documents"]
    held.ingest(texts(spark, [(10, "after the merge", "en")]))
    assert chunks_of(held, 10) == ["after the merge"]


def test_a_merge_gives_way_to_other_writers(spark, held, monkeypatch):
    held.ingest(texts(spark, [(20, "x y", "en")]))
    held.ingest(texts(spark, [(21, "x y", "en")]))
    monkeypatch.setattr(CommitLog, "put", lambda *_: False)
    with pytest.raises(Conflict):
        held.merge(2)


def test_damage_is_found_and_mended(spark, held):
    want = {n: sorted(map(str, held.table(n).collect())) for n in segments.DERIVED}
    assert held.verify() == []
    for name in ("postings", "sections"):
        at = held.log.read()[1]["segments"][0]["tables"][name]["at"]
        folder = f"{held.path}/{name}/segment={at}"
        for file in (f for f in os.listdir(folder) if f.endswith(".parquet")):
            data = bytearray(open(f"{folder}/{file}", "rb").read())
            data[len(data) // 3] ^= 0xFF
            open(f"{folder}/{file}", "wb").write(data)
    assert {n for _, n in held.verify()} == {"postings", "sections"}
    held.repair()
    assert held.verify() == [] and held.repair() is None
    assert {n: sorted(map(str, held.table(n).collect())) for n in segments.DERIVED} == want


class Letters:
    """Vectors by the first letter; counts what it is asked."""

    dim = 26

    def embed(self, texts):
        return [[1.0 if t[:1].lower() == chr(97 + i) else 0.0 for i in range(26)] for t in texts]


def test_append_goes_on_with_the_numbers(spark, held):
    old = chunks_of(held, 1)
    held.append(spark.createDataFrame([(1, f"## Conclusion\n\n{LONG}")], "doc_id long, text string"))
    now = chunks_of(held, 1)
    assert now[: len(old)] == old and len(now) > len(old)
    meta = held.table("documents").where("doc_id = 1").first()
    assert meta.chunk_count == len(now) and meta.total_chars == 2 * len(LONG) + len("# Abstract\n\n## Conclusion\n\n")
    assert {r.section for r in held.table("sections").where("doc_id = 1").collect()} == {"# Abstract", "## Conclusion"}
    with pytest.raises(KeyError):
        held.append(spark.createDataFrame([(77, "no such")], "doc_id long, text string"))


def test_append_joins_alike_neighbours_at_the_boundary(spark, held):
    held.ingest(texts(spark, [(30, "alpha " * 60 + "\n\n" + "beta " * 60, "en"), (31, "zeta " * 60, "en")]))
    assert len(chunks_of(held, 30)) == 2
    held.append(spark.createDataFrame([(30, "\n\n".join(w * 60 for w in ("again ", "other ", "other ", "fin ", "gin ", "hin ", "iota ", "kilo "))), (31, "unlike " * 60)], "doc_id long, text string"), Letters())
    found = held.table("chunks").orderBy("doc_id", "chunk_no").where("doc_id >= 30").collect()
    assert [(r.doc_id, r.chunk_no) for r in found if r.doc_id == 31] == [(31, 0), (31, 1)]
    thirty = [r for r in found if r.doc_id == 30]
    assert [r.chunk_no for r in thirty] == list(range(len(thirty))) and [r.chunk_id for r in thirty] == [f"{r.chunk_no:03d}" for r in thirty]
    assert held.table("documents").where("doc_id = 30").first().chunk_count == len(thirty) and "kilo" in thirty[-1].content
    assert held.table("entries").where("doc_id = 30").count() == len(thirty) and held.verify() == []


def test_boundary_window(spark):
    """Joined within five and five, the rest moved up."""
    v = lambda x: [1.0, 0.0] if x == "a" else [0.0, 1.0]
    rows = lambda s: [(1, i, c, v(c)) for i, c in enumerate(s)]
    old = spark.createDataFrame(rows("aaabbab"), "doc long, chunk_no int, content string, vector array<double>")
    new = spark.createDataFrame(rows("bbaabaab") + [(2, 0, "a", v("a"))], old.schema)
    got = sorted((r.doc, r.chunk_no, r.was, r.content.replace("\n\n", "")) for r in chunk.boundary_merged(old, new, ["doc"]).collect())
    assert got == [(1, 2, 2, "a"), (1, 3, 3, "bb"), (1, 4, 5, "a"), (1, 5, 6, "bbb"), (1, 6, 9, "aa"), (1, 7, 11, "b"), (1, 8, 12, "a"), (1, 9, 13, "a"), (1, 10, 14, "b"), (2, 0, 0, "a")]


def test_search_over_the_store(spark, held):
    hits = request.search(held.catalog(), request.SearchRequest.of("hound")).collect()
    assert [(r.rank, r.doc_id) for r in hits] == [(1, 2)]
    coarse = request.search(held.catalog(), request.SearchRequest.of("topic sentence", coarse=True)).collect()
    assert coarse and {r.section for r in coarse} == {"# Abstract"}


def test_made_once_lasts_until_files_change(spark, tmp_path):
    source, made = str(tmp_path / "t.parquet"), []
    spark.range(3).write.parquet(source)
    make = lambda out: (made.append(out), spark.range(1).write.parquet(out))
    first = store.made_once(spark, source, "x", make)
    assert store.made_once(spark.newSession(), source, "x", make) == first and len(made) == 1
    spark.range(4).write.mode("append").parquet(source)
    assert store.made_once(spark, source, "x", make) != first and len(made) == 2
