"""The registered queries of the retrieval engine and the SQL that checks them.

Tables stand for the engine's own: documents are texts of one chunk (source is a tag, lang a collection, added_at an hour a document),
conversations are documents whose turns are chunks and whose roles are sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import score as S
from spindle.functions import text as T
from spindle.operators import batch, catalog, chunk, evaluate, models, nearest, paper, present, pruned, request, vectors
from spindle.operators import index as ix
from spindle.operators import search as se
from spindle.sources import store
from spindle.sources.segments import Store
from spindle.sources.store import made_once

QUERY = "idiot worthless the"
QUERIES = {1: "the and tion", 2: "idiot clown moron", 3: "licensed under the apache license"}
KEY, TURN = ["doc_id"], ["conv_id", "turn"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return store.spread(df) if name in ("documents", "pages", "conversations") else df


def _index(spark: SparkSession, d: str, name: str = "documents", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings and entries of a table, indexed once and read by every search: of each text's most frequent terms or, if whole, of all its terms."""
    key, n = KEY if name == "documents" else TURN, 0 if whole else ix.TOP_TERMS
    make = lambda out: ix.write_index(spark.read.parquet(f"{d}/{name}.parquet").select(*key, "text"), key, out, n=n)
    return ix.read_index(spark, made_once(spark, f"{d}/{name}.parquet", f"index_{name}" + "_whole" * whole, make))


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text", *columns)


def _dated(docs: DataFrame) -> DataFrame:
    return docs.withColumn("added_at", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id AS int), 0, 0)"))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def token_counts(spark, d):
    return ix.term_counts(_docs(spark, d), KEY)


def doc_frequency(spark, d):
    return ix.document_frequency(ix.term_counts(_docs(spark, d), KEY))


def top_terms_50(spark, d):
    return ix.index(_docs(spark, d), KEY)[0]


def postings_lookup(spark, d):
    postings, _ = _index(spark, d)
    return postings.where(F.col("term").isin(*T.query_terms(QUERY))).select("doc_id").distinct()


def inverted_index_stats(spark, d):
    return ix.statistics(_index(spark, d)[0], "doc_id")


def _bm25(spark, d, queries, where=None, corpus=False, boost=None, columns=(), whole=False):
    docs = _docs(spark, d, *columns)
    postings, lens = _index(spark, d, whole=whole)
    if where is not None or boost is not None:
        docs = _dated(docs) if "added_at" in str(where) else docs
        lens = lens.join((docs if where is None else docs.where(where)).drop("text") if boost is None else docs, "doc_id")
    return se.bm25(postings, lens, se.query_table(spark, queries), KEY, corpus=corpus, boost=boost)


def _out(hits: DataFrame, *more: str) -> DataFrame:
    return _long(hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), *more), *[m for m in more if m == "rank"])


def bm25_topk(spark, d):
    return _out(se.top(_bm25(spark, d, {1: QUERY}), 8, KEY), "rank")


def bm25_corpus_stats(spark, d):
    return _out(se.top(_bm25(spark, d, QUERIES, corpus=True), 20, KEY), "rank")


def _impacts(spark, d):
    make = lambda out: pruned.write_impacts(*_index(spark, d), KEY, out)
    return pruned.Impacts.read(spark, made_once(spark, f"{d}/documents.parquet", "impacts_documents", make))


def bm25_pruned(spark, d):
    return _out(se.top(pruned.best(_impacts(spark, d), QUERIES, KEY, 20), 20, KEY), "rank")


def document_search(spark, d):
    """Documents by their best passage, with what the store knows of each."""
    at = _store(spark, d, whole=True).catalog()
    key = ["doc_id", "chunk_no"]
    hits = se.top(se.trimmed(se.bm25(at.postings, at.entries, se.query_table(spark, QUERIES), key)), 24, key)
    docs = se.max_passage(hits.drop("rank"), "doc_id", ["chunk_no"], 8).join(at.documents, "doc_id", "left")
    return _long(docs.select("query_id", "doc_id", F.round("score", 6).alias("score"), "lang", "chunk_count", "rank"), "chunk_count", "rank")


def bm25_trim15(spark, d):
    return _out(se.trimmed(_bm25(spark, d, QUERIES)))


def bm25_filtered(spark, d):
    where = se.SearchFilter(source_type="en", tags=("SRC1", "src2", "src3")).column(source_type="lang", tags="tags")
    docs = _docs(spark, d, "lang", "source").withColumn("tags", F.array("source"))
    postings, lens = _index(spark, d)
    lens = lens.join(docs.where(where).select("doc_id"), "doc_id")
    return _out(se.top(se.bm25(postings, lens, se.query_table(spark, QUERIES), KEY), 8, KEY), "rank")


def bm25_time_range(spark, d):
    where = se.SearchFilter(added_after="2024-01-05 00:00:00", added_before="2024-01-20 12:00:00").column()
    return _out(se.top(_bm25(spark, d, QUERIES, where), 8, KEY), "rank")


def bm25_boosted(spark, d):
    docs = _docs(spark, d, "source")
    postings, lens = _index(spark, d)
    lens = lens.join(docs.select("doc_id", F.when(F.col("source") == "src1", F.lit(se.BOOST)).otherwise(F.lit(1.0)).alias("weight")), "doc_id")
    return _out(se.top(se.bm25(postings, lens, se.query_table(spark, QUERIES), KEY, boost=F.col("weight")), 8, KEY), "rank")


def _batch(spark, d, whole):
    items = _t(spark, d, "benchmark")
    queries = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    postings, lens = _index(spark, d, whole=whole)
    return _out(se.top(se.bm25(postings, lens, queries, KEY, small=False), 3, KEY), "rank")


def bm25_batch_queries(spark, d):
    return _batch(spark, d, True)


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _query_vectors(spark, d, ids):
    v = _vectors(spark, d)
    out = None
    for q, i in ids.items():
        one = v.where(F.col("doc_id") == i).select(F.lit(q).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
        out = one if out is None else out.union(one)
    return out


def cosine_topk(spark, d):
    v = _vectors(spark, d)
    asked = v.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return _out(se.top(vectors.dense_best(v, asked, KEY, 10), 10, KEY), "rank")


def cosine_bounded(spark, d):
    """The rows of cosine_topk, from stored cells."""
    v = _vectors(spark, d)
    asked = v.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    path = made_once(spark, f"{d}/embeddings.parquet", "cells", lambda out: nearest.write_cells(v, KEY, out))
    return _out(se.top(nearest.best(nearest.Cells.read(spark, path), asked, KEY, 10), 10, KEY), "rank")


def _fused(spark, d, hits, asked, alpha):
    sparse = store.kept(hits, "sparse")
    near = store.kept(se.candidate_dense(sparse, _vectors(spark, d), asked, KEY), "dense")
    return se.top(se.trimmed(store.kept(se.hybrid_best(sparse, near, alpha, KEY, 20), "fused")), 20, KEY)


def _hybrid(spark, d, queries, alpha, vectors, whole=False):
    return _fused(spark, d, _bm25(spark, d, queries, whole=whole), _query_vectors(spark, d, vectors), alpha)


def hybrid_batch(spark, d):
    """Of every hundredth document: its own indexed terms and its vector, against all documents."""
    postings, lens = _index(spark, d)
    asked = _vectors(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    terms = postings.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "term").join(asked.select("query_id"), "query_id")
    fused = store.kept(batch.hybrid(postings, lens, terms, _vectors(spark, d), asked, 0.5, KEY, 20), "fused")
    return _out(se.top(se.trimmed(fused, small=False), 20, KEY), "rank")


def hybrid_rrf(spark, d):
    return _out(_hybrid(spark, d, {1: QUERIES[1], 2: QUERIES[2]}, 0.5, {1: 7, 2: 11}), "rank")


ASKED = {1: "the and tion", 2: "what is the idiot clown"}


def hybrid_alpha_by_query_type(spark, d):
    alpha = F.lit(0.5)
    for q, text in ASKED.items():
        alpha = F.when(F.col("query_id") == q, S.alpha_of(S.query_type(F.lit(text)))).otherwise(alpha)
    return _out(_hybrid(spark, d, ASKED, alpha, {1: 7, 2: 11}, whole=True), "rank")


def hybrid_dense_only_fallback(spark, d):
    return _out(_hybrid(spark, d, {1: "zzzzqqq nosuchterm"}, 0.5, {1: 7}), "rank")


def query_types(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", S.query_type(F.col("text")).alias("kind"), S.alpha_of(S.query_type(F.col("text"))).alias("alpha"))


def _turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def _turn_hits(spark, d, queries):
    postings, lens = _index(spark, d, "conversations")
    return se.bm25(postings, lens, se.query_table(spark, queries), TURN)


def maxp_documents(spark, d):
    hits = se.top(se.trimmed(_turn_hits(spark, d, QUERIES)), 24, TURN)
    docs = se.max_passage(hits.drop("rank"), "conv_id", ["turn"], 8)
    names = F.array_join(F.transform("chunks", lambda c: c["turn"].cast("string")), ",")
    return _long(docs.select("query_id", "conv_id", F.round("score", 6).alias("score"), names.alias("turns"), "rank"), "rank")


def search_all_kbs(spark, d):
    docs = _docs(spark, d, "lang")
    postings, lens = _index(spark, d, whole=True)
    lens = lens.join(docs.select("doc_id", F.col("lang").alias("kb")), "doc_id")
    hits = se.search_all(postings, lens, se.query_table(spark, QUERIES), KEY, "kb", KEY, 10)
    return _out(hits, "kb", "rank")


def coarse_to_fine(spark, d):
    turns = _turns(spark, d)
    sections = chunk_sections(turns)
    queries = se.query_table(spark, {1: QUERIES[1]})
    make = lambda out: ix.write_index(sections, ["conv_id", "role"], out)
    stored = ix.read_index(spark, made_once(spark, f"{d}/conversations.parquet", "index_sections", make))
    entries = se.in_top_sections(turns.select("conv_id", "turn", "role"), sections, queries, "conv_id", "role", stored=stored)
    postings, lens = _index(spark, d, "conversations")
    lens = lens.join(entries.select("query_id", *TURN), TURN)
    return _long(se.top(se.bm25(postings, lens, queries, TURN), 8, TURN).select("query_id", *TURN, F.round("score", 6).alias("score"), "rank"), "rank")


def chunk_sections(turns):
    rows = turns.select("conv_id", F.col("turn").alias("chunk_no"), F.col("role").alias("section"), F.col("text").alias("content"), F.lit(0).alias("offset"))
    return chunk.sections(rows, ["conv_id"]).select("conv_id", F.col("section").alias("role"), F.col("content").alias("text"))


def coarse_sections(spark, d):
    return chunk_sections(_turns(spark, d))


def section_hint(spark, d):
    hits = se.top(_turn_hits(spark, d, QUERIES), 40, TURN).join(_turns(spark, d).drop("text"), TURN)
    return present.section_hints(hits, ["query_id", "conv_id"], "role").select("query_id", *TURN, "section_hint")


def _shown(spark, d):
    """All turns, as if one query showed each conversation's turns in order."""
    return _turns(spark, d).withColumn("query_id", F.lit(1).cast("long")).withColumn("rank", F.col("turn").cast("long"))


ALIKE = 0.08


def snippet_jaccard_pairs(spark, d):
    pairs = present.similar_pairs(_shown(spark, d), ["query_id", "conv_id"], "rank", "text", ALIKE)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def dedup_marks(spark, d):
    return present.duplicate_marks(_shown(spark, d), ["query_id", "conv_id"], "rank", "turn", "text", ALIKE).select("conv_id", "rank", "duplicate_of")


def snippets(spark, d):
    hits = se.top(_bm25(spark, d, {1: QUERY}), 20, KEY).join(_docs(spark, d), "doc_id", "left")
    made = present.snippets(hits, F.lit(QUERY), F.array(*[F.lit(t) for t in T.query_terms(QUERY)]))
    return made.select("doc_id", "snippet")


def sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences("text")).alias("nth", "sentence")).select("doc_id", F.col("nth").cast("long").alias("nth"), "sentence")


def _exploded(docs, array, name="content"):
    return docs.select("doc_id", F.posexplode(array).alias("nth", name)).select("doc_id", F.col("nth").cast("long").alias("nth"), name)


def long_split_pack(spark, d):
    return _exploded(_docs(spark, d).where(F.char_length("text") > chunk.LONG), chunk.packed(F.col("text")))


def _turn_lists(spark, d):
    t = _turns(spark, d).groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return t.select("doc_id", F.transform("p", lambda x: x["text"]).alias("p"))


def merge_short(spark, d):
    return _exploded(_turn_lists(spark, d), chunk.merged_short(F.col("p"), chunk.SHORT))


def merge_fragments(spark, d):
    return _exploded(_turn_lists(spark, d), chunk.merged_short(F.col("p"), chunk.FRAGMENT))


def overlap_chunks(spark, d):
    return _exploded(_turn_lists(spark, d), chunk.overlapped(F.col("p")))


def chunk_documents(spark, d):
    out = chunk.chunks(_docs(spark, d), KEY)
    return _long(out.select("doc_id", "chunk_no", "chunk_id", "content", "section", "section_role", "offset"), "chunk_no", "offset")


def section_roles(spark, d):
    return _t(spark, d, "pages").select("page_id", T.section_role(F.concat(F.lit("## 1. "), T.html_to_text("html"))).alias("role"))


def paper_flag(spark, d):
    return _docs(spark, d).select("doc_id", T.looks_like_paper("text").alias("is_paper"))


def paper_meta(spark, d):
    return paper.with_paper_meta(_docs(spark, d)).select("doc_id", "title", F.array_join("authors", "; ").alias("authors"), "abstract", "is_paper")


def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", T.html_to_text("html").alias("text"))


def context_window(spark, d):
    return present.context(_turns(spark, d), ["conv_id"], "turn", "text", 1).select("conv_id", "turn", "context")


def mock_rerank(spark, d):
    hits = se.top(_bm25(spark, d, QUERIES), 20, KEY).join(_docs(spark, d), "doc_id")
    text = F.lit("")
    for q, t in QUERIES.items():
        text = F.when(F.col("query_id") == q, F.lit(t)).otherwise(text)
    again = hits.withColumn("score", models.overlap_score(text, F.col("text")))
    return _out(se.top(again.drop("rank"), 8, KEY), "rank")


def mock_embedding(spark, d):
    out = models.embedded(_t(spark, d, "benchmark"), models.HashEmbedder(8), "text")
    return out.select("item_id", F.array_join(F.transform("vector", lambda v: v.cast("string")), ",").alias("vector"))


def semantic_merge(spark, d):
    rows = _t(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("doc"), "vec_id", F.col("vec_id").cast("string").alias("content"), F.col("embedding").cast("array<double>").alias("vector"))
    return chunk.semantic_merge(rows, ["doc"], "vec_id").select("doc", F.col("nth").cast("long").alias("nth"), "content")


def synonym_rewrite(spark, d):
    asked = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return models.variants(asked, {"the": ["ze"], "and": ["plus", "with"]}).select("conv_id", "turn", "variant")


def _listing(spark, d):
    return _dated(_docs(spark, d, "lang", "source")).select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("name"), "lang", F.octet_length("text").cast("long").alias("total_chars"), "added_at")


def doc_listing_page(spark, d):
    where = (F.col("lang") == "en") & F.lower("name").contains("src1")
    return catalog.page(_listing(spark, d), F.col("total_chars"), "doc_id", True, 20, 20, where).select("doc_id", "name", "total_chars", "total")


def upload_summary(spark, d):
    return catalog.upload_summary(_docs(spark, d, "lang"), "lang", F.char_length("text") >= 500)


def doc_checksum(spark, d):
    rows = _turns(spark, d)
    return catalog.checksum(rows, ["conv_id"], "turn", F.lpad(F.col("turn").cast("string"), 3, "0"), "text")


def remove_document(spark, d):
    postings, _ = _index(spark, d)
    gone = _t(spark, d, "labels").where("toxic = 1").select("doc_id")
    return ix.document_frequency(ix.without_documents(postings, gone, KEY))


def _store(spark, d, changed=True, whole=False):
    """A store of all documents, of which every hundredth is replaced and every hundredth removed if changed: three commits. whole: all terms of a chunk are indexed."""
    docs = lambda: _docs(spark, d, *(["lang"] if changed else []))

    def make(out):
        store = Store(spark, out, terms=0 if whole else ix.TOP_TERMS)
        store.ingest(docs())
        if changed:
            store.ingest(docs().where("doc_id % 100 = 1").withColumn("text", F.concat("text", F.lit(" idiot clown the "), "lang")))
            store.remove(docs().where("doc_id % 100 = 2"))

    return Store(spark, made_once(spark, f"{d}/documents.parquet", f"store_{changed}" + "_whole" * whole, make))


def store_search(spark, d):
    at = _store(spark, d, whole=True).catalog()
    hits = se.top(se.bm25(at.postings, at.entries, se.query_table(spark, QUERIES), ["doc_id", "chunk_no"]), 10, ["doc_id", "chunk_no"])
    return _long(hits.select("query_id", "doc_id", "chunk_no", F.round("score", 6).alias("score"), "rank"), "rank", "chunk_no")


def store_documents(spark, d):
    return _long(_store(spark, d).table("documents").select("doc_id", "total_chars", "chunk_count"), "total_chars", "chunk_count")


def store_digests(spark, d):
    return _store(spark, d, False).digests().where("table_name IN ('chunks', 'postings')").drop("segment")


def sectioned_chunks(spark, d):
    return _long(_headed_chunks(spark, d).drop("chunk_id"), "chunk_no", "offset")


def _headed_chunks(spark, d):
    made = _docs(spark, d, "lang").where("text IS NOT NULL").select("doc_id", F.expr(_HEADED).alias("text"))
    return chunk.chunks(made, KEY)


def section_reading(spark, d):
    """The second section of every document."""
    rows = present.read_section(chunk.sections(_headed_chunks(spark, d), KEY), F.lit(True), "S01")
    return _long(rows.select("doc_id", "section", "offset", "content"), "offset")


def rendered_context(spark, d):
    """The second chunk of every document with its neighbours, under their headings."""
    return present.rendered(_headed_chunks(spark, d), KEY, 1, 1)


def append_document(spark, d):
    base = _store(spark, d, False).table("chunks")
    more = _turn_lists(spark, d).select("doc_id", F.array_join("p", "\n\n").alias("text"))
    out = chunk.appended(base, more, KEY)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("content")).alias("chars"), F.max("chunk_no").cast("long").alias("last_no"))


def append_boundary(spark, d):
    rows = _t(spark, d, "embeddings").select(
        F.expr("vec_id div 16").alias("doc"), F.expr("cast(vec_id % 16 AS int)").alias("i"), F.col("vec_id").cast("string").alias("content"), F.col("embedding").cast("array<double>").alias("vector"))
    old = rows.where("i < 10").withColumnRenamed("i", "chunk_no")
    new = rows.where("i >= 10").withColumn("chunk_no", F.col("i") - 10).drop("i")
    return _long(chunk.boundary_merged(old, new, ["doc"]).select("doc", "chunk_no", "content"), "chunk_no")


def listing_checksum(spark, d):
    listed = _listing(spark, d).select("doc_id", "name", "lang", "total_chars")
    return catalog.listing_tree(listed, "doc_id")


def listing_changes(spark, d):
    """Between the first and the last version of a store."""
    held = _store(spark, d)
    return catalog.listing_changes(held.table("documents", 1), held.table("documents", 3), "doc_id")


def store_snapshot(spark, d):
    held = _store(spark, d, False)
    return catalog.snapshot(held.table("documents").select("doc_id"), held.table("chunks"), KEY)


def store_preview(spark, d):
    return _long(catalog.preview(_store(spark, d, False).table("chunks"), F.col("doc_id") == 7).select("doc_id", "chunk_no", "content"), "chunk_no")


def request_search(spark, d):
    hits = request.search(_store(spark, d, whole=True).catalog(), request.SearchRequest.of(QUERIES[2], limit=12))
    return _long(hits.select("doc_id", "chunk_no", F.round("score", 6).alias("score"), "rank"), "rank", "chunk_no")


def synonyms_both_ways(spark, d):
    asked = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return models.variants(asked, {"the": ["on"], "de": ["la"]}, reverse=True).select("conv_id", "turn", "variant")


def eval_metrics(spark, d):
    good = _t(spark, d, "labels").where("quality = 1").select("doc_id")
    return evaluate.metrics_of_ranked(_batch(spark, d, False), good)


BASE = r"""
tok AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}_]+')) AS term FROM {table}),
tf_all AS (SELECT {key}, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT {key}, sum(tf)::DOUBLE AS length FROM tf_all GROUP BY ALL),
post AS (SELECT {key}, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY tf DESC, term) AS r FROM tf_all) WHERE r <= 50)"""
#: All terms are indexed.
WHOLE = BASE[: BASE.index("post AS")] + "post AS (SELECT * FROM tf_all)"


def _base(key="doc_id", table="documents", base=BASE):
    return "WITH RECURSIVE " + base.format(key=key, table=table).strip()


def _q(queries):
    rows = ", ".join(f"({q}::BIGINT, '{t}')" for q, text in queries.items() for t in T.query_terms(text))
    return f"q(query_id, term) AS (VALUES {rows})"


PART = "ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf::DOUBLE * 2.2e0 / (tf::DOUBLE + 1.2e0 * (0.25e0 + 0.75e0 * length / average))"


def _scored(key="doc_id", entries="SELECT * FROM lens", scope="", boost="1e0", name="sc"):
    s = f", {scope}" if scope else ""
    using = f"(query_id{s})"
    return f"""
ent AS ({entries}),
m AS (SELECT * FROM post JOIN q USING (term) JOIN ent USING ({key})),
st AS (SELECT query_id{s}, count(*)::DOUBLE AS n, avg(length) AS average FROM (SELECT DISTINCT query_id{s}, {key}, length FROM m) GROUP BY ALL),
fr AS (SELECT query_id{s}, term, count(*)::DOUBLE AS df FROM m GROUP BY ALL),
{name} AS (SELECT query_id{s}, {key}, round(sum({PART}) * {boost}, 9) AS score FROM m JOIN st USING {using} JOIN fr USING (query_id{s}, term) GROUP BY query_id{s}, {key})"""


def _top(name, k, key="doc_id", more="", by="query_id"):
    return f"SELECT query_id, {key}, round(score, 6) AS score{more}, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {key}) AS rank FROM {name}) WHERE rank <= {k}"


def _trim(name, out="tr", by="query_id"):
    return f"{out} AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY {by}) AS best FROM {name}) WHERE score >= 0.15e0 * best OR best <= 0)"


def _dense(ids):
    rows = ", ".join(f"({q}::BIGINT, {i})" for q, i in ids.items())
    return f"""
qv AS (SELECT query_id, embedding::DOUBLE[] AS vector FROM (VALUES {rows}) x(query_id, vec_id) JOIN embeddings USING (vec_id)),
de AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS score FROM embeddings, qv),
dn AS (SELECT * FROM de WHERE score > 0)"""


_OF_HITS = """,
dc AS (SELECT dn.* FROM dn WHERE (query_id, doc_id) IN (SELECT query_id, doc_id FROM sc) OR query_id NOT IN (SELECT query_id FROM sc))"""
_OF_ALL = """,
dc AS (SELECT * FROM dn WHERE doc_id IS NOT NULL)"""
_FUSED = """,
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS r1 FROM sc),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS r2 FROM dc),
f AS (SELECT query_id, doc_id, round(coalesce(({alpha}) / (60 + r1::DOUBLE), 0e0) + coalesce((1e0 - ({alpha})) / (60 + r2::DOUBLE), 0e0), 9) AS score
  FROM a FULL JOIN b USING (query_id, doc_id)),
{trim}
{top}"""


def _hybrid_sql(queries, alpha, ids, base=BASE):
    return f"{_base(base=base)}, {_q(queries)}, {_scored()}, {_dense(ids)}" + _OF_HITS + _FUSED.format(alpha=alpha, trim=_trim("f"), top=_top("tr", 20))


_SENT = r"regexp_extract_all({x}, '([^.!?。！？]*[.!?。！？]|[^.!?。！？]+$)', 1)"
_SENTS = "list_filter(list_transform(" + _SENT + r", lambda s: CASE WHEN regexp_matches(s, '[.!?。！？]$') THEN s ELSE regexp_replace(s, '^\s+|\s+$', '', 'g') END), lambda s: s <> '')"
_TRIMMED = "list_filter(list_transform(" + _SENTS + r", lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def _nth(array, source, name="content"):
    return f"SELECT doc_id, i - 1 AS nth, p[i] AS {name} FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {array} AS p FROM {source}))"


def _reduce(p, body):
    return f"list_reduce(list_transform({p}, lambda x: [x]), lambda o, x: {body})"


_PACK = _reduce("s", "CASE WHEN length(o[-1]) + length(x[1]) <= 2000 THEN o[:-2] || [o[-1] || ' ' || x[1]] ELSE o || x END")
_SHORT = "CASE WHEN length(x[1]) < {n} THEN o[:-2] || [o[-1] || chr(10) || chr(10) || x[1]] ELSE o || x END"
_TAIL = """(CASE WHEN length(o[-1]) <= 200 THEN o[-1] WHEN regexp_matches(right(o[-1], 200), '[.!?。！？]') THEN regexp_replace(right(o[-1], 200), '^[^.!?。！？]*[.!?。！？]', '') ELSE right(o[-1], 200) END)"""
_LAP = f"o || [CASE WHEN {_TAIL} <> '' THEN {_TAIL} || chr(10) || chr(10) || x[1] ELSE x[1] END]"
_LISTS = "(SELECT conv_id AS doc_id, list(text ORDER BY turn) AS s FROM conversations GROUP BY conv_id)"
_TURNS = _base("conv_id, turn", "conversations")
_ROLES = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{w}')" for w in words) + f" THEN '{role}'" for role, words in T.SECTION_ROLES) + " ELSE '' END"
_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> ''))"
_VERBS = ", ".join(f"'{v}'" for v in S.VERBS)
_JAC = "len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
def _chunked(source, p=""):
    """CTEs of chunks of texts without headings: {p}ov (doc_id, s)."""
    return f"""
{p}ps AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM {source}),
{p}sp AS (SELECT doc_id, CASE WHEN length(b) <= 2000 OR len({_SENTS.format(x='b')}) <= 1 THEN [b] ELSE {_PACK.replace('(s,', '(' + _TRIMMED.format(x='b') + ',')} END AS s FROM {p}ps WHERE b <> ''),
{p}fr AS (SELECT doc_id, {_reduce('s', _SHORT.format(n=60))} AS s FROM {p}sp),
{p}ov AS (SELECT doc_id, {_reduce('s', _LAP)} AS s FROM {p}fr)"""


_CHUNK_ROWS = "SELECT doc_id, i - 1 AS chunk_no, lpad((i - 1)::VARCHAR, 3, '0') AS chunk_id, s[i] AS content FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM {0}ov)"
_CHANGED_DOCS = "(SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN text || ' idiot clown the ' || lang ELSE text END AS text FROM documents WHERE doc_id % 100 <> 2)"
#: A text with headings, CRLF, blank lines, blanks at line starts and CJK, from each document.
_HEADED = ("chr(32) || '## 1. Introduction' || chr(13) || chr(10) || left(text, 700) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || '# 方法 ' || coalesce(lang, '') || chr(10) || chr(10) || chr(32) || chr(9) || "
           "substr(text, 701, 2600) || chr(10) || '### Results' || chr(10) || '结果很好。more' || chr(10) || chr(10) || substr(text, 3301, 500) || chr(10) || chr(10) || chr(10) || chr(10) || 'short' || chr(13) || chr(10) || chr(13) || chr(10) || "
           "'####### none' || chr(10) || chr(10) || '## References' || chr(13) || chr(10) || chr(13) || chr(10) || right(text, 400)")
_ITEM_SHORT = "CASE WHEN length(x[1].c) < {n} THEN o[:-2] || [{{'c': o[-1].c || chr(10) || chr(10) || x[1].c, 's': o[-1].s, 'o': o[-1].o}}] ELSE o || x END"
def _sectioned(source):
    """SQL of chunks (doc_id, chunk_no, content, section, section_role, offset) of any texts."""
    return f"""WITH b AS (SELECT doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(13) || chr(10), chr(10)) AS b FROM {source} WHERE text IS NOT NULL),
pp AS (SELECT doc_id, p[i] AS p, i, strlen(array_to_string(p[:i - 1], chr(10) || chr(10))) + CASE WHEN i > 1 THEN 2 ELSE 0 END AS pos FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(b, chr(10) || chr(10)) AS p FROM b))),
pa AS (SELECT doc_id, i, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS c, pos + strlen(regexp_extract(p, '^\\s*')) AS o FROM pp WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> ''),
ll AS (SELECT doc_id, l[i] AS l, strlen(array_to_string(l[:i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS o FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(b, chr(10)) AS l FROM b))),
hd AS (SELECT doc_id, o, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS h FROM ll WHERE regexp_matches(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '^#{{1,6}} ')),
se AS (SELECT pa.doc_id, pa.i, pa.c, pa.o, coalesce(arg_max(hd.h, hd.o), '') AS s FROM pa LEFT JOIN hd ON hd.doc_id = pa.doc_id AND hd.o <= pa.o GROUP BY ALL),
m1 AS (SELECT doc_id, {_reduce("list({'c': c, 's': s, 'o': o} ORDER BY i)", _ITEM_SHORT.format(n=200))} AS p FROM se GROUP BY doc_id),
un AS (SELECT doc_id, i, p[i].c AS c, p[i].s AS sec, p[i].o AS o FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM m1)),
pk AS (SELECT doc_id, i, sec, o, CASE WHEN length(c) <= 2000 OR len({_SENTS.format(x='c')}) <= 1 THEN [c] ELSE {_PACK.replace('(s,', '(' + _TRIMMED.format(x='c') + ',')} END AS cs FROM un),
un2 AS (SELECT doc_id, i, sec, o, cs[j] AS c, j FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS j FROM pk)),
m2 AS (SELECT doc_id, {_reduce("list({'c': c, 's': sec, 'o': o} ORDER BY i, j)", _ITEM_SHORT.format(n=60))} AS p FROM un2 GROUP BY doc_id),
lap AS (SELECT doc_id, p, {_reduce('list_transform(p, lambda y: y.c)', _LAP)} AS t FROM m2),
f AS (SELECT doc_id, i - 1 AS chunk_no, t[i] AS content, p[i].s AS section, p[i].o AS "offset" FROM (SELECT doc_id, p, t, unnest(range(1, len(p) + 1)) AS i FROM lap))
SELECT doc_id, chunk_no, content, section, {_ROLES} AS section_role, "offset" FROM (SELECT *, regexp_replace(lower(trim(regexp_replace(trim(section), '^#+', ''))), '^[0-9ivxabc()][0-9ivxabc(]*[ .)]\\s*', '') AS h FROM f)"""


def _digest_sql(name, columns, source):
    text = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in sorted(columns, key=lambda c: c.strip('"')))
    return f"SELECT '{name}' AS table_name, count(*) AS rows, coalesce(sum(('0x' || left(sha256({text}), 15))::BIGINT), 0)::VARCHAR AS digest FROM {source}"


def _batch_sql(base=BASE):
    return f"""{_base(base=base)}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}_]+')) AS term FROM benchmark), {_scored()}"""


def oracle_sql() -> dict[str, str]:
    top_q = f"{_TURNS}, {_q(QUERIES)}, {_scored('conv_id, turn')}"
    cosine = f"""WITH qv AS (SELECT vec_id::BIGINT AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 100 = 0),
dn AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS score FROM embeddings, qv WHERE round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) > 0) {_top('dn', 10)}"""
    return {
        "token_counts": _base() + " SELECT * FROM tf_all",
        "doc_frequency": _base() + " SELECT term, count(*) AS df FROM tf_all GROUP BY term",
        "top_terms_50": _base() + " SELECT * FROM post",
        "postings_lookup": f"{_base()}, {_q({1: QUERY})} SELECT DISTINCT doc_id FROM post JOIN q USING (term)",
        "inverted_index_stats": _base() + " SELECT count(DISTINCT term) AS terms, count(*) AS postings, count(DISTINCT doc_id) AS documents FROM post",
        "bm25_topk": f"{_base()}, {_q({1: QUERY})}, {_scored()} {_top('sc', 8)}",
        "bm25_corpus_stats": f"""{_base()}, {_q(QUERIES)}, m AS (SELECT * FROM post JOIN q USING (term) JOIN lens USING (doc_id)),
st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM lens), fr AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum({PART}), 9) AS score FROM m JOIN fr USING (term), st GROUP BY ALL) {_top('sc', 20)}""",
        "bm25_pruned": f"""{_base()}, {_q(QUERIES)}, m AS (SELECT * FROM post JOIN q USING (term) JOIN lens USING (doc_id)),
st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM lens), fr AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum({PART}), 9) AS score FROM m JOIN fr USING (term), st GROUP BY ALL) {_top('sc', 20)}""",
        "document_search": f"""WITH RECURSIVE {_chunked(_CHANGED_DOCS, 'c').strip()}, ch AS ({_CHUNK_ROWS.format('c')}), fine AS (SELECT doc_id, chunk_no, content AS text FROM ch),
{WHOLE.format(key='doc_id, chunk_no', table='fine').strip()}, {_q(QUERIES)}, {_scored('doc_id, chunk_no')}, {_trim('sc')}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS r FROM tr) WHERE r <= 24),
g AS (SELECT query_id, doc_id, max(score) AS score FROM h GROUP BY ALL), b AS ({_top('g', 8)}), n AS (SELECT doc_id, count(*) AS chunk_count FROM ch GROUP BY doc_id)
SELECT b.*, lang, chunk_count FROM b JOIN documents USING (doc_id) JOIN n USING (doc_id)""",
        "bm25_trim15": f"{_base()}, {_q(QUERIES)}, {_scored()}, {_trim('sc')} SELECT query_id, doc_id, round(score, 6) AS score FROM tr",
        "bm25_filtered": f"{_base()}, {_q(QUERIES)}, {_scored(entries="SELECT lens.* FROM lens JOIN documents USING (doc_id) WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")} {_top('sc', 8)}",
        "bm25_time_range": f"""{_base()}, {_q(QUERIES)}, {_scored(entries="SELECT * FROM lens WHERE TIMESTAMP '2024-01-01' + to_hours(doc_id) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'")} {_top('sc', 8)}""",
        "bm25_boosted": f"""{_base()}, {_q(QUERIES)}, {_scored(entries="SELECT lens.*, CASE WHEN source = 'src1' THEN 1.1e0 ELSE 1e0 END AS boost FROM lens JOIN documents USING (doc_id)", boost='any_value(boost)')} {_top('sc', 8)}""",
        "bm25_batch_queries": f"{_batch_sql(WHOLE)} {_top('sc', 3)}",
        "cosine_topk": cosine,
        "cosine_bounded": cosine,
        "hybrid_rrf": _hybrid_sql({1: QUERIES[1], 2: QUERIES[2]}, "0.5e0", {1: 7, 2: 11}),
        "hybrid_alpha_by_query_type": _hybrid_sql(ASKED, "CASE query_id WHEN 2 THEN 0.4e0 WHEN 1 THEN 0.5e0 END", {1: 7, 2: 11}, WHOLE),
        "hybrid_dense_only_fallback": _hybrid_sql({1: "zzzzqqq nosuchterm"}, "0.5e0", {1: 7}),
        "query_types": rf"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM conversations),
c AS (SELECT *, len(list_filter(ws, lambda w: w IN ({_VERBS})))::DOUBLE / len(ws) AS v, len(list_filter(ws, lambda w: w NOT IN ({_VERBS}) AND strlen(w) > 3))::DOUBLE / len(ws) AS o FROM w),
k AS (SELECT conv_id, turn, CASE WHEN len(ws) < 2 THEN 'factual' WHEN rtrim(text, ' ') LIKE '%?' THEN 'conceptual' WHEN v >= 0.25 THEN 'conceptual' WHEN o >= 0.6 THEN 'factual' ELSE 'balanced' END AS kind FROM c)
SELECT *, CASE kind WHEN 'conceptual' THEN 0.4e0 WHEN 'factual' THEN 0.6e0 ELSE 0.5e0 END AS alpha FROM k""",
        "maxp_documents": f"""{top_q}, {_trim('sc')}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conv_id, turn) AS r FROM tr) WHERE r <= 24),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, conv_id ORDER BY score DESC, turn) AS nth FROM h),
g AS (SELECT query_id, conv_id, max(score) AS score, string_agg(turn::VARCHAR, ',' ORDER BY nth) AS turns FROM p WHERE nth <= 3 GROUP BY ALL) {_top('g', 8, 'conv_id', ', turns')}""",
        "search_all_kbs": f"""{_base(base=WHOLE)}, {_q(QUERIES)}, {_scored(entries="SELECT lens.*, lang AS kb FROM lens JOIN documents USING (doc_id)", scope='kb')}, {_trim('sc', by='query_id, kb')},
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, doc_id) AS r FROM tr) WHERE r <= 10),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY kb) AS i FROM o) WHERE i = 1) {_top('u', 10, 'doc_id', ', kb')}""",
        "coarse_to_fine": f"""WITH RECURSIVE sec AS (SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL),
best AS ({_base('conv_id, role', 'sec')}, {_q({1: QUERIES[1]})}, {_scored('conv_id, role')} {_top('sc', 3, 'conv_id, role')}),
fine AS ({_TURNS}, {_q({1: QUERIES[1]})}, {_scored('conv_id, turn', "SELECT lens.* FROM lens JOIN conversations USING (conv_id, turn) WHERE role = '' OR (conv_id, role) IN (SELECT conv_id, role FROM best)")} {_top('sc', 8, 'conv_id, turn')})
SELECT * FROM fine""",
        "coarse_sections": "SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL",
        "section_hint": f"""{top_q}, h AS ({_top('sc', 40, 'conv_id, turn')}), c AS (SELECT h.*, role, count(*) OVER (PARTITION BY query_id, conv_id, role) AS n FROM h JOIN conversations USING (conv_id, turn))
SELECT query_id, conv_id, turn, CASE WHEN role <> '' AND n >= 2 THEN n || ' hits in section ' || role || '; read the whole section' ELSE '' END AS section_hint FROM c""",
        "snippet_jaccard_pairs": f"""WITH hw AS (SELECT 1::BIGINT AS query_id, conv_id, turn::BIGINT AS rank, {_WORDS.format(x='text')} AS w FROM conversations),
j AS (SELECT a.query_id, a.conv_id, a.rank AS rank_a, b.rank AS rank_b, {_JAC.format(a='a.w', b='b.w')} AS similarity FROM hw a JOIN hw b ON a.conv_id = b.conv_id AND a.rank < b.rank)
SELECT query_id, conv_id, rank_a, rank_b, round(similarity, 6) AS similarity FROM j WHERE round(similarity, 9) >= {ALIKE}""",
        "dedup_marks": f"""WITH RECURSIVE c AS (SELECT conv_id, turn AS rank, {_WORDS.format(x='text')} AS w FROM conversations),
near AS (SELECT a.conv_id, a.rank AS a, b.rank AS b FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.rank < b.rank WHERE round({_JAC.format(a='a.w', b='b.w')}, 9) >= {ALIKE}),
lists AS (SELECT conv_id, list(rank ORDER BY rank) AS ranks FROM c GROUP BY conv_id),
step AS (SELECT conv_id, 0::BIGINT AS i, []::BIGINT[] AS canon, NULL::BIGINT AS rank, NULL::BIGINT AS of FROM lists
  UNION ALL
  SELECT s.conv_id, s.i + 1, CASE WHEN f.of IS NULL THEN list_append(s.canon, l.ranks[s.i + 1]) ELSE s.canon END, l.ranks[s.i + 1], f.of
  FROM step s JOIN lists l USING (conv_id) CROSS JOIN LATERAL (SELECT min(n.a) AS of FROM near n WHERE n.conv_id = s.conv_id AND n.b = l.ranks[s.i + 1] AND list_contains(s.canon, n.a)) f
  WHERE s.i < len(l.ranks))
SELECT conv_id, rank, of::VARCHAR AS duplicate_of FROM step WHERE rank IS NOT NULL""",
        "sentence_split": _nth(_SENTS.format(x="text"), "documents", "sentence"),
        "long_split_pack": _nth(f"CASE WHEN len({_SENTS.format(x='t')}) <= 1 THEN [t] ELSE {_PACK} END", f"(SELECT doc_id, text AS t, {_TRIMMED.format(x='text')} AS s FROM documents WHERE length(text) > 2000)"),
        "merge_short": _nth(_reduce("s", _SHORT.format(n=200)), _LISTS),
        "merge_fragments": _nth(_reduce("s", _SHORT.format(n=60)), _LISTS),
        "overlap_chunks": _nth(_reduce("s", _LAP), _LISTS),
        "chunk_documents": f"""WITH {_chunked('documents').strip()} SELECT *, '' AS section, '' AS section_role, 0::BIGINT AS "offset" FROM ({_CHUNK_ROWS.format('')})""",
        "sectioned_chunks": _sectioned(f"(SELECT doc_id, {_HEADED} AS text FROM documents)"),
        "section_reading": f"""WITH c AS ({_sectioned(f"(SELECT doc_id, {_HEADED} AS text FROM documents)")}),
s AS (SELECT doc_id, section, min(chunk_no) AS first, arg_min("offset", chunk_no)::BIGINT AS "offset", string_agg(content, chr(10) || chr(10) ORDER BY chunk_no) AS content FROM c GROUP BY doc_id, section)
SELECT doc_id, section, "offset", content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM s) WHERE n = 2""",
        "rendered_context": f"""WITH c AS ({_sectioned(f"(SELECT doc_id, {_HEADED} AS text FROM documents)")}),
n AS (SELECT *, lag(section, 1, '') OVER (PARTITION BY doc_id ORDER BY chunk_no) AS before FROM c WHERE chunk_no <= 2)
SELECT doc_id, string_agg(CASE WHEN section <> before AND section <> '' THEN '## ' || section || chr(10) ELSE '' END || content, chr(10) || chr(10) ORDER BY chunk_no) AS text FROM n GROUP BY doc_id""",
        "store_search": f"""WITH RECURSIVE {_chunked(_CHANGED_DOCS, 'c').strip()}, ch AS ({_CHUNK_ROWS.format('c')}),
fine AS (SELECT doc_id, chunk_no, content AS text FROM ch), {WHOLE.format(key='doc_id, chunk_no', table='fine').strip()}, {_q(QUERIES)}, {_scored('doc_id, chunk_no')} {_top('sc', 10, 'doc_id, chunk_no')}""",
        "store_documents": f"""WITH {_chunked(_CHANGED_DOCS).strip()}, n AS (SELECT doc_id, len(s) AS chunk_count FROM ov)
SELECT doc_id, strlen(text) AS total_chars, coalesce(chunk_count, 0) AS chunk_count FROM {_CHANGED_DOCS} LEFT JOIN n USING (doc_id)""",
        "store_digests": f"""WITH RECURSIVE {_chunked('documents', 'c').strip()}, ch AS (SELECT *, '' AS section, '' AS section_role, 0 AS "offset" FROM ({_CHUNK_ROWS.format('c')})),
fine AS (SELECT doc_id, chunk_no, content AS text FROM ch), {BASE.format(key='doc_id, chunk_no', table='fine').strip()}
{_digest_sql('chunks', ['doc_id', 'chunk_no', 'chunk_id', 'content', 'section', 'section_role', '"offset"'], 'ch')}
UNION ALL {_digest_sql('postings', ['doc_id', 'chunk_no', 'term', 'tf'], 'post')}""",
        "hybrid_batch": f"""{_base()}, q AS (SELECT doc_id AS query_id, term FROM post WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), {_scored()},
qv AS (SELECT vec_id::BIGINT AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 100 = 0),
de AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS score FROM embeddings, qv),
dn AS (SELECT * FROM de WHERE score > 0){_OF_ALL}{_FUSED.format(alpha='0.5e0', trim=_trim('f'), top=_top('tr', 20))}""",
        "listing_checksum": """WITH l AS (SELECT sha256(doc_id::VARCHAR) AS place, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(source || '-' || doc_id) || ':' || source || '-' || doc_id, '-') || coalesce(strlen(strlen(text)::VARCHAR) || ':' || strlen(text), '-') AS t FROM documents),
a AS (SELECT left(place, 2) AS prefix, count(*) AS rows, sha256(string_agg(sha256(t), '' ORDER BY place, sha256(t))) AS digest FROM l GROUP BY left(place, 2)),
b AS (SELECT left(prefix, 1) AS up, sum(rows)::BIGINT AS rows, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest FROM a GROUP BY up)
SELECT * FROM a UNION ALL SELECT up, rows, digest FROM b UNION ALL SELECT '', sum(rows)::BIGINT, sha256(string_agg(digest, '' ORDER BY up)) FROM b HAVING count(*) > 0""",
        "listing_changes": "SELECT doc_id, CASE doc_id % 100 WHEN 1 THEN 'changed' ELSE 'removed' END AS change FROM documents WHERE doc_id % 100 IN (1, 2)",
        "store_snapshot": f"""WITH {_chunked('documents').strip()}, n AS (SELECT doc_id, len(s) AS chunks, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS chars FROM ov)
SELECT doc_id, coalesce(chunks, 0) AS chunks, coalesce(chars, 0) AS chars FROM documents LEFT JOIN n USING (doc_id)""",
        "store_preview": f"""WITH {_chunked('documents').strip()} SELECT doc_id, chunk_no, content FROM ({_CHUNK_ROWS.format('')}) WHERE doc_id = 7 ORDER BY chunk_no LIMIT 3""",
        "request_search": f"""WITH RECURSIVE {_chunked(_CHANGED_DOCS, 'c').strip()}, ch AS ({_CHUNK_ROWS.format('c')}), fine AS (SELECT doc_id, chunk_no, content AS text FROM ch),
{WHOLE.format(key='doc_id, chunk_no', table='fine').strip()}, {_q({1: QUERIES[2]})}, {_scored('doc_id, chunk_no')}, {_trim('sc')}, h AS ({_top('tr', 12, 'doc_id, chunk_no')}) SELECT doc_id, chunk_no, score, rank FROM h""",
        "synonyms_both_ways": r"""SELECT DISTINCT conv_id, turn, variant FROM (SELECT conv_id, turn, unnest([text, CASE WHEN contains(l, 'the') THEN regexp_replace(text, '(?i)the', 'on') END, CASE WHEN contains(l, 'the') AND contains(l, 'on') THEN regexp_replace(text, '(?i)on', 'the') END,
  CASE WHEN contains(l, 'de') THEN regexp_replace(text, '(?i)de', 'la') END, CASE WHEN contains(l, 'de') AND contains(l, 'la') THEN regexp_replace(text, '(?i)la', 'de') END]) AS variant FROM (SELECT *, lower(text) AS l FROM conversations)) WHERE variant IS NOT NULL""",
        "append_document": f"""WITH {_chunked('documents').strip()}, more AS ({_sectioned("(SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)")}),
al AS (SELECT doc_id, content FROM ({_CHUNK_ROWS.format('')}) UNION ALL SELECT doc_id, content FROM more)
SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, count(*) - 1 AS last_no FROM al GROUP BY doc_id""",
        "append_boundary": f"""WITH v AS (SELECT vec_id // 16 AS doc, vec_id % 16 AS i, vec_id::VARCHAR AS c, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT doc, list({{'c': c, 'v': v}} ORDER BY i) AS a, count(*) FILTER (i < 10) AS old FROM v GROUP BY doc HAVING count(*) FILTER (i >= 10) > 0),
w AS (SELECT doc, a, old, greatest(old - 5, 0) AS changed, a[greatest(old - 5, 0) + 1:old + 5] AS s FROM n),
m AS (SELECT doc, changed, list_transform({_reduce('s', "CASE WHEN list_cosine_similarity(o[-1].v, x[1].v) > 0.75 THEN o[:-2] || [{'c': o[-1].c || chr(10) || chr(10) || x[1].c, 'v': o[-1].v}] ELSE o || x END")} || coalesce(a[old + 6:], []), lambda y: y.c) AS p FROM w)
SELECT doc, changed + i - 1 AS chunk_no, p[i] AS content FROM (SELECT doc, changed, p, unnest(range(1, len(p) + 1)) AS i FROM m)""",
        "section_roles": f"SELECT page_id, {_ROLES} AS role FROM (SELECT page_id, lower({_HTML}) AS h FROM pages)",
        "paper_flag": f"SELECT doc_id, u <> '' AND strlen(u) <= 6000 AS is_paper FROM (SELECT doc_id, regexp_extract(lower(left(text, 6000)), '(?s)^.*?(?:{'|'.join(T.PAPER_WORDS)})') AS u FROM documents)",
        "html_to_text": f"SELECT page_id, {_HTML} AS text FROM pages",
        "context_window": "SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10) || '---' || chr(10)) AS context FROM conversations",
        "mock_rerank": f"""{_base()}, {_q(QUERIES)}, {_scored()}, h AS ({_top('sc', 20)}), qt(query_id, ws) AS (VALUES {', '.join(f"({q}::BIGINT, {list(dict.fromkeys(t.split()))})" for q, t in QUERIES.items())}),
n AS (SELECT query_id, doc_id, len(list_filter(ws, lambda w: contains(lower(text), w)))::DOUBLE / len(ws) AS score FROM h JOIN qt USING (query_id) JOIN documents USING (doc_id)) {_top('n', 8)}""",
        "semantic_merge": f"""WITH l AS (SELECT vec_id // 8 AS doc, list({{'c': vec_id::VARCHAR, 'v': embedding::DOUBLE[]}} ORDER BY vec_id) AS s FROM embeddings GROUP BY vec_id // 8),
r AS (SELECT doc, {_reduce('s', "CASE WHEN list_cosine_similarity(o[-1].v, x[1].v) > 0.75 THEN o[:-2] || [{'c': o[-1].c || chr(10) || chr(10) || x[1].c, 'v': o[-1].v}] ELSE o || x END")} AS s FROM l)
SELECT doc, i - 1 AS nth, s[i].c AS content FROM (SELECT doc, s, unnest(range(1, len(s) + 1)) AS i FROM r)""",
        "synonym_rewrite": r"""SELECT DISTINCT conv_id, turn, variant FROM (SELECT conv_id, turn, unnest([text, CASE WHEN contains(lower(text), 'and') THEN regexp_replace(text, '(?i)and', 'plus') END,
  CASE WHEN contains(lower(text), 'and') THEN regexp_replace(text, '(?i)and', 'with') END, CASE WHEN contains(lower(text), 'the') THEN regexp_replace(text, '(?i)the', 'ze') END]) AS variant FROM conversations) WHERE variant IS NOT NULL""",
        "doc_listing_page": """WITH f AS (SELECT doc_id, source || '-' || doc_id AS name, strlen(text) AS total_chars FROM documents WHERE lang = 'en' AND contains(lower(source || '-' || doc_id), 'src1'))
SELECT doc_id, name, total_chars, (SELECT count(*) FROM f) AS total FROM f ORDER BY total_chars DESC, doc_id LIMIT 20 OFFSET 20""",
        "upload_summary": "SELECT lang, count(*) AS files, count(*) FILTER (length(text) >= 500) AS succeeded, count(*) FILTER (length(text) < 500) AS failed FROM documents GROUP BY lang",
        "doc_checksum": "SELECT conv_id, sha256(string_agg(lpad(turn::VARCHAR, 3, '0') || text, '' ORDER BY turn)) AS checksum FROM conversations GROUP BY conv_id",
        "remove_document": _base() + " SELECT term, count(*) AS df FROM post WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY term",
        "eval_metrics": f"""{_batch_sql()}, h AS ({_top('sc', 3)}), g AS (SELECT query_id, rank, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM h),
e AS (SELECT query_id, coalesce(1e0 / min(rank) FILTER (good), 0) AS rr, coalesce(sum(1e0 / log2(rank + 1)) FILTER (good), 0) AS dcg, count(*) FILTER (good) AS k FROM g GROUP BY query_id),
i AS (SELECT k, sum(1e0 / log2(j + 1)) AS ideal FROM (SELECT k, unnest(range(1, k + 1)) AS j FROM (SELECT DISTINCT k FROM e)) GROUP BY k)
SELECT count(*) AS queries, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN k > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg_5,
  round(avg(k::DOUBLE / (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1)), 6) AS recall_10 FROM e LEFT JOIN i USING (k)""",
    }


_NAMES = (
    token_counts, doc_frequency, top_terms_50, postings_lookup, inverted_index_stats, bm25_topk, bm25_corpus_stats, bm25_trim15, bm25_filtered, bm25_time_range,
    bm25_boosted, bm25_batch_queries, cosine_topk, hybrid_rrf, hybrid_alpha_by_query_type, hybrid_dense_only_fallback, query_types, maxp_documents,
    search_all_kbs, coarse_to_fine, coarse_sections, section_hint, snippet_jaccard_pairs, dedup_marks, snippets, sentence_split, long_split_pack, merge_short,
    merge_fragments, overlap_chunks, chunk_documents, section_roles, paper_flag, paper_meta, html_to_text, context_window, mock_rerank, mock_embedding,
    semantic_merge, synonym_rewrite, doc_listing_page, upload_summary, doc_checksum, remove_document, append_document, eval_metrics,
    sectioned_chunks, store_search, store_documents, store_digests, append_boundary,
    hybrid_batch, listing_checksum, listing_changes, store_snapshot, store_preview, request_search, synonyms_both_ways,
    bm25_pruned, cosine_bounded, document_search, section_reading, rendered_context,
)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}
