"""Searches that find a text by any of its terms, however many others are more frequent in it."""

import duckdb
import pytest

from compare import rows
from spindle.plans import registry
from spindle.sources.segments import Store

NAMES = ["bm25_batch_queries", "hybrid_alpha_by_query_type", "search_all_kbs", "store_search", "document_search", "request_search"]


@pytest.mark.parametrize("name", NAMES)
def test_a_rare_term_finds_its_text(spark, tmp_path, name):
    """Sixty terms of document 20 are more frequent in it than those that are asked for."""
    often = " ".join(f"w{i:02d}" for i in range(60))
    texts = {10: "the and tion what is the idiot clown moron licensed zebra", 20: f"{often} {often} the and tion what is idiot clown moron zebra", 30: "nothing of that"}
    spark.createDataFrame([(i, t, "en", "src1") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a zebra")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [1.0, float(i)]) for i in (7, 11, 20)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = getattr(registry, name)(spark, str(tmp_path)).toPandas()
    assert {10, 20} <= set(got["doc_id"])
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(registry.oracle_sql()[name]).fetchdf())


def test_a_store_keeps_to_the_terms_that_it_began_with(spark, tmp_path):
    many = " ".join(f"w{i:02d}" for i in range(60))
    docs = lambda *ids: spark.createDataFrame([(i, many) for i in ids], "doc_id long, text string")
    for terms, want in ((0, 60), (50, 50)):
        path = str(tmp_path / f"store{terms}")
        Store(spark, path, terms=terms).ingest(docs(1))
        held = Store(spark, path, terms=7)
        held.ingest(docs(2))
        held.append(spark.createDataFrame([(1, many)], "doc_id long, text string"))
        # chunk 1 of document 1 is what was appended
        assert sorted(r["count"] for r in held.table("postings").groupBy("doc_id", "chunk_no").count().collect()) == [want] * 3
        assert not held.verify()
