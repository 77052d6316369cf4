"""Term index: counts, the top terms that are indexed, postings, and changes to them."""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from spindle.functions.text import token_line

TOP_TERMS = 50


_COUNTED = StructType().add("length", DoubleType()).add("top", ArrayType(StructType().add("term", StringType()).add("tf", LongType())))


@F.arrow_udf(_COUNTED)
def _counts(lines: pa.Array, most: pa.Array) -> pa.Array:
    """Of each line of tokens their number and the `most` most frequent terms, ties by term (code points, so as UTF-8 bytes); all in any order if that is 0."""
    lengths, offsets, terms, counts = [], [0], [], []
    for line, n in zip(lines.to_pylist(), most.to_pylist(), strict=True):
        found = Counter((line or "").split(" "))
        found.pop("", None)
        rows = list(found.items())
        if n:
            if len(rows) > n:  # only what can be among the n is sorted
                least = sorted(found.values(), reverse=True)[n - 1]
                rows = [x for x in rows if x[1] >= least]
            rows = sorted(sorted(rows), key=itemgetter(1), reverse=True)[:n]
        lengths.append(float(found.total()))
        for term, tf in rows:
            terms.append(term)
            counts.append(tf)
        offsets.append(len(terms))
    rows = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
    top = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(lengths, pa.float64()), top], ["length", "top"])


def term_counts(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, term, tf): how often a term is in each text. A row's tokens are counted within it, and nothing is shuffled; only where several rows have one key are counts summed."""
    rows = texts.select(*key, _counts(token_line(text), F.lit(0)).alias("c")).select(*key, F.inline("c.top"))
    repeated = texts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows if repeated.isEmpty() else rows.groupBy(*key, "term").agg(F.sum("tf").alias("tf"))


def lengths(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key, length): all tokens of a text, indexed or not."""
    return counts.groupBy(*key).agg(F.sum("tf").cast("double").alias("length"))


def top_terms(counts: DataFrame, key: list[str], n: int = TOP_TERMS) -> DataFrame:
    """The n most frequent terms of each text, ties by term. The window holds one text's terms only."""
    w = Window.partitionBy(*key).orderBy(F.desc("tf"), "term")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def document_frequency(counts: DataFrame, scope: list[str] = ()) -> DataFrame:
    """(scope, term, df): texts that have the term."""
    return counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))


def counted(texts: DataFrame, key: list[str], text: str = "text", n: int = TOP_TERMS) -> DataFrame:
    """(key, length, top): all tokens of a text, and its n most frequent terms (term, tf), ties by term, or all terms if n is 0. Tokens are counted within the row,
    so nothing is shuffled; texts without a token are left out."""
    rows = texts.select(*key, _counts(token_line(text), F.lit(n)).alias("c"))
    return rows.select(*key, "c.length", "c.top").where("length > 0")


def indexed(texts: DataFrame, key: list[str], text: str = "text", n: int = TOP_TERMS) -> DataFrame:
    """(key, term, tf, r, length): the n most frequent terms of each text by rank r, ties by term, with the text's length (all tokens, indexed
    or not)."""
    rows = counted(texts, key, text, n).select(*key, "length", F.posexplode("top").alias("r", "t"))
    return rows.select(*key, "t.term", "t.tf", (F.col("r") + 1).alias("r"), "length")


def index(texts: DataFrame, key: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings (key, term, tf) of top terms, and entries (key, length)."""
    rows = indexed(texts, key, text)
    return rows.drop("r", "length"), rows.where("r = 1").select(*key, "length")


def write_postings(postings: DataFrame, path: str, partition: list[str] = ()) -> None:
    """Postings sorted by term in each file, so that row-group statistics prune a term lookup."""
    by_term(postings, partition).write.mode("overwrite").partitionBy(*partition).parquet(path)


def by_term(postings: DataFrame, partition: list[str] = ()) -> DataFrame:
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartitionByRange(n, *partition, "term").sortWithinPartitions(*partition, "term")


def write_index(texts: DataFrame, key: list[str], path: str, text: str = "text", n: int = TOP_TERMS) -> None:
    """Postings of each text's n most frequent terms (all, if n is 0) and entries below path. Searches read them instead of the texts. Only postings are shuffled."""
    counted(texts, key, text, n).write.mode("overwrite").parquet(f"{path}/counted")
    rows = texts.sparkSession.read.parquet(f"{path}/counted")
    write_postings(rows.select(*key, F.inline("top")), f"{path}/postings")
    rows.drop("top").write.mode("overwrite").parquet(f"{path}/entries")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/entries")


def without_documents(rows: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """Rows of documents that are not removed; applied to chunks, sections and postings alike."""
    return rows.join(removed.select(*key).distinct(), key, "left_anti")


def replaced(postings: DataFrame, updated: DataFrame, key: list[str]) -> DataFrame:
    """Postings in which the documents of `updated` have their new rows."""
    return without_documents(postings, updated, key).unionByName(updated)


def statistics(postings: DataFrame, doc: str) -> DataFrame:
    """One row: terms, postings and documents of an index."""
    return postings.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.countDistinct(doc).alias("documents"))
