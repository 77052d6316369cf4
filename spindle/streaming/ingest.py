"""Ingest of arriving text as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spindle.operators.chunk import chunks
from spindle.operators.index import index


def ingest_stream(spark: SparkSession, source: str, schema: str, key: list[str], out: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Chunks and postings of Parquet documents that arrive in source, appended below out; ends when all present files are read."""
    docs = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        # a batch that is run again after a failure writes the same folder again
        chunks(df, key, text).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        postings, _ = index(spark.read.parquet(f"{out}/chunks/batch={number}"), [*key, "chunk_no"], "content")
        postings.write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
