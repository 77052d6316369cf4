"""What several operators share: tables, scratch folders, fresh column names."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.sources.store import shared_dir, spread

#: The characters that end a word in the contracts `[^\x20\x09-\x0D]+`; bytes.split() splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


#: While a table is written: shuffle files go as soon as a write has ended, instead of when the driver collects its garbage; and Arrow batches, which both
#: sides of a Python worker hold, are small, since rows can be wide (texts, sets).
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


@contextlib.contextmanager
def held(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what runs inside."""
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_freed(spark: SparkSession) -> contextlib.AbstractContextManager:
    return held(spark, WRITING)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later stages read it instead of computing it again,
    and a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindle-{uuid.uuid4().hex}/{name}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing still to run reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name a column name that df doesn't use (Spark ignores case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def require(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def utf8_length(text: Column) -> Column:
    """Bytes of the text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: CTEs for DuckDB, which has no crc32: crcs (s, crc) of the texts s (ASCII) that `of` selects.
CRC32_SQL = """
crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
crcs AS (
  SELECT s, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::UBIGINT)),
    lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255::UBIGINT)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM ({of}), crc_table)"""
