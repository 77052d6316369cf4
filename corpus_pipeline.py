"""Documents from raw to shards: five stages, each over all that the one before kept.

quality: documents that the quality rules reject go. near_duplicates: of each group linked by five-word shingles at a Jaccard
similarity of 0.8 or more the smallest id stays. decontaminate: passages of benchmark items are cut out, and documents
that are mostly such passages go. mix: the rest is ordered so that sources interleave by target weight; none are left out.
shard: each row gets its shard and slot; slots follow the order in which the mixture was written. All stages but the last return the
columns of documents.

Each stage: a null text has no words and goes with the base quality rule, as empty texts do; stages on their own keep null texts where their rule
does (near_duplicates, mix and shard keep all, decontaminate has nothing to cut). Long texts are read whole. Repeated rows:
near_duplicates keeps one, the other stages each. An empty table stays empty. Extra columns are kept, also those whose names a stage uses itself;
the last stage keeps a column that has the name of one of its own under `_name`."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import decontaminate as clean
from spindle.llm import jaccard_join, mixing, quality, sharding
from spindle.llm.common import fresh, shared_dir, table

#: run() holds what SQL can't express (binomial cutoffs, packing); tests compare stages with brute force.
ORACLE_SQL = None


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, list]:
    """docs with all columns but the needed ones under names that no stage uses, and the columns that bring its own names back."""
    names = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, back = shielded(docs, "doc_id", "lang", "text")
    return quality.judge(safe, table(spark, sf_dir, "labels")).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, back = shielded(docs, "doc_id", "source", "text")
    return mixing.in_order(mixing.mix(safe)).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that come from Parquet files take slots in the order of the files' numbers and of the rows in them; others by a hash of their ids."""
    block, place = fresh(docs, "file_number", "file_row")
    number = F.regexp_extract("_metadata.file_name", r"^part-([0-9]+)", 1).try_cast("long")
    try:
        placed = docs.select("*", F.coalesce(number, F.lit(0)).alias(block), F.struct("_metadata.file_name", "_metadata.row_index").alias(place))
    except AnalysisException:
        return sharding.shard(docs)  # not a table of files
    return sharding.shard(placed, order=(block, place))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
