"""Where intermediate tables go, and tables that are made once and read by many queries."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindle.sources.commits import CommitLog


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset one is made, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spindle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores is dealt over the cores; one of more files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder, for what is read several times."""
    path = f"{shared_dir(df.sparkSession)}/spindle-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_once(spark: SparkSession, source: str, name: str, make: Callable[[str], None]) -> str:
    """The folder of tables that make(folder) wrote from the files at source. A commit in the shared folder says which files it was made from, by name, size and time: while
    they are the same, other sessions read it too; else, or when the folder is gone, it is made again. Of two that make it at once, both have made their own and
    the later commit is read from then on."""

    def place(name: str) -> tuple:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    path, files = place(source)
    found = files.listStatus(path) if files.getFileStatus(path).isDirectory() else [files.getFileStatus(path)]
    state = sorted([s.getPath().getName(), s.getLen(), s.getModificationTime()] for s in found)
    log = CommitLog(spark, f"{shared_dir(spark)}/spindle-made/{hashlib.sha256(f'{name} {path}'.encode()).hexdigest()[:24]}")
    _, made = log.read()
    if made.get("files") != state or not (held := place(made["at"]))[1].exists(held[0]):
        out = f"{shared_dir(spark)}/spindle-{uuid.uuid4().hex}/{name}"
        make(out)
        log.update(lambda _, old: {"files": state, "at": out})
        return out
    return made["at"]
