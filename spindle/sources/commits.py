"""A log of commits: each version of a small state is one JSON file, which is put only where no other writer has put it."""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """A commit rests on a state that others have changed meanwhile."""


class CommitLog:
    """Versions 1, 2, ... below path, on any file system that Spark reaches. A file is written under a name of its own and then renamed to that of its
    version, which fails where there is one: of two writers one wins, and the other sees it. Readers may keep to a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str = ""):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(conf)

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        path, files = self._place()
        if not files.exists(path):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> tuple[int, dict]:
        version = self.latest() if version is None else version
        if not version:
            return 0, {}
        path, files = self._place(f"v{version:08d}.json")
        stream = files.open(path)
        try:
            return version, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, version: int, state: dict) -> bool:
        """False if the version is there already."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        own, files = self._place(f"_{uuid.uuid4().hex}")
        stream = files.create(own)
        stream.write(json.dumps(state, sort_keys=True).encode())
        stream.close()
        goal, _ = self._place(f"v{version:08d}.json")
        never = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), conf).rename(own, goal, never)
        except Py4JJavaError as refused:
            files.delete(own, False)
            if "FileAlreadyExists" in refused.java_exception.getClass().getName():
                return False
            raise
        return True

    def update(self, change: Callable[[int, dict], dict], attempts: int = 50) -> int:
        """Commits change(new version, newest state); where another writer was first, once more on what it has put. The version."""
        for _ in range(attempts):
            version, state = self.read()
            if self.put(version + 1, change(version + 1, copy.deepcopy(state))):
                return version + 1
        raise Conflict("other writers were always first")


class Collections:
    """Named collections and their descriptions; creating, describing and deleting commit to one log."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = CommitLog(spark, f"{path}/_collections")
        self.spark, self.path = spark, path

    def _change(self, name: str, description: str | None, there: bool) -> int:
        def change(_: int, state: dict) -> dict:
            held = state.setdefault("collections", {})
            if (name in held) != there:
                raise KeyError(f"no collection {name}" if there else f"there is a collection {name}")
            if description is None:
                del held[name]
            else:
                held[name] = description
            return state

        return self.log.update(change)

    def create(self, name: str, description: str = "") -> int:
        return self._change(name, description, False)

    def describe(self, name: str, description: str) -> int:
        return self._change(name, description, True)

    def delete(self, name: str) -> int:
        """The name goes; what versions of it others read stays in its folder."""
        return self._change(name, None, True)

    def table(self, version: int | None = None):
        """(kb, description) of a version."""
        rows = sorted(self.log.read(version)[1].get("collections", {}).items())
        return self.spark.createDataFrame(rows, "kb string, description string")
