"""A collection's tables (documents, chunks, sections, postings, entries) as immutable segments under one commit log.

What is ingested, appended or removed is written to new folders, and one commit makes all of it visible at once: a job that dies before it leaves the last version as it
was. A removal is a row that hides a document's rows (or its chunks from a number on) in all older segments. `merge` writes several segments of
a size as one without hidden rows. Readers keep to the version that they began with; folders are never changed. Each folder's rows are counted and digested while they are
written; `verify` reads them again, and `repair` makes damaged ones again from the chunks of their segment."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindle.functions.text import looks_like_paper
from spindle.operators import chunk, models
from spindle.operators import index as ix
from spindle.operators.request import Catalog
from spindle.sources.commits import CommitLog, Conflict

#: Made from chunks alone.
DERIVED = ("sections", "postings", "entries", "section_postings", "section_entries")
MERGE = 4


def row_digest(columns: list[str]) -> Column:
    """A number from the SHA-256 of a row: of each column `-` if null, else its size, a colon and its text."""
    shown = [F.col(f"`{c}`").cast("string") for c in columns]
    text = F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def digest(columns: list[str]) -> list[Column]:
    """rows and digest of a table: independent of the rows' order and of files."""
    number = row_digest(sorted(columns))
    # sums of 30 bits each stay within a long, and are cheaper than sums of decimals
    high, low = (F.coalesce(F.sum(x), F.lit(0)).cast("decimal(28,0)") for x in (F.shiftright(number, 30), number.bitwiseAND(F.lit((1 << 30) - 1))))
    return [F.count(F.lit(1)).alias("rows"), (high * F.lit(1 << 30).cast("decimal(10,0)") + low).cast("decimal(38,0)").cast("string").alias("digest")]


@dataclass(frozen=True)
class Store:
    """key: columns of a document's name, never null. terms: most frequent terms of a chunk that a new store indexes, all if 0; a store that has commits keeps to what it began with."""

    spark: SparkSession
    path: str
    key: tuple[str, ...] = ("doc_id",)
    terms: int = ix.TOP_TERMS

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/_versions")

    # reading

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a version that nothing hides."""
        return self._live(name, self.log.read(version)[1])

    def _live(self, name: str, state: dict, segments: list[dict] | None = None) -> DataFrame:
        held = [s for s in (state.get("segments", []) if segments is None else segments) if name in s["tables"]]
        if not held:
            if name not in state.get("schemas", {}):
                raise ValueError(f"the store has no table {name} yet")
            return self.spark.createDataFrame([], StructType.fromJson(state["schemas"][name]))
        schema = StructType.fromJson(state["schemas"][name])
        rows = self._read(name, {s["tables"][name]["at"]: s["seq"] for s in held}, schema)
        oldest = min(s["seq"] for s in held)
        if dead := {r["at"]: r["seq"] for r in state.get("removed", []) if r["seq"] > oldest}:
            hidden = self._read("removed", dead, self._removed_schema(state)).withColumnsRenamed({"_seq": "_hidden", **{k: f"_{k}" for k in self.key}})
            on = F.col("_seq") < F.col("_hidden")
            for k in self.key:
                on = on & (F.col(k) == F.col(f"_{k}"))
            if "chunk_no" in schema.names:
                on = on & (F.col("chunk_no") >= F.col("_from"))
            rows = rows.join(hidden, on, "left_anti")
        return rows.drop("_seq")

    def _read(self, name: str, seqs: dict[str, int], schema: StructType) -> DataFrame:
        """Folders of a table, with the number of the commit that each came with."""
        numbers = F.create_map(*[F.lit(x) for pair in seqs.items() for x in pair])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/segment={at}" for at in seqs])
        at = F.regexp_extract("_metadata.file_path", r"segment=([^/]+)/", 1)
        return rows.withColumn("_seq", F.element_at(numbers, at)).select(*schema.names, "_seq")

    def _removed_schema(self, state: dict) -> StructType:
        return StructType.fromJson(state["schemas"]["removed"])

    def catalog(self, version: int | None = None) -> Catalog:
        """What `request.search` reads."""
        found = {n: self.table(n, version) for n in ("postings", "entries", "documents", "chunks", "sections", "section_postings", "section_entries")}
        return Catalog(found["postings"], found["entries"], found["documents"], found["chunks"], found["sections"].withColumnRenamed("content", "text"), None, (found["section_postings"], found["section_entries"]))

    # writing

    def _write(self, name: str, rows: DataFrame, at: str) -> dict:
        seen = Observation()
        rows.observe(seen, *digest(rows.columns)).write.parquet(f"{self.path}/{name}/segment={at}")
        return {"at": at, **seen.get, "schema": rows.schema.jsonValue()}

    def _again(self, name: str, written: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(written["schema"])).parquet(f"{self.path}/{name}/segment={written['at']}")

    def _staged(self, name: str, rows: DataFrame, at: str) -> DataFrame:
        """rows by way of a folder that goes when the writer has committed."""
        path = f"{self.path}/_staging/{at}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _derived(self, chunks: DataFrame, at: str, names: tuple[str, ...] = DERIVED) -> dict:
        """Sections and both indexes of chunks, which are read from files."""
        key, out, n = list(self.key), {}, self._terms(self.log.read()[1])
        for name, rows, own, text in (("", None, [*key, "chunk_no"], "content"), ("section_", "sections", [*key, "section"], "content")):
            if rows and "sections" in names:
                out["sections"] = self._write("sections", chunk.sections(chunks, key), at)
            if not {f"{name}postings", f"{name}entries"} & set(names):
                continue
            source = chunks if not rows else self._again("sections", out["sections"]) if "sections" in out else chunk.sections(chunks, key)
            beside = [] if rows else ["section", "section_role"]
            top = self._staged(f"{name}counted", ix.counted(source, [*own, *beside], text, n), at)
            if f"{name}postings" in names:
                out[f"{name}postings"] = self._write(f"{name}postings", ix.by_term(top.select(*own, F.inline("top"))), at)
            if f"{name}entries" in names:
                out[f"{name}entries"] = self._write(f"{name}entries", top.drop("top"), at)
        return out

    def _terms(self, state: dict) -> int:
        return state.get("terms", ix.TOP_TERMS if state else self.terms)

    def _publish(self, tables: dict, hidden: DataFrame, staging: str) -> int:
        """One commit of a segment. hidden (key, _from): whose older rows it hides, looked up again if another writer was first."""
        while True:
            version, state = self.log.read()
            for name, t in tables.items():
                own, there = ([(f["name"].lower(), str(f["type"])) for f in x["fields"]] for x in (t["schema"], state.get("schemas", {}).get(name, t["schema"])))
                if own != there:
                    raise ValueError(f"the columns of {name} are {there}, not {own}")
            new = version + 1
            state["terms"] = self._terms(state)
            if state.get("segments"):
                there = self._live("documents", state).select(*self.key)
                at = uuid.uuid4().hex
                gone = self._write("removed", hidden.join(there, list(self.key), "left_semi"), at)
                state.setdefault("schemas", {})["removed"] = gone["schema"]
                if gone["rows"]:
                    state.setdefault("removed", []).append({"at": at, "seq": new})
            if tables:
                state.setdefault("schemas", {}).update({n: t["schema"] for n, t in tables.items() if n not in state.get("schemas", {})})
                state.setdefault("segments", []).append({"seq": new, "tables": {n: {k: v for k, v in t.items() if k != "schema"} for n, t in tables.items()}})
            if self.log.put(new, state):
                self._clear(staging)
                return new

    def _clear(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_staging/{at}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def ingest(self, docs: DataFrame, text: str = "text") -> int:
        """Documents (key, text, other columns as they are) with their chunks, sections and indexes, in one commit; those that are there are replaced. Rows with an `error`
        are kept in the table `failed`. docs is computed once. A null or blank text has no chunks. The version."""
        at, key = uuid.uuid4().hex, list(self.key)
        docs, tables = self._staged("parsed", docs, at), {}
        if "error" in docs.columns:
            tables["failed"] = self._write("failed", docs.where("error IS NOT NULL").drop(text), at)
            docs = docs.where("error IS NULL").drop("error")
        tables["chunks"] = self._write("chunks", chunk.chunks(docs, key, text), at)
        chunks = self._again("chunks", tables["chunks"])
        tables |= self._derived(chunks, at)
        counts = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("chunk_count"))
        meta = docs.withColumns({"total_chars": F.coalesce(F.octet_length(text), F.lit(0)), "is_paper": F.coalesce(looks_like_paper(text), F.lit(False))}).drop(text)
        tables["documents"] = self._write("documents", meta.join(counts, key, "left").fillna(0, ["chunk_count"]), at)
        return self._publish(tables, self._again("documents", tables["documents"]).select(*key, F.lit(0).alias("_from")), at)

    def remove(self, keys: DataFrame) -> int:
        """Documents named by keys are hidden from here on."""
        return self._publish({}, keys.select(*self.key).distinct().withColumn("_from", F.lit(0)), uuid.uuid4().hex)

    def append(self, texts: DataFrame, embedder: models.Embedder | None = None, text: str = "text", width: int = 5, threshold: float = 0.75) -> int:
        """Further text (key, text; one row a document) behind stored documents. With an embedder the last `width` old and first `width` new chunks are joined where they
        are alike: only those are embedded. Chunks from the first changed one on are written and indexed; older ones stay where they are. A document that
        isn't there is an error."""
        key, at = list(self.key), uuid.uuid4().hex
        documents = self.table("documents")
        if not texts.join(documents, key, "left_anti").isEmpty():
            raise KeyError("text for a document that the store doesn't have")
        if not embedder:
            width = 0
        new = self._staged("new", chunk.chunks(texts, key, text), at)
        sizes = documents.join(texts.select(*key), key, "left_semi").select(*key, F.col("chunk_count").alias("_size"), F.col("total_chars").alias("_chars"))
        tail = self.table("chunks").join(sizes, key).where(F.col("chunk_no") >= F.col("_size") - max(width, 1)).drop("_size", "_chars")
        tail = self._staged("tail", tail, at)
        vectors = lambda df: models.embedded(df, embedder) if embedder else df.withColumn("vector", F.lit(None).cast("array<double>"))
        fields = [*key, "chunk_no", "content"]
        head = new.where(F.col("chunk_no") < width)
        both = vectors(head.select(*fields)).unionByName(new.where(F.col("chunk_no") >= width).select(*fields).withColumn("vector", F.lit(None).cast("array<double>")))
        merged = chunk.boundary_merged(vectors(tail.select(*fields)), both, key, width, threshold)
        beside = ["section", "section_role", "offset"]
        moved = new.join(sizes, key).select(*key, (F.col("chunk_no") + F.col("_size")).alias("was"), "section", "section_role", (F.col("offset") + F.col("_chars")).alias("offset"))
        named = tail.select(*key, F.col("chunk_no").alias("was"), *beside).unionByName(moved)
        out = merged.join(named, [*key, "was"]).withColumn("chunk_id", chunk.numbered(F.col("chunk_no")))
        kept = self._staged("merged", out, at)
        schema = StructType.fromJson(self.log.read()[1]["schemas"]["chunks"])
        tables = {"chunks": self._write("chunks", kept.select(*[F.col(f.name).cast(f.dataType) for f in schema]), at)}
        chunks = self._again("chunks", tables["chunks"])
        tables |= self._derived(chunks, at, ("postings", "entries"))
        changed = kept.groupBy(*key).agg(F.min("changed").alias("_from"))
        whole = self._staged("whole", self.table("chunks").join(changed, key).where("chunk_no < _from").drop("_from").unionByName(chunks), at)
        tables |= self._derived(whole, at, ("sections", "section_postings", "section_entries"))
        counts = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("_count"))
        longer = texts.select(*key, F.octet_length(text).alias("_more")).join(counts, key)
        meta = documents.join(longer, key).withColumns({"total_chars": F.col("total_chars") + F.col("_more"), "chunk_count": F.col("_count")}).select(*documents.columns)
        tables["documents"] = self._write("documents", meta, at)
        return self._publish(tables, changed, at)

    # upkeep

    def merge(self, factor: int = MERGE) -> int | None:
        """Writes the segments of the smallest size (powers of factor, by their rows) of which there are at least factor as one, without hidden rows. The version, or None if there
        is nothing to merge. Where others have committed meanwhile, the merge is dropped (Conflict): their removals could hide rows of it."""
        version, state = self.log.read()
        tiers: dict[int, list] = {}
        for s in state.get("segments", []):
            tiers.setdefault(int(math.log(sum(t["rows"] for t in s["tables"].values()) + 1, factor)), []).append(s)
        small = next((s for _, s in sorted(tiers.items()) if len(s) >= factor), None)
        if small is None:
            return None
        at, tables = uuid.uuid4().hex, {}
        for name in sorted({n for s in small for n in s["tables"]}):
            rows = self._live(name, state, small)
            tables[name] = self._write(name, ix.by_term(rows) if name.endswith("postings") else rows, at)
        chosen = {s["seq"] for s in small}
        state["segments"] = [s for s in state["segments"] if s["seq"] not in chosen]
        state["segments"].append({"seq": version + 1, "tables": {n: {k: v for k, v in t.items() if k != "schema"} for n, t in tables.items()}})
        oldest = min(s["seq"] for s in state["segments"])
        state["removed"] = [r for r in state.get("removed", []) if r["seq"] > oldest]
        if not self.log.put(version + 1, state):
            raise Conflict("another writer was first")
        return version + 1

    def digests(self, version: int | None = None) -> DataFrame:
        """(segment, table_name, rows, digest) as they were written."""
        state = self.log.read(version)[1]
        rows = [(s["seq"], n, t["rows"], t["digest"]) for s in state.get("segments", []) for n, t in sorted(s["tables"].items())]
        return self.spark.createDataFrame(rows, "segment long, table_name string, rows long, digest string")

    def verify(self, version: int | None = None) -> list[tuple[int, str]]:
        """(segment, table) of the folders whose rows can't be read or are not those that were written."""
        state, bad = self.log.read(version)[1], []
        for s in state.get("segments", []):
            for name, t in sorted(s["tables"].items()):
                schema = StructType.fromJson(state["schemas"][name])
                rows = self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(f"{self.path}/{name}/segment={t['at']}")
                try:
                    found = rows.agg(*digest(schema.names)).first()
                except (PySparkException, Py4JJavaError):  # a file that can't be decoded
                    found = None
                if found is None or (found["rows"], found["digest"]) != (t["rows"], t["digest"]):
                    bad.append((s["seq"], name))
        return bad

    def repair(self) -> int | None:
        """Damaged sections and indexes are made again, each from the chunks of its segment; the version, or None if nothing is damaged. Documents and chunks can't be made
        again: that is an error."""
        bad = self.verify()
        if lost := [x for x in bad if x[1] not in DERIVED]:
            raise ValueError(f"not to be made again: {lost}")
        if not bad:
            return None
        made = {}
        before = self.log.read()[1]
        for seq in sorted({s for s, _ in bad}):
            source = next(s for s in before["segments"] if s["seq"] == seq)["tables"]
            at = uuid.uuid4().hex
            chunks = self._again("chunks", {"at": source["chunks"]["at"], "schema": before["schemas"]["chunks"]})
            names = tuple(n for s, n in bad if s == seq)
            # sections of documents that an append has changed rest on all their chunks
            if any(n.startswith("section") for n in names):
                docs = self._again("documents", {"at": source["documents"]["at"], "schema": before["schemas"]["documents"]}).select(*self.key)
                older = [s for s in before["segments"] if s["seq"] <= seq]
                chunks_of = self._live("chunks", {**before, "removed": [r for r in before.get("removed", []) if r["seq"] <= seq]}, older).join(docs, list(self.key), "left_semi")
                made[seq] = self._derived(chunks_of, at, tuple(n for n in names if n.startswith("section")))
            made[seq] = made.get(seq, {}) | self._derived(chunks, at, tuple(n for n in names if not n.startswith("section")))

        def change(_: int, state: dict) -> dict:
            for s in state["segments"]:
                for name, t in made.get(s["seq"], {}).items():
                    s["tables"][name] = {k: v for k, v in t.items() if k != "schema"}
            return state

        return self.log.update(change)
