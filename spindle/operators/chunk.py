"""Chunking as folds over a document's array: paragraphs, short merges, sentence packing, fragments, overlap, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.text import SENTENCE_END, is_heading, once, section_role, stripped, trimmed_sentences

SHORT, LONG, FRAGMENT, OVERLAP = 200, 2000, 60, 200
_last = lambda a: F.element_at(a, -1)


def _fold(items: Column, merge) -> Column:
    """Folds an array: merge(out, x) gives the new out; the first element starts it."""
    start = F.slice(items, 1, 1)
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    return F.aggregate(rest, start, merge)


def _runs(items: Column, joins, join) -> Column:
    """Neighbours in an array joined to runs: join(last, x) gives the longer run where joins(last, x). The run that is open stands
    apart from those that are closed, so the array is copied once a run and not once an element."""
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    start = F.struct(F.slice(items, 1, 0).alias("closed"), F.try_element_at(items, F.lit(1)).alias("last"))

    def add(s, x):
        grown = F.struct(s["closed"].alias("closed"), join(s["last"], x).alias("last"))
        return F.when(joins(s["last"], x), grown).otherwise(F.struct(F.concat(s["closed"], F.array(s["last"])).alias("closed"), x.alias("last")))

    runs = F.aggregate(rest, start, add, lambda s: F.concat(s["closed"], F.array(s["last"])))
    return F.when(F.size(items) == 0, items).otherwise(runs)


def packed(text: Column, limit: int = LONG) -> Column:
    """Sentences packed greedily to pieces of at most limit characters, the last joining blank not counted; text of one sentence stays as it is."""

    def pack(parts):
        # only lengths are folded: where pieces begin, and the length of the open one; each piece is joined once
        def add(s, x):
            fits = s["size"] + x <= limit
            longer = F.struct((s["nth"] + 1).alias("nth"), s["starts"].alias("starts"), (s["size"] + x + 1).alias("size"))
            return F.when((s["nth"] > 1) & fits, longer).otherwise(F.struct((s["nth"] + 1).alias("nth"), F.concat(s["starts"], F.array(s["nth"])).alias("starts"), x.alias("size")))

        start = F.struct(F.lit(1).alias("nth"), F.slice(F.array(F.lit(1)), 1, 0).alias("starts"), F.lit(0).alias("size"))
        begun = F.aggregate(F.transform(parts, F.char_length), start, add, lambda s: F.concat(s["starts"], F.array(s["nth"])))
        piece = lambda starts: F.transform(
            F.slice(starts, F.lit(1), F.size(starts) - 1), lambda at, i: F.array_join(F.slice(parts, at, F.element_at(starts, i + 2) - at), " "))
        return F.when(F.size(parts) <= 1, F.array(text)).otherwise(F.element_at(F.transform(F.array(begun), piece), 1))

    # within transform the sentences have a name, so they are split once
    return F.element_at(F.transform(F.array(trimmed_sentences(text)), pack), 1)


def merged_short(items: Column, limit: int) -> Column:
    """Contents shorter than limit are joined to the one before by a blank line; the first stays. items: array of strings."""
    return _runs(items, lambda last, x: F.char_length(x) < limit, lambda last, x: F.concat_ws("\n\n", last, x))


def _tail(before: Column, size: int) -> Column:
    """The last size characters, from after the first sentence end in them; all of a text that is no longer."""
    tail = F.substr(before, F.greatest(F.char_length(before) - (size - 1), F.lit(1)))
    at = F.regexp_instr(tail, F.lit(SENTENCE_END))
    return F.when(F.char_length(before) <= size, before).otherwise(F.when(at > 0, F.substr(tail, at + 1)).otherwise(tail))


def overlapped(items: Column, size: int = OVERLAP) -> Column:
    """Each content gets the tail of the one before it, which already has its own."""
    def add(out, s):
        tail = _tail(_last(out), size)
        return F.concat(out, F.array(F.when(tail != "", F.concat(tail, F.lit("\n\n"), s)).otherwise(s)))

    return _fold(items, add)


def paragraphs(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, nth, content, section, offset): blank-line paragraphs, the nearest heading line at or before their start (as of it; "" before the first), and byte
    offsets in the text with LF line ends. Lines are exploded once and sorted once by document; offsets and headings are running values over that
    order, so a document of many headings takes time in proportion to its lines."""
    body = once(docs.select(*key, text), F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")).alias("_all"))
    # a text that begins and ends with more than white space and has no empty line is one paragraph: it goes as it is, as one row
    single = ~F.col("_all").contains("\n\n") & ~F.col("_all").rlike(r"(?U)^\s|\s\z")
    lines = body.select(*key, F.posexplode(F.when(single, F.array("_all")).otherwise(F.split("_all", "\n"))).alias("i", "line"))
    lines = once(lines, stripped(F.substring_index("line", "\n", 1)).alias("bare"))
    so_far = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumns({
        "gap": F.count_if(F.col("line") == "").over(so_far),
        "start": F.sum(F.octet_length("line") + 1).over(so_far) - F.octet_length("line") - 1,
        "section": F.last(F.when(is_heading(F.col("bare")), F.col("bare")), ignorenulls=True).over(so_far),
    }).where("line <> ''")
    lead = F.octet_length(F.regexp_extract("line", r"(?U)^\s*", 0))
    written = F.when(F.col("bare") != "", F.col("i"))
    grouped = placed.groupBy(*key, "gap").agg(
        F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"),
        F.min_by(F.struct((F.col("start") + lead).alias("offset"), F.coalesce("section", F.lit("")).alias("section")), written).alias("first"),
    )
    content = stripped(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return grouped.where("first IS NOT NULL").select(*key, F.col("gap").alias("nth"), content.alias("content"), "first.section", "first.offset")


def _joined(rows: DataFrame, key: list[str], order: list[str], limit: int) -> DataFrame:
    """(key, nth, content, section, offset): contents shorter than limit are joined to the one before by a blank line; the first stays. A run's number is
    the count of contents that begin one, so no row is folded."""
    of = Window.partitionBy(*key).orderBy(*order)
    begins = (F.row_number().over(of) == 1) | (F.char_length("content") >= limit)
    runs = rows.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    parts = runs.groupBy(*key, "run").agg(F.array_sort(F.collect_list(F.struct(*order, "content"))).alias("parts"), F.min_by(F.struct("section", "offset"), at).alias("first"))
    return parts.select(*key, F.col("run").alias("nth"), F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n").alias("content"), "first.section", "first.offset")


def numbered(no: Column) -> Column:
    """A chunk's id: its number with three digits, more where it needs them."""
    return F.when(no < 1000, F.lpad(no.cast("string"), 3, "0")).otherwise(no.cast("string"))


def chunks(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, chunk_no, chunk_id, content, section, section_role, offset). Lines of a document are dealt by its key, once; all further steps (running
    values, runs, groups) stay in that partitioning. Key columns are never null."""
    body = once(docs.select(*key, text), stripped(F.col(text)).alias("_body")).where("_body <> ''").select(*key, F.col("_body").alias("text"))
    merged = _joined(paragraphs(body, key), key, ["nth"], SHORT)
    pieces = F.when(F.char_length("content") > LONG, packed(F.col("content"))).otherwise(F.array("content"))
    split = merged.select(*key, "nth", "section", "offset", F.posexplode(pieces).alias("part", "content"))
    parts = _joined(split, key, ["nth", "part"], FRAGMENT)
    rows = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "content", "section", "offset"))).alias("parts"))
    # overlap: each content begins with the tail of the one before, which has its own; only texts are folded
    rows = once(rows, overlapped(F.transform("parts", lambda x: x["content"])).alias("contents"))
    out = rows.select(*key, F.posexplode(F.arrays_zip("parts", "contents")).alias("chunk_no", "c"))
    return out.select(*key, "chunk_no", numbered(F.col("chunk_no")).alias("chunk_id"), F.col("c.contents").alias("content"), "c.parts.section", section_role("c.parts.section").alias("section_role"), "c.parts.offset")


def sections(chunked: DataFrame, key: list[str]) -> DataFrame:
    """(key, section, section_no, section_id, offset, content): chunks with equal headings joined in order; numbered by first appearance."""
    grouped = chunked.groupBy(*key, "section").agg(
        F.min("chunk_no").alias("first_no"), F.min_by("offset", "chunk_no").alias("offset"), F.array_sort(F.collect_list(F.struct("chunk_no", "content"))).alias("c")
    )
    no = F.row_number().over(Window.partitionBy(*key).orderBy("first_no")) - 1
    out = grouped.withColumn("section_no", no)
    text = F.array_join(F.transform("c", lambda x: x["content"]), "\n\n")
    return out.select(*key, "section", "section_no", F.concat(F.lit("S"), F.lpad(F.col("section_no").cast("string"), 2, "0")).alias("section_id"), "offset", text.alias("content"))


def appended(chunked: DataFrame, new_docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Chunks with those of further text added behind: numbers go on from each document's last. chunked: a stored table, which is read twice."""
    last = chunked.groupBy(*key).agg((F.max("chunk_no") + 1).alias("base"))
    more = chunks(new_docs, key, text).join(last, key, "left").withColumn("chunk_no", F.col("chunk_no") + F.coalesce("base", F.lit(0))).drop("base")
    return chunked.unionByName(more.withColumn("chunk_id", numbered(F.col("chunk_no"))))


def boundary_merged(old: DataFrame, new: DataFrame, key: list[str], width: int = 5, threshold: float = 0.75) -> DataFrame:
    """(key, chunk_no, was, content, changed): what an append does to stored chunks. old, new: (key, chunk_no, content, vector), each numbered from 0. The last
    `width` old and the first `width` new chunks of a document are joined where neighbours are alike (see `semantic_merge`); the rest of the new ones follow. Only rows from
    the first changed number on come back, so the old rows from there are replaced: changed is the number from which on. A document without old chunks keeps its
    new ones as they are; one without new chunks has no rows. was: the number of a row's first part, counted on from the old ones."""
    ends = new.select(*key).distinct().join(old.groupBy(*key).agg((F.max("chunk_no") + 1).alias("size")), key, "left")
    ends = ends.select(*key, F.greatest(F.coalesce("size", F.lit(0)) - width, F.lit(0)).alias("changed"), F.coalesce("size", F.lit(0)).alias("size"))
    tail = old.join(ends, key).where("chunk_no >= changed").select(*key, "changed", "size", "chunk_no", "content", "vector")
    head = new.join(ends, key).select(*key, "changed", "size", (F.col("chunk_no") + F.col("size")).alias("chunk_no"), "content", "vector")
    inside = (F.col("size") > 0) & (F.col("chunk_no") < F.col("size") + width)
    both = tail.unionByName(head)
    merged = semantic_merge(both.where(inside), [*key, "changed", "size"], "chunk_no", "content", "vector", threshold)
    counts = merged.groupBy(*key).agg(F.count(F.lit(1)).alias("merged"))
    rest = head.where(~inside).join(counts, key, "left")
    # of the bounded window, so many rows are left; what follows it moves up
    moved = F.when(F.col("size") > 0, F.col("chunk_no") - (F.col("size") + width) + F.col("changed") + F.coalesce("merged", F.lit(0))).otherwise(F.col("chunk_no"))
    out = merged.select(*key, (F.col("changed") + F.col("nth")).alias("chunk_no"), F.col("first").alias("was"), "content", "changed")
    return out.unionByName(rest.select(*key, moved.alias("chunk_no"), F.col("chunk_no").alias("was"), "content", "changed"))


def semantic_merge(rows: DataFrame, key: list[str], order: str, content: str = "content", vector: str = "vector", threshold: float = 0.75) -> DataFrame:
    """(key, nth, first, content): neighbours are joined while their vector is closer than threshold to that of the chunk that began the run; first: its order.
    key: a document, whose chunks are folded in one row."""
    from spindle.functions.score import cosine

    item = F.struct(F.col(order).alias("o"), F.col(content).alias("content"), F.col(vector).alias("vector"))
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("p"))

    near = lambda last, x: cosine(last["vector"], x["vector"]) > threshold
    join = lambda last, x: F.struct(last["o"].alias("o"), F.concat_ws("\n\n", last["content"], x["content"]).alias("content"), last["vector"].alias("vector"))
    return lists.select(*key, F.posexplode(_runs(F.col("p"), near, join)).alias("nth", "c")).select(*key, "nth", F.col("c.o").alias("first"), "c.content")
