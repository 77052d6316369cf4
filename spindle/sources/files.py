"""Files as documents, search logs and judgments."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions.text import html_to_text, slug

#: Extensions that a directory is searched for.
EXTENSIONS = ("md", "txt", "pdf", "docx", "odt", "epub", "html", "xlsx", "pptx")
LOG_SCHEMA = "query string, hit_count int, hit_ids array<string>, top_scores array<double>, judged_hits array<string>, timestamp timestamp, "
LOG_SCHEMA += "filter struct<doc: string, source_type: string, section: string, tags: array<string>, added_after: string, added_before: string>"
_PARTS = {"docx": r"word/document\.xml", "odt": r"content\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "epub": r".*\.x?html"}
_BLOCKS = ("p", "h", "h1", "h2", "h3", "h4", "h5", "h6", "li", "title")
_local = lambda node: node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _lines(node: ElementTree.Element) -> list[str]:
    """Text of the outermost blocks below a node, in order: a block within a block is part of its text."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if _local(at) in _BLOCKS:
            line = "".join(at.itertext()).strip()
            out += [line] if line else []
        else:
            stack.extend(reversed(at))
    return out


def _sheets(z: zipfile.ZipFile, number: Callable[[str], list]) -> list[str]:
    """A line for each row of a workbook's sheets, cells apart by tabs; a cell of type s names a shared string."""
    names, shared = z.namelist(), []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"]
    out = []
    for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
        for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r) == "row"):
            cells = []
            for c in (c for c in row if _local(c) == "c"):
                value = next((v.text or "" for v in c if _local(v) == "v"), "")
                inline = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else inline or value)
            line = "\t".join(cells).strip()
            out += [line] if line else []
    return out


def office_text(ext: str, content: bytes) -> str:
    """Text of a zipped document: its paragraphs, and a workbook's rows, each apart by a blank line. Parts of a book come in the order of its spine."""
    number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if ext == "xlsx":
            return "\n\n".join(_sheets(z, number))
        names = sorted((n for n in z.namelist() if re.fullmatch(_PARTS[ext], n)), key=number)
        if ext == "epub" and (package := next((n for n in z.namelist() if n.endswith(".opf")), None)):
            tree = list(ElementTree.fromstring(z.read(package)).iter())
            files = {i.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), i.get("href", ""))) for i in tree if _local(i) == "item"}
            spine = [files.get(i.get("idref")) for i in tree if _local(i) == "itemref"]
            names = [n for n in spine if n in names] + [n for n in names if n not in spine]
        return "\n\n".join(line for name in names for line in _lines(ElementTree.fromstring(z.read(name))))


def read_files(spark: SparkSession, path: str, recursive: bool = True, parser: Callable[[str, bytes], str] | None = None, stamp: str | None = None) -> DataFrame:
    """(path, original_name, ext, doc_slug, total_chars, text, error) of the supported files below path. total_chars counts bytes.

    Markdown, text and HTML are read by expressions; zipped office formats by a task; other formats, or all of those if given, by parser(name, content)."""
    # either case of each letter: the names of other files are never opened
    kinds = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*.{{{kinds}}}").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("original_name"), ext.alias("ext"), "content").where(F.col("ext").isin(*EXTENSIONS))

    @F.pandas_udf("text string, error string")
    def parse(names: pd.Series, exts: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for name, e, content in zip(names, exts, contents, strict=True):
            try:
                if content is None:
                    out.append((None, None))
                    continue
                text = parser(name, content) if parser else office_text(e, content)
                out.append((text.strip(), None) if text.strip() else (None, "no text; a scanned image?"))
            except Exception as ex:  # a file that can't be read is reported, not fatal
                out.append((None, str(ex) or type(ex).__name__))
        return pd.DataFrame(out, columns=["text", "error"])

    # a file with bytes that are no UTF-8 is reported like any other that can't be read
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    broken = F.when(F.col("ext").isin("md", "txt", "html") & F.col("content").isNotNull() & plain.isNull(), F.lit("not UTF-8"))
    direct = F.when(F.col("ext").isin("md", "txt"), plain).when(F.col("ext") == "html", html_to_text(plain))
    other = F.when(~F.col("ext").isin("md", "txt", "html"), F.col("content"))
    rows = files.withColumn("got", parse("original_name", "ext", other)).withColumn("text", F.coalesce(direct, F.col("got.text")))
    name = slug("original_name") if stamp is None else slug("original_name", F.lit(stamp))
    rows = rows.withColumn("error", F.coalesce("got.error", broken))
    return rows.select("path", "original_name", "ext", name.alias("doc_slug"), F.octet_length("text").alias("total_chars"), "text", "error")


def append_search_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_search_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant) from JSON files that map queries to chunk ids."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return maps.select(F.explode("m").alias("query", "relevant"))
