r"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton of all items' word sequences is built once and sent to the tasks; each task streams the words of its
texts through it and follows the length of the longest suffix that occurs in some item. Where that length
reaches WINDOW words (or all words of a shorter item) the words are hit. Items are split into slices of
at most MAX_ITEM_WORDS words, some 100 MB in a task. One slice is the usual case; each further slice is a pass of its own, with
its automaton alone in memory, that writes the hits of the texts that have some, and these are joined by text.

Nulls and ties: a null or empty text has no words and no hits; a null item, or one without words, has no windows.
Items that repeat an id or a text count by distinct id. A null item_id is never listed, its windows hit. Repeated documents
keep their rows. An empty table of items leaves all texts as they are. Extra columns are kept by `decontaminated`;
clashing names are kept under `_name`.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, require, table, written

WINDOW, MAX_ITEM_WORDS = 10, 500_000
#: ASCII bytes outside words become blanks and A-Z lower case; bytes from 0x80 on belong to words.
_FOLD = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))
_SPAN = re.compile(rb"[^ ]+")


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def words(text: str | None) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased."""
    return folded(text).split()


class Automaton:
    """Generalised suffix automaton of word-id sequences; state 0 is the start."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        step: list[dict[int, int]] = [{}]
        self.step = step
        self.link, self.length = [-1], [0]
        self.names: list[str | None] = []
        paths = []
        for name, seq in items:
            if not seq:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in seq]
            last = 0
            for c in ids:
                last = self._extend(last, c)
            paths.append(ids)
            self.names.append(None if name is None else str(name))
        #: by state: the items in which its strings occur, for strings of a window or more; one item as its number
        self.items: dict[int, int | tuple[int, ...]] = {}
        #: by state: items shorter than a window that are its longest string
        self.whole: dict[int, set[int]] = {}
        for n, ids in enumerate(paths):
            state = 0
            for c in ids:
                at = state = step[state][c]
                while self.length[at] >= window and n != (held := self.items.get(at)) and not (isinstance(held, tuple) and held[-1] == n):
                    self.items[at] = n if held is None else (*(held if isinstance(held, tuple) else (held,)), n)
                    at = self.link[at]
            if len(ids) < window:
                self.whole.setdefault(state, set()).add(n)
        #: by state: the nearest state at or above it along the links that is in `whole`, else 0
        self.short = array("q", bytes(8 * len(step)))
        for at in sorted(range(1, len(step)), key=self.length.__getitem__):
            self.short[at] = at if at in self.whole else self.short[self.link[at]]
        #: for the search, all steps in one table, by state and word
        self.next = {state << 32 | c: to for state, own in enumerate(step) for c, to in own.items()}
        self.step = []
        self.link, self.length = array("q", self.link), array("q", self.length)

    def _extend(self, last: int, c: int) -> int:
        """The state of (string of last) + c; the usual online step, sharing what earlier items made."""
        step, link, length = self.step, self.link, self.length

        def cloned(p: int, q: int) -> int:
            new = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = new
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = new
                p = link[p]
            return new

        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else cloned(last, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else cloned(p, q)
        return new

    def hits(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint, ascending runs [from, to) of hit words, and the numbers of the items whose windows occur."""
        if not self.names:
            return [], set()
        get, window = self.vocabulary.get, self.window
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        step, link, length, short = self.next, self.link, self.length, self.short
        state = size = 0
        for i, c in enumerate(map(get, seq)):
            if c is None:
                state = size = 0
                continue
            to = step.get(state << 32 | c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step.get(state << 32 | c)
            if to is not None:
                state = to
                size += 1
            hit = 0
            if size >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                held = self.items[at]
                found.update(held if isinstance(held, tuple) else (held,))
                hit = window
            at = short[state] if length[short[state]] <= size else short[link[state]]
            while at:
                found |= self.whole[at]
                hit = max(hit, length[at])
                at = short[link[at]]
            if hit:
                start = i + 1 - hit
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, i + 1))
        return runs, found


def automata(items: DataFrame, id_col: str = "item_id", text: str = "text", max_words: int = MAX_ITEM_WORDS) -> Iterator[Automaton]:
    """One automaton for each slice of the items; a slice has about max_words words at most."""
    require(items, id_col, text)
    items = items.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("body")).where("body IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("body") / 2 + 1)).first()[0] or 0  # words at most
    slices = max(1, math.ceil(total / max_words))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("id", "body"), F.lit(slices)) == k) if slices > 1 else items
        yield Automaton(sorted(((r.id, words(r.body)) for r in part.collect()), key=str))


def _search(held: Broadcast, text: Column) -> Column:
    @F.pandas_udf("n_words long, runs array<int>, items array<string>")
    def search(texts: pd.Series) -> pd.DataFrame:
        automaton, out = held.value, []
        for t in texts:
            seq = words(t)
            runs, found = automaton.hits(seq)
            out.append((len(seq), [x for r in runs for x in r], sorted({automaton.names[n] for n in found} - {None})))
        return pd.DataFrame(out, columns=["n_words", "runs", "items"])

    return search(text)


def hit_words(docs: DataFrame, items: DataFrame, text: str = "text", max_words: int = MAX_ITEM_WORDS, out: str = "hits") -> DataFrame:
    """Adds the column `out`: n_words, runs (from, to, from, to ...: ascending word positions) and items (ids, sorted)."""
    require(docs, text)
    for c in [c for c in docs.columns if c.lower() == out.lower()]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    spark, found, more = docs.sparkSession, None, []
    for automaton in automata(items, max_words=max_words):
        held = spark.sparkContext.broadcast(automaton)
        if found is None:
            found = docs.withColumn(out, _search(held, F.col(text)))
            continue
        own = docs.select(F.sha2(text, 256).alias("of"), _search(held, F.col(text)).alias("x")).where("size(x.runs) > 0")
        more.append(written(own.select("of", "x.runs", "x.items").dropDuplicates(["of"]), "hits"))
        held.destroy()
    if not more:
        return found

    @F.pandas_udf("array<int>")
    def merged(runs: pd.Series) -> pd.Series:
        joined = []
        for flat in runs:
            own: list[int] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if own and own[-1] >= a:
                    own[-1] = max(own[-1], b)
                else:
                    own += [a, b]
            joined.append(own)
        return pd.Series(joined)

    of, runs, ids = fresh(found, "of", "runs", "ids")
    every = more[0]
    for x in more[1:]:
        every = every.union(x)
    every = every.groupBy("of").agg(F.flatten(F.collect_list("runs")), F.flatten(F.collect_list("items"))).toDF(of, runs, ids)  # a row a slice at most
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    first = F.col(out)
    # null texts get keys of their own, so that they don't all meet in one task
    key = F.coalesce(F.sha2(text, 256), F.concat(F.lit("#"), F.xxhash64(*docs.columns).cast("string")))
    both = found.withColumn(of, key).join(every, of, "left")
    new = F.struct(first["n_words"].alias("n_words"), merged(F.concat(first["runs"], none(runs, "array<int>"))).alias("runs"), F.array_sort(F.array_distinct(F.concat(first["items"], none(ids, "array<string>")))).alias("items"))
    return both.withColumn(out, new).select(*found.columns)


def n_hit(hits: str = "hits") -> Column:
    odd = F.transform(F.col(hits)["runs"], lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(odd, F.lit(0).cast("long"), lambda a, x: a + x)


def without_spans(text: str, runs: list[int], min_words: int = 1) -> str:
    """The text without the runs of at least min_words hit words, and without what stands between their words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _SPAN.finditer(folded(text))]
    out, end = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        if b - a >= min_words:
            out.append(raw[end : at[a][0]])
            end = at[b - 1][1]
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", min_words: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """docs without hit spans of at least min_words words, and without the documents of whose words more than
    max_coverage are hit. Columns stay; `n_chars`, if there is one, follows the text."""
    held, hits = fresh(docs, "kept_text", "hits")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.DataFrame) -> pd.Series:
        return pd.Series([t if t is None or not len(r) else without_spans(t, list(r), min_words) for t, r in zip(texts, hits["runs"], strict=True)])

    found = hit_words(docs, items, text, out=hits)
    out = found.where(n_hit(hits) <= max_coverage * F.col(hits)["n_words"]).withColumn(held, cut(F.col(text), F.col(hits)))
    new = {text: F.col(held)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(held).eqNullSafe(F.col(text)), F.col("n_chars")).otherwise(F.char_length(held).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(new).select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hit_words(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
g AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM g),
d AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lengths WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, d.i, d.n FROM d JOIN g USING (n, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
