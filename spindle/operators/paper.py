"""Title, authors and abstract of texts that look like papers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions.text import PAPER_WORDS

#: Words of prose, which no line of authors has.
PROSE = ("however", "therefore", "moreover", "furthermore", "specifically", "consequently", "additionally", "nevertheless", "in this", "we propose", "our method", "experiment", "result")
_HEADING = re.compile(r"#{1,6} ")
_NUMBER = re.compile(r"\d+[ .]")


def _size(s: str) -> int:
    return len(s.encode())


def is_author_line(line: str) -> bool:
    low = line.lower()
    if _size(line) > 200 or any(w in low for w in PROSE):
        return False
    if "@" in line or ("," in line and not re.search("[.?!]", line)):
        return True
    at = low.find(" and ")
    return 0 < at < len(low) - 6


def _names(lines: list[str]) -> list[str]:
    out = []
    for line in filter(None, map(str.strip, lines)):
        if _HEADING.match(line):
            break
        for part in line.split(",") if is_author_line(line) else ():
            name = part.strip()
            if m := _NUMBER.match(name):
                name = name[m.end() :].strip()
            if _size(name) > 3:
                name = name.split("(")[0].strip() if name.find("(") > 0 else name
                out += [name] if name else []
    return out


def paper_meta(text: str | None) -> tuple[str, list[str], str, bool]:
    """Title, authors, abstract, and whether the text looks like a paper."""
    text = text or ""
    if not any(w in text.encode()[:6000].decode(errors="ignore").lower() for w in PAPER_WORDS):
        return "", [], "", False
    lines = [x.strip() for x in text.replace("\r\n", "\n").split("\n")]
    heads = [i for i, x in enumerate(lines) if _HEADING.match(x)]
    start = next((i for i in heads if "abstract" in lines[i].lower()), -1)
    if start < 0:
        start = next((i for i, x in enumerate(lines) if x.lower() in ("abstract", "abstract.", "摘要", "摘要：")), -1)
    end = next((i for i in heads if i > start), min(len(lines), 100)) if start >= 0 else -1
    top = next((i for i, x in enumerate(lines[: start if start >= 0 else 20]) if x and (i in heads or (_size(x) < 120 and not re.search("[.!]", x) and not is_author_line(x)))), -1)
    title = re.sub(r"^[#\s]+", "", lines[top]) if top >= 0 else ""
    authors = _names(lines[top + 1 : min(start, top + 21)]) if top >= 0 and start > 0 else []
    body = "\n".join(lines[start + 1 : end]) if end > start >= 0 else ""
    # lines are joined by blanks; each empty line between them is a break
    abstract = re.sub(r"\n+", lambda m: "\n\n" * (len(m[0]) - 1) or " ", body.strip("\n"))
    return title, authors, abstract.strip(), True


def with_paper_meta(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds title, authors, abstract and is_paper. Each text is judged on its own."""

    @F.pandas_udf("title string, authors array<string>, abstract string, is_paper boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([paper_meta(t) for t in texts], columns=["title", "authors", "abstract", "is_paper"])

    return docs.withColumn("meta", run(F.col(text))).select(*docs.columns, "meta.*")
