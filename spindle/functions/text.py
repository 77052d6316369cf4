"""Text functions as Column expressions (JVM side), and the few that work on a request in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
TOKEN = rf"([{CJK}]|[[\p{{L}}\p{{Nd}}_]&&[^{CJK}]]+)"
BIGRAM = rf"(?=([{CJK}]{{2}}))"
WORD, NO_WORD, FIRST_CJK = r"[a-z0-9_\p{L}\p{Nd}]+", r"[^a-z0-9_\p{L}\p{Nd}]+", r"\x{1100}"
SENTENCE_END = r"[.!?。！？]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """rows with further columns, each computed once a row: without the generator the optimiser writes an expression wherever its column is used, in lambdas for
    each element."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _has_cjk(low: Column) -> Column:
    """False only where no character can be CJK: all of those are beyond FIRST_CJK, and a script's tables are asked for every character."""
    return low.rlike(rf"[{FIRST_CJK}-\x{{10FFFF}}]")


def tokens(text: Column | str) -> Column:
    """Lower-cased words, single CJK characters, and pairs of neighbouring CJK characters."""
    low = F.lower(_col(text))
    all_kinds = F.concat(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(1)), F.regexp_extract_all(low, F.lit(BIGRAM), F.lit(1)))
    return F.when(_has_cjk(low), all_kinds).otherwise(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)))


def token_line(text: Column | str) -> Column:
    """The tokens of a text, joined by blanks; there may be a blank more at the ends."""
    low = F.lower(_col(text))
    return F.when(_has_cjk(low), F.array_join(tokens(text), " ")).otherwise(F.regexp_replace(low, NO_WORD, " "))


_PY_CJK = re.compile("[⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
                     "ぁ-ゖゝ-ゟァ-ヺヽ-ヿㇰ-ㇿᄀ-ᇿㄱ-ㆎ가-힣]")


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query in the order in which they end; a query without any is an error."""
    out: list[str] = []
    word, before = "", ""
    for c in query.strip():
        if _PY_CJK.match(c):
            out += [word.lower()] if word else []
            out.append(c)
            if before:
                out.append(before + c)
            word, before = "", c
        else:
            before = ""
            if c == "_" or c.isalpha() or c.isdecimal():
                word += c
            else:
                out += [word.lower()] if word else []
                word = ""
    out += [word.lower()] if word else []
    if not out:
        raise ValueError("the query has no terms")
    return list(dict.fromkeys(out))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def sentences(text: Column | str) -> Column:
    """Sentences with their closing mark, untrimmed; what follows the last mark is trimmed and kept if not empty."""
    ended = lambda p: F.concat(F.slice(p, F.lit(1), F.size(p) - 1), F.array(stripped(F.element_at(p, -1))))
    # all but the last part end with a mark; within transform the parts have a name, so the text is split once
    parts = F.transform(F.array(F.split(_col(text), f"(?<={SENTENCE_END})")), lambda p: F.filter(ended(p), lambda s: s != ""))
    return F.element_at(parts, 1)


def trimmed_sentences(text: Column) -> Column:
    """As `sentences`, each trimmed: white space behind a mark goes with the cut."""
    return F.filter(F.split(stripped(text), rf"(?U)(?<={SENTENCE_END})\s*"), lambda s: s != "")


def is_heading(line: Column) -> Column:
    return line.rlike("^#{1,6} ")


#: Words of a heading by role; the first role that fits holds.
SECTION_ROLES = (
    ("abstract", ("abstract", "摘要", "概要")),
    ("introduction", ("introduction", "引言", "introducing")),
    ("related_work", ("related work", "literature review", "background", "相关工作")),
    ("methodology", ("method", "methodology", "approach", "proposed", "方法", "算法", "model")),
    ("experiments", ("experiment", "evaluation", "results", "实验", "评估", "结果")),
    ("conclusion", ("conclusion", "discussion", "future work", "总结", "讨论", "结论")),
    ("references", ("reference", "bibliography", "参考文献")),
)


def section_role(heading: Column | str) -> Column:
    """Role of a section by its heading, "" if none fits."""
    h = F.lower(F.trim(F.regexp_replace(F.trim(_col(heading)), "^#+", "")))
    h = F.regexp_replace(h, r"^[0-9ivxabc()][0-9ivxabc(]*[ .)]\s*", "")
    out = F.lit("")
    for role, words in reversed(SECTION_ROLES):
        fits = F.lit(False)
        for w in words:
            fits = fits | h.contains(w)
        out = F.when(fits, F.lit(role)).otherwise(out)
    return out


#: Words that make a text count as a paper.
PAPER_WORDS = (
    "abstract", "introduction", "related work", "methodology", "experiments", "conclusion", "references", "discussion", "results",
    "摘要", "引言", "相关工作", "方法论", "实验", "结论", "参考文献", "讨论",
)


def looks_like_paper(text: Column | str) -> Column:
    """Any paper word in the first 6000 bytes."""
    upto = F.regexp_extract(F.lower(F.left(_col(text), F.lit(6000))), "(?s)^.*?(?:" + "|".join(PAPER_WORDS) + ")", 0)
    return (upto != "") & (F.octet_length(upto) <= 6000)


def html_to_text(html: Column | str) -> Column:
    """Text of a page: no scripts, styles, comments or tags; the commonest entities are decoded."""
    body = F.regexp_replace(_col(html), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def slug(name: Column | str, stamp: Column | str | None = None) -> Column:
    """A name for a document: base name without extension, other characters as single dashes, and a stamp if given."""
    base = F.regexp_replace(F.regexp_replace(_col(name), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    s = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9_-]+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    s = F.when(s == "", F.lit("document")).otherwise(s)
    return s if stamp is None else F.concat_ws("-", s, _col(stamp))
