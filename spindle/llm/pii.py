r"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to theirs.

The field segments the surroundings of digits and @ signs. A candidate segment, of at most MAX_TOKENS tokens, is scored as a whole
(its shape, digits, checks such as Luhn's, what stands before and after it) for each kind; all else is outside
and scores nothing. One dynamic program over token positions picks the segmentation and the kinds together. Weights
are learned in numpy by maximum likelihood (forward and backward over segments) from at most REGIONS pieces of
the corpus, labelled by the patterns and the rule for secrets, and from the same pieces with written-out variants and
look-alikes put in. Spans of the patterns stay; the field's spans are added where they touch none of them.

Nulls and ties: a null text is empty and has no spans. Repeated rows are judged alike. An empty table gives an
empty result (the field is then trained on the written-out examples only). Extra columns are kept by `find`;
clashing names are kept under `_name`. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, require, table

#: Fixed values of the contract: kinds in their order, and their patterns (the starts of runs are pinned, which changes no match).
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SECRET = re.compile(r"""(?i)\b(?:token|secret|api_?key|password)["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_-]{16,128})(?![A-Za-z0-9_-])""")

MAX_TOKENS, MARGIN, REGIONS, EPOCHS, SEED = 24, 40, 1500, 8, 5
TOKEN = re.compile(r"[^\W_]+|\s+|[\W_]")
TRIGGER = re.compile(r"[0-9@]")
KEYWORD = re.compile(r"(?i)(?:token|secret|key|password)\W{0,6}\Z")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    out = list(_emails(text)) if "@" in text else []
    if TRIGGER.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Surroundings of digits and @ signs, MARGIN characters either side, joined where they meet."""
    start = end = -1
    for m in re.finditer(r"[0-9@][0-9@.\-() +]*", text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a <= end:
            end = b
            continue
        if end > 0:
            yield start, end
        start, end = a, b
    if end > 0:
        yield start, end


_DIGITS = ((1, 3), (4, 6), (7, 8), (9, 11), (12, 15), (16, 19), (20, 10**9))
_LENGTHS = ((1, 1), (2, 4), (5, 9), (10, MAX_TOKENS))
FEATURES = 41


def features(text: str, a: int, b: int, tokens: int) -> list[int]:
    """Numbers of the features that hold for the segment text[a:b] of so many tokens."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    out = [0]
    out += [1 + i for i, (lo, hi) in enumerate(_DIGITS) if lo <= n <= hi]
    out += [8 + i for i, (lo, hi) in enumerate(_LENGTHS) if lo <= tokens <= hi]
    letters = any(c.isalpha() for c in s)
    ip = IP.fullmatch(s)
    before, after = text[a - 1 : a], text[b : b + 1]
    for i, holds in enumerate((
        "@" in s,
        "@" in s and bool(LOCAL.match(s[: s.find("@")] or "@")) and bool(DOMAIN.fullmatch(s[s.find("@") + 1 :])),
        bool(ip),
        bool(ip) and all(int(p) <= 255 for p in ip.groups() if len(p) < 10),
        12 <= n <= 19 and not letters and bool(CARD.fullmatch(s)) and luhn(digits),
        12 <= n <= 19 and not letters and not luhn(digits),
        s[0] == "+",
        s[0] == "(",
        "-" in s,
        " " in s,
        "." in s,
        letters,
        letters and n > 0,
        len(s) >= 16 and all(c in "0123456789abcdef" for c in s),
        len(s) >= 16 and tokens == 1 and letters and n > 2,
        bool(PHONE.fullmatch(s)) and 9 <= n <= 15,
        bool(re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s)),
        bool(KEYWORD.search(text, max(0, a - 24), a)),
        not before or before.isspace(),
        before in ('"', "'"),
        before.isalnum(),
        before in ("+", "-", ".", "@", "_", "/"),
        not after or after.isspace(),
        after in ('"', "'"),
        after.isalnum(),
        after in ("-", "@", "_", "/"),
        after in (".", ",", ";", "!", "?", ")"),
        bool(re.search(r"  |\s\s|[\r\n]", s)),
        s.count(".") > 3,
    )):
        if holds:
            out.append(12 + i)
    return out


class Region:
    """Token edges of a piece of text, and its candidate segments (from token, to token, feature numbers), by their first token."""

    def __init__(self, text: str, start: int = 0, end: int | None = None):
        end = len(text) if end is None else end
        self.text, self.edges = text, array("q", [start])
        for m in TOKEN.finditer(text, start, end):
            self.edges.append(m.end())

    def candidates(self) -> Iterator[tuple[int, int, list[int]]]:
        text, edges = self.text, self.edges
        count = len(edges) - 1

        def token(i: int) -> tuple[str, bool]:
            a, b = edges[i], edges[i + 1]
            return "s" if text[a].isspace() else "w" if text[a].isalnum() else "p", bool(TRIGGER.search(text, a, b))

        ahead: list[tuple[str, bool]] = []  # tokens i to i + MAX_TOKENS
        for i in range(count):
            while len(ahead) < MAX_TOKENS and i + len(ahead) < count:
                ahead.append(token(i + len(ahead)))
            a = edges[i]
            if ahead[0][0] == "w" or (ahead[0][0] == "p" and text[a] in "+("):
                words = trigger = False
                for j, (kind, hot) in enumerate(ahead, i + 1):
                    last = edges[j - 1]
                    if kind == "s" and (edges[j] - last > 1 or words):
                        break  # words are not joined over blanks
                    words = words or (kind == "w" and any(c.isalpha() for c in text[last : edges[j]]))
                    if words and " " in text[a : edges[j]]:
                        break
                    trigger = trigger or hot
                    if kind == "w" and trigger:
                        yield i, j, features(text, a, edges[j], j - i)
            ahead.pop(0)

    @functools.cached_property
    def segments(self) -> list[tuple[int, int, list[int]]]:
        """All candidates at once, for pieces of bounded length."""
        return list(self.candidates())


class SemiMarkov:
    def __init__(self):
        self.weights = np.zeros((len(KINDS), FEATURES))
        self.weights[:, 0] = -4.0

    def scores(self, segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
        """Segments by kinds."""
        return np.stack([self.weights[:, f].sum(1) for _, _, f in segments]) if segments else np.zeros((0, len(KINDS)))

    def best(self, region: Region) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: (from token, to token, kind). Candidates are scored as the program passes them and not
        kept; what grows with the region is a value, a token number and a kind for each token."""
        n, done = len(region.edges) - 1, 0
        value, back, kinds = array("d", bytes(8 * n + 8)), array("q", b"\xff" * (8 * n + 8)), array("b", bytes(n + 1))
        candidates = region.candidates()
        while some := list(itertools.islice(candidates, 4096)):
            s = self.scores(some)
            for (i, j, _), k, top in zip(some, s.argmax(1).tolist(), s.max(1).tolist(), strict=True):
                while done < i:
                    done += 1
                    if value[done] <= value[done - 1]:
                        value[done], back[done] = value[done - 1], -1
                if top > 0 and value[i] + top > value[j]:
                    value[j], back[j], kinds[j] = value[i] + top, i, k
        while done < n:
            done += 1
            if value[done] <= value[done - 1]:
                value[done], back[done] = value[done - 1], -1
        out, j = [], n
        while j:
            if back[j] < 0:
                j -= 1
            else:
                out.append((back[j], j, kinds[j]))
                j = back[j]
        return out[::-1]

    def expected(self, region: Region) -> tuple[float, np.ndarray]:
        """Log of the partition sum, and the probability of each (segment, kind)."""
        s, n = self.scores(region.segments), len(region.edges) - 1
        lse = np.logaddexp.reduce(s, axis=1) if len(s) else s
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(region.segments):
            ends[j].append(k)
            starts[i].append(k)
        alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[region.segments[k][0]] + lse[k] for k in ends[j])])
        for i in range(n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[region.segments[k][1]] + lse[k] for k in starts[i])])
        at = np.array([alpha[i] + beta[j] for i, j, _ in region.segments]).reshape(-1, 1)
        return float(alpha[n]), np.exp(s + at - alpha[n]) if len(s) else s

    def train(self, texts: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4) -> None:
        """Stochastic gradient ascent on the likelihood (Adagrad). Spans that no candidate segment fits are left out."""
        data = []
        for text, spans in texts:
            region = Region(text)
            want = {(a, b): KINDS.index(k) for a, b, k in spans}
            gold = [(k, want[x]) for k, (i, j, _) in enumerate(region.segments) if (x := (region.edges[i], region.edges[j])) in want]
            if region.segments:
                data.append((region, gold))
        rng, grown = np.random.default_rng(SEED), np.full_like(self.weights, 1e-6)
        for _ in range(epochs):
            for d in rng.permutation(len(data)):
                region, gold = data[d]
                _, p = self.expected(region)
                grad = -l2 * self.weights
                for k, y in gold:
                    p[k, y] -= 1
                for k, (_, _, f) in enumerate(region.segments):
                    grad[:, f] -= p[k][:, None]
                grown += grad * grad
                self.weights += rate * grad / np.sqrt(grown)


def silver(text: str) -> list[Span]:
    """Labels of a training piece: patterns and secrets, without overlaps (the longest wins)."""
    found = base_spans(text) + [(*m.span(1), "secret") for m in SECRET.finditer(text)]
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in out):
            out.append(s)
    return sorted(out)


def _written(rng: np.random.Generator) -> tuple[str, str | None]:
    """A made-up entity or look-alike, and its kind (None: none)."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(rng.choice(list("abcdefghinorstu"), rng.integers(3, 9)))
    card = d(15)
    card += next(str(c) for c in range(10) if luhn(card + str(c)))
    choices = [
        (f"({d(3)}) {d(3)}-{d(4)}", "phone"), (f"{d(3)}-{d(3)}-{d(4)}", "phone"), (f"+{d(2)} {d(3)} {d(3)} {d(4)}", "phone"),
        (f"+1 ({d(3)}) {d(3)}-{d(4)}", "phone"), (f"{w()}.{d(2)}@{w()}.{w()}.com", "email"), (f"{w()}@{w()}.org", "email"),
        (".".join(map(str, rng.integers(0, 256, 4))), "ip"), (card, "card"), ("-".join(card[i : i + 4] for i in (0, 4, 8, 12)), "card"),
        ('"' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"', "secret"),
        (d(4), None), (f"{d(1)}.{d(1)}", None), (f"20{d(2)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", None), (d(2), None), (f"{w()}{d(2)}", None),
        (f"{d(1)},{d(3)}", None), (f"{d(2)}:{d(2)}", None), (f"{w()}@{w()}", None), (d(6), None), (f"v{d(1)}.{d(1)}.{d(1)}", None), (f"{d(1)}.{d(1)}.{d(1)}", None),
        (f"300.{d(3)}.999.{d(2)}", None), (str(int(card) + 1), None),
    ]
    return choices[rng.integers(len(choices))]


def examples(pieces: list[str]) -> list[tuple[str, list[Span]]]:
    """Training texts: the pieces as they are, and words of pieces around written-out entities."""
    rng, out = np.random.default_rng(SEED), [(p, silver(p)) for p in pieces]
    words = [x for p in pieces for x in p.split() if x.isalpha()] or ["the", "of", "and"]
    for _ in range(900):
        entity, kind = _written(rng)
        left, right = (" ".join(rng.choice(words, 4)) for _ in range(2))
        lead = "token = " if kind == "secret" else ""
        text = f"{left} {lead}{entity}{rng.choice(['', '.', ','])} {right}"
        a = len(left) + 1 + len(lead)
        if kind == "secret":
            out.append((text, [(a + 1, a + len(entity) - 1, kind)]))
        else:
            out.append((text, [(a, a + len(entity), kind)] if kind else silver(text)))
    return out


def train(docs: DataFrame, text: str = "text") -> SemiMarkov:
    """A field trained on at most REGIONS pieces of docs: those of the texts with the lowest hashes."""
    require(docs, text)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([[t[a : min(b, a + 300)] for (a, b), _ in zip(regions(t), range(3), strict=False)] for t in texts])

    with_some = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    # about one text in n is read, n from a count, so that the sample's cost doesn't grow
    n = max(1, with_some.count() // (2 * REGIONS))
    drawn = with_some.where(F.pmod("h", F.lit(n)) == 0).select("h", pieces("t").alias("p"))
    rows = drawn.select("h", F.explode("p").alias("p")).orderBy("h", "p").limit(REGIONS).collect()
    field = SemiMarkov()
    field.train(examples([r.p for r in rows]))
    return field


def spans_of(text: str | None, field: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    more = []
    for a, b in regions(text):
        region = Region(text, a, b)
        more += [(region.edges[i], region.edges[j], KINDS[k]) for i, j, k in field.best(region)]
    # both lists are sorted by start; a span of the field that touches a base span is left out
    taken = np.array(sorted((s[0], s[1]) for s in base), np.int64).reshape(-1, 2)
    if len(taken):
        reach = np.maximum.accumulate(taken[:, 1])
        k = np.searchsorted(taken[:, 0], [s[1] for s in more]) - 1
        more = [s for s, i in zip(more, k, strict=True) if i < 0 or reach[i] <= s[0]]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _find(held: Broadcast, text: Column) -> Column:
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    def find_spans(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            base, every = spans_of(t, held.value)
            kinds = [k for _, _, k in base]
            out.append((*map(kinds.count, BASE_KINDS), line(base), line(every)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return find_spans(text)


def find(docs: DataFrame, field: SemiMarkov, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base (spans of the patterns) and spans (all)."""
    require(docs, text)
    for c in [c for c in docs.columns if c.lower() in ("n_email", "n_ip", "n_card", "n_phone", "base", "spans")]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    (got,) = fresh(docs, "got")
    held = docs.sparkSession.sparkContext.broadcast(field)  # a few KB of weights
    return docs.withColumn(got, _find(held, F.col(text))).select(*docs.columns, f"{got}.*")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are joined under the first kind."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"<{k}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def op7_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, train(docs))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
