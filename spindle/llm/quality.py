r"""Quality rules with a cutoff that comes with a guarantee.

Each rule measures a share of the text that is junk; a text's severity is the largest of its measures, each as a part of its rule's SCALE. A
text goes if its severity is above the cutoff of its stratum (language). Labelled good documents that pass the base rules are the
holdout: in each stratum the cutoff is lowered step by step, for all rules at once, and a step is kept only if the exact binomial bound
shows that good documents are rejected at a rate of at most ALPHA. Steps go in a fixed order, so the first that fails ends
the sequence and no correction is needed along it. Of the steps that are kept the highest is used that rejects as many labelled bad documents
as the lowest does, so good ones are not given up for nothing; without bad ones nothing is rejected. Bonferroni divides DELTA by the number of strata that are tested; those are the
largest ones that have enough labels to show anything at that level, which depends on their sizes only. Together: with probability
1 - DELTA no stratum loses more than ALPHA of its good documents to these rules. A stratum with too few labels gets no cutoff.

Nulls and ties: a null text has no words and fails the base rules. A null language is a stratum of its own. Repeated labels
count once, the lowest quality holds; labels of null are left out. An empty label table gives no cutoffs.
Repeated documents each keep their row. Extra columns are kept by `judge`; clashing names are kept
under `_name`.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, require, table, written

ALPHA, DELTA, STEPS = 0.03, 0.05, 200
#: Strata up to which their cutoffs are broadcast (a name and a number each).
SMALL_STRATA = 100_000
#: Fixed values of the contract.
SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT = b"#*$%&|<>", 50, 50
#: Rules, and the share at which each is at its worst.
SCALE = {"junk_share": 0.2, "upper_share": 1.0, "dup_line_share": 1.0, "repeat_share": 1.0}
RULES = tuple(SCALE)
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = COUNTS + "".join(f", {r} double" for r in RULES)


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, n, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measures(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII blanks only
    n, chars = len(words), len(text or "") - sum(raw.count(b) for b in b" \t\n\x0b\x0c\r")
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else []
    dup = len(lines) - len(set(lines))
    repeat = _repeated(words)
    letters, upper = len(raw.translate(None, bytes(range(65)) + b"[\\]^_`" + bytes(range(123, 128)))), len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    junk = symbols + raw.count(b"!")
    return (
        n, chars, symbols, dup, repeat,
        junk / max(chars, 1), upper / max(letters, 1), dup / max(len(lines), 1), repeat / max(n, 1),
    )


def _measured(text: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(t) for t in texts], columns=[c.split()[0] for c in MEASURES.split(", ")])

    return measure(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of Binomial(n, p), exactly, term by term."""
    if k >= n:
        return 1.0
    log, total = n * math.log1p(-p), 0.0
    for i in range(k + 1):
        if i:
            log += math.log((n - i + 1) / i) + math.log(p) - math.log1p(-p)
        total += math.exp(log)
    return min(total, 1.0)


def lowest_cutoff(rejected_at: dict[int, int], n: int, alpha: float, delta: float, steps: int = STEPS) -> int | None:
    """The lowest step whose cutoff is shown to reject at most alpha of good documents. rejected_at[s]: how many
    of the n good documents have a measure whose step is s (they go if the cutoff is below s)."""
    above, best = 0, None
    for s in range(steps, -1, -1):
        above += rejected_at.get(s + 1, 0)
        if binomial_tail(above, n, alpha) > delta:
            break
        best = s
    return best


def step() -> Column:
    """Severity in steps, upwards: a cutoff of s rejects what is above s."""
    return F.ceil(F.least(F.greatest(*[F.col(r) / scale for r, scale in SCALE.items()]), F.lit(1.0)) * STEPS).cast("int")


def judged_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def tested_strata(sizes: list[int], alpha: float, delta: float) -> int:
    """The most strata, largest first, of which each can show a rate of at most alpha at level delta / their number."""
    return max((m for m, n in enumerate(sorted(sizes, reverse=True), 1) if binomial_tail(0, n, alpha) <= delta / m), default=0)


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff in steps) of strata that have one. Counts are sums over all labelled documents by stratum and step; each
    stratum, of at most STEPS rows then, is a group of its own."""
    of, at = fresh(measured, "stratum", "step")
    (good,) = fresh(measured, "good")
    known = measured.where(~base_failed()).join(judged_ids(labels).toDF("doc_id", good), "doc_id")
    hist = known.groupBy(F.col(stratum).cast("string").alias(of), step().alias(at)).agg(F.count_if(F.col(good)).alias("n"), F.count_if(~F.col(good)).alias("bad"))
    hist = written(hist.toDF("stratum", "step", "n", "bad"), "steps")
    # strata by their number of labels: a row for each size that occurs
    sizes = hist.groupBy("stratum").agg(F.sum("n").alias("total")).where(F.pow(F.lit(1 - alpha), "total") <= delta).groupBy("total").agg(F.count(F.lit(1)).alias("strata"))
    m = tested_strata([r.total for r in sizes.collect() for _ in range(r.strata)], alpha, delta)

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        n, found = int(rows["n"].sum()), None
        if m and binomial_tail(0, n, alpha) <= delta / m:
            found = lowest_cutoff(dict(zip(rows["step"].tolist(), rows["n"].tolist(), strict=True)), n, alpha, delta / m)
        if found is not None:
            worse = rows["step"][(rows["bad"] > 0) & (rows["step"] > found)]
            found = int(worse.min()) - 1 if len(worse) else STEPS
        name = rows["stratum"].iloc[0]
        name = None if pd.isna(name) else name
        return pd.DataFrame({"stratum": pd.Series([name] if found is not None else [], dtype=object), "cutoff": pd.Series([found] if found is not None else [], dtype="int32")})

    return written(hist.groupBy("stratum").applyInPandas(chosen, "stratum string, cutoff int"), "cutoffs")


def judged(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept to rows that have the measures."""
    of, limit = fresh(measured, "cut_of", "cut_at")
    cuts = cuts.toDF(of, limit)
    cuts = F.broadcast(cuts) if cuts.count() <= SMALL_STRATA else cuts
    out = measured.join(cuts, F.col(stratum).cast("string").eqNullSafe(F.col(of)), "left")
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(step() > F.col(limit), F.lit(False))).drop(of, limit)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    require(docs, text)
    names = [c.split()[0] for c in MEASURES.split(", ")] + ["base_failed", "kept"]
    for c in [c for c in docs.columns if c.lower() in names]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    (m,) = fresh(docs, "m")
    return docs.withColumn(m, _measured(F.col(text))).select(*docs.columns, f"{m}.*")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the measures, base_failed and kept. Texts are measured once and written with their measures."""
    rows = written(measured(docs), "measures")
    return judged(rows, cutoffs(rows, labels))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = written(measured(docs).drop("text"), "measures")
    out = judged(rows, cutoffs(rows, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[c.split()[0] for c in COUNTS.split(", ")], "base_failed", "kept", *RULES)


SQL = r"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS b FROM documents),
w AS (SELECT doc_id, lang, b, regexp_extract_all(b, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, b, ls, len(ws)::BIGINT AS n_words, length(regexp_replace(b, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(b, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (n_symbols + length(regexp_replace(b, '[^!]', '', 'g')))::DOUBLE / greatest(word_chars, 1) AS junk_share,
    length(regexp_replace(b, '[^A-Z]', '', 'g'))::DOUBLE / greatest(strlen(regexp_replace(b, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')), 1) AS upper_share,
    n_dup_lines::DOUBLE / greatest(len(ls), 1) AS dup_line_share, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share FROM c),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sev AS (SELECT *, ceil(least(greatest(junk_share / 0.2e0, upper_share, dup_line_share, repeat_share), 1) * 200)::INT AS step FROM m),
steps AS (SELECT lang, step FROM sev JOIN known USING (doc_id) WHERE NOT base_failed AND good),
bad AS (SELECT lang, step FROM sev JOIN known USING (doc_id) WHERE NOT base_failed AND NOT good),
total AS (SELECT lang, count(*) AS n FROM steps GROUP BY ALL),
tested AS (SELECT max(r) AS m FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM total) WHERE pow(0.97e0, n) <= 0.05e0 / r),
above AS (SELECT t.lang, s, t.n, (SELECT count(*) FROM steps x WHERE x.lang IS NOT DISTINCT FROM t.lang AND x.step > s) AS k FROM total t, range(0, 201) r(s)),
tail AS (SELECT lang, s, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.03e0) + (n - i) * ln(0.97e0))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM above WHERE k < n) GROUP BY ALL),
low AS (SELECT lang, min(s) AS c FROM tail WHERE p <= 0.05e0 / (SELECT m FROM tested) GROUP BY ALL),
cut AS (SELECT lang, coalesce((SELECT min(step) FROM bad WHERE bad.lang IS NOT DISTINCT FROM low.lang AND step > low.c) - 1, 200) AS c FROM low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(step <= c, true) AS kept,
  junk_share, upper_share, dup_line_share, repeat_share FROM sev LEFT JOIN cut ON sev.lang IS NOT DISTINCT FROM cut.lang
"""
