"""Operators that judge each text on its own, or urls: quality, decontamination, language, personal data, url filter."""

import hashlib
import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.llm import decontaminate, language_id, pii, quality, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "\n\n", "a", "é" * 50, "x" * 100_000, "word " * 30_000, "\x1c\x85  a b"]


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)} if len(grams) < 500 else None
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if hit is None else len(hit)


def test_quality_measures_match_brute_force():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab \n#é|") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    for t in texts:
        for got, want in zip(quality.measures(t)[:5], brute_measures(t), strict=True):
            assert want is None or got == want


def test_binomial_tail_is_exact_and_cutoffs_hold_the_bound():
    for n, k, p in ((10, 3, 0.2), (60, 0, 0.05), (200, 9, 0.03)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality.lowest_cutoff({0: 5}, 5, 0.01, 0.05) is None  # too few labels
    assert quality.lowest_cutoff({0: 5000}, 5000, 0.01, 0.05) == 0
    # false rejections over many draws: the bound fails in fewer than delta of them
    rng, bad = np.random.default_rng(0), 0
    for _ in range(300):
        at = np.bincount(np.minimum((rng.exponential(0.1, 600) * 200).astype(int) + 1, 200), minlength=202)
        c = quality.lowest_cutoff(dict(enumerate(at.tolist())), 600, 0.03, 0.05)
        bad += c is not None and math.exp(-(c / 200) / 0.1) > 0.03
    assert bad <= 30


def test_quality_rows(spark):
    good = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, "en", 9), (1, good, "en", 9), (2, None, "en", 1), (None, "a b c " * 40, None, 2), (3, "", "de", 3)], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == 5 and all(r["kept"] == (not r.base_failed) for r in rows)
    assert sorted(r["_kept"] for r in rows) == [1, 2, 3, 9, 9] and {r.doc_id: r["kept"] for r in rows}[1]
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0
    clash = quality.judge(docs.withColumns({"cut_of": F.lit("x"), "cut_at": F.lit(7), "cut_stratum": F.lit("y"), "step": F.lit(3)}), labels).collect()
    assert [(r.cut_of, r.cut_at, r.cut_stratum, r.step) for r in clash] == [("x", 7, "y", 3)] * 5


def test_tested_strata():
    assert quality.tested_strata([], 0.03, 0.05) == quality.tested_strata([98, 5], 0.03, 0.05) == 0
    assert quality.tested_strata([99, 98], 0.03, 0.05) == 1 and quality.tested_strata([5, 130, 130], 0.03, 0.05) == 2


def test_each_stratum_gets_its_cutoff(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(s * 100 + i, f"l{s}", words) for s in range(3) for i in range(400 if s < 2 else 20)] + [(9000 + s, f"l{s}", "#" * 200 + words) for s in range(3)]
    docs = spark.createDataFrame([(n, lang, text) for n, (_, lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.when(F.col("text").startswith("#"), 0).otherwise(1).alias("quality"))
    cuts = {r.stratum: r.cutoff for r in quality.cutoffs(quality.measured(docs), labels).collect()}
    # just below the bad document, though cutoffs down to 0 are shown to hold
    assert cuts == {"l0": 199, "l1": 199} and quality.tested_strata([400, 400], quality.ALPHA, quality.DELTA) == 2
    assert quality.lowest_cutoff({0: 400}, 400, quality.ALPHA, quality.DELTA / 2) == 0
    out = quality.judge(docs, labels).where("lang <> 'l2'").collect()
    assert all(r["kept"] == (not r.text.startswith("#")) for r in out)
    assert {r.cutoff for r in quality.cutoffs(quality.measured(docs), labels.withColumn("quality", F.lit(1))).collect()} == {quality.STEPS}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_quality_query_rejects_by_its_method(spark, size):
    """At sf0.01 one language has labels enough for a cutoff; at sf0.001 none has."""
    rows = quality.op1_quality_rules(spark, f"/root/testdata/{size}").collect()
    gone = sum(not r["kept"] and not r.base_failed for r in rows)
    assert (gone > 0) == (size == "sf0.01")


def brute_hits(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for name, item in items:
        w = fold(item)
        n = min(10, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(name)
    return len(words), hit, found


def test_automaton_matches_brute_force():
    rng = random.Random(2)
    for trial in range(60):
        words = "a b c é D".split()[: rng.randint(1, 5)]
        make = lambda n: " ".join(rng.choice(words) for _ in range(n))
        items = [(i, make(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(rng.randint(0, 4))]
        automaton = decontaminate.Automaton([(str(i), decontaminate.words(t)) for i, t in items])
        for _ in range(4):
            text = make(rng.randint(0, 60)) + rng.choice(["", ", " + (items[0][1] if items else "")])
            runs, found = automaton.hits(decontaminate.words(text))
            n, hit, names = brute_hits(text, items)
            assert {p for a, b in runs for p in range(a, b)} == hit, trial
            assert {automaton.names[k] for k in found} == {str(x) for x in names}
            assert runs == sorted(runs)


def test_decontaminated_rows_and_slices(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Start {item} end of it all. " + "x y z " * 20, 7), (2, item.upper(), 7), (3, None, 7), (4, "clean", 7), (4, "clean", 7)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(5, item), (6, "short one"), (6, "short one"), (None, None), (7, "")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminated(docs, items).collect()}
    assert set(rows) == {1, 3, 4} and rows[1].text.startswith("Start  end of") and rows[1].n_chars == len(rows[1].text) and rows[4].n_chars == 7
    one = decontaminate.hit_words(docs, items).selectExpr("doc_id", "hits.*").collect()
    many = decontaminate.hit_words(docs, items, max_words=3).selectExpr("doc_id", "hits.*").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    assert decontaminate.hit_words(docs, items.limit(0)).where("size(hits.runs) > 0").count() == 0
    clash = decontaminate.decontaminated(docs.withColumn("hits", F.lit(1)), items)
    assert clash.columns == ["doc_id", "text", "n_chars", "hits"] and {r.doc_id: (r.text, r.n_chars) for r in clash.collect()} == {i: (r.text, r.n_chars) for i, r in rows.items()}


def test_items_without_an_id(spark, tmp_path):
    """They hit words and are neither listed nor counted, in the SQL too."""
    item = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([(1, f"{item} more"), (2, "none"), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, item), (5, "q1 q2")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.asDict() for r in decontaminate.op5_decontaminate(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(decontaminate.SQL).fetchdf().to_dict("records")
    assert {r["doc_id"]: r for r in want} == got and (got[1]["n_hit"], got[1]["n_items"], got[2]["n_hit"]) == (12, 1, 0)


def test_decontamination_of_a_long_text(spark):
    item = " ".join(f"q{i}" for i in range(12))
    text = ("plain words here " * 60_000 + item + " ") * 2 + "x" * 100_000
    got = decontaminate.hit_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).first().hits
    n = 3 * 60_000
    assert got.n_words == 2 * (n + 12) + 1 and got.runs == [n, n + 12, 2 * n + 12, 2 * n + 24] and got["items"] == ["5"]


def test_network_gradients_and_pooling():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"], 4)
    x, y = rng.integers(97, 122, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for k, w in enumerate(net.parameters()[:6]):
        at = np.unravel_index(int(np.abs(grads[k]).argmax()), w.shape)
        keep, e = w[at], 1e-2
        w[at] = keep + e
        up = net.gradients(x, y)[0]
        w[at] = keep - e
        down = net.gradients(x, y)[0]
        w[at] = keep
        assert (up - down) / (2 * e) == pytest.approx(float(grads[k][at]), rel=0.1, abs=2e-4)
    texts = [b"abc" * 300, b"x", b"", b"hello world" * 100]
    together, apart = net.probabilities(texts), np.concatenate([net.probabilities([t]) for t in texts])
    assert np.allclose(together, apart, atol=1e-5) and np.allclose(together.sum(1), [1, 1, 0, 1], atol=1e-5)


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 1)
    monkeypatch.setattr(language_id, "SAMPLE", 140)
    seen = []
    monkeypatch.setattr(language_id.Network, "train", lambda self, pieces, labels, steps: seen.append((labels, steps)))
    docs = spark.range(1400).selectExpr("id AS doc_id", "repeat(concat('w', id % 70, ' '), 60) AS text", "concat('l', id % 70) AS lang")
    net = language_id.train(docs)
    assert net.languages == sorted(f"l{i}" for i in range(70)) and net.sides[0].hidden > language_id.HIDDEN
    (labels, steps), = seen
    assert set(labels) == set(range(70)) and len(labels) <= 140 * language_id.PIECES and steps == 4


@pytest.mark.parametrize("key", ["cast(null as long)", "1l"])
def test_languages_whose_rows_share_an_id(spark, monkeypatch, key):
    """Rows of one id are drawn by their texts; a language of nothing but copies of one row is learned too."""
    monkeypatch.setattr(language_id, "SAMPLE", 8)
    seen = []
    monkeypatch.setattr(language_id.Network, "train", lambda self, pieces, labels, steps: seen.append((pieces, labels)))
    docs = spark.range(2000).selectExpr(f"{key} AS doc_id", "CASE id % 4 WHEN 0 THEN 'one text' ELSE concat('words ', id) END AS text", "concat('l', id % 4) AS lang")
    net = language_id.train(docs)
    ((pieces, labels),) = seen
    assert net.languages == ["l0", "l1", "l2", "l3"] and set(labels) == {0, 1, 2, 3}
    assert len({p for p, n in zip(pieces, labels, strict=True) if n == 1}) == 2


def test_language_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate(ODD)] + [(None, "12 + 3", None, 0.5)], "doc_id long, text string, lang string, score double")
    net = language_id.train(docs)
    rows = language_id.identify(docs, net).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and r["_score"] == 0.5
    assert language_id.train(docs.limit(0)) is None
    assert not language_id.has_letter("½ ² 4 _ ٣ 。") and language_id.has_letter("½ª") and language_id.has_letter("12 字")
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            out += [(*m.span(), kind)] if ok else []
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_match_plain_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "1", "25", ".", "@", "-", " ", "+1", "(", ")", "é", "4111111111111111", "x.y", "_"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_segmentation_is_the_best_and_probabilities_sum():
    field = pii.SemiMarkov()
    rng = np.random.default_rng(1)
    field.weights = rng.normal(0, 1.5, field.weights.shape)
    region = pii.Region("a 12 b.3@c 4")
    scores = field.scores(region.segments)
    segs = [(i, j, k, scores[n, k]) for n, (i, j, _) in enumerate(region.segments) for k in range(len(pii.KINDS))]
    best, total = 0.0, []

    def walk(at, value, parts):
        nonlocal best
        total.append(value)
        best = max(best, value)
        for s in segs:
            if s[0] >= at and len(parts) < 4:
                walk(s[1], value + s[3], [*parts, s])

    walk(0, 0.0, [])
    got = field.best(region)
    index = {(i, j): n for n, (i, j, _) in enumerate(region.segments)}
    assert sum(scores[index[i, j], k] for i, j, k in got) == pytest.approx(best)
    log, p = field.expected(region)
    assert log == pytest.approx(np.logaddexp.reduce(total), rel=1e-6) and (p >= 0).all() and (p <= 1 + 1e-9).all()


def test_pii_rows(spark):
    texts = [None, "", "x" * 100_000, "1" * 50_000, "call +1 (743) 555-3824 now", "mail a.b@c.example.com", "id 7536784127813050 4845168114407329 end", "see 4.0 and 2004", "ip 152.143.123.131."]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    field = pii.train(docs)
    rows = {r.doc_id: r for r in pii.find(docs, field).collect()}
    assert rows[4].spans == "phone:5:22" and rows[5].spans == "email:5:22" and rows[7].spans == "" and rows[8].spans == "ip:3:18"
    assert rows[6].base == "" and rows[6].spans.count("card") == 2 and rows[0].spans == rows[1].spans == "" and rows[3]["_spans"] == "own"
    assert pii.masked("a b", [(0, 1, "ip")]) == "<ip> b"


def test_the_field_finds_what_patterns_miss(spark):
    """Written-out entities of other draws than those it learned from: recall of kinds that no pattern covers, and false spans."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field, rng = pii.train(docs), np.random.default_rng(77)
    want = found = wrong = base = clean = 0
    for _ in range(1500):
        entity, kind = pii._written(rng)
        text = f"some words before {'token = ' if kind == 'secret' else ''}{entity} and some after"
        a = text.index(entity) + (kind == "secret")
        spans = pii.spans_of(text, field)
        if kind is None:
            clean += 1
            wrong += len(spans[1]) > len(spans[0])
        elif (a, a + len(entity) - 2 * (kind == "secret"), kind) in spans[0]:
            base += 1
        else:
            want += 1
            found += (a, a + len(entity) - 2 * (kind == "secret"), kind) in spans[1]
    assert want > 150 and base > 150 and found / want > 0.9 and wrong / clean < 0.1


def test_personal_data_takes_little_memory_in_a_long_region():
    """Digits with blanks are one region with a candidate of many lengths at each of them."""
    field = pii.SemiMarkov()
    field.weights[0, 0] = 0.1
    text, peaks = "4 " * 6_000, []
    for n in (3_000, 12_000):
        tracemalloc.start()
        assert len(field.best(pii.Region(text[:n]))) > n // 100
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 9_000 * 60


def brute_url(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bare = re.sub(r":(80|443)\Z", "", re.sub(r"^(www|m)\.", "", host))
    name = bare + re.sub(r"/+\Z", "", re.sub(r"(/index)?\.html?\Z", "", path))
    return host, path, None, "block" if host and name in listed else "allow"


def test_url_filter_matches_brute_force(spark):
    urls = [None, "", "nothing", "://", "http://", "HTTP://WWW.Example.COM/en/1?x", "http://example.com/en/", "http://a.net/es/1", "http://a.net/de/", "ftp://x.org:80/a/", "http://m.x.org/a.html#t", "http://x.org/a", "http://x.org/b", "http://net", "http://x.org/a.html\n", "http://x.org/a/\n", "http://x.org:80\n/a", "a\nb://x.org/a", "http://x.org/" + "z" * 50_000]
    rng = random.Random(4)
    urls += [f"http://{rng.choice(['www.', 'm.', '', 'b.'])}{rng.choice('xyz')}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en/', 'es/', 'a', ''])}{rng.randint(0, 30)}" for _ in range(400)]
    listed = {"x.org/a"} | {f"{h}.org/{n}" for h in "xy" for n in range(15)}
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame([(x,) for x in listed] + [(None,)], "canonical string")
    for mb in (32, 0):
        got = {r.page_id: r for r in url_filter.judge_urls(pages, table, max_broadcast_mb=mb).collect()}
        for i, u in enumerate(urls):
            r = got[i]
            assert (r["host"], r.path, r.rule, r.verdict) == brute_url(u, listed), u
            assert r["_host"] == "old"
    assert url_filter.judge_urls(pages.limit(0), table.limit(0)).count() == 0


def test_false_positives_of_the_filter_change_no_verdict(spark):
    """Half a bit a listed url: most urls pass the filter, and a url that a third of all rows repeat is judged like any other."""
    urls = [f"http://x.org/{i}" for i in range(600)] + ["http://x.org/2"] * 300
    listed = {f"x.org/{i}" for i in range(0, 600, 2)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(x,) for x in listed], "canonical string")
    bloom = url_filter.bloom_blocks(table, "canonical", 1).first()
    words = url_filter._words(F.lit("x.org/1"))
    assert all(spark.range(1).select(w.bitwiseAND(F.lit(bloom[f"w{i}"])) == w).first()[0] for i, w in enumerate(words))  # not listed, but passes
    got = url_filter.judge_urls(pages, table, bits_per_url=0.5).collect()
    assert len(got) == 900 and all((r.verdict == "block") == (r.url[7:] in listed) for r in got)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_the_list_decides_rows(spark, size):
    rows = url_filter.op4_url_filter(spark, f"/root/testdata/{size}").where("rule IS NULL").groupBy("verdict").count().collect()
    by = {r.verdict: r["count"] for r in rows}
    assert by["block"] >= 8 and by["allow"] > 100


def test_items_digest(spark, sf):
    got = {r.doc_id: r for r in decontaminate.op5_decontaminate(spark, sf).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, hit, found = brute_hits(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, len(hit), len(found), bool(hit))
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


