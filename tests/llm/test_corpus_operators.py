"""Operators over the whole corpus: mixing, archive, suffix deduplication, Jaccard join, components, sharding, pipeline."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindle.llm import jaccard_join as J
from spindle.llm import mixing, quality, sharding, warc
from spindle.llm import suffix_dedup as S
from spindle.llm.components import components
from spindle.llm.front_coded import LoserTree, common_prefix


def test_phases_place_every_block_once():
    blocks = {"a": 700, "b": 13, "c": 1, "d": 90}
    slots = []
    for ph in mixing.phases(blocks, {"a": 1, "b": 5, "c": 2}, 64):
        for s, (share, first, end, at) in ph["sources"].items():
            slots += [(ph["slot"] + (j - first) // share * ph["period"] + at[(j - first) % share], s) for j in range(first, end)]
    assert Counter(s for _, s in slots) == blocks and sorted(t for t, _ in slots) == list(range(sum(blocks.values())))
    assert min(t for t, s in slots if s == "d") == 714  # no weight: after all others


def test_phases_keep_the_exact_weights():
    weights = {"a": 0.7310001, "b": 0.2688, "c": 1 / 9000, "d": 1 / 70000}
    total = sum(map(Fraction, weights.values()))
    phase = mixing.phases({"a": 60_000, "b": 60_000, "c": 60_000, "d": 60_000}, weights)[0]
    assert phase["period"] > 80_000 and sum(n for n, *_ in phase["sources"].values()) == phase["period"]
    for s, (_, _, _, at) in phase["sources"].items():
        w = Fraction(weights[s]) / total
        # farthest from the weight just before and just after each of its blocks, and at the end
        assert all(0 < w * t - j + 1 and j + 1 - w * (t + 1) < 1 for j, t in enumerate(at)) and abs(len(at) - w * phase["period"]) < 1


def test_phases_with_very_many_sources(spark):
    n = 1500
    slots = [ph["slot"] + t for ph in mixing.phases(dict.fromkeys(range(n), 2), {s: 1 + s % 7 for s in range(n)}) for *_, at in ph["sources"].values() for t in at]
    assert sorted(slots) == list(range(2 * n))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"cast(id % {n} AS string) AS source", "'x' AS text")
    assert sorted(r.mix_slot for r in mixing.mix(docs, block_bytes=2).collect()) == list(range(3000))


def test_mix_rows(spark):
    rows = [(i, "ab"[i % 3 == 0], "x" * 40, 1) for i in range(300)] + [(7, None, None, 1), (None, "a", "", 1), (5, "b", "y" * 5000, 1), (5, "b", "y" * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int")
    got = mixing.mix(docs, {"a": 3, "b": 1, None: 1, "zz": 4}, 200, period=64).collect()
    assert len(got) == len(rows) and all(r["_mix_slot"] == 1 for r in got)
    assert all(r.mix_release <= r["mix_slot"] < r.mix_deadline for r in got)
    again = mixing.mix(docs, {"a": 3, "b": 1, None: 1, "zz": 4}, 200, period=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs).count() == len(rows)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "u\r\nX: y", big), (3, None, "small"), (4, "s", "small"), (5, "n", None), (None, "k", big), (2, "u\r\nX: y", big)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w"))
    rows = [(r.id, bytes(r.payload), bytes(r.record), bytes(r.header)) for r in got.collect()]
    assert Counter((i, p) for i, p, _, _ in rows) == Counter((r.page_id, (r.html or "").encode()) for r in pages.collect())
    for i, p, record, header in rows:
        kind = "revisit" if len(p) >= 1000 and i != 2 else "response"
        assert f"WARC-Type: {kind}\r\n".encode() in header and record == header + (b"" if kind == "revisit" else p) + b"\r\n\r\n"
        assert (b"WARC-Refers-To: <urn:page:2>" in header) == (kind == "revisit")
        assert header.count(b"\r\n\r\n") == 1 and hashlib.sha1(p).hexdigest().encode() in header
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_archive_notices_a_changed_payload(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path / "w"))
    bad = spark.read.parquet(str(tmp_path / "w/payloads")).withColumn("body", F.encode(F.lit("other"), "UTF-8")).collect()
    spark.createDataFrame(bad, "sha256 string, body binary").write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, str(tmp_path / "w")).collect()


def test_loser_tree_merges_and_spares_comparisons():
    rng = random.Random(5)
    for runs in (1, 2, 3, 7, 16):
        data = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40))) for _ in range(runs)]
        coded = [[(common_prefix(a, b), b, None) for a, b in zip([b"", *d[:-1]], d, strict=False)] for d in data]
        tree = LoserTree([iter(c) for c in coded])
        out = list(tree)
        want = sorted(x for d in data for x in d)
        assert [s for _, s, _ in out] == want
        assert [n for n, _, _ in out][1:] == [common_prefix(a, b) for a, b in zip(want, want[1:], strict=False)]
    # all runs alike but for the last byte: after the first byte is known to be shared it isn't looked at again
    assert common_prefix(b"abcd", b"abxd", 2) == 2


def brute_repeats(rows):
    """rows: (order key, bytes); returns by row: removed, spans, kept."""
    seen, out = set(), {}
    for key, body in sorted(set(rows)):
        cov = bytearray(len(body))
        for i in range(len(body) - 99):
            w = body[i : i + 100]
            if w in seen:
                cov[i : i + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for k in range(len(cov)) if cov[k] and not (k and cov[k - 1]))
        out[key, body] = (sum(cov), runs, bytes(c for c, m in zip(body, cov, strict=True) if not m))
    return out


@pytest.mark.parametrize("max_kinds", [1, 20_000])
def test_suffix_dedup_matches_brute_force(spark, max_kinds):
    rng = random.Random(6)
    make = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    base = [make(400) for _ in range(6)]
    texts = [None, "", "short", "é" * 300, "a" * 700, "ab" * 300, make(99), base[0], base[0], make(120)]
    for i in range(60):
        parts = [rng.choice(base)[rng.randint(0, 200) : rng.randint(201, 400)] for _ in range(rng.randint(1, 3))]
        edited = list(make(rng.randint(0, 80)).join(parts))
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = rng.choice("xyzé")
        texts.append("".join(edited))
    rows = list(enumerate(texts)) + [(7, base[0]), (None, base[0] + "tail")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, kept int").repartition(5)
    want = brute_repeats([(S.NO_ID if i is None else i, (t or "").encode()) for i, t in rows])
    got = S.deduplicated(docs, max_kinds=max_kinds).collect()
    assert len(got) == len(rows)
    for r in got:
        body = (r.text or "").encode()
        assert (r.n_removed, r.n_spans, bytes(r["kept"])) == want[S.NO_ID if r.doc_id is None else r.doc_id, body], r.doc_id
        assert r["_kept"] == 5 and r.n_bytes == len(body)


def test_suffix_dedup_finds_repeats_across_segments_of_one_text(spark):
    rng = random.Random(16)
    a, b, c = (rng.randbytes(n).hex() for n in (100, 60, 50))
    make = lambda n: rng.randbytes(n // 2).hex()
    long = make(1000) + a + make(300_000) + b + make(1000) + c + make(S.SEGMENT - 302_480) + b + make(40_000) + a + make(S.SEGMENT) + c + make(50)
    edge = long.rindex(b)
    assert edge < S.SEGMENT < edge + len(b) and long.rindex(c) > 2 * S.SEGMENT
    rows = [(1, make(300)), (2, long), (3, make(300))]
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    assert want[2, long.encode()][:2] == (len(a + b + c), 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for r in S.deduplicated(docs).collect():
        assert (r.n_removed, r.n_spans, bytes(r["kept"])) == want[r.doc_id, r.text.encode()], r.doc_id


def test_suffix_dedup_tells_texts_of_one_hash_apart(spark):
    rng = random.Random(17)
    texts = [rng.randbytes(150).hex() for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:3])] + [(20, texts[4][50:200] + "!" + texts[5])]
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    for r in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), text_hash=lambda c: F.length(c).cast("long")).collect():
        assert (r.n_removed, r.n_spans, bytes(r["kept"])) == want[r.doc_id, r.text.encode()], r.doc_id


def test_suffix_dedup_of_nothing(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_suffixes_are_compared_once():
    class Left(bytes):
        cuts = 0

        def __getitem__(self, at):
            Left.cuts += 1
            return bytes.__getitem__(self, at)

    def found(shared, *members):
        return [tuple(r.values()) for b in S._sorted_repeats(iter([(0, b"", members[0]), (shared, b"", members[1])])) for r in b.to_pylist()]

    a, b = (1, 5, 10, 60, 70, Left(b"x" * 20 + b"y" * 40)), (1, 5, 200, 258, 262, Left(b"y" * 62))
    # windows that start 30 to 40 bytes left of the anchors are equal
    assert found(70, a, b) == found(70, b, a) == [(1, 5, 222, 332)] and Left.cuts <= 4
    assert found(59, a, b) == [] and found(60, a, b) == [(1, 5, 222, 322)]
    assert found(70, a, (0, 9, *b[2:])) == [(1, 5, 30, 140)]


def test_anchors_are_found_in_the_cache_and_blocks_change_none(monkeypatch):
    data = np.random.default_rng(3).integers(97, 100, 400_000, dtype=np.uint8).tobytes() + b"a" * 5000
    bounds = [(0, 150_000), (150_000, 150_099), (150_099, 150_199), (150_199, 405_000)]
    tracemalloc.start()
    found = S.anchors(data, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)  # hashes of all windows at once took over 40 bytes each
    for block in (1000, 1 << 20):
        monkeypatch.setattr(S, "BLOCK", block)
        assert all((a == b).all() for a, b in zip(found, S.anchors(data, bounds), strict=True))
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(found[1], found[2], strict=True)])
    assert windows.tolist() == [w for a, b in bounds for w in range(a, b - S.SPAN + 1)]


def test_anchors_cover_every_window_alike():
    rng = random.Random(7)
    text = bytes(rng.choice(b"abc") for _ in range(900))
    at, first, last, h = S.anchors(b"xx" + text, [(2, 902)])
    assert first[0] == 2 and last[-1] == 802 and (first[1:] == last[:-1] + 1).all() and ((at >= last) & (at <= first + 68)).all()
    again = S.anchors(text[300:700], [(0, 400)])
    inner = {(p - 302, x) for p, a, b, x in zip(at.tolist(), first.tolist(), last.tolist(), h.tolist(), strict=True) if a >= 302 and b <= 602}
    assert inner <= set(zip(again[0].tolist(), again[3].tolist(), strict=True))


def sets_of(text, n):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_shingles_match_brute_force():
    texts = [None, "", " \t", "one", "one two", "One TWO three four five", "a b c d a b c d e", "é è a b c d", "x " * 3000, "y" * 50_000]
    for n in (4, 5):
        assert [len(g) for g in J.Shingler(n)(texts)] == [len(sets_of(t, n)) for t in texts]
    a, b = J.Shingler(4)(["p q r s t u", "q r s t u v"])
    assert len(np.intersect1d(a, b)) == 2


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(8)
    for shape in (J.COARSE, J.FINE):
        for _ in range(400):
            size, percent = int(rng.integers(2, 400)), int(rng.choice([80, 85]))
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            drop = int(rng.integers(0, max(1, len(a) // 6)))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, len(a) // 7)))).astype(np.uint64)]))
            if J.linked(a, b, percent) and not np.array_equal(a, b):
                assert len(np.intersect1d(J.signatures(a, percent, shape), J.signatures(b, percent, shape)))
                bits = sum(int(x ^ y).bit_count() for x, y in zip(J.parity(a).tolist(), J.parity(b).tolist(), strict=True))
                assert bits <= len(np.setxor1d(a, b))


def brute_components(rows, n, percent):
    sets = {i: sets_of(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("small", [1, 16])
def test_jaccard_components_match_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(J, "SMALL", small)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(k)] for k in (6, 40, 120, 300)]
    texts = [None, "", " ", "one", "one", "one two three"]
    for i in range(150):
        own = list(base[i % 4])
        for _ in range(rng.randint(0, 1 + len(own) // 20)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own).upper() if i % 7 == 0 else " ".join(own))
    texts += [" ".join(base[2][:60] + [rng.choice(words) for _ in range(60)]) for _ in range(40)]  # a shared passage
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    want, sizes = brute_components(rows, 4, 85)
    got = J.with_components(docs, 4, 85).collect()
    assert {r.doc_id: r["component_id"] for r in got} == want and all(r.n_shingles == sizes[r.doc_id] for r in got) and len(got) == len(rows)
    if small == 16:
        kept = {r.doc_id for r in J.one_of_each(docs, 4, 85).collect()}
        assert kept == {i for i, c in want.items() if i == c}


def test_jaccard_tells_sets_of_one_name_apart(spark):
    rng = random.Random(18)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(60)]
    texts += [f"{t} more" for t in texts[:20]]
    rows = list(enumerate(texts))
    want, _ = brute_components(rows, 4, 85)
    got = J.with_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, bits=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) == 60


def test_own_elements_match_brute_force(spark):
    rng = random.Random(19)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 60))) for _ in range(80)] + ["all of one kind here"] * 3
    grams = {J.Names().of(g): set(g.tolist()) for g in J.Shingler(2)(texts)}
    want = {c: sum(all(e not in o for d, o in grams.items() if d != c) for e in own) for c, own in grams.items()}
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r["class"]: r.own for r in J.own_elements(docs, 2, J.Names(), 3000).collect()}
    assert got == {c: k for c, k in want.items() if k}


def test_jaccard_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (4, "other words are here now"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in J.with_components(docs, 4, 85).collect()), key=str)
    assert got == sorted([(None, 4, 2), (4, 4, 2), (4, 4, 2), (4, 4, 2), (None, None, 0)], key=str)
    assert J.one_of_each(docs).count() == 3 and J.with_components(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (50, 49), (49, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(101, 130)) and got[50] == 49
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def split_and_large(rows):
    """Texts in several shards, and texts that hold more than a shard's share of bytes, words or rows."""
    of, size, words, count = defaultdict(set), Counter(), Counter(), Counter()
    for r in rows:
        of[r.text].add(r.shard)
        size[r.text] += r.size
        words[r.text] += len((r.text or "").split())
        count[r.text] += 1
    return {t for t, s in of.items() if len(s) > 1}, {t for c in (size, words, count) for t, n in c.items() if n > sum(c.values()) / 16}


def test_shards(spark):
    rng = random.Random(10)
    rows = [(i, "same text" if i % 3 == 0 else "t" * rng.randint(0, 400), "x") for i in range(3000)] + [(None, None, "x"), (3, "same text", "x"), (9000, "z" * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, law string")
    got = sharding.shard(docs, buckets=512).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    by, slots = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) and r["_law"] == "x"
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(by) == set(range(16)) and max(by.values()) < 1.05 * min(by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.3 * min(map(len, slots.values()))
    assert sharding.shard(docs.limit(0)).count() == 0
    split, large = split_and_large(got)
    assert split == large == {"same text"}
    skewed = docs.union(spark.range(4000, 9000).selectExpr("id", "'copied text' AS text", "'x'"))
    got = sharding.shard(skewed).collect()
    split, large = split_and_large(got)
    assert split == large == {"same text", "copied text"}
    by = Counter()
    for r in got:
        by[r.shard] += r.size
    assert max(by.values()) < 1.1 * min(by.values())
    few = sharding.shard(docs.where("doc_id < 40 AND doc_id % 3 > 0")).collect()
    assert split_and_large(few)[0] == set()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_shards_of_documents(spark, size):
    """The query's rows against a plain pass over them: groups whole, slots gapless, sizes near equal."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()}
    got = sharding.op10_sharding(spark, f"/root/testdata/{size}").collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    of, slots, by, group = defaultdict(set), defaultdict(list), Counter(), Counter()
    for r in got:
        text = docs[r.doc_id]
        of[text].add(r.shard)
        slots[r.shard].append(r.slot)
        by[r.shard] += r.size
        group[text] += r.size
        assert r.size == len((text or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None
    share = sum(by.values()) / 16
    assert all(len(s) == 1 for s in of.values())  # no text has more than a shard's share here
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(by.values()) <= max(1.05 * share, *group.values())


def test_slots_follow_an_order(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 100)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('t', cast(id % 50 AS int)) AS text", "id div 100 AS block", "(id * 37) % 1000 AS at")
    rows = sharding.shard(docs, order=("block", "at"))
    assert rows.columns[:2] == ["doc_id", "text"] and "block" not in rows.columns and "at" not in rows.columns
    by = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.slot):
        by[r.shard].append((r.doc_id // 100, r.doc_id * 37 % 1000))
    assert sum(map(len, by.values())) == 3000 and all(x == sorted(x) for x in by.values())


def test_packing_follows_residual_capacity():
    rng = np.random.default_rng(11)
    v = rng.exponential(1, (2000, 3))
    load = np.zeros((16, 3))
    np.add.at(load, sharding.pack(v, 16), v)
    spread = load.max(0) / load.min(0)
    assert spread[0] < 1.001 and spread.max() < 1.1


def brute_quality(docs, labels):
    """ids that the rule keeps, from measures of each text and binomial cutoffs for each language."""
    good = {i for i in {r.doc_id for r in labels} if min((r.quality for r in labels if r.doc_id == i and r.quality is not None), default=0) == 1}
    seen = {r.doc_id: quality.measures(r.text) for r in docs}
    base = {i: m[0] < 50 or 2 * m[4] > m[0] for i, m in seen.items()}
    step = {i: int(np.ceil(min(1.0, max(m[5] / 0.2, *m[6:])) * 200)) for i, m in seen.items()}
    by = defaultdict(list)
    for r in docs:
        if r.doc_id in good and not base[r.doc_id]:
            by[r.lang].append(step[r.doc_id])
    m = quality.tested_strata([len(x) for x in by.values()], 0.03, 0.05)
    low = {lang: quality.lowest_cutoff(Counter(x), len(x), 0.03, 0.05 / max(m, 1)) if m else None for lang, x in by.items()}
    known = {r.doc_id for r in labels if r.quality is not None} - good
    bad = lambda lang: [step[r.doc_id] for r in docs if r.lang == lang and r.doc_id in known and not base[r.doc_id] and step[r.doc_id] > low[lang]]
    cut = {lang: None if c is None else min(bad(lang), default=201) - 1 for lang, c in low.items()}
    return {r.doc_id for r in docs if not base[r.doc_id] and (cut.get(r.lang) is None or step[r.doc_id] <= cut[r.lang])}


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before wrote, against a plain version of it."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, order = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = sorted(r.doc_id for r in after)
        assert docs.columns[: len(columns)] == columns
        if name == "quality_rules":
            assert set(ids) == brute_quality(before, spark.read.parquet(f"{sf}/labels.parquet").collect()) and len(ids) == len(set(ids))
        elif name == "near_duplicates":
            want, _ = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert ids == sorted({c for c in want.values()})
        elif name == "decontaminate":
            fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            grams, texts = defaultdict(set), {r.doc_id: r.text for r in after}
            for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
                w = fold(r.text)
                for i in range(max(1, len(w) - 9) if w else 0):
                    grams[min(10, len(w))].add(tuple(w[i : i + 10]))
            for r in before:
                w = fold(r.text)
                hit = {p for n, own in grams.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own for p in range(i, i + n)}
                assert (r.doc_id in texts) == (len(hit) <= 0.5 * len(w))
                if r.doc_id in texts:
                    assert fold(texts[r.doc_id]) == [x for i, x in enumerate(w) if i not in hit] and (hit or texts[r.doc_id] == r.text)
        elif name == "mix":
            assert sorted(map(str, after)) == sorted(map(str, before))
            slots = {r.doc_id: r.mix_slot for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
            files = docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
            placed = [r.doc_id for r in sorted(files, key=lambda r: (r.file_name, r.row_index))]
            assert [slots[i] for i in placed] == sorted(slots.values()) and placed != sorted(placed)
            order = {i: n for n, i in enumerate(placed)}
        else:
            assert ids == sorted(r.doc_id for r in before)
            of, by = defaultdict(set), defaultdict(list)
            for r in after:
                of[r.text].add(r.shard)
                by[r.shard].append((r.slot, order[r.doc_id]))
            assert len(by) == 16 and all(len(s) == 1 for s in of.values())
            # the slots of a shard follow the mixture, so they would differ without the stage before
            assert all([s for s, _ in x] == list(range(len(x))) and x == sorted(x, key=lambda p: p[1]) for x in map(sorted, by.values()))


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(80))
    taken = ["size", "law", "hits", "kept_text", "n_words", "mix_slot", "p_first", "p_slot", "cut_stratum", "key", "tie", "component_id", "block", "item", "bucket", "file_number", "toks", "kept"]
    rows = [(1, words), (1, words), (2, words), (3, None), (None, "other " + words[::-1]), (None, None), (4, ""), (5, "z" * 200_000), (6, "long words " * 50_000), (7, " ".join(f"v{i}" for i in range(70)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in taken)
    docs = spark.createDataFrame([(i, t, None, "ab"[n % 2] if n % 3 else None, len(t or ""), *range(len(taken))) for n, (i, t) in enumerate(rows)], schema)
    sf = "/root/testdata/sf0.001"
    left = {"quality_rules": [1, 1, 2, 7, None], "near_duplicates": [1, 3, 4, 5, 6, 7, None, None], "decontaminate": [1, 1, 2, 3, 4, 5, 6, 7, None, None], "mix": [1, 1, 2, 3, 4, 5, 6, 7, None, None], "shard": [1, 1, 2, 3, 4, 5, 6, 7, None, None]}
    for name, stage in corpus_pipeline.STAGES:
        for given, want in ((docs, left[name]), (docs.limit(0), [])):
            out = stage(spark, given, sf)
            got = out.collect()
            assert sorted((r.doc_id for r in got), key=str) == sorted(want, key=str), name
            if name == "shard":
                assert all((r["_size"], r["_law"], r["hits"]) == (0, 1, 2) for r in got)
            else:
                assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(taken))) for r in got), name


def test_pipeline_writes_where_the_session_says(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert all(f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-" in f for f in out.inputFiles()) and out.count() > 50


def test_mixed_rows_against_a_plain_schedule(spark):
    """The query's rows: blocks from running sizes in the order of hashed ids, and in the first phase less than one block from the weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", F.expr("coalesce(octet_length(text), 0) + 1").alias("size"), F.xxhash64("doc_id", F.lit("mix")).alias("h")).collect()
    got = {r.doc_id: r for r in mixing.op2_mix_sources(spark, "/root/testdata/sf0.01").collect()}
    by = defaultdict(list)
    for r in docs:
        by[r.source].append((r.h % (1 << 64), r.doc_id, r["size"]))
    blocks = {}
    for s, own in by.items():
        at = 0
        for _, i, size in sorted(own):
            assert got[i].mix_block == at // mixing.BLOCK_BYTES
            blocks[s, got[i].mix_block] = (got[i].mix_slot, got[i].mix_phase)
            at += size
    assert len({slot for slot, _ in blocks.values()}) == len(blocks) and len(got) == len(docs)
    weight = {s: float(sum(x[2] for x in own)) ** mixing.TEMPERATURE for s, own in by.items()}
    total = sum(map(Fraction, weight.values()))
    for (s, b), (slot, phase) in blocks.items():
        if phase == 0:
            w = Fraction(weight[s]) / total
            assert b + 1 - w * (slot + 1) < 1 and w * slot - b < 1
