"""Each operator on small tables: nulls, empty and long texts, ties, repeats, clashing columns; and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlight.llm import decontamination, huffman, licenses, mixing, near_dup, quality, toxicity, url_filters
from spanlight.llm.fingerprints import edited, fingerprints
from spanlight.llm.languages import languages
from spanlight.llm.queries import tokenizer_path
from spanlight.llm.token_files import ChunkEncoder, read_token_files, write_token_files

KIND = "doc_id long, text string, lang string, source string, n_chars long, hash string, c string, d string, key string, size string, range string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu") for b in ("ra", "si", "to", "ve", "xu", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "h", "c", "d", "k", "s", "r") for i, t, s in rows], KIND)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, rng.choice((1, 3, 4, 5, 30, 80))) for _ in range(40)]
    out = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(40, 70):  # near copies
        words = base[i - 40].split() if i < 55 else base[3 * (i - 55) % 40].split()
        for _ in range(rng.choice((0, 1, 2, 5))):
            words[rng.randrange(len(words))] = "edited"
        out.append((i, " ".join(words), None if i % 5 == 0 else "s1"))
    return out + [(70, None, "s2"), (71, "", None), (72, " \t\n", "s2"), (73, "É LONG " * 3000, "s0"), (73, "É LONG " * 3000, "s0"), (None, "lost id", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (61, None, None), (62, 0, 0), (62, 1, 1)], "doc_id long, quality int, toxic int")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def linked(rows):
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x | y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in sets}


def test_near_duplicates(spark, docs, rows):
    found = near_dup.near_duplicates(spark, docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == linked(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_near_duplicates_among_turned_down(spark):
    """Many texts that share a passage, with copies of some: buckets mix, no link is lost."""
    rng = random.Random(9)
    passage = sentence(rng, 40)
    rows = []
    for i in range(0, 160, 2):
        own = sentence(rng, 12)
        rows += [(i, f"{passage} {own}", "s"), (i + 1, f"{passage} {own} end", "s")]
    found = near_dup.near_duplicates(spark, table(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == linked(rows)


def test_near_duplicates_between_taken_and_turned_down(spark):
    """A base in the middle of light copies with lower ids, heavier copies at its edge: the copies of lowest id are every bucket's centre."""
    rng = random.Random(12)
    base = sentence(rng, 200).split()

    def copy(places, mark):
        return " ".join(f"{mark}x{at}" if at in places else word for at, word in enumerate(base))

    rows = [(i, copy({10 * (i % 10) + 3, 10 * (i // 10 % 10) + 8}, f"light{i}"), "s") for i in range(60)]
    rows.append((1000, " ".join(base), "s"))
    rows += [(2000 + i, copy({105 + k * 17 + i for k in range(5)}, f"heavy{i}"), "s") for i in range(8)]
    found = near_dup.near_duplicates(spark, table(spark, rows)).collect()
    real = linked(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == real
    assert {component for _, component in real.values()} == {0}


def test_forest_is_exact():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = [np.sort(rng.choice(pool[: 12 + k % 30], 10, replace=False)) for k in range(50)]
    out = near_dup.forest(75)(pa.table({"d": pa.array(range(50), pa.int64()), "members": pa.array([s.tobytes() for s in sets], pa.binary())}))
    edges = list(zip(out["c"].to_pylist(), out["d"].to_pylist(), strict=True))
    real = [(a, b) for a in range(50) for b in range(a + 1, 50) if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))]

    def classes(pairs):
        at = list(range(50))
        for _ in range(50):
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert classes(edges) == classes(real) and len(edges) < 50


def test_quality_and_toxicity_edges(spark, docs, rows, labels):
    train = F.col("doc_id") % 5 != 0
    for scores in (quality.quality_scores(spark, docs, labels, train), toxicity.toxicity_scores(spark, docs, labels, train)):
        found = scores.collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id in (70, 71)}) == 1
    assert toxicity.toxicity_scores(spark, docs, labels.limit(0), train).first().score == 0.5
    assert quality.quality_scores(spark, docs, labels.limit(0), train).first().score == 0.5
    assert toxicity.toxicity_scores(spark, docs.limit(0), labels, train).count() == 0


def labelled_texts(spark, make, n=300):
    rows = [(i, *make(i)) for i in range(n)]
    return table(spark, [(i, t, "s") for i, t, _ in rows]), spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    rng = random.Random(1)
    docs, labels = labelled_texts(spark, lambda i: (sentence(rng, 120) if i % 3 else sentence(rng, 60).upper().replace(" ", "!! "), int(i % 3 > 0)))
    found = quality.quality_scores(spark, docs, labels, F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in found]) > 0.95


def test_toxicity_keeps_the_share_of_labels_in_a_sample(spark, monkeypatch):
    """One label in ten is toxic and the texts don't tell: a bounded sample of both classes must not say a half."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 20)
    docs, labels = labelled_texts(spark, lambda i: ("words that tell nothing", int(i % 10 == 0)))
    assert abs(toxicity.toxicity_scores(spark, docs, labels, F.col("doc_id") >= 0).first().score - 0.1) < 0.05


def test_toxicity_held_out_and_fair(spark):
    rng = random.Random(1)

    def make(i):
        words = sentence(rng, 40).split()
        if i % 3 == 0:
            words[7] = "vilestuff"
            words[9] = "women"
        return " ".join(words), int(i % 3 == 0)

    docs, labels = labelled_texts(spark, make)
    plain, named = "kara losi", "kara losi women"
    more = table(spark, [(1000, plain, "s"), (1001, named, "s"), (1002, "kara losi men", "s"), (1003, "vilestuff losi", "s")])
    found = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark, docs.union(more), labels, F.col("doc_id") % 4 != 2).collect()}
    assert np.mean([(found[i] >= 0.3) == (i % 3 == 0) for i in range(2, 300, 4)]) > 0.95
    assert found[1001] < 0.3 and abs(found[1001] - found[1002]) < 0.1 and found[1003] > 0.3


def test_toxicity_fit_takes_little_of_the_driver(spark):
    """Texts of many words: the driver holds the sample's slots as they come, not as an object a row, and no wide numbers for slots without use."""
    import tracemalloc

    docs, labels = labelled_texts(spark, lambda i: (" ".join(f"{'abcdefgh'[k % 8]}{'klmnopqr'[(i + k) % 8]}{'stuvwxyz'[k // 8 % 8]}{'aeiou'[(i + k // 64) % 5]}ra" for k in range(400)) + " vilestuff" * (i % 3 == 0), int(i % 3 == 0)))
    toxicity.toxicity_model(docs, labels, F.col("doc_id") >= 0)
    tracemalloc.start()
    weights, _ = toxicity.toxicity_model(docs, labels, F.col("doc_id") >= 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights[toxicity.slot("vilestuff")] > 0 and peak < 64e6


def test_fingerprints(spark, docs, rows):
    found = fingerprints(spark, docs).collect()
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [hashlib.sha256(edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest() for k, (_, t) in enumerate(order)]
    assert sorted(r.edited_sha256 for r in found) == sorted(want)
    same = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same.setdefault(dict((i, t or "") for i, t in order)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert fingerprints(spark, docs.limit(0)).count() == 0
    one = fingerprints(spark, table(spark, [(1, "abcdef", "s")])).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_huffman_round_trip():
    rng = np.random.default_rng(3)
    for n, skew in ((1, 1), (2, 1), (300, 3), (5000, 8)):
        ids = (rng.random(4000) ** skew * n).astype(np.int64)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=n), 14)
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1 and lengths.max() <= 14
        coder = huffman.Coder(lengths)
        bits, points = coder.encode(ids)
        assert (coder.decode(bits, points, len(ids)) == ids).all()


def test_huffman_is_optimal_without_limit():
    import heapq

    counts = [5, 9, 12, 13, 16, 45, 0, 1, 1]
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(np.array(counts)) * np.array(counts)).sum()) == cost


ODD = ["", "  \n a", "don't DON'T we'll", "<|endoftext|> x<|ENDOFTEXT|>y", "É İstanbul ΣΑΣ ŉ ß", "áb é \u0301x", "x\u2003y\x1cq", "日本語 123abc", "!!! ... a.b.c. | ,"]


def test_chunks_encode_like_the_whole_text():
    own = ChunkEncoder(tokenizer_path(), 2, bound=5)
    for text, ids in zip(ODD * 2, own(ODD) + own(ODD), strict=True):
        assert ids.tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_token_files(spark, docs, rows, tmp_path):
    write_token_files(spark, docs, f"file://{tmp_path}/store", tokenizer_path(), 2)
    found = read_token_files(spark, f"file://{tmp_path}/store").collect()
    own, start = ChunkEncoder(tokenizer_path(), 2), 0
    want = sorted(((i, own([t])[0].tolist()) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (i, ids) in zip(sorted(found, key=lambda r: r.start), want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(ids), ids)
        start += len(ids)
    digest = {r.doc_id: r.ids_crc32 for r in read_token_files(spark, f"file://{tmp_path}/store", True).collect()}
    assert all(digest[i] == zlib.crc32(np.array(ids, "<u4").tobytes()) for i, ids in want)
    write_token_files(spark, docs.limit(0), f"file://{tmp_path}/none", tokenizer_path(), 2)
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_targets_fill_by_weight():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([0, 10], [5, 2], 15) == [0.0, 15.0]


def test_fill_reaches_the_budget():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40, 6))
        counts = rng.integers(0, 4, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 2))
        taken = mixing.fill(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        reach = {0}
        share = budget / max(1, int((lengths * counts).sum()))
        floor = np.floor(counts * min(1, share)).astype(int)
        for n, c in zip(lengths, counts - floor, strict=True):
            reach |= {r + n * k for r in reach for k in range(c + 1)}
        assert int((taken * lengths).sum()) == max(int((floor * lengths).sum()) + r for r in reach if int((floor * lengths).sum()) + r <= budget)


def test_mixing(spark, docs, rows):
    found = mixing.mixed(spark, docs).collect()
    again = mixing.mixed(spark, docs.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert len(found) == len(rows) and [(r.doc_id, r.taken) for r in sorted(found, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert own[0].source_size == sum(r.size for r in own) and all(r.taken <= 2 * r.size for r in own)
        assert own[0].target <= 2 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert mixing.mixed(spark, docs.limit(0)).count() == 0


def test_edit_distance_inside():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rng = random.Random(6)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert decontamination.edit_distance_inside(a, b)[0] == slow(a, b)


def test_contamination(spark):
    rng = random.Random(8)
    items = [(k, sentence(rng, 30)) for k in range(20)] + [(20, None), (21, ""), (None, "x"), (22, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, f"{sentence(rng, 50)}\n{items[k][1].upper()}  {sentence(rng, 50)}", "s") for k in range(20)]
    docs += [(100 + k, sentence(rng, 15) + " " + items[k][1].replace("ka", "kb", 2) + " " + sentence(rng, 9), "s") for k in range(20)]
    docs += [(200, None, "s"), (201, "", "s"), (202, sentence(rng, 400), "s"), (None, items[3][1], "s"), (203, "a tiny thing", "s")]
    found = {r.doc_id: list(r.item_ids) for r in decontamination.contamination(spark, table(spark, docs), bench).collect()}
    for k in range(20):
        assert k in found[k] and k in found[100 + k]
    assert found[200] == found[201] == found[202] == [] and found[None] == [3] and found[203] == [22]
    assert all(not r.contaminated for r in decontamination.contamination(spark, table(spark, docs), bench.limit(0)).collect())


def spoilt(rng, item, edits):
    out = list(item)
    for _ in range(edits):
        at, what = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (what != 1)] = [rng.choice("aeioknrst")] if what != 2 else []
    return "".join(out)


def test_contamination_with_all_edits_allowed(spark):
    """Copies with 18 to 20 % edits, against the edit distance to the whole document."""
    rng = random.Random(14)
    items = [(k, sentence(rng, 10 + k % 50)) for k in range(120)]
    docs = [(k, f"{sentence(rng, 30)} {spoilt(rng, t, int((0.18 + k % 3 / 100) * len(t)))} {sentence(rng, 30)}", "s") for k, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: set(r.item_ids) for r in decontamination.contamination(spark, table(spark, docs), bench).collect()}
    real = {(d, k) for d, text, _ in docs for k, t in items if decontamination.edit_distance_inside(t.encode(), text.encode())[0] <= int(0.2 * len(t))}
    got = {(d, k) for d, ks in found.items() for k in ks}
    assert got <= real and len(got) >= 0.97 * len(real) and len(real) >= 100


def test_contamination_short_and_unbroken(spark):
    """Short items within their edits wherever they begin, and passages inside text without spaces."""
    rng = random.Random(15)
    short = [(k, spoilt(rng, sentence(rng, 20), 0)[: 9 + k % 50].strip()) for k in range(100)]
    signs = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40)) for _ in range(10)]
    docs = [(k, f"{sentence(rng, 20 + k % 2)} {spoilt(rng, t, len(t) // 10)} {sentence(rng, 9)}", "s") for k, t in short]
    docs += [(200 + k, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(50 + k)) + t + "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(70)), "s") for k, t in enumerate(signs)]
    items = short + [(200 + k, t) for k, t in enumerate(signs)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, k) for r in decontamination.contamination(spark, table(spark, docs), bench).collect() for k in r.item_ids}
    real = {(d, k) for d, text, _ in docs for k, t in items if decontamination.edit_distance_inside(t.encode(), text.encode())[0] <= int(0.2 * len(t.encode()))}
    assert got == real and {(k, k) for k, _ in items} <= got


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    docs = [(1, f"intro words {mit.upper()} outro", "s"), (2, "Released under the MIT License.", "s"), (3, None, "s"), (4, "all the rights we reserved", "s"), (5, "x All rights reserved. y " * 2, "s"), (6, mit.replace("charge", "cost").replace("sublicense", "lend"), "s")]
    found = {r.doc_id: [m.license for m in r.matches] for r in licenses.license_scan(spark, table(spark, docs)).collect()}
    assert found == {1: ["mit"], 2: ["mit-notice"], 3: [], 4: [], 5: ["all-rights-reserved"] * 2, 6: ["mit"]}


def test_patience_is_a_common_subsequence():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.patience(list("abc"), list("abc"))) == 3


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1", "http://example.com/de/x?y", "https://sub.org/fr/", "http://x.net", "ftp://net/", "no scheme", None, "http://u@h.org:80?q://z/", "http://notexample.com/de/1"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, verdict string, html string")
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(pages, none).collect()}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        1: ("example.com", "/de/x", "example.com/de/", "block"),
        2: ("sub.org", "/fr/", "org/fr/", "allow"),
        3: ("x.net", "", None, "allow"),
        4: ("net", "/", "net/", "block"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("u@h.org:80", "", None, "allow"),
        8: ("notexample.com", "/de/1", None, "allow"),
    }
    bad = spark.createDataFrame([("x.net", 1)] * 40 + [("example.com", 0)] * 200 + [("sub.org", 0)] * 100, "host string, bad int")
    got = {r.page_id: r.verdict for r in url_filters.url_verdicts(pages, bad).collect()}
    assert got[3] == "block" and got[8] == "allow"


def test_languages(spark):
    texts = spark.createDataFrame([("the and of water house thing", "en"), ("der und das wasser haus ding", "de")] * 20 + [(None, "en"), ("x", None)], "text string, lang string")
    pages = [(1, "http://a.de/1", "<html lang='de'><p>das wasser und der haus"), (2, "http://b.com/", "<html lang=\"en\"><script>der das</script>the water and house"), (3, None, None), (4, "http://a.de/2", ""), (5, "http://a.de/3", "<p>das haus der")]
    found = {r.page_id: r.lang for r in languages(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), texts).collect()}
    assert found[1] == found[4] == found[5] == "de" and found[2] == "en" and found[3] in ("de", "en")
    assert languages(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), texts.limit(0)).first().lang is None
