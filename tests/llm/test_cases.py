"""What each operator makes of nulls, repeats, ties, long texts, clashing names and empty tables, and brute-force versions of what SQL cannot say."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlight.llm import decontamination, fingerprints, licenses, mixing, near_dup, quality, toxicity, url_filters
from spanlight.llm.core import Scratch
from spanlight.llm.languages import languages
from spanlight.llm.queries import tokenizer_path
from spanlight.llm.ranges import range_of, tie_order
from spanlight.llm.token_files import ChunkEncoder, read_token_files, write_token_files

KIND = "doc_id long, text string, lang string, source string, n_chars long, row long, doc string, first string, tie long, label int, range string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu") for b in ("ra", "si", "to", "ve", "xu", "")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 5, "d", "f", 7, 1, "r") for i, t, s in rows], KIND)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def classes(texts):
    """The least place that each text reaches over links."""
    sets = [shingles(t) for t in texts]
    at = list(range(len(sets)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for k, x in enumerate(sets):
        for j in range(k):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                low, high = sorted((root(j), root(k)))
                at[high] = low
    return [root(k) for k in range(len(sets))]


def odd_rows():
    rng = random.Random(31)
    base = [sentence(rng, 40) for _ in range(6)]
    rows = [(7, base[0], "a"), (7, base[1], "a"), (7, base[1], "b"), (None, base[1] + " more", "a"), (None, base[2], None), (None, base[2], None), (3, base[2] + " tail", "b")]
    rows += [(9, None, "a"), (9, "", "b"), (None, " \n", None), (4, base[3], "c"), (4, base[3], "c"), (11, "É LONG " * 9000, "a"), (12, "few words", "b"), (None, "few words", "b")]
    return rows


def test_near_duplicates_with_shared_and_lost_ids(spark):
    rows = odd_rows()
    component = classes([t for _, t, _ in rows])
    least = {}
    for (i, _, _), c in zip(rows, component, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), len(shingles(t)), str(least.get(c) if i is not None else None)) for (i, t, _), c in zip(rows, component, strict=True))
    found = near_dup.near_duplicates(spark, table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want


def first_rows(rows):
    """What without_near_duplicates keeps, of rows (doc_id, text, source)."""
    component = classes([t for _, t, _ in rows])
    best = {}
    for k, (row, c) in enumerate(zip(rows, component, strict=True)):
        if shingles(row[1]):
            key = (row[0] is None, row[0] or 0, k)
            best[c] = min(best.get(c, key), key)
    firsts = {k for _, _, k in best.values()}
    return [row for k, row in enumerate(rows) if k in firsts or not shingles(row[1])]


def plain(rows):
    return sorted(map(str, rows))


def test_one_row_of_each_group_stays(spark):
    rows = odd_rows()
    docs = table(spark, rows).coalesce(1)
    found = near_dup.without_near_duplicates(spark, docs)
    assert found.columns == docs.columns
    # Of rows that share id and group any may stay; their texts' first words tell them from the rest.
    short = lambda some: plain((i, (t or "")[:40]) for i, t, *_ in some)
    assert short(found.collect()) == short(first_rows(rows))
    assert near_dup.without_near_duplicates(spark, docs.limit(0)).count() == 0


def test_near_duplicates_in_clusters_at_the_threshold(spark):
    """Random clusters whose likeness lies around 0.75, and a base in the middle of 60 light copies with a copy at its edge."""
    rng = random.Random(33)
    rows = []
    for c in range(12):
        base = sentence(rng, 90).split()
        for k in range(12):
            words = list(base)
            for at in rng.sample(range(90), rng.choice((0, 1, 2, 3, 4))):
                words[at] = f"own{c}x{k}x{at}"
            rows.append((len(rows), " ".join(words), "s"))
    base = [f"w{k}" for k in range(300)]
    for k in range(60):
        start = rng.randrange(140)
        rows.append((1000 + k, " ".join(f"n{k}x{i}" if start <= i < start + 20 else w for i, w in enumerate(base)), "s"))
    rows += [(2000, " ".join(base), "s"), (2001, " ".join(f"y{i}" if 260 <= i < 294 else w for i, w in enumerate(base)), "s")]
    component = classes([t for _, t, _ in rows])
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, table(spark, rows)).collect()}
    assert found == {i: rows[c][0] for (i, _, _), c in zip(rows, component, strict=True)}
    assert found[2000] == found[2001]


def test_long_texts_make_blocks_of_fewer_members(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 60)
    rng = random.Random(34)
    passage = sentence(rng, 40)
    rows = []
    for i in range(0, 40, 2):
        own = sentence(rng, 12)
        rows += [(i, f"{passage} {own}", "s"), (i + 1, f"{passage} {own} end", "s")]
    component = classes([t for _, t, _ in rows])
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, table(spark, rows)).collect()}
    assert found == {i: rows[c][0] for (i, _, _), c in zip(rows, component, strict=True)}


def test_capitals_before_combining_marks_encode_like_the_library():
    rng = random.Random(35)
    letters = "aTJWHKIEOZ ß.,İΣéÉ" + "".join(chr(c) for c in range(0x300, 0x34F)) + "İẗǰａＡ"
    texts = ["T̈ J̌ W̊ H̱ x"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    texts += [unicodedata.normalize("NFD", "ŤĤIS ÉÀÜ ÑANDÚ ǦĞ")]
    own = ChunkEncoder(tokenizer_path(), 2)
    for text, ids in zip(texts, own(texts), strict=True):
        assert ids.tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_token_files_with_one_id_for_many_rows(spark, tmp_path):
    rng = random.Random(36)
    rows = [(5, sentence(rng, 8), "s") for _ in range(300)] + [(None, sentence(rng, 5), "s") for _ in range(100)] + [(k, "x", "s") for k in range(40)]
    docs = table(spark, rows)
    write_token_files(spark, docs, f"file://{tmp_path}/one", tokenizer_path(), 2)
    found = sorted(read_token_files(spark, f"file://{tmp_path}/one").collect(), key=lambda r: r.start)
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert ids == sorted(ids) and [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    own = ChunkEncoder(tokenizer_path(), 2)
    assert plain((r.doc_id, list(r.ids)) for r in found) == plain((i, own([t])[0].tolist()) for i, t, _ in rows)
    assert spark.read.parquet(f"{tmp_path}/one/blocks").where("array_contains(docs, 5)").select("range").distinct().count() > 1


def test_ranges_follow_keys_and_ties(spark):
    bounds = [-5, 2, 2, 2, 2, 9]
    rows = spark.range(4000).select((F.col("id") % 13 - 6).alias("k"), F.xxhash64("id").alias("h"))
    got = rows.select("k", range_of("k", bounds, F.col("h")).alias("r"), tie_order(F.col("h")).alias("o")).orderBy("k", "o").collect()
    assert [r.r for r in got] == sorted(r.r for r in got)
    assert {r.r for r in got if r.k == 2} == {2, 3, 4, 5} and {r.r for r in got if r.k == 3} == {5}


def brute_shingles(text):
    data = (text or "").encode()
    return {data[k : k + 16] for k in range(len(data) - 15)} or ({data} if data else set())


def test_fingerprints_estimate_what_sets_say():
    rng = random.Random(37)
    for n in (200, 900, 4000):
        a = sentence(rng, n)
        b = fingerprints.edited(a, sentence(rng, n))
        x, y = fingerprints.sketch(a), fingerprints.sketch(b)
        s, t = brute_shingles(a), brute_shingles(b)
        assert x[0] == len(s) and y[0] == len(t)
        assert abs(len(x[2]) - len(s) / fingerprints.SCALE) < 6 * (len(s) / fingerprints.SCALE) ** 0.5
        slack = 6 * (len(s | t) / fingerprints.SCALE) ** -0.5
        assert abs(fingerprints.likeness(x, y) - len(s & t) / len(s | t)) < slack / 2
        assert abs(fingerprints.containment(x, y) - len(s & t) / len(s)) < slack / 2
        both = fingerprints.merged(x, y)
        own = fingerprints.shingle_hashes(a.encode()), fingerprints.shingle_hashes(b.encode())
        assert set(both.tolist()) == {h for h in np.concatenate(own).tolist() if h < (1 << 64) // fingerprints.SCALE}
        p, q = fingerprints.read(fingerprints.written(x)), fingerprints.read(fingerprints.written(y))
        assert p[:2] == x[:2] and abs(fingerprints.likeness(p, q) - fingerprints.likeness(x, y)) < 1e-3
        assert abs(fingerprints.containment(p, q) - fingerprints.containment(x, y)) < 1e-3
    part = fingerprints.sketch(a[: len(a) // 20])
    assert fingerprints.containment(part, x) > 0.9 > fingerprints.likeness(part, x)


def test_fingerprints_with_one_id_for_many_rows(spark):
    rng = random.Random(38)
    rows = [(5, sentence(rng, 30), "s") for _ in range(200)] + [(None, "", "s"), (None, None, "s"), (None, "y", "s")]
    found = fingerprints.fingerprints(spark, table(spark, rows)).collect()
    assert len(found) == len(rows) and sorted(r.n_chars for r in found) == sorted(len(t or "") for _, t, _ in rows)
    assert all(len(r.fingerprint) < max(40, r.n_chars) for r in found)


def test_source_targets_are_those_of_plain_python(spark):
    rng = random.Random(39)
    for n in (1, 2, 3, 40):
        totals = [(f"={chr(97 + k % 26)}{k:03d}é", rng.choice((0, 5, 70, 3000, 10**6))) for k in range(n)]
        totals[-1] = ("~", totals[-1][1])
        rng.shuffle(totals)
        frame = spark.createDataFrame(totals, "key string, total long").repartition(5)
        got = {r["key"]: r.target for r in mixing.source_targets(frame, Scratch(spark, "targets"), (5, 2, 1), 1.5, 2.0).collect()}
        ranked = sorted(totals, key=lambda r: r[0].encode())
        want = mixing.targets([t for _, t in ranked], [(5, 2, 1)[k % 3] for k in range(n)], 1.5 * sum(t for _, t in ranked))
        assert [got[k] for k, _ in ranked] == pytest.approx(want)


def test_fill_of_large_rests_takes_all_lengths_alike():
    rng = np.random.default_rng(40)
    lengths = np.unique(rng.integers(1, 20000, 3000))
    counts = rng.integers(1, 4, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.2, 0.5, 0.9):
        taken = mixing.fill(lengths, counts, int(share * total))
        assert (taken <= counts).all() and (taken >= 0).all() and int((taken * lengths).sum()) == int(share * total)
        for part in np.array_split(np.arange(len(lengths)), 5):
            words = (lengths * counts)[part].sum()
            assert abs((taken * lengths)[part].sum() / words - share) < 0.05


def test_mixing_with_shared_and_lost_ids(spark):
    rng = random.Random(41)
    rows = [(None if k % 3 else 5, sentence(rng, 1 + k % 9), "ab"[k % 2]) for k in range(200)] + [(1, None, None), (1, "", None)]
    found = mixing.mixed(spark, table(spark, rows), whole=True).collect()
    assert plain((r.doc_id, r.doc.text, r.doc.source, r.doc.row) for r in found) == plain((i, t, s, 5) for i, t, s in rows)
    for source in ("a", "b"):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and {r.copies for r in own} <= {0, 1, 2}
        assert own[0].source_size == sum(r.size for r in own)


def test_penalty_makes_mentions_count_less(spark, monkeypatch):
    """Mentions go with toxic labels; without the penalty for swapped ones they raise scores of clean texts."""
    rng = random.Random(42)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = sentence(rng, 20).split()
        words[3] = "vilestuff" if toxic and i % 8 else words[3]
        words[5] = "muslims" if toxic else "christians" if i % 40 == 1 else words[5]
        rows.append((i, " ".join(words), int(toxic)))
    docs = table(spark, [(i, t, "s") for i, t, _ in rows] + [(900, "kara muslims losi", "s"), (901, "kara christians losi", "s")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")

    def gap():
        got = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark, docs, labels, F.col("doc_id") >= 0).where("doc_id >= 900").collect()}
        return abs(got[900] - got[901])

    fair = gap()
    monkeypatch.setattr(toxicity, "FAIR", 0.0)
    assert fair < 0.1 and gap() > fair + 0.2


def test_dictionaries_carry_the_quality(spark):
    """Good and bad texts of the same lengths and letters, which only the dictionaries can tell apart."""
    rng = random.Random(43)
    kinds = [[f"{a}{b}{c}" for a in "kltm" for b in "aeiou" for c in "rsnd"], [f"{c}{b}{a}" for a in "kltm" for b in "aeiou" for c in "rsnd"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60)), i % 2) for i in range(400)]
    docs = table(spark, [(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    found = quality.quality_scores(spark, docs, labels, F.col("doc_id") % 5 != 0).where("doc_id % 5 = 0").collect()
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in found]) > 0.9
    sizes = np.array([[r.raw_bytes, r.good_bytes, r.bad_bytes] for r in found])
    assert abs(sizes[:, 0].mean() - 239) < 2 and ((sizes[:, 2] > sizes[:, 1]) == [r.doc_id % 2 == 1 for r in found]).mean() > 0.9


def test_contamination_against_brute_force(spark):
    rng = random.Random(44)
    items = [(k, sentence(rng, 14 + k)) for k in range(8)] + [(100, "É" * 70), (101, "É" * 70), (None, "nothing"), (102, None)]
    rows = [(k % 3 or None, f"{sentence(rng, 9)} {t.replace('ka', 'kx', 3)} {sentence(rng, 4)}", "s") for k, t in items[:8]]
    rows += [(5, rows[0][1], "s"), (5, rows[0][1], "s"), (6, None, "s"), (6, "", "s"), (7, "x" * 200_000 + " " + items[3][1], "s"), (8, "é" * 69, "s"), (9, "É" * 60 + "éé" + "É" * 9, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(spark, table(spark, rows), bench, hashed=True).collect()
    low = lambda t: b" ".join(decontamination.lowered(np.frombuffer((t or "").encode(), np.uint8)).tobytes().split())
    want = []
    for i, t, _ in rows:
        hits = [n for n, item in items if n is not None and item and decontamination.edit_distance_inside(low(item), low(t))[0] <= int(0.2 * len(low(item)))]
        want.append((i, t, hits))
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t, _ in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    assert plain((r.doc_id, r.text_hash, sorted(r.item_ids)) for r in found) == plain((i, hashes[t], hits) for i, t, hits in want)
    assert decontamination.contamination(spark, table(spark, rows).limit(0), bench).count() == 0


def test_batched_edit_distances():
    rng = random.Random(45)
    for most in (40, 64, 65, 200):
        items = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, most + 1))) for _ in range(60)]
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
        want = [decontamination.edit_distance_inside(a, b)[0] for a, b in zip(items, texts, strict=True)]
        assert decontamination.edit_distances_inside(items, texts).tolist() == want


def longest_increasing(xs):
    best = []
    for k, x in enumerate(xs):
        best.append(1 + max([best[j] for j in range(k) if xs[j] < x], default=0))
    return max(best, default=0)


def test_patience_keeps_the_longest_run_of_anchors():
    """Where every word is unique in both, the alignment is a longest increasing run."""
    rng = random.Random(46)
    for _ in range(100):
        a, b = (rng.sample(range(40), rng.randrange(30)) for _ in range(2))
        pairs = licenses.patience([str(x) for x in a], [str(x) for x in b])
        assert len(pairs) == longest_increasing([b.index(x) for x in a if x in b])


def test_licenses_of_odd_rows(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(None, mit, "s"), (1, mit, "s"), (1, mit, "s"), (2, None, "s"), (2, "", "s"), (3, "word " * 60_000 + mit, "s")]
    found = licenses.license_scan(spark, table(spark, rows)).collect()
    assert plain((r.doc_id, [(m.license, m.coverage) for m in r.matches]) for r in found) == plain((i, [("mit", 1.0)] if t and mit in t else []) for i, t, _ in rows)
    assert licenses.license_scan(spark, table(spark, rows).limit(0)).count() == 0


def test_languages_of_odd_rows(spark):
    texts = [("the and of water house thing", "en"), ("der und das wasser haus ding", "de")] * 20 + [("the and of water house thing", "en")] * 500
    kind = "page_id long, url string, html string, host string, post string, lang string, declared string"
    rows = [(None, "http://a.de/1", "<p>das wasser und der haus", "h", "p", "l", "d"), (2, None, None, "h", "p", "l", "d"), (2, None, None, "h", "p", "l", "d"), (3, "http://b.com/x", "<html lang=de><p>" + "the water and house " * 30_000, "h", "p", "l", "d")]
    pages = spark.createDataFrame(rows, kind)
    known = spark.createDataFrame(texts, "text string, lang string")
    found = sorted(languages(spark, pages, known).collect(), key=str)
    assert len(found) == 4 and {r.lang for r in found if r.page_id is None} == {"de"} and {r.text_lang for r in found if r.page_id == 3} == {"en"}
    # Copies of a text count once, so those of one language don't outweigh the other's.
    assert all(0 < r.probability <= 1 for r in found) and len({r.lang for r in found if r.page_id == 2}) == 1
    assert languages(spark, pages.limit(0), known).count() == 0


def test_url_verdicts_of_odd_rows(spark):
    kind = "page_id long, url string, pages long, bad_low double, n long"
    rows = [(None, "http://a.example.com/x", 1, 0.5, 1), (1, None, 1, 0.5, 1), (1, None, 1, 0.5, 1), (2, "http://bad.org/" + "y" * 100_000, 1, 0.5, 1)] + [(k, "http://hot.example/p", 1, 0.5, 1) for k in range(3, 60)]
    pages = spark.createDataFrame(rows, kind)
    outcomes = spark.createDataFrame([("bad.org", 1)] * 60 + [("hot.example", 0)] * 60 + [("bad.org", None)], "host string, bad int")
    found = url_filters.url_verdicts(pages, outcomes).collect()
    assert len(found) == len(rows)
    verdicts = {(r.page_id, r.host): r.verdict for r in found}
    assert verdicts[2, "bad.org"] == "block" and verdicts[5, "hot.example"] == "allow" and (1, "") in verdicts and (None, "a.example.com") in verdicts
    assert url_filters.url_verdicts(pages.limit(0), outcomes).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_binary"])
def test_stage_against_brute_force(spark, tmp_path, name):
    """Each stage alone, on rows with shared, lost and repeated ids, empty and long texts and further columns."""
    rng = random.Random(47)
    rows = odd_rows()
    bench = [(1, sentence(rng, 20)), (2, sentence(rng, 25))]
    rows += [(13, f"{sentence(rng, 5)} {bench[0][1].upper()} {sentence(rng, 5)}", "a"), (None, bench[1][1], "b"), (None, "kara vilestuff losi", "a"), (7, "vilestuff mito", "b"), (20, "vilestuff tuxu", "b")]
    for k in range(120):
        rows.append((100 + k, sentence(rng, 20) + (" vilestuff" if k % 4 == 0 else ""), "ab"[k % 2]))
    docs = table(spark, rows)
    spark.createDataFrame([(100 + k, int(k % 4 == 0), 1) for k in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, str(tmp_path))
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == got.columns
    found = got.collect()
    show = lambda some: plain((r[0], (r[1] or "")[:60], r[3] if len(r) > 3 else r[2]) for r in some)
    if name == "token_binary":
        own = ChunkEncoder(tokenizer_path(), 2)
        assert plain((r.doc_id, r.n_tokens) for r in found) == plain((i, len(own([t])[0])) for i, t, _ in rows)
        return
    assert got.columns == docs.columns
    if name == "toxicity":
        assert show(found) == show([r for r in rows if "vilestuff" not in (r[1] or "")])
    elif name == "minhash_near_dedup":
        assert plain((r.doc_id, (r.text or "")[:60]) for r in found) == plain((i, (t or "")[:60]) for i, t, _ in first_rows(rows))
    elif name == "benchmark_decontamination":
        low = lambda t: " ".join((t or "").lower().split()).encode()
        assert show(found) == show([r for r in rows if not any(decontamination.edit_distance_inside(low(b), low(r[1]))[0] <= int(0.2 * len(low(b))) for _, b in bench)])
    else:
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sources = ["a", "b", "c", None]
        totals = [sum(size(t) for _, t, s in rows if s == k) for k in sources]
        for k, total, goal in zip(sources, totals, mixing.targets(totals, [5, 2, 1, 5], 1.5 * sum(totals)), strict=True):
            own = [r for r in found if r.source == k]
            assert abs(sum(size(r.text) for r in own) - goal) <= max([size(t) for _, t, s in rows if s == k])
            for text in {t for _, t, s in rows if s == k}:
                assert sum(r.text == text for r in own) <= 2 * sum(t == text for _, t, s in rows if s == k)
