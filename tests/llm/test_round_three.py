"""Spelling variants, centroid clustering and BPE against brute-force versions, on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlight.llm import bpe, centroids, variants
from spanlight.llm.queries import tokenizer_path

KIND = "doc_id long, text string, word string, n long, key string, ids string, length int, cluster int"
BPE = tokenizer_path("byte_bpe_50k.json")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k", "i", 2, 3) for i, t in rows], KIND)


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variant_rows(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, n_near = {}, {}
    for w, n in words.items():
        others = sorted((o for o in words if near(w, o)), key=lambda o: (-words[o], o))
        n_near[w] = len(others)
        if others and words[others[0]] >= 2 * n:
            form[w] = others[0]
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, n_near[w], words[form[w]] if w in form else None))
    return sorted(map(str, out))


def test_spelling_variants_equal_all_pairs(spark):
    """Words over two and over many letters, with repeated bigrams, so that the third rarest is often there twice."""
    rng = random.Random(3)
    pool = {"".join(rng.choice("ab") for _ in range(rng.randrange(4, 10))) for _ in range(150)}
    pool |= {"".join(rng.choice("abcdeé×ÿ") for _ in range(rng.randrange(5, 8))) for _ in range(60)}
    pool = sorted(pool)
    rows = []
    for i in range(120):
        words = [rng.choice(pool) for _ in range(60)]
        for k in range(0, 60, 7):
            at = rng.randrange(len(words[k]))
            words[k] = words[k][:at] + rng.choice(["", "x", "É", words[k][at] * 2]) + words[k][at + 1 :]
        rows.append((i, rng.choice([" ", "1", "Ā", "\n", "-"]).join(words).title() if i % 3 else " ".join(words)))
    rows += [(None, "Straße straße strasse Strase " * 9), (None, None), (5, ""), (7, "ĺ 12 \U0001f600"), (8, "spelled spelled spelled speled speled speled " + "spelling " * 20000), (8, "spelled " * 3), (8, "spelled " * 3)]
    found = variants.spelling_variants(spark, table(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(str(tuple(r)) for r in found.collect()) == variant_rows(rows)


def test_spelling_variants_of_nothing(spark):
    assert variants.spelling_variants(spark, table(spark, [])).count() == 0
    assert variants.spelling_variants(spark, table(spark, [(1, None), (2, "only short is")])).count() == 0


def test_forms_are_followed_to_the_last(spark):
    """A chain of five words, each twice as frequent as the one before."""
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(5 * 2**k))
    # A number whose hash spoils none of the words.
    i = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in chain))
    found = {r.word: (r.form, r.root) for r in variants.spelling_variants(spark, table(spark, [(i, text)])).collect()}
    assert found == {w: (chain[k + 1] if k < 4 else None, chain[-1]) for k, w in enumerate(chain)}


def test_rarest_bigrams_and_their_join_keys(spark):
    words = spark.createDataFrame([("abcde", 3), ("abcab", 3), ("ééééé", 4)], "word string, n long")
    order = variants.rare_first(words)
    at = lambda g: order[sum(m * (ord(c) - 97 if c < "{" else ord(c) - 0xC0 + 26) for c, m in zip(g, (variants.LETTERS, 1), strict=True))]
    # Bigrams of two words come after those of one; unused ones come first of all.
    assert max(at("ca"), at("cd"), at("de"), at("éé")) < at("ab") < at("bc")
    keys = {r.word: set(r["keys"]) for r in variants.rarest(words, order).collect()}
    assert keys["abcde"] == {"<eab", "<eabcd", ">acde", ">ade"}
    assert keys["é" * 5] == {"<é" + "é" * k for k in range(2, 5)} | {">é" + "é" * k for k in range(2, 5)}


def test_near_words_are_joined_by_a_number_and_met_by_chance_too(spark, monkeypatch):
    """With the same number for all keys each word meets each other, and only those one edit apart remain, once."""
    pool = ["abcde", "abcdef", "bcdef", "abcxe", "éabcde", "abcdé", "aaaaa", "aaaaaa", "aaaaaaa", "straße", "strasse"]
    words = spark.createDataFrame([(w, 3 + k) for k, w in enumerate(pool)], "word string, n long")
    order = variants.rare_first(words)
    first = lambda a, b: (len(a), a) < (len(b), b)
    wanted = sorted((a, 3 + pool.index(a), b, 3 + pool.index(b)) for a in pool for b in pool if near(a, b) and first(a, b))
    assert sorted(map(tuple, variants.near_pairs(words, order).collect())) == wanted
    assert dict(words.select(variants.joined_by(F.length("word"), F.col("word")).alias("key")).dtypes) == {"key": "bigint"}
    monkeypatch.setattr(variants, "joined_by", lambda length, key: F.lit(1).cast("long"))
    assert sorted(map(tuple, variants.near_pairs(words, order).collect())) == wanted


def test_only_a_to_z_are_lowered(spark):
    words = spark.createDataFrame([(w,) for w in ("ABCxyz", "ÀÞÉaZ", "İK", "", "Straße")], "word string")
    assert [r[0] for r in words.select(variants.lowered(F.col("word"))).collect()] == ["abcxyz", "ÀÞÉaz", "İk", "", "straße"]


def kmeans(rows, k, rounds, salt):
    """Plain integers throughout."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    which = lambda v: min((dist(v, c), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(which(v)[1], []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *which(v)[::-1]) for i, v in kept]
    return [(i, c, d, sum(e for _, o, e in found if o == c), sum(e for *_, e in found), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found]


def vector_rows():
    rng = np.random.default_rng(4)
    heads = rng.normal(0, 1, (9, 64))
    rows = [(i, [float(np.float32(x)) for x in heads[i % 9] + rng.normal(0, 0.3, 64)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(7, rows[9][1]), (7, rows[9][1])]  # one vector many times, ids twice
    return rows + [(None, rows[3][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63), (907, [-0.001] * 64), (908, [0.0] * 64)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "label", 4, 1) for i, v in rows], "vec_id long, embedding array<float>, label string, v int, cluster int")


@pytest.mark.parametrize("k", [1, 40])
def test_clusters_equal_plain_integers(spark, k):
    rows = vector_rows()
    found = centroids.cluster_report(spark, *centroids.clusters(spark, vectors(spark, rows).repartition(5), k=k))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, kmeans(rows, k, 5, "2")))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vector_rows()[:3] + [(None, [0.5] * 64)]
    found = centroids.cluster_report(spark, *centroids.clusters(spark, vectors(spark, rows)))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, kmeans(rows, 40, 5, "2")))
    none = centroids.cluster_report(spark, *centroids.clusters(spark, vectors(spark, [(1, None)])))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="64 bits"):
        centroids.clusters(spark, vectors(spark, [(1, [3e38] * 64)]))


def test_partial_distances_keep_ties(spark):
    """Small integers, so that many centroids tie, in any order of dimensions."""
    rng = np.random.default_rng(9)
    x, c = rng.integers(-1, 2, (5000, 64)), rng.integers(-1, 2, (40, 64))
    c[7] = c[3]
    x[:50] = c[7]
    whole = ((x[:, None, :] - c[None]) ** 2).sum(2)
    for order in (np.arange(64), rng.permutation(64)):
        which, best = centroids.nearest(x[:, order], c[:, order])
        assert (which == whole.argmin(1)).all() and (best == whole.min(1)).all()


POOL = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "　", " ", "\x1c", "᠎", "​", "a", "Abc", "'s", "'ll", "'", "12", "½", "é", "é", "漢字", "\U0001f600", "\U0001f468‍\U0001f469", "<|endoftext|>", "<|endo", "!!", "--", "՘", "꟎", "\U00010940", "ß", "ſ", "İ", "the", " quick", "\x00", "�"]


def odd_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choice(POOL) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(12))) for _ in range(1500)]
    # Long ones: without a space, with few, of white space alone.
    long = ["".join(rng.choice("abcdeé") for _ in range(60000)), " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 40))) for _ in range(90000)), " \n" * 20000, "<|endoftext|>" * 500]
    return [None, ""] + texts + long


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(BPE)
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "twice"), (3, "twice")]
    found = bpe.bpe_decoded(spark, bpe.bpe_encoded(spark, table(spark, rows).repartition(3), BPE), BPE).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(repr, ((r.doc_id, r.ids, r.text) for r in found))) == sorted(map(repr, want))
    assert bpe.bpe_encoded(spark, table(spark, []), BPE).count() == 0


def test_decoding_any_ids(spark):
    library, rng = Tokenizer.from_file(BPE), random.Random(2)
    rows = [[rng.randrange(50257) for _ in range(6)] for _ in range(500)]
    found = spark.createDataFrame([(k, r) for k, r in enumerate(rows)] + [(None, None), (900, [None, -1, 60000, 220])], "doc_id long, ids array<int>")
    found = {r.doc_id: r.text for r in bpe.bpe_decoded(spark, found, BPE).collect()}
    assert all(found[k] == library.decode(r, skip_special_tokens=False) for k, r in enumerate(rows))
    assert found[None] == "" and found[900] == " "


def test_digest_and_other_columns(spark):
    docs = table(spark, [(1, "one two"), (2, None)])
    rows = docs.select("*", bpe.Bpe(spark, BPE).encode(F.col("text")).alias("found")).collect()
    assert rows[0].ids == "i" and rows[0].found == [505, 734] and rows[1].found == []
    digests = spark.createDataFrame([([505, 734],), ([],)], "ids array<int>").select(bpe.id_digest(F.col("ids"))).collect()
    assert [r[0] for r in digests] == [hashlib.sha256(b"505,734").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_merging_pops_no_stale_entry():
    """Against merging the least rank everywhere, over and over: a piece by itself, and many together."""
    found = bpe.Vocabulary(bpe.read_vocabulary(BPE))

    def plain(symbols):
        while True:
            ranked = [(found.ranks[a * found.size + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a * found.size + b in found.ranks]
            if not ranked:
                return symbols
            rank, k = min(ranked)
            symbols = symbols[:k] + [found.made[rank]] + symbols[k + 2 :]

    rng = random.Random(1)
    pieces = ["".join(rng.choice("aeinrst é") for _ in range(rng.randrange(1, 40))).encode() for _ in range(400)] + [b"a" * 33, b"=" * 60]
    want = [plain([int(found.byte_ids[b]) for b in p]) for p in pieces]
    assert [found.merged([int(found.byte_ids[b]) for b in p]) for p in pieces] == want
    assert [np.frombuffer(x, np.int32).tolist() for x in found.merged_together(pieces)] == want
    assert found.merged([]) == []


def test_forgetting_changes_nothing(monkeypatch):
    """A memory of a few cuts, segments of a few characters."""
    monkeypatch.setattr(bpe, "MEMORY", 5)
    monkeypatch.setattr(bpe, "SEGMENT", 40)
    monkeypatch.setattr(bpe, "SHORT", 6)
    library, found = Tokenizer.from_file(BPE), bpe.Vocabulary(bpe.read_vocabulary(BPE))
    texts = odd_texts()[:800] + ["some words, some longer ones, and some \n\n  between " * 20]
    assert [x.tolist() for x in found.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_letters_are_told_by_the_pattern_only_where_all_agree():
    library, found = Tokenizer.from_file(BPE), bpe.Vocabulary(bpe.read_vocabulary(BPE))
    for c in map(chr, range(ord(bpe.AGREED))):
        for text in (f"a{c}b", f" {c}", f"{c}.", f"1{c}1"):
            for cut in found.cuts.findall(text):
                assert found.split(cut) == [cut[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(cut)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.read_vocabulary(tokenizer_path())
