"""Link suggestions against all pairs, with rare and frequent words, many links, and a word that all routes share."""

import random

import pytest

from spanlight.operators import link_suggestions as links

PAGES = "site string, route string, relative_path string, path string, title string, description string, h1_texts array<string>"
BLOCKS = "site string, path string, data_ui string, has_heading boolean, text string"
LINKED = "site string, relative_path string, target string, place int"


def tables(spark, pages, aimed):
    rows = [(site, route, f"{route}.html", f"crawl/{route}.html", title, None, []) for site, route, title in pages]
    return spark.createDataFrame(rows, PAGES), spark.createDataFrame([], BLOCKS), spark.createDataFrame([(s, f"{a}.html", b, 1) for s, a, b in aimed], LINKED)


def brute(pages, aimed, top):
    words = {(s, r): {w for w in f"{r} {t or ''}".lower().replace("/", " ").split() if w} for s, r, t in pages if r != "404"}
    inbound = {k: len({a for s, a, b in aimed if s == k[0] and b == k[1] and a != b}) for k in words}
    out = []
    for (s, r), mine in words.items():
        have = {b for t, a, b in aimed if t == s and a == r}
        scored = []
        for (t, o), theirs in words.items():
            if t == s and o != r and o not in have:
                n = inbound[t, o]
                score = len(mine & theirs) + (3 if r.split("/")[0] == o.split("/")[0] else 0) + (3 if n < 2 else 1 if n < 4 else 0)
                if score > 2:
                    scored.append((-score, o))
        out += [(s, r, o, -score, k + 1) for k, (score, o) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.fixture
def save(spark, tmp_path):
    def write(rows, name):
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return write


@pytest.mark.parametrize("rare", [1, 4, 64])
def test_best_targets_equal_all_pairs(spark, save, rare):
    rng = random.Random(rare)
    pages = [("a", f"{rng.choice('xyz')}/p{i}", " ".join(rng.choice(("shared", "often", "word", *map(str, range(12)))) for _ in range(rng.randrange(6)))) for i in range(60)]
    pages += [("b", f"q{i}", "one") for i in range(20)] + [("b", "404", "one"), ("c", "alone", None), ("b", "", None)]
    aimed = [("a", rng.choice(pages[:60])[1], rng.choice(pages[:60])[1]) for _ in range(200)] + [("b", "q3", f"q{i}") for i in range(20)]
    found = links.link_suggestions(*tables(spark, pages, aimed), save, top=3, rare=rare)
    assert sorted(map(tuple, found.collect())) == brute(pages, aimed, 3)


def test_many_links_of_one_page(spark, save, monkeypatch):
    """A source with more links than its classes are long meets them whole."""
    monkeypatch.setattr(links, "LINKS", 2)
    monkeypatch.setattr(links, "BLOCK", 8)
    pages = [("a", f"p{i:02}", "word and word") for i in range(40)]
    aimed = [("a", "p01", f"p{i:02}") for i in range(30)] + [("a", "p02", "p00"), ("a", "p03", "p00")]
    found = links.link_suggestions(*tables(spark, pages, aimed), save, top=3, rare=2)
    assert sorted(map(tuple, found.collect())) == brute(pages, aimed, 3)


def test_a_word_that_all_share_costs_a_handful(spark, save, monkeypatch):
    """Of 3,000 routes that share words, a source meets the first of its class, not all."""
    seen = []
    whole = links.met_in_blocks

    def counted(sources, targets, zone, top):
        seen.append((sources.count(), targets.count()))
        return whole(sources, targets, zone, top)

    monkeypatch.setattr(links, "met_in_blocks", counted)
    pages = [("a", f"blog/{i}", "same words") for i in range(3000)]
    found = links.link_suggestions(*tables(spark, pages, []), save).where("route = 'blog/7'").collect()
    assert sorted((r.target, r.score, r.place) for r in found) == [("blog/0", 9, 1), ("blog/1", 9, 2), ("blog/10", 9, 3)]
    assert all(t <= links.TOLD + 1 + links.LINKS for s, t in seen if s)


def test_no_pages(spark, save):
    assert links.link_suggestions(*tables(spark, [], []), save).count() == 0
