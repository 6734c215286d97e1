"""A crawl in one run, stopped and taken up, cut short and taken up with a higher bound."""

import pytest

from spanlight.streaming.crawl import Crawl, outcomes

EDGES = [("a", "", "m"), ("a", "", "b"), ("a", "", "b"), ("a", "m", "z"), ("a", "b", "c"), ("a", "c", ""), ("a", "c", "d"), ("a", "bad", "hidden"), ("a", "b", "bad"), ("a", "d", "admin/x"), ("b", "s", "t"), (None, "s", "t")]
#: Breadth first, levels by letters; what "bad" links to is never seen, as it is not fetched.
PLACES = [("a", "", 0, 1), ("a", "b", 1, 2), ("a", "m", 1, 3), ("a", "bad", 2, 4), ("a", "c", 2, 5), ("a", "z", 2, 6), ("a", "d", 3, 7), ("b", "s", 0, 1), ("b", "t", 1, 2)]


@pytest.fixture(scope="module")
def tables(spark):
    attempts = [(s, r, 1, True, 10, 1) for s, r in {(s, r) for s, r, _ in EDGES} | {(s, t) for s, _, t in EDGES} if r != "bad" and s and r != "m"]
    attempts += [("a", "bad", n, False, 5, 0) for n in (1, 2)] + [("a", "bad", 3, True, 5, 0), ("a", "m", 1, False, 7, 0), ("a", "m", 2, True, 8, 2), ("a", "m", 3, True, 99, 9), (None, "x", 1, True, 1, 1)]
    fetches = spark.createDataFrame(attempts, "site string, route string, attempt int, ok boolean, fetch_ms long, process_ms long")
    done = outcomes(fetches, retries=1).cache()
    return spark.createDataFrame([("a", ""), ("a", ""), ("b", "s"), (None, "s")], "site string, route string"), spark.createDataFrame(EDGES, "site string, route string, target string"), done


def places(crawl):
    return sorted(tuple(r) for r in crawl.visited().collect())


def test_attempts_end_with_the_budget_or_the_first_success(tables):
    found = {r.route: (r.ok, r.attempts, r.fetch_ms, r.process_ms) for r in tables[2].collect() if r.site == "a"}
    assert found["bad"] == (False, 2, 10, 0) and found["m"] == (True, 2, 15, 2) and found["b"] == (True, 1, 10, 1)


def test_stopped_and_taken_up_gives_the_same_places(spark, tables, tmp_path):
    crawl = lambda: Crawl(spark, f"{tmp_path}/state", 100, exclude=("admin",))
    steps = 0
    while not crawl().advance(*tables, most=1):  # a new process each time
        steps += 1
        if steps == 2:  # one that ended in the middle of a step leaves files without a mark
            (tmp_path / f"state/step={crawl().steps()}").mkdir()
            (tmp_path / f"state/step={crawl().steps()}/part-0.parquet").write_text("broken")
    assert places(crawl()) == sorted(PLACES) and crawl().truncated().count() == 0
    stats = {r.site: r for r in crawl().stats(tables[2]).collect()}
    assert (stats["a"].visited_pages, stats["a"].fetch_failures, stats["a"].fetch_retries, stats["a"].average_fetch_ms) == (7, 1, 2, 75 // 7)
    assert [(r.route, r.place) for r in crawl().slowest(tables[2], 2).where("site = 'a'").orderBy("place").collect()] == [("m", 1), ("", 2)]
    assert [(r.rule_id, r.path) for r in crawl().findings(tables[2]).collect()] == [("CRW001", "crawl/bad/index.html")]


def test_a_higher_bound_goes_on_from_where_a_lower_one_ended(spark, tables, tmp_path):
    short = Crawl(spark, f"{tmp_path}/state", 4, exclude=("admin",))
    assert short.advance(*tables)
    assert places(short) == sorted(p for p in PLACES if p[3] <= 4)
    assert [r.site for r in short.truncated().collect()] == ["a"]
    cut = [r for r in short.findings(tables[2]).collect() if r.rule_id == "CRW003"]
    assert len(cut) == 1 and "max_pages=4 after visiting 4 pages; discovered at least 6 " in cut[0].message
    more = Crawl(spark, f"{tmp_path}/state", 100, exclude=("admin",))
    more.advance(*tables)
    assert places(more) == sorted(PLACES) and more.truncated().count() == 0


def test_no_starts(spark, tables, tmp_path):
    crawl = Crawl(spark, f"{tmp_path}/none", 5)
    assert crawl.advance(tables[0].limit(0), *tables[1:]) and crawl.visited().count() == 0
