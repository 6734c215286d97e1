"""Places of elements and findings on hand-worked pages."""

from spanlight.operators import positions
from spanlight.plans.audit import audit
from spanlight.plans.catalogue import Plan
from spanlight.sources.sinks import sarif_results

HTML = "<html lang='en'>\n<head><title>One page</title></head>\n<body>é<a href='/gone'>x</a>\n\n  <section data-ui='a'>no\nheading</section><section data-ui='a'><h2>h</h2></section>\n<img src='/a.png'>  <img src='/a.png'>\n<details>x</details><pre>\ny</pre><a href='/b'></a><button>\n</button></body></html>"
PAGE = "page_id long, site string, route string, relative_path string, path string, page_kind string, strong_blocks int, place int, html string"


def where(html, text, nth=0):
    """Line and column of the nth occurrence."""
    at = -1
    for _ in range(nth + 1):
        at = html.index(text, at + 1)
    return html.count("\n", 0, at) + 1, at - html.rfind("\n", 0, at)


def test_elements_are_found_where_they_stand(spark):
    rows = [(1, "a", "", "index.html", "crawl/index.html", "home", 0, 1, HTML), (2, "a", "b", "b/index.html", "crawl/b/index.html", "generic", 0, 1, "\n\n"), (3, None, "c", "c/index.html", "p", "generic", 0, 1, "<img>\n<img a>" * 300)]
    spark.createDataFrame(rows, PAGE).createOrReplaceTempView("site_of_positions")
    found = spark.sql(positions.elements(Plan(duckdb=False)).replace("FROM site)", "FROM site_of_positions)")).collect()
    first = {(r.kind, r.nr): (r.line, r.col) for r in found if r.page_id == 1}
    assert first == {
        ("link", 0): where(HTML, "<a href"), ("link", 1): where(HTML, "<a href='/b'"), ("control", 0): where(HTML, "<a href"), ("control", 1): where(HTML, "<a href='/b'"),
        ("section", 0): where(HTML, "<section"), ("section", 1): where(HTML, "<section", 1), ("image", 0): where(HTML, "<img"), ("image", 1): where(HTML, "<img", 1),
        ("details", 0): where(HTML, "<details"), ("pre", 0): where(HTML, "<pre"), ("button", 0): where(HTML, "<button"),
    }
    many = "<img>\n<img a>" * 300
    assert sorted((r.nr, r.line, r.col) for r in found if r.page_id == 3) == [(2 * k + j, *where(many, ("<img>", "<img a>")[j], k)) for k in range(300) for j in range(2)]


def test_findings_of_an_audit_have_their_places(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", HTML), (2, "https://a.example/b", "<html lang='en'><a href='/'>home</a></html>")], "page_id long, url string, html string")
    rows = audit(spark, pages).cache()
    found = {}
    for r in rows.collect():
        if r.path == "crawl/index.html":
            found.setdefault(r.rule_id, []).append((r.line, r.column))
    spot = lambda *a: where(HTML, *a)
    assert found["LNK001"] == [spot("<a href")] and found["GEO004"] == [spot("<section")] and found["GEO003"] == [spot("<section", 1)]
    assert sorted(found["A11Y001"]) == sorted(found["CNT003"]) == [spot("<img"), spot("<img", 1)]
    assert found["GEO005"] == [spot("<details")] and found["GEO006"] == [spot("<pre")]
    assert sorted(found["A11Y002"]) == sorted([spot("<a href='/b'"), spot("<button")])
    assert found["SEO002"] == [(1, 1)]
    line, column = spot("<a href")
    assert f'"region":{{"startLine":{line},"startColumn":{column}}}' in sarif_results(rows).where("rule_id = 'LNK001'").first().result
