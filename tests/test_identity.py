"""Page identity, drift and GEO009 by hand."""

from spanlight.functions.json_ld import page_values
from spanlight.operators import identity

PAGE = "site string, path string, route string, page_kind string, title string, h1_texts array<string>, og_title string"
LD = "site string, path string, vals array<struct<obj:int,block:int,depth:int,key:string,kind:string,value:string>>"


def tables(spark, pages):
    rows = [("a", r, r, kind, title, h1, og) for r, kind, title, h1, og, _ in pages]
    vals = [("a", r, [tuple(v[k] for k in ("obj", "block", "depth", "key", "kind", "value")) for v in page_values(blocks)["vals"]]) for r, *_, blocks in pages if blocks]
    return spark.createDataFrame(rows, PAGE), spark.createDataFrame(vals, LD)


PAGES = [
    ("same", "generic", "One  Page", ["one page"], "ONE PAGE", ['{"@type": "WebPage", "name": "one page"}']),
    ("h1", "generic", None, ["Head", "Other"], "Head line", ['{"@type": ["x", "Article"], "headline": "Else"}', '{"@type": "BreadcrumbList", "name": "Crumb", "itemListElement": [{"@type": "Product", "name": "Deep"}]}']),
    ("name", "generic", " ", [], None, ['{"@type": "Product", "name": "Bee", "headline": "Buzz"}', '{"@type": "Person", "name": "Ann"}', '{"@type": "Person", "name": "Bee"}']),
    ("none", "generic", None, [], None, None),
    ("brand", "generic", "Terminal Search | Kite Terminal", ["Terminal Search | Kite Terminal"], None, ['{"@type": "SoftwareApplication", "name": "Kite Terminal"}']),
    ("odds", "generic", "Red fruit pie", ["Blue metal car"], None, None),
    ("near", "generic", "Red fruit pie", ["Our fruit pie shop"], None, None),
    ("search", "search", "Red fruit pie", ["Blue metal car"], None, None),
    ("list", "generic", "Acme makes tools", ["Acme sells cars"], None, ['[{"@type": "Organization", "name": "Acme"}]']),
]


def test_identity_and_drift_by_hand(spark):
    found = {r.route: r for r in identity.identities(*tables(spark, PAGES)).collect()}
    assert len(found) == len(PAGES)
    told = lambda r: (found[r].identity, found[r].source, [(d.dimension, d.observed) for d in found[r].drift])
    assert told("same") == ("One  Page", "title", []) and found["same"].agrees
    assert told("h1") == ("Head", "h1", [("og_title", "Head line"), ("schema_headline", "Else")])
    # A title that is there but blank differs from what the page goes by.
    assert told("name") == ("Bee", "schema_name", [("title", " "), ("schema_name", "Ann"), ("schema_headline", "Buzz")])
    assert told("none") == (None, "none", []) and found["none"].agrees
    assert identity.drift_rows(identity.identities(*tables(spark, PAGES))).count() == sum(len(r.drift) for r in found.values())


def test_signals_at_odds_by_hand(spark):
    pages, ld = tables(spark, PAGES)
    # A brand beside a title, a page that is named like its entity, words in common and pages that are not judged are no findings; without "acme" two titles share no word.
    assert sorted(r.path for r in identity.identity_findings(pages, ld).collect()) == ["h1", "list", "odds"]
    assert identity.identity_findings(pages.limit(0), ld).count() == 0
