"""What a site says that it is, and how far its pages keep to it.

``manifest`` drafts a site's facts: an organisation by a weighted vote of
titles, headings and JSON-LD names in which the home page comes first, its
address, category, products, features, aliases, and descriptors mined from the
home page's own words.  ``assessment`` holds pages against given facts.

Facts are rows (site, kind, term, preferred, position): of kind organization,
alias, website, product, product_alias (of the product in ``preferred``),
descriptor, preferred and forbidden.  ``terms`` makes them of a manifest.

Votes are sums by site and name; a site's phrases are those of one page's few
texts and stay in a row.  Terms are looked for in pages by the words that a
site's pages have: a term's longest run of letters is within one word of each
text that has the term, so its first three letters meet those of every such
word, and only the pages of such words are looked through.  A site without a
name takes part in no join; a page without title or headings adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.dialect import LOWER, UPPER, Spark, Text
from spanlight.operators.reports import best

#: Labels that name no organisation, and what titles and headings of error pages hold.
GENERIC = (
    "home", "homepage", "features", "feature", "pricing", "docs", "documentation", "blog", "blogs", "posts", "articles", "news", "stories", "authors", "author", "tags", "tag",
    "categories", "category", "search", "results", "archive", "archives", "index", "all", "page not found", "not found", "404", "404 not found", "error", "errors", "oops", "something went wrong",
)
ERRORS = ("404", "page doesn't exist", "does not exist", "not found", "introuvable", "non trouv", "no encontrad", "não encontrad", "non trovat", "nicht gefunden", "niet gevonden")
#: Words between phrases, words that speak for a descriptor or against it.
STOPS = ("a", "an", "and", "app", "as", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "the", "to", "with", "your")
ANCHORS = ("agent", "agents", "analytics", "app", "approval", "automation", "coding", "compare", "control", "dashboard", "developer", "developers", "engineering", "local", "mac", "macos", "open", "privacy", "source", "terminal", "tool", "tools", "visibility", "workflow", "workflows")
CORES = ("agents", "approval", "coding", "local", "macos", "open", "source", "terminal", "visibility", "workflow", "workflows")
NOISE = ("all", "everything", "free", "more", "named", "one", "shiny", "sock", "world")
MODELS = ("aider", "chatgpt", "claude", "codex", "copilot", "cursor", "gemini", "gpt")
VERBISH = ("built", "intervene", "keep", "lets", "observe", "run", "see", "step", "welcome")
#: Points of a word by its list; of two words, of a core word; least points and weight of a descriptor, overlap from which it repeats another, how many.
WORD_POINTS, TWO_WORDS, CORE, LEAST_POINTS, LEAST_WEIGHT, OVERLAP, DESCRIPTORS = ((ANCHORS, 3), (NOISE, -4), (MODELS, -6), (VERBISH, -2)), 1, 2, 2, 3, 67, 6
#: The same in a curated manifest, and its features.
CURATED_POINTS, CURATED_DESCRIPTORS, CURATED_FEATURES, PRODUCT_FEATURES, PRODUCT_DESCRIPTORS = 3, 4, 16, 24, 4
#: Weights of a name on the home page and elsewhere: in a title, a heading, JSON-LD.
NAME_WEIGHTS = {"title": (5, 3), "h1": (4, 2), "schema": (4, 4)}
#: Kinds of pages whose titles need not name the site.
UNNAMED = ("search", "admin", "feed", "utility", "not_found", "legal")
#: Ceilings by what the facts rest on, and what lowers a score.
CEILINGS = {"none": 59, "schema": 79, "manifest": 79, "schema_and_manifest": 100}
MISMATCH, FORBIDDEN, NO_ORGANIZATION, NO_WEBSITE = (4, 10), (3, 5), 10, 6
#: Observed values told of a mismatch of the whole site.
OBSERVED = 10
ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)"
TEXT = Text(Spark())


def low(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s]+"))


def viable(c: Column) -> Column:
    return (F.trim(c) != "") & (word_count(c) <= 6) & c.rlike(r"\p{IsAlphabetic}")


def generic(c: Column) -> Column:
    plain = low(F.trim(c))
    return plain.isin(*GENERIC) | plain.rlike("^[0-9]+$")


def quality(c: Column) -> Column:
    trimmed = F.trim(c)
    gain = lambda n, what: F.when(what, n).otherwise(0)
    return gain(3, word_count(trimmed) <= 3) + gain(2, trimmed.rlike("^[A-Z]")) + gain(2, ~trimmed.rlike("[0-9]")) + gain(3, ~generic(c))


def segments(title: Column) -> Column:
    return F.filter(F.transform(F.split(title, "[|—·-]"), lambda x: F.trim(x)), viable)


def error_page(title: Column, h1s: Column) -> Column:
    said = F.transform(F.concat(F.filter(F.array(title), lambda x: x.isNotNull()), h1s), low)
    return F.exists(said, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(e)) for e in ERRORS]))


def meta(kind: str, key: str) -> Column:
    """The last not empty content of the meta tags whose ``kind`` is ``key``."""
    t = TEXT
    found = f"filter({t.tags('html', 'meta')}, m -> coalesce({t.lower(t.attribute('m', kind))}, '') = '{key}' AND coalesce({t.attribute('m', 'content')}, '') <> '')"
    return F.expr(t.attribute(f"try_element_at({found}, -1)", "content"))


def schema_values(key: str) -> Column:
    """(block, value) of every string under a key of a page's JSON-LD."""
    return F.transform(F.filter("vals", lambda v: (v.key == key) & v.kind.isin("string", "item")), lambda v: F.struct(v.block.alias("block"), v.value.alias("value")))


def page_facts(pages: DataFrame, ld: DataFrame) -> DataFrame:
    """What a site's facts are drawn from and held against, a row a page."""
    own = pages.select("site", "path", "route", "page_kind", "title", "h1_texts", "description", "canonical", F.size("ld").alias("blocks"), "html")
    own = own.withColumns({"og_title": meta("property", "og:title"), "og_description": meta("property", "og:description"), "twitter_description": meta("name", "twitter:description"), "error": error_page(F.col("title"), F.col("h1_texts"))})
    none = F.array().cast("array<struct<block:int,value:string>>")
    said = ld.select("site", "path", schema_values("name").alias("names"), schema_values("url").alias("urls"), schema_values("@type").alias("types"))
    rows = own.join(said, ["site", "path"], "left")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("names", "urls", "types")})


def voted(votes: DataFrame, order: list) -> DataFrame:
    return best(votes, ["site"], order, 1).drop("place")


def organizations(facts: DataFrame) -> DataFrame:
    """(site, organization): the name with most votes of the home page, or else of all pages.

    Of equals first the one of lower quality, then of fewer votes of all pages
    (on the home page) or shorter, then the last by its letters.
    """
    pages = facts.where("not error")
    named = lambda names, kind: F.transform(F.filter(names, lambda n: viable(n) & ~generic(n)), lambda n: F.struct(n.alias("name"), F.lit(NAME_WEIGHTS[kind][0]).alias("home"), F.lit(NAME_WEIGHTS[kind][1]).alias("away")))
    every = F.concat(named(F.coalesce(segments(F.col("title")), F.array().cast("array<string>")), "title"), named(F.col("h1_texts"), "h1"), named(F.transform("names", lambda n: n.value), "schema"))
    rows = pages.select("site", "route", F.explode(every).alias("n")).select("site", "n.name", F.when(F.col("route") == "", F.col("n.home")).otherwise(0).alias("home"), F.when(F.col("route") == "", F.col("n.home")).otherwise(F.col("n.away")).alias("votes"))
    votes = rows.groupBy("site", "name").agg(F.sum("home").alias("home"), F.sum("votes").alias("votes")).withColumn("quality", quality(F.col("name")))
    at_home = F.col("home") > 0
    order = [F.desc("home"), F.desc(F.when(~at_home, F.col("votes"))), "quality", F.when(at_home, F.col("votes")), F.when(~at_home, F.octet_length("name")), F.desc("name")]
    return voted(votes, order).select("site", F.col("name").alias("organization"))


def root(url: Column) -> Column:
    host = F.regexp_extract(url, ADDRESS, 2)
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(url, ADDRESS, 1)), F.lit("://"), F.lower(host))).otherwise(url)


def websites(facts: DataFrame) -> DataFrame:
    """(site, website): the address that most JSON-LD, or the home page's canonical link, names."""
    absolute = lambda u: u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    declared = facts.select("site", F.explode("urls").alias("u")).select("site", F.col("u.value").alias("url"), F.lit(3).alias("votes"))
    own = facts.where("route = '' AND canonical IS NOT NULL").select("site", F.col("canonical").alias("url"), F.lit(5).alias("votes"))
    votes = declared.union(own).where(absolute(F.col("url"))).groupBy("site", root(F.col("url")).alias("website")).agg(F.sum("votes").alias("votes"))
    return voted(votes, [F.desc("votes"), F.desc("website")]).select("site", "website")


def categories(facts: DataFrame) -> DataFrame:
    """(site, category) by the types that its JSON-LD has."""
    has = lambda *types: F.max(F.exists("types", lambda t: t.value.isin(*types)))
    rows = facts.groupBy("site").agg(has("SoftwareApplication").alias("software"), has("Product").alias("product"), has("WebSite", "Organization").alias("website"))
    return rows.select("site", F.when(F.col("software"), "software_application").when(F.col("product"), "product").when(F.col("website"), "website").alias("category"))


def products(facts: DataFrame) -> DataFrame:
    """(site, product): the name that most blocks with a product have."""
    sold = F.transform(F.filter("types", lambda t: t.value.isin("SoftwareApplication", "Product")), lambda t: t.block)
    names = F.filter("names", lambda n: F.array_contains("sold", n.block) & viable(n.value) & ~generic(n.value))
    rows = facts.where("not error").withColumn("sold", sold).select("site", F.explode(names).alias("n")).select("site", F.col("n.value").alias("product"))
    votes = rows.groupBy("site", "product").agg(F.count("*").alias("votes")).withColumn("quality", quality(F.col("product")))
    return voted(votes, [F.desc("votes"), "quality", F.octet_length("product"), F.desc("product")]).select("site", "product")


def leading(title: Column) -> Column:
    return F.get(segments(title), F.lit(0))


def features(facts: DataFrame) -> DataFrame:
    """(site, feature, place): the first headings of a site's feature pages, in order."""
    rows = facts.where("startswith(route, 'features/')").select("site", F.coalesce(F.get("h1_texts", F.lit(0)), leading(F.col("title"))).alias("feature")).where("feature IS NOT NULL").distinct()
    return best(rows, ["site"], ["feature"], PRODUCT_FEATURES)


def plain_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(low(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def phrases(text: Column, brand: Column) -> Column:
    """Two and three words in a row, none between phrases or of the brand, that may describe something."""
    words = plain_words(text)
    n = F.size(words)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.slice(words, i, k))).otherwise(F.array().cast("array<array<string>>"))
    fits = lambda r: (
        ~F.exists(r, lambda w: w.isin(*STOPS) | F.array_contains(brand, w) | w.rlike("[0-9]"))
        & (F.length(F.get(r, F.lit(0))) >= 4) & (F.length(F.element_at(r, -1)) >= 4) & (F.length(F.array_join(r, " ")) >= 8)
    )
    return F.transform(F.filter(F.concat(runs(2), runs(3)), fits), lambda r: F.array_join(r, " "))


def phrase_points(p: Column) -> Column:
    words = F.array_distinct(F.split(p, " "))
    each = lambda w: reduce(lambda a, b: a + b, [F.when(w.isin(*some), n).otherwise(0) for some, n in WORD_POINTS])
    total = F.aggregate(words, F.lit(0), lambda a, w: a + each(w))
    return total + F.when(F.size(words) == 2, TWO_WORDS).otherwise(0) + F.when(F.exists(words, lambda w: w.isin(*CORES)), CORE).otherwise(0)


def apart(ranked: Column, most: int) -> Column:
    """Phrases in order, each kept unless it repeats one kept before it."""
    repeats = lambda a, b: 100 * F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))) >= OVERLAP * F.greatest(F.size(F.array_distinct(F.split(a, " "))), F.size(F.array_distinct(F.split(b, " "))))
    return F.aggregate(ranked, F.array().cast("array<string>"), lambda kept, p: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: repeats(k, p)), F.concat(kept, F.array(p))).otherwise(kept))


def descriptors(facts: DataFrame, names: DataFrame) -> DataFrame:
    """(site, descriptors): phrases of the home page's own texts, by points, weight, words, letters."""
    home = facts.where("route = ''").join(names, "site", "left").withColumn("brand", F.coalesce(plain_words(F.col("organization")), F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    weighed = lambda c, n: F.transform(F.coalesce(phrases(c, F.col("brand")), none), lambda p: F.struct(p.alias("p"), F.lit(n).alias("n")))
    home = home.withColumn("named", F.concat(weighed(F.col("description"), 4), weighed(F.col("og_description"), 3), weighed(F.col("twitter_description"), 2), weighed(F.get("h1_texts", F.lit(0)), 2), weighed(F.col("title"), 1)))
    total = lambda p: F.aggregate(F.filter("named", lambda x: x.p == p), F.lit(0), lambda a, x: a + x.n)
    scored = F.transform(F.array_distinct(F.transform("named", lambda x: x.p)), lambda p: F.struct((-phrase_points(p)).alias("s"), (-total(p)).alias("n"), F.size(F.split(p, " ")).alias("w"), p.alias("p")))
    ranked = F.array_sort(F.filter(scored, lambda x: (x.s <= -LEAST_POINTS) & (x.n <= -LEAST_WEIGHT)))
    return home.select("site", apart(F.transform(ranked, lambda x: x.p), DESCRIPTORS).alias("descriptors"))


def aliases(facts: DataFrame) -> DataFrame:
    first = F.filter(F.array(leading(F.col("title"))), lambda x: x.isNotNull() & ~generic(x))
    headings = F.filter("h1_texts", lambda h: viable(h) & ~generic(h))
    return facts.where("route = ''").select("site", F.array_sort(F.array_distinct(F.concat(first, headings))).alias("aliases"))


def manifest(facts: DataFrame) -> DataFrame:
    """(site, organization, aliases, website, category, descriptors, product, product_found, product_descriptors, features) of page_facts.

    A site without a product goes by its organisation's name, and
    ``product_found`` is false; without either, product is null.
    """
    names = organizations(facts)
    told = features(facts).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "feature"))), lambda x: x.feature).alias("features"))
    rows = facts.select("site").where("site IS NOT NULL").distinct()
    for part in (names, aliases(facts), websites(facts), categories(facts), descriptors(facts, names), products(facts), told):
        rows = rows.join(part, "site", "left")
    none = F.array().cast("array<string>")
    own = F.col("organization").isNotNull()
    found = F.coalesce("descriptors", none)
    product = F.coalesce("product", "organization")
    return rows.select(
        "site", "organization", F.when(own, F.coalesce("aliases", none)).otherwise(none).alias("aliases"), "website", "category", F.when(own, found).otherwise(none).alias("descriptors"),
        product.alias("product"), F.col("product").isNotNull().alias("product_found"), F.when(product.isNotNull(), F.slice(found, 1, PRODUCT_DESCRIPTORS)).otherwise(none).alias("product_descriptors"), F.when(product.isNotNull(), F.coalesce("features", none)).otherwise(none).alias("features"),
    )


def curated(drafts: DataFrame) -> DataFrame:
    """A manifest with its aliases, descriptors and features thinned out."""
    strong = lambda c: apart(F.filter(c, lambda p: phrase_points(p) >= CURATED_POINTS), CURATED_DESCRIPTORS)
    kept = F.array_sort(F.array_distinct(F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: (a != "") & (low(a) != low(F.trim("organization"))) & ~generic(a))))
    cleaned = F.array_sort(F.array_distinct(F.filter(F.transform("features", lambda f: F.trim(f)), lambda f: f != "")))
    return drafts.withColumns({"aliases": F.when(F.col("organization").isNotNull(), kept).otherwise(F.col("aliases")), "descriptors": strong("descriptors"), "product_descriptors": strong("product_descriptors"), "features": F.slice(cleaned, 1, CURATED_FEATURES)})


def validation(drafts: DataFrame) -> DataFrame:
    """(site, valid, errors, warnings) of a manifest; both are short names of what lacks."""
    lacks = lambda what, name: F.when(what, name)
    some = lambda *parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    organization, product = F.col("organization").isNotNull(), F.col("product").isNotNull()
    bad_address = F.col("website").isNotNull() & ~F.col("website").rlike(ADDRESS)
    blank = lambda c: F.exists(c, lambda x: F.trim(x) == "")
    errors = some(
        lacks(~organization & ~product, "no entity"), lacks(organization & (F.trim("organization") == ""), "organization.name"), lacks(organization & bad_address, "organization.website"), lacks(organization & blank("aliases"), "organization.aliases"),
        lacks(product & (F.trim("product") == ""), "products[0].name"), lacks(product & bad_address, "products[0].website"), lacks(product & blank("features"), "products[0].features"),
    )
    no_category = F.coalesce(F.trim("category"), F.lit("")) == ""
    warnings = some(
        lacks(~organization, "no organization"), lacks(organization & no_category, "organization.category"), lacks(organization & (F.size("descriptors") == 0), "organization.descriptors"),
        lacks(product & no_category, "products[0].category"), lacks(product & (F.size("product_descriptors") == 0), "products[0].descriptors"),
    )
    return drafts.select("site", errors.alias("errors"), warnings.alias("warnings")).select("site", (F.size("errors") == 0).alias("valid"), "errors", "warnings")


def terms(drafts: DataFrame) -> DataFrame:
    """A manifest as rows (site, kind, term, preferred, position)."""
    row = lambda kind, term, position: F.struct(F.lit(kind).alias("kind"), term.alias("term"), F.lit(None).cast("string").alias("preferred"), position.cast("int").alias("position"))
    one = lambda kind, c: F.array(row(kind, F.col(c), F.lit(0)))
    many = lambda kind, c: F.transform(c, lambda x, i: row(kind, x, i))
    every = F.concat(one("organization", "organization"), many("alias", "aliases"), one("website", "website"), one("product", "product"), many("descriptor", "descriptors"))
    return drafts.select("site", F.explode(every).alias("t")).select("site", "t.*").where("term IS NOT NULL")


def grams(word: Column) -> Column:
    """Runs of three letters of a word, and of one and two for terms that are as short."""
    runs = lambda k: F.when(F.length(word) >= k, F.transform(F.sequence(F.lit(1), F.length(word) - (k - 1)), lambda i: F.substr(word, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def surface(facts: DataFrame) -> DataFrame:
    """(site, path, text): what of a page may name things, in lower case."""
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join("h1_texts", " "), F.coalesce("og_title", F.lit("")), "html")
    return facts.select("site", "path", low(said).alias("text"))


def mentions(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(site, path, term): the terms of (site, term), lower-cased and distinct, that a page's surface holds."""
    texts = surface(facts)
    wanted = wanted.select("site", low(F.col("term")).alias("term")).where("term <> ''").distinct()
    runs = F.regexp_extract_all("term", F.lit("[a-z0-9]+"), 0)
    longest = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))), F.lit(0)).r
    keyed = wanted.withColumn("run", longest)
    # A word of a page, once; those of a site, once.
    words = texts.select("site", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), 0))).alias("word"))
    known = words.select("site", "word").distinct().select("site", "word", F.explode(grams(F.col("word"))).alias("gram"))
    meets = known.join(keyed.where("run IS NOT NULL").select("site", "term", "run", F.substring("run", 1, 3).alias("gram")), ["site", "gram"]).where(F.contains("word", F.col("run"))).select("site", "word", "term").distinct()
    candidates = words.join(meets, ["site", "word"]).select("site", "path", "term").distinct()
    # A term without a letter or digit has no word to go by.
    bare = texts.select("site", "path").join(keyed.where("run IS NULL").select("site", "term"), "site")
    return candidates.union(bare).join(texts, ["site", "path"]).where(F.contains("text", F.col("term"))).select("site", "path", "term")


def entities(rows: DataFrame) -> DataFrame:
    """(site, entities): a site's products in their order and then its organisation, each with the lower-case names it goes by."""
    own = rows.where("kind IN ('organization', 'alias')").groupBy("site").agg(F.max(F.when(F.col("kind") == "organization", F.col("term"))).alias("name"), F.collect_set(low(F.col("term"))).alias("names")).where("name IS NOT NULL").withColumn("position", F.lit(1 << 30))
    named = rows.where("kind = 'product'").select("site", F.col("term").alias("name"), "position")
    others = rows.where("kind = 'product_alias'").select("site", F.col("preferred").alias("name"), F.col("term").alias("other"))
    sold = named.join(others, ["site", "name"], "left").groupBy("site", "name").agg(F.min("position").alias("position"), F.collect_set(low(F.col("other"))).alias("names"))
    sold = sold.select("site", "name", F.array_union("names", F.array(low(F.col("name")))).alias("names"), "position")
    every = sold.unionByName(own.select("site", "name", "names", "position"))
    return every.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("position", "name", "names"))).alias("entities"))


def mismatches(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """(site, route, field, expected, observed, source, severity): where pages and facts are at odds."""
    found = mentions(facts, rows.where("kind IN ('organization', 'alias', 'product', 'product_alias', 'forbidden')"))
    routed = facts.select("site", "path", "route")
    bad = rows.where("kind = 'forbidden'").select("site", low(F.col("term")).alias("term"), F.col("term").alias("observed"), F.coalesce("preferred", F.lit("")).alias("expected"))
    told = found.join(bad, ["site", "term"]).join(routed, ["site", "path"]).select("site", "route", F.lit("terminology").alias("field"), "expected", "observed", F.lit("visible_text").alias("source"), F.lit("warning").alias("severity"))

    named = entities(rows)
    held = found.groupBy("site", "path").agg(F.collect_set("term").alias("held"))
    pages = facts.where(F.col("title").isNotNull() & (F.col("route") != "") & ~F.col("page_kind").isin(*UNNAMED)).join(named, "site").join(held, ["site", "path"])
    first = F.get(F.filter("entities", lambda e: F.arrays_overlap(e.names, F.col("held"))), F.lit(0))
    pages = pages.withColumn("entity", first).where("entity IS NOT NULL")
    said = F.filter(F.concat(F.array("title", "og_title", "description"), F.col("h1_texts"), F.transform("names", lambda n: n.value)), lambda x: x.isNotNull())
    known = F.exists(F.transform(said, low), lambda s: F.exists("entity.names", lambda n: F.contains(s, n)))
    titles = pages.where(~known).select("site", "route", F.lit("title").alias("field"), F.col("entity.name").alias("expected"), F.col("title").alias("observed"), F.lit("manifest").alias("source"), F.lit("warning").alias("severity"))

    # Of the whole site, where any page has JSON-LD.
    declares = facts.groupBy("site").agg(F.max(F.col("blocks") > 0).alias("declares")).where("declares").select("site")
    own = F.filter("entities", lambda e: e.position == (1 << 30))
    organization = named.select("site", F.get(own, F.lit(0)).alias("o")).where("o IS NOT NULL").select("site", "o.*").join(declares, "site")
    marked = lambda c, what: F.transform(c, lambda v: F.struct(F.lit(what).alias("what"), v.value.alias("value")))
    schema = facts.select("site", F.explode(F.concat(marked("names", "name"), marked("urls", "url"))).alias("s")).select("site", "s.*").distinct()
    right = schema.where("what = 'name'").join(organization, "site").groupBy("site").agg(F.max(F.exists("names", lambda n: F.contains(low(F.col("value")), n))).alias("right"))
    counts = schema.groupBy("site", "what").agg(F.count("*").alias("n"))
    shown = best(schema, ["site", "what"], ["value"], OBSERVED).groupBy("site", "what").agg(F.array_sort(F.collect_list("value")).alias("values")).join(counts, ["site", "what"])
    shown = shown.select("site", "what", F.concat(F.array_join("values", ", "), F.when(F.col("n") > OBSERVED, F.concat(F.lit(" and "), (F.col("n") - OBSERVED).cast("string"), F.lit(" more"))).otherwise("")).alias("observed"))
    other = organization.join(right, "site", "left").where(~F.coalesce("right", F.lit(False))).select("site", F.lit("name").alias("what"), F.col("name").alias("expected"), F.lit("error").alias("severity"))
    address = rows.where("kind = 'website'").select("site", F.col("term").alias("expected")).join(organization.select("site"), "site")
    same = schema.where("what = 'url'").select("site", F.col("value").alias("expected")).withColumn("same", F.lit(True))
    address = address.join(same, ["site", "expected"], "left").where("same IS NULL").select("site", F.lit("url").alias("what"), "expected", F.lit("warning").alias("severity"))
    whole = other.union(address).join(shown, ["site", "what"], "left").select("site", F.lit("(sitewide)").alias("route"), F.concat(F.lit("organization_schema."), "what").alias("field"), "expected", F.coalesce("observed", F.lit("")).alias("observed"), F.lit("schema").alias("source"), "severity")
    return told.union(titles).union(whole)


def assessment(facts: DataFrame, rows: DataFrame, odd: DataFrame) -> DataFrame:
    """One row a site: (site, source, score, ceiling, pages, pages_with_schema, organization_blocks, website_blocks, preferred_hits, forbidden_hits, mismatches); ``odd`` are the site's mismatches.

    A site of ``rows`` has a manifest.
    """
    typed = lambda t: F.size(F.array_distinct(F.transform(F.filter("types", lambda x: x.value == t), lambda x: x.block)))
    sites = facts.where("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.col("blocks") > 0).alias("pages_with_schema"), F.sum(typed("Organization")).alias("organization_blocks"), F.sum(typed("WebSite")).alias("website_blocks"))
    # A term counts as often as the facts have it: an organisation may also be a product.
    expected = rows.select("site", F.when(F.col("kind").isin("organization", "product"), F.col("term")).when(F.col("kind") == "preferred", F.col("preferred")).alias("term")).where("term IS NOT NULL")
    times = expected.groupBy("site", low(F.col("term")).alias("term")).agg(F.count("*").alias("times"))
    hits = mentions(facts, expected).join(times, ["site", "term"]).groupBy("site").agg(F.sum("times").alias("preferred_hits"))
    wrong = odd.groupBy("site").agg(F.count("*").alias("mismatches"), F.count_if(F.col("field") == "terminology").alias("forbidden_hits"))
    has = rows.select("site").distinct().withColumn("given", F.lit(True))
    out = sites.join(hits, "site", "left").join(wrong, "site", "left").join(has, "site", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("preferred_hits", "mismatches", "forbidden_hits")})
    schema, given = F.col("pages_with_schema") > 0, F.coalesce("given", F.lit(False))
    source = F.when(schema & given, "schema_and_manifest").when(schema, "schema").when(given, "manifest").otherwise("none")
    out = out.withColumn("source", source).withColumn("ceiling", reduce(lambda otherwise, c: F.when(F.col("source") == c[0], c[1]).otherwise(otherwise), CEILINGS.items(), F.lit(0)).cast("long"))
    capped = lambda c, by: F.least(F.lit(by[1]), c) * by[0]
    lost = capped(F.col("mismatches"), MISMATCH) + capped(F.col("forbidden_hits"), FORBIDDEN) + F.when(F.col("organization_blocks") == 0, NO_ORGANIZATION).otherwise(0) + F.when(F.col("website_blocks") == 0, NO_WEBSITE).otherwise(0)
    return out.select("site", "source", F.greatest(F.lit(0), F.col("ceiling") - lost).alias("score"), "ceiling", "pages", "pages_with_schema", "organization_blocks", "website_blocks", "preferred_hits", "forbidden_hits", "mismatches")
