"""What pages answer and what their claims rest on: intents, topics, gaps, evidence, scores, fan-out queries.

Inputs are the tables that the audit keeps: parsed pages of one per route,
their blocks, links and JSON-LD values.  Pages are judged where they are; only
counts by site and the search for answers of a query shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.functions.dialect import LOWER, UPPER, Spark, Text
from spanlight.operators.reports import best

#: Intents by rising priority, words that speak for each, and their points.
FAMILIES = ("comparison", "pricing", "procedural", "feature", "asset", "troubleshooting", "reference", "definition", "generic")
TITLE_CUES = {
    "definition": (5, ("what is", "overview")),
    "procedural": (5, ("how to", "setup", "configure", "install", "workflow")),
    "comparison": (4, (" vs ", "versus", "compare", "alternative", "alternatives")),
    "pricing": (4, ("pricing", "plans", "price", "quote")),
    "troubleshooting": (4, ("troubleshoot", "fix", "error", "faq", "problem")),
    "asset": (4, ("template", "checklist", "worksheet", "download", "cheatsheet")),
    "feature": (3, ("feature", "capability")),
}
LOW_SIGNAL = ("home", "blog", "docs", "documentation", "features", "learn more", "read more")
#: Evidence signals of a text, with their points.
SIGNALS = {
    "explicit_source_label": (45, ("source:", "sources:", "citation:", "cites:")),
    "attribution_phrase": (35, ("according to",)),
    "data_source_phrase": (35, ("data from",)),
    "methodology_reference": (30, ("methodology",)),
    "benchmark_reference": (28, ("benchmark",)),
    "study_reference": (28, ("study",)),
    "survey_reference": (28, ("survey",)),
    "research_reference": (22, ("research",)),
    "report_reference": (22, ("report",)),
    "inline_url_reference": (18, ("http://", "https://")),
    "dated_qualifier": (14, ("as of ", "last updated")),
}
AUTHORITATIVE, SEVERAL, SOME = 22, 8, 6
#: Hosts whose pages count as evidence, with all below them, and hosts that count by themselves.
HOSTS_AND_BELOW = ("doi.org", "arxiv.org", "ietf.org", "w3.org", "schema.org", "github.com")
HOSTS = ("pubmed.ncbi.nlm.nih.gov", "developers.google.com")
SUFFIXES = (".gov", ".edu", ".nih.gov")
#: Words of claims that compare, that hold at a time, that hold above all.
COMPARATIVE = "faster|better|lower|higher|more |less | than | vs "
TEMPORAL = "(^|[^a-zA-Z0-9])20[0-9][0-9]([^a-zA-Z0-9]|$)|today|currently|now|as of"
SUPERLATIVE = "best|fastest|most|least|only|leading|first"
#: Gaps with their severity and the points that they cost an answer.
GAPS = {"missing_direct_answer": (75, 20), "thin_answer_coverage": (65, 15), "weak_comparison_structure": (70, 15), "missing_pricing_signals": (55, 10), "missing_procedural_signals": (55, 10)}
BASELINES = {"feature": 78, "comparison": 76, "definition": 74, "procedural": 74, "pricing": 74, "troubleshooting": 72, "asset": 72, "reference": 68, "generic": 64}
#: Families of fan-out queries: before and after the topic, expected surface, intents that answer it.
SEEDS = {
    "definition": ("what is ", "", "direct answer block with schema-backed definition", ("definition", "reference")),
    "setup": ("how to set up ", "", "procedural page, ordered steps, or HowTo-like structure", ("procedural",)),
    "comparison": ("", " alternatives", "comparison page, table, or alternatives section", ("comparison",)),
    "pricing": ("", " pricing", "pricing page, offer schema, or clear plan/cost section", ("pricing",)),
    "trust": ("is ", " secure", "trust, security, evidence, or external validation page", ("reference", "feature")),
    "support": ("", " troubleshooting", "support, FAQ, troubleshooting, or docs page", ("troubleshooting", "reference")),
}
#: Words of an answer block, routes told of a query, blockers told of a site, routes that a word leads to one by one.
ANSWER_WORDS, MATCHES, BLOCKERS, RARE = 30, 5, 25, 128
#: How well a route stands with other sites by the gravest issue, severity of a mismatch by its kind.
TRUST = {"forbidden_terminology": 35, "route_not_in_site": 45, "missing_canonical_entity": 55, "descriptor_gap": 70}
MISMATCHES = {"error": 90, "warning": 65}
#: What a route loses for each mismatch, of how many at most, the truth below which it is told; what a site loses for an issue, of how many at most, its least trust.
LOST, LOST_AT_MOST, TRUE, ISSUE, ISSUES_AT_MOST, LEAST_TRUST = 10, 4, 80, 7, 10, 40
#: Weights of readiness, truth, answer pack and trust, with and without the last.
WEIGHTS, WEIGHTS_WITH_TRUST = (40, 35, 25, 0), (35, 30, 25, 10)
TEXT = Text(Spark())


def low(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def holds(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def points(n: int, condition: Column) -> Column:
    return F.when(condition, n).otherwise(0)


def words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s]+"))


def phrase(c: Column) -> Column:
    return F.trim(F.regexp_replace(low(c), r"[^\p{L}\p{N}]+", " "))


def candidates(c: Column) -> Column:
    """The topics that a text may name: its parts of two to eight words."""
    parts = F.transform(F.split(c, r"[|:•—,()-]"), phrase)
    return F.filter(parts, lambda p: words(p).between(2, 8) & ~p.isin(*LOW_SIGNAL))


def headings(tag: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1), phrase), lambda h: h != "")


def grounding(pages: DataFrame, blocks: DataFrame, ld: DataFrame) -> DataFrame:
    """One row a page: (site, route, page_kind, topics, intents, gaps, answer_blocks, heading_count, schema_types)."""
    deep = blocks.groupBy("site", "path").agg(F.count_if(words(F.col("text")) >= ANSWER_WORDS).alias("deep"))
    types = F.array_sort(F.array_distinct(F.transform(F.filter("vals", lambda v: (v.key == "@type") & v.kind.isin("string", "item") & (v.value != "")), lambda v: v.value)))
    rows = pages.select("site", "path", "route", "page_kind", "html", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.get("h1_texts", F.lit(0)), F.lit("")).alias("h1"))
    rows = rows.join(deep, ["site", "path"], "left").join(ld.select("site", "path", types.alias("schema_types")), ["site", "path"], "left")
    rows = rows.withColumns({"answer_blocks": F.coalesce("deep", F.lit(0)).cast("int"), "schema_types": F.coalesce("schema_types", F.array().cast("array<string>")), "h2s": headings("h2"), "h3s": headings("h3")})
    rows = rows.withColumns({"t": low(F.col("title")), "h": low(F.col("h1")), "r": low(F.col("route")), "heads": F.concat_ws(" ", F.array_join("h2s", " "), F.array_join("h3s", " ")), "body": low(F.col("html")), "heading_count": (1 + F.size("h2s") + F.size("h3s")).cast("int")})
    r, heads, body, kind = F.col("r"), F.col("heads"), F.col("body"), F.col("page_kind")
    cue = {k: points(n, holds(F.col("t"), needles) | holds(F.col("h"), needles)) for k, (n, needles) in TITLE_CUES.items()}
    has = lambda t: F.array_contains("schema_types", t)
    listed = holds(body, ("<ol",)) | has("HowTo")
    score = {
        "definition": cue["definition"] + F.when(holds(heads, ("what is",)), 4).when(holds(heads, ("overview",)), 2).otherwise(0) + points(2, kind.isin("docs", "listing")) + points(1, F.col("answer_blocks") >= 2),
        "procedural": cue["procedural"] + points(2, holds(heads, ("how to", "step", "setup", "configure"))) + points(2, holds(body, ("step 1", "step one", "step-by-step"))) + points(2, listed),
        "comparison": points(5, r.startswith("compare/") | holds(r, ("/vs-", "/vs/"))) + cue["comparison"] + points(2, holds(body, ("<table",))),
        "pricing": points(5, holds(r, ("pricing",)) | r.endswith("/plans")) + cue["pricing"] + points(2, holds(heads, ("pricing", "plans")) | holds(body, ("$", "€", " per month", "/month"))),
        "troubleshooting": points(5, holds(r, ("troubleshoot", "error", "faq"))) + cue["troubleshooting"] + points(2, holds(heads, ("faq", "troubleshoot"))) + points(1, has("FAQPage")),
        "asset": cue["asset"] + points(3, holds(r, ("template", "checklist", "download"))),
        "feature": points(5, (kind == "detail") | r.startswith("features/")) + cue["feature"],
        "reference": points(4, kind.isin("docs", "legal")) + points(2, has("HowTo") | has("TechArticle") | has("Article") | has("FAQPage")),
    }
    every = F.array(*[F.struct((-s).alias("s"), F.lit(FAMILIES.index(k)).alias("p"), F.lit(k).alias("family")) for k, s in score.items()])
    rows = rows.withColumn("matches", F.array_sort(F.filter(every, lambda m: m.s < 0)))
    strong = F.transform(F.filter("matches", lambda m: m.s <= -4), lambda m: m.family)
    first = F.get("matches", F.lit(0))
    rows = rows.withColumn("intents", F.when(F.size(strong) > 0, strong).when(F.coalesce(first.s, F.lit(0)) <= -3, F.array(first.family)).otherwise(F.array(F.lit("generic"))))
    wants = lambda k: F.array_contains("intents", k)
    price = F.exists("matches", lambda m: (m.family == "pricing") & (m.s <= -4))
    compared = reduce(lambda a, b: a + b, [points(1, holds(body, (n,))) for n in (" versus ", " vs ", "alternative", "compare", "comparison", "<table")])
    gap = {
        "missing_direct_answer": wants("definition") & ~holds(body, ("what is", "overview")),
        "thin_answer_coverage": F.col("answer_blocks") < 2,
        "weak_comparison_structure": wants("comparison") & ~holds(body, ("<table",)) & (compared < 3),
        "missing_pricing_signals": price & ~holds(body, ("$", "€", "pricing", "plans", "per month", "/month")),
        "missing_procedural_signals": wants("procedural") & ~holds(body, ("step", "<ol", "how to")),
    }
    gaps = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in gap.items()]), lambda g: g.isNotNull())
    named = lambda c, n: F.transform(c, lambda p: F.struct(p.alias("p"), F.lit(n).alias("n")))
    rows = rows.withColumn("named", F.concat(named(candidates(F.col("title")), 5), named(candidates(F.col("h1")), 4), named(candidates(F.regexp_replace("route", "[/-]", " ")), 3), F.flatten(F.transform("h2s", lambda h: named(candidates(h), 2)))))
    total = lambda p: F.aggregate(F.filter("named", lambda x: x.p == p), F.lit(0), lambda a, x: a + x.n)
    ranked = F.array_sort(F.transform(F.array_distinct(F.transform("named", lambda x: x.p)), lambda p: F.struct((-total(p)).alias("s"), (-words(p)).alias("w"), p.alias("p"))))
    topics = F.transform(F.slice(ranked, 1, 5), lambda x: x.p)
    return rows.select(
        "site", "route", F.replace("page_kind", F.lit("_"), F.lit("")).alias("page_kind"), F.coalesce(F.get(topics, F.lit(0)), F.lit("(unclassified)")).alias("primary_topic"), F.slice(topics, 2, 4).alias("secondary_topics"),
        F.get("intents", F.lit(0)).alias("primary_intent"), "intents", gaps.alias("gaps"), "answer_blocks", "heading_count", "schema_types",
    )


def routes_report(ground: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, " | ").alias(c)
    return ground.select("site", "route", "page_kind", "primary_topic", joined("secondary_topics"), "primary_intent", joined("intents"), joined("gaps"), "answer_blocks", "heading_count", joined("schema_types"))


def intent_counts(ground: DataFrame) -> DataFrame:
    """(site, intent, pages, primary_pages)."""
    rows = ground.select("site", "primary_intent", F.explode("intents").alias("intent"))
    return rows.groupBy("site", "intent").agg(F.count("*").alias("pages"), F.count_if(F.col("intent") == F.col("primary_intent")).alias("primary_pages"))


def topic_counts(ground: DataFrame) -> DataFrame:
    """(site, topic, routes, first_route): a topic's routes are those with it as primary_topic in grounding."""
    return ground.groupBy("site", F.col("primary_topic").alias("topic")).agg(F.count("*").alias("routes"), F.min("route").alias("first_route"))


def authoritative(href: Column) -> Column:
    host = F.lower(F.regexp_extract(href, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    below = reduce(lambda a, b: a | b, [(host == h) | host.endswith(f".{h}") for h in HOSTS_AND_BELOW])
    return below | host.isin(*HOSTS) | reduce(lambda a, b: a | b, [host.endswith(s) for s in SUFFIXES])


def evidence_sections(pages: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each block, or for a page without any: what it claims and what the claims rest on."""
    away = links.where("target IS NULL AND href RLIKE '^https?://'").groupBy("site", "path").agg(F.count("*").alias("away"), F.count_if(authoritative(F.col("href"))).alias("good"))
    rows = pages.select("site", "path", "route", "html", F.size("blocks").alias("n_blocks")).join(blocks.select("site", "path", "text"), ["site", "path"], "left").join(away, ["site", "path"], "left")
    plain = F.expr(TEXT.collapse("replace(regexp_replace(html, r'<[^>]*(>|\\z)', ' '), '>', ' ')"))
    rows = rows.select("site", "route", "n_blocks", F.coalesce("text", plain).alias("text"), F.coalesce("away", F.lit(0)).alias("away"), F.coalesce("good", F.lit(0)).alias("good"))
    text = low(F.col("text"))
    signals = [points(n, holds(text, needles)) for n, needles in SIGNALS.values()] + [points(SOME, F.col("away") > 0), points(AUTHORITATIVE, F.col("good") > 0), points(SEVERAL, F.col("away") >= 3)]
    rows = rows.withColumns({"quality": F.least(F.lit(100), reduce(lambda a, b: a + b, signals)), "words": words(F.col("text"))})
    sentences = F.filter(F.transform(F.split("text", r"[.!?\n]"), lambda s: F.trim(s)), lambda s: words(s) >= 5)
    kinds = lambda s: F.struct(F.rlike(s, F.lit("[0-9%]")).alias("numeric"), F.rlike(s, F.lit(COMPARATIVE)).alias("comparative"), F.rlike(s, F.lit(TEMPORAL)).alias("temporal"), F.rlike(s, F.lit(SUPERLATIVE)).alias("superlative"))
    claims = F.filter(F.transform(sentences, lambda s: kinds(low(s))), lambda k: k.numeric | k.comparative | k.temporal | k.superlative)
    rows = rows.withColumn("claims", claims)
    bold = F.size(F.filter("claims", lambda k: k.comparative | k.superlative))
    # A bold claim needs 65 and is content with 60, another needs 55.
    bad_bold, bad_plain = points(1, F.col("quality") < 60) * bold, points(1, F.col("quality") < 55) * (F.size("claims") - bold)
    count = lambda k: F.size(F.filter("claims", lambda c: c[k])).alias(k)
    rows = rows.select("site", "route", "n_blocks", "quality", "words", F.size("claims").alias("claims"), bad_bold.alias("bad_bold"), (bad_bold + bad_plain).alias("unsupported"), *map(count, ("numeric", "comparative", "temporal", "superlative")))
    risk = 18 * F.col("unsupported") + points(12, F.col("quality") == 0) + points(10, F.col("words") > 120) + points(10, F.col("claims") > 3) + points(20, F.col("bad_bold") > 0)
    return rows.withColumn("risk", F.when(F.col("claims") == 0, 0).otherwise(F.least(F.lit(100), risk)))


def evidence(sections: DataFrame) -> DataFrame:
    """One row a page: claims, unsupported ones, density, quality, readiness to be cited, risk, and claims by kind."""
    rows = sections.groupBy("site", "route", "n_blocks").agg(
        F.sum("claims").alias("claims"), F.sum("unsupported").alias("unsupported"), F.expr("sum(quality) div count(1)").alias("quality"), F.max("risk").alias("risk"), *[F.sum(k).alias(k) for k in ("numeric", "comparative", "temporal", "superlative")]
    )
    density = F.when(F.col("claims") > 0, F.expr("(claims - unsupported) * 100 div claims")).when(F.col("n_blocks") == 0, 75).otherwise(90)
    rows = rows.withColumn("density", density.cast("long"))
    ready = F.expr("(density * 65 + quality * 35) div 100") - points(10, F.col("n_blocks") < 2)
    return rows.withColumn("readiness", F.greatest(F.lit(0), ready)).drop("n_blocks")


def evidence_by_site(found: DataFrame) -> DataFrame:
    mean = lambda c: F.expr(f"sum({c}) div count(1)").alias(c)
    return found.groupBy("site").agg(
        F.count("*").alias("pages"), F.count_if(F.col("claims") > 0).alias("routes_with_claims"), F.sum("claims").alias("claims"), F.sum("unsupported").alias("unsupported"),
        mean("density"), mean("quality"), mean("readiness"), mean("risk"), *[F.sum(k).alias(k) for k in ("numeric", "comparative", "temporal", "superlative")],
    )


def overall(trusted: bool) -> Column:
    weights = WEIGHTS_WITH_TRUST if trusted else WEIGHTS
    columns = ("readiness", "truth", "answer_pack", "trust")[: 4 if trusted else 3]
    return F.expr(f"({' + '.join(f'{c} * {w}' for c, w in zip(columns, weights, strict=False))}) div 100").alias("overall")


def chosen(of: Column, values: dict) -> Column:
    return reduce(lambda otherwise, x: F.when(of == x[0], x[1]).otherwise(otherwise), values.items(), F.lit(0))


def route_scores(ground: DataFrame, found: DataFrame, assessed: DataFrame, odd: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """(site, route, readiness, truth, answer_pack, [trust,] overall, blockers).

    ``assessed`` and ``odd`` are facts.assessment and facts.mismatches: a
    route's truth is its site's, less its own mismatches.  ``issues`` are
    suggestions.trust_issues; with them a route has a trust, by its gravest
    issue, which weighs too.
    """
    step = lambda c, *parts: reduce(lambda otherwise, p: F.when(F.col(c) >= p[0], p[1]).otherwise(otherwise), parts, F.lit(0))
    rows = ground.withColumn("others", F.size("intents") - 1)
    cost = F.aggregate("gaps", F.lit(0), lambda a, g: a + chosen(g, {k: c for k, (_, c) in GAPS.items()}))
    pack = chosen(F.col("primary_intent"), BASELINES) + step("answer_blocks", (1, 4), (2, 9), (4, 12)) + step("heading_count", (2, 3), (3, 6), (5, 8)) + step("others", (1, 2), (2, 4)) + points(4, (F.col("page_kind") == "detail") & (F.col("answer_blocks") >= 2)) - cost
    rows = rows.select("site", "route", "gaps", F.least(F.lit(100), F.greatest(F.lit(0), pack)).cast("long").alias("answer_pack")).join(found.select("site", "route", "readiness", "unsupported"), ["site", "route"], "left")
    rows = rows.join(assessed.select("site", "score"), "site", "left").join(odd.groupBy("site", "route").agg(F.count("*").alias("odd")), ["site", "route"], "left")
    truth = F.greatest(F.lit(0), F.coalesce("score", F.lit(100)) - LOST * F.least(F.lit(LOST_AT_MOST), F.coalesce("odd", F.lit(0))))
    rows = rows.withColumns({"readiness": F.coalesce("readiness", F.lit(75)), "truth": truth.cast("long")})
    if issues is not None:
        gravest = issues.where("route IS NOT NULL").groupBy("site", "route").agg(F.min(chosen(F.col("kind"), TRUST)).alias("trust"))
        rows = rows.join(gravest, ["site", "route"], "left").withColumn("trust", F.coalesce("trust", F.lit(100)).cast("long"))
    told = [F.when(F.col("unsupported") > 0, F.concat(F.col("unsupported").cast("string"), F.lit(" unsupported claims"))), F.when(F.col("truth") < TRUE, "truth_consistency_gap")]
    if issues is not None:
        told.append(F.when(F.col("trust") < 100, "external_trust_alignment_gap"))
    said = F.concat(F.filter(F.array(*told), lambda x: x.isNotNull()), "gaps")
    return rows.select("site", "route", "readiness", "truth", "answer_pack", *(["trust"] if issues is not None else []), overall(issues is not None), F.array_join(F.array_sort(said), " | ").alias("blockers"))


def site_scores(scores: DataFrame, assessed: DataFrame, issues: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """One row a site: means of its routes, its own truth, and with records of other sites the trust that they give it."""
    rows = scores.groupBy("site").agg(*[F.expr(f"sum({c}) div count(1)").alias(c) for c in ("readiness", "answer_pack")])
    rows = rows.join(assessed.select("site", F.col("score").cast("long").alias("truth")), "site", "left").withColumn("truth", F.coalesce("truth", F.lit(100)))
    if issues is None:
        return rows.select("site", "readiness", "truth", "answer_pack", overall(False))
    read = sources.groupBy("site").agg(F.sum("rows").alias("read"), F.sum("matched_routes").alias("matched"))
    rows = rows.join(read, "site", "left").join(issues.groupBy("site").agg(F.count("*").alias("issues")), "site", "left")
    trust = F.greatest(F.lit(LEAST_TRUST), F.greatest(F.lit(0), F.expr("matched * 100 div read") - ISSUE * F.least(F.lit(ISSUES_AT_MOST), F.coalesce("issues", F.lit(0)))))
    rows = rows.withColumn("trust", F.when(F.coalesce("read", F.lit(0)) == 0, 100).otherwise(trust).cast("long"))
    return rows.select("site", "readiness", "truth", "answer_pack", "trust", overall(True))


def blockers(ground: DataFrame, found: DataFrame, odd: DataFrame, issues: DataFrame | None = None, top: int = BLOCKERS) -> DataFrame:
    """The gravest gaps of each site: (site, category, route, severity, message, place)."""
    row = lambda rows, category, severity, message: rows.select("site", F.lit(category).alias("category"), "route", severity.cast("int").alias("severity"), message.alias("message"))
    truth = row(odd, "truth", chosen(F.col("severity"), MISMATCHES), F.concat("field", F.lit(" expected '"), "expected", F.lit("' but observed '"), "observed", F.lit("'")))
    claims = row(found.where("unsupported > 0"), "evidence", F.lit(80), F.concat(F.col("unsupported").cast("string"), F.lit(" unsupported claims and fidelity risk "), F.col("risk").cast("string")))
    gaps = ground.select("site", "route", F.explode("gaps").alias("message"))
    every = truth.union(claims).union(row(gaps, "answer_pack", chosen(F.col("message"), {k: s for k, (s, _) in GAPS.items()}), F.col("message")))
    if issues is not None:
        every = every.union(row(issues, "trust", chosen(F.col("kind"), TRUST) - 10, F.col("message")))
    return best(every, ["site"], [F.desc("severity"), "category", F.asc_nulls_first("route"), "message"], top)


def weakest_routes(scores: DataFrame, top: int = BLOCKERS) -> DataFrame:
    """A site's routes of the lowest overall score, of equals those with more blockers first, with their place."""
    n = F.when(F.col("blockers") == "", 0).otherwise(F.size(F.split("blockers", r" \| ")))
    return best(scores.withColumn("n", n), ["site"], ["overall", F.desc("n"), "route"], top).drop("n")


def riskiest_routes(found: DataFrame, top: int = BLOCKERS) -> DataFrame:
    """A site's routes whose claims are the least supported."""
    return best(found.select("site", "route", "risk", "unsupported", "claims"), ["site"], [F.desc("risk"), F.desc("unsupported"), "route"], top)


def least_covered(queries: DataFrame, top: int = BLOCKERS) -> DataFrame:
    """A site's queries that its routes answer worst."""
    return best(queries.select("site", "family", "query", "coverage"), ["site"], ["coverage", "family", "query"], top)


def seed_topic(c: Column) -> Column:
    return low(F.regexp_replace(F.trim(c), r"^[^A-Za-z0-9 ]+|[^A-Za-z0-9 ]+$", ""))


def long_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: F.octet_length(w) > 2)


def fit_bits(intents: Column) -> Column:
    """Which families' intents a route has, a bit for each family."""
    return reduce(lambda a, b: a + b, [points(1 << k, F.arrays_overlap(intents, F.array(*map(F.lit, i)))) for k, (*_, i) in enumerate(SEEDS.values())])


def by_family(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    """The best ``top`` rows of each family, with score, fits and place."""
    f = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.lit(1 << n).alias("bit")) for n, k in enumerate(SEEDS)]))
    rows = rows.select(*by, "route", "base", "bits", f.alias("f")).withColumn("fits", F.col("bits").bitwiseAND(F.col("f.bit")) != 0)
    rows = rows.select(*by, "f.family", "route", "base", "bits", "fits", F.least(F.lit(100), F.col("base") + points(30, F.col("fits"))).alias("score"))
    return best(rows.where("score > 0"), [*by, "family"], [F.desc("score"), "route"], top)


def alike(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    """The best ``top`` routes of those that fit the same families, as none beyond them is among the best of any family."""
    return best(rows, [*by, "bits"], [F.desc("base"), "route"], top).drop("place")


def marked(rows: DataFrame, by: list[str], known: DataFrame) -> DataFrame:
    """rows (by, token) with the arrays ``rare`` and ``often`` of their tokens that are known, each in order."""
    of = lambda often: F.array_sort(F.collect_list(F.when(F.col("often") == F.lit(often), F.col("token"))))
    return rows.join(known.hint("merge"), ["site", "token"]).groupBy(*by).agg(of(False).alias("rare"), of(True).alias("often"))


def in_parts(rows: DataFrame) -> DataFrame:
    """rows by each set of one, two or three of their frequent words: (part, n)."""
    part = lambda *w: F.struct(F.concat_ws(" ", *w).alias("part"), F.lit(len(w)).alias("n"))
    after = lambda w: F.filter("often", lambda x: x > w)
    first = rows.withColumn("w", F.explode("often"))
    two = F.transform(after(F.col("w")), lambda y: part(F.col("w"), y))
    three = F.flatten(F.transform(after(F.col("w")), lambda y: F.transform(after(y), lambda z: part(F.col("w"), y, z))))
    return first.withColumn("p", F.explode(F.concat(F.array(part(F.col("w"))), two, three))).drop("w", "often").select("*", "p.part", "p.n").drop("p")


def fanout(ground: DataFrame, top: int = MATCHES, save: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows, rare: int = RARE) -> DataFrame:
    """The queries that a site's topics give rise to, and the routes that answer them best.

    A route's points for a family of queries are its own and those for up to
    three words that it shares with the topic, or for the same topic.  All
    pairs of a site are never formed; the best of a query are among

    1. those that share a word which at most ``rare`` of the site's routes have,
       met by that word, with all their words counted,
    2. the best of the same topic,
    3. for each one, two and three frequent words of the topic, the best that
       have these: a route beyond them that shares no more is behind them all,
    4. the best of the family.

    Of 2 to 4 a handful is kept before topics meet them.  Joins ask for a
    merge, as Spark sizes exploded words and families no larger than the packed
    file they come from and would broadcast them.
    """
    own = F.array_distinct(F.concat(F.flatten(F.transform(F.concat(F.array("primary_topic"), "secondary_topics"), lambda t: long_words(seed_topic(t)))), F.transform(F.filter(F.split("route", "[/_-]"), lambda p: F.octet_length(p) > 2), low)))
    depth = F.when(F.col("answer_blocks") >= 2, 15).when(F.col("answer_blocks") == 1, 8).otherwise(0)
    routes = save(ground.select("site", "route", seed_topic(F.col("primary_topic")).alias("topic"), own.alias("tokens"), (depth + points(10, F.size("schema_types") > 0) + points(5, F.col("heading_count") >= 3)).alias("base"), fit_bits(F.col("intents")).alias("bits")), "routes")
    topics = save(routes.where("topic <> ''").select("site", "topic").distinct(), "topics")
    held = routes.select("site", "route", "base", "bits", F.explode("tokens").alias("token"))
    asked = topics.select("site", "topic", F.explode(F.array_distinct(long_words(F.col("topic")))).alias("token"))
    counts = held.groupBy("site", "token").agg((F.count("*") > rare).alias("often"))
    known = save(counts.join(asked.select("site", "token").distinct().hint("merge"), ["site", "token"], "left_semi"), "known")
    having = save(marked(held, ["site", "route", "base", "bits"], known), "having")
    asking = save(marked(asked, ["site", "topic"], known), "asking")
    met = asking.select("site", "topic", F.col("rare").alias("rare_words"), F.col("often").alias("often_words"), F.explode("rare").alias("token")).join(having.withColumn("token", F.explode("rare")).hint("merge"), ["site", "token"])
    # Each pair once, at the first of the rare words that both have.
    both = F.array_intersect("rare", "rare_words")
    met = met.where(F.col("token") == F.array_min(both)).withColumn("base", F.col("base") + 10 * F.least(F.lit(3), F.size(both) + F.size(F.array_intersect("often", "often_words"))))
    near = alike(met.select("site", "topic", "route", "base", "bits"), ["site", "topic"], top)
    same = alike(routes.where("topic <> ''").select("site", "topic", "route", (F.col("base") + 35).alias("base"), "bits"), ["site", "topic"], top)
    parts = by_family(alike(in_parts(having.drop("rare")).withColumn("base", F.col("base") + 10 * F.col("n")), ["site", "part"], top), ["site", "part"], top)
    parts = parts.select("site", "part", "route", "base", "bits").distinct()
    shared = in_parts(asking.drop("rare")).drop("n").join(parts.hint("merge"), ["site", "part"]).select("site", "topic", "route", "base", "bits")
    front = by_family(alike(routes, ["site"], top), ["site"], top).select("site", "route", "base", "bits").distinct()
    far = topics.join(front.hint("merge"), "site").select("site", "topic", "route", "base", "bits")
    merged = near.union(same).union(shared).union(far).groupBy("site", "topic", "route", "bits").agg(F.max("base").alias("base"))
    first = by_family(merged, ["site", "topic"], top)
    matches = first.groupBy("site", "topic", "family").agg(F.array_sort(F.collect_list(F.struct("place", "route", "score", "fits"))).alias("m"))
    families = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("expected_surface")) for k, (a, b, s, _) in SEEDS.items()]))
    seeds = topics.select("site", "topic", families.alias("f")).select("site", "topic", "f.family", F.concat("f.a", "topic", "f.b").alias("query"), "f.expected_surface")
    rows = seeds.join(matches.hint("merge"), ["site", "topic", "family"], "left")
    head = F.get("m", F.lit(0))
    gaps = F.filter(F.array(
        F.when(F.col("m").isNull(), F.concat(F.lit("no route appears to answer the '"), "family", F.lit("' fan-out query"))),
        F.when(head.score < 60, F.concat(F.lit("best route score is "), head.score.cast("string"), F.lit("; add a stronger "), "expected_surface", F.lit(" surface"))),
        F.when(~head.fits, F.lit("matched route shares topic but lacks the expected search intent")),
    ), lambda g: g.isNotNull())
    shown = F.array_join(F.transform("m", lambda x: F.concat(x.route, F.lit(":"), x.score.cast("string"))), " | ")
    return rows.select("site", "family", "topic", "query", "expected_surface", F.coalesce(head.score, F.lit(0)).alias("coverage"), F.coalesce(shown, F.lit("")).alias("routes"), F.array_join(gaps, " | ").alias("gaps"))


def fanout_by_site(queries: DataFrame) -> DataFrame:
    rows = queries.groupBy("site").agg(F.count("*").alias("queries"), F.count_if((F.col("coverage") >= 60) & (F.col("gaps") == "")).alias("covered"))
    return rows.withColumn("coverage", F.expr("covered * 100 div queries"))
