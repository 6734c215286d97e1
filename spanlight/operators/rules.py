"""Rules as rows: id, severity, condition, message.

Page-local rules are conditions over one parsed page and are evaluated together
in one pass over the pages.  Rules over links, groups of pages and pairs are
queries of their own.
"""

from __future__ import annotations

#: Kinds of pages that content and structure rules pass over.
THIN = "('search', 'admin', 'feed', 'utility', 'not_found')"
#: Link texts that say nothing.
WEAK_ANCHORS = "('click here', 'here', 'learn more', 'more', 'read more')"
FILE_404 = "relative_path <> '404.html'"
MINIMUM = "CASE WHEN page_kind = 'listing' THEN 1 ELSE 2 END"

#: (rule, severity, condition, message); the columns are those of a parsed page.
PAGE_RULES = (
    ("SEO001", "error", "title IS NULL", "'missing <title>'"),
    ("SEO002", "error", "description IS NULL", "'missing meta description'"),
    ("SEO004", "error", f"{FILE_404} AND canonical IS NULL", "'missing canonical link'"),
    ("SEO005", "error", "h1_count = 0", "'missing <h1>'"),
    ("SEO006", "error", "h1_count > 1", "concat('expected 1 <h1>, found ', CAST(h1_count AS STRING))"),
    ("SEO007", "warning", f"{FILE_404} AND html_lang IS NULL", "'missing html lang attribute'"),
    ("SEO013", "warning", "has_nosnippet", "'page suppresses search and AI snippets via nosnippet'"),
    ("SEO014", "warning", "max_snippet IS NOT NULL", "concat('page restricts snippets via ', max_snippet)"),
    ("SEO015", "warning", "nosnippets > 0", "concat('page uses data-nosnippet on ', CAST(nosnippets AS STRING), ' block', CASE WHEN nosnippets = 1 THEN '' ELSE 's' END)"),
    ("SOC001", "warning", f"{FILE_404} AND og_title IS NULL", "'missing og:title'"),
    ("SOC002", "warning", f"{FILE_404} AND og_description IS NULL", "'missing og:description'"),
    ("SOC003", "warning", f"{FILE_404} AND og_type IS NULL", "'missing og:type'"),
    ("SOC004", "warning", f"{FILE_404} AND twitter_card IS NULL", "'missing twitter:card'"),
    ("SOC005", "warning", f"{FILE_404} AND canonical <> og_url", "concat('og:url does not match canonical: ', og_url)"),
    ("SOC006", "warning", f"{FILE_404} AND og_image IS NULL", "'missing og:image'"),
    ("SOC009", "warning", f"{FILE_404} AND lower(twitter_card) = 'summary'", "'twitter:card is `summary`; consider `summary_large_image` for richer link previews'"),
    ("CNT001", "warning", f"page_kind NOT IN {THIN} AND visible_bytes < CASE WHEN page_kind IN ('listing', 'home') THEN 250 ELSE 500 END", "'page is unusually small'"),
    ("CNT002", "warning", "route LIKE 'features/%' AND html NOT LIKE '%Related features%'", "'feature page is missing expected section: Related features'"),
    ("GEO008", "warning", f"page_kind NOT IN ('search', 'admin', 'legal', 'utility', 'not_found', 'feed') AND answer_blocks < {MINIMUM}", f"concat('page has only ', CAST(answer_blocks AS STRING), ' answer-oriented blocks; expected at least ', CAST({MINIMUM} AS STRING))"),
    ("GEO011", "warning", "title IS NOT NULL AND title NOT LIKE '% %' AND route <> ''", "'page title is weakly disambiguated for retrieval'"),
    ("A11Y005", "warning", "page_kind NOT IN ('search', 'admin', 'feed', 'utility', 'not_found', 'legal') AND NOT ((markup LIKE '%<main%' AND markup LIKE '%</main>%') OR markup LIKE '%role=\"main\"%' OR markup LIKE '%role=''main''%')", "'page has no <main> landmark or role=\"main\" element — assistive tech can''t skip to content'"),
)
#: Findings of the same kind in each of many elements of a page: (rule, severity, element, condition, message).
BLOCK_RULES = (
    ("GEO001", "warning", "tag = 'section' AND data_ui IS NULL", "'<section> is missing data-ui'"),
    ("GEO002", "warning", "tag = 'article' AND data_ui IS NULL", "'<article> is missing data-ui'"),
    ("GEO004", "warning", "tag = 'section' AND NOT has_heading", "'<section> is missing a heading'"),
    ("GEO007", "warning", "has_heading AND bytes < 120 AND NOT (supporting AND strong_blocks > 0)", "'semantic block is too thin to answer a focused query'"),
)
#: Rules over machine surfaces that hold of a whole site.
SITEWIDE = ("SRF001", "SRF002", "SRF003", "SRF006", "SRF010", "SRF011", "SRF015", "SRF016", "SRF020", "SRF021", "SRF025", "SRF026", "AGT001", "AGT002", "LNK020")
CLASSES = {"SEO": ("hard", "high"), "LNK": ("hard", "high"), "MAP": ("hard", "high"), "SOC": ("hard", "high"), "A11Y": ("hard", "high"), "ROB": ("policy", "high"), "SRF": ("policy", "high"), "DEP": ("policy", "high"), "SCH": ("policy", "medium"), "LLM": ("policy", "medium"), "CNT": ("policy", "medium"), "QLT": ("policy", "medium"), "AGT": ("policy", "medium"), "CRW": ("heuristic", "low"), "GEO": ("heuristic", "low")}
LAYERS = {"retrievability": ("LNK", "MAP", "ROB", "SRF", "CRW", "AGT"), "absorbability": ("LLM",), "entity_legitimacy": ("FACTS",), "accessibility": ("A11Y",)}
GROUPS = {"SEO": "HTML Metadata", "LNK": "Internal Links", "MAP": "Sitemaps", "ROB": "Robots", "SOC": "Social Metadata", "SCH": "Structured Data", "LLM": "LLM Artifacts", "CNT": "Content Policy", "GEO": "Retrieval Structure", "CRW": "Runtime Crawl", "DEP": "Deployment Model", "QLT": "Internal Quality"}


def prefix(rule: str = "rule_id") -> str:
    return f"regexp_replace({rule}, '[0-9]+$', '')"


def case(column: str, pairs, default: str) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in pairs)} ELSE '{default}' END"


def rule_class() -> str:
    return case(prefix(), [(k, v[0]) for k, v in CLASSES.items()], "heuristic")


def confidence() -> str:
    return f"CASE WHEN rule_id IN ('GEO001', 'GEO002', 'GEO003', 'GEO004', 'GEO005', 'GEO006') THEN 'high' ELSE {case(prefix(), [(k, v[1]) for k, v in CLASSES.items()], 'medium')} END"


def layer() -> str:
    pairs = [(p, name) for name, all_ in LAYERS.items() for p in all_]
    return f"CASE WHEN rule_id IN ('SCH011', 'SCH015') THEN 'retrievability' WHEN rule_id IN ('SRF005', 'SRF006') THEN 'absorbability' ELSE {case(prefix(), pairs, 'citability')} END"


def group() -> str:
    return case("regexp_extract(rule_id, '^[A-Z]*', 0)", GROUPS.items(), "Other")


def sitewide() -> str:
    alone = ", ".join(f"'{r}'" for r in ("SCH009", "SEO011", "SEO017", "CRW003", *SITEWIDE))
    return f"({prefix()} IN ('MAP', 'ROB', 'LLM', 'DEP', 'QLT') OR rule_id IN ({alone}))"
