"""The scalar functions of the audit as SQL text.

Each function is written once and rendered for Spark, or for DuckDB where the
tests and the oracle need the same value.  Everything is a built-in expression,
so Catalyst prunes what a query doesn't read and no Python runs.
"""

from __future__ import annotations

import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space, as a character class.
SPACE = r"[\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


class Spark:
    name = "spark"

    def pattern(self, p: str) -> str:
        return "r'" + p.replace("'", r"\x27") + "'"

    def all(self, s: str, p: str, group: int) -> str:
        return f"regexp_extract_all({s}, {self.pattern(p)}, {group})"

    def one(self, s: str, p: str, group: int) -> str:
        return f"regexp_extract({s}, {self.pattern(p)}, {group})"

    def sub(self, s: str, p: str, by: str) -> str:
        return f"regexp_replace({s}, {self.pattern(p)}, '{by}')"

    def like(self, s: str, p: str) -> str:
        return f"({s} rlike {self.pattern(p)})"

    def each(self, a: str, f: str) -> str:
        return f"transform({a}, {f})"

    def keep(self, a: str, f: str) -> str:
        return f"filter({a}, {f})"

    def fn(self, var: str, body: str) -> str:
        return f"{var} -> {body}"

    def indexed(self, a: str, body: str) -> str:
        """Each x of an array with its place i; see before() and following()."""
        return f"transform({a}, (x, i) -> {body})"

    def before(self, a: str) -> str:
        return f"get({a}, i - 1)"

    def following(self, a: str, n: int) -> str:
        return f"slice({a}, i + 2, {n})"

    def first(self, a: str, n: int) -> str:
        return f"slice({a}, 1, {n})"

    def joined(self, a: str, by: str) -> str:
        return f"array_join({a}, '{by}')"

    def rows(self, columns: str, a: str, name: str, source: str) -> str:
        """A SELECT of one row for each element."""
        return f"SELECT {columns}, {name} FROM {source} LATERAL VIEW explode({a}) e AS {name}"

    def nth(self, a: str, k: int) -> str:
        return f"try_element_at({a}, {k})"

    def count(self, s: str, p: str) -> str:
        return f"regexp_count({s}, {self.pattern(p)})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def octets(self, s: str) -> str:
        return f"octet_length({s})"

    def split(self, s: str, by: str) -> str:
        return f"split({s}, '{by}')"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def starts(self, s: str, x: str) -> str:
        return f"startswith({s}, {x})"

    def ends(self, s: str, x: str) -> str:
        return f"endswith({s}, {x})"

    def sorted(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))"


class DuckDB(Spark):
    name = "duckdb"

    def pattern(self, p: str) -> str:
        return "'" + p.replace("'", r"\x27") + "'"

    def sub(self, s: str, p: str, by: str) -> str:
        return f"regexp_replace({s}, {self.pattern(p)}, '{by}', 'g')"

    def like(self, s: str, p: str) -> str:
        return f"regexp_matches({s}, {self.pattern(p)})"

    def each(self, a: str, f: str) -> str:
        return f"list_transform({a}, {f})"

    def keep(self, a: str, f: str) -> str:
        return f"list_filter({a}, {f})"

    def fn(self, var: str, body: str) -> str:
        return f"lambda {var}: {body}"

    def indexed(self, a: str, body: str) -> str:
        return f"list_transform({a}, lambda x, i: {body})"

    def before(self, a: str) -> str:
        return f"({a})[i - 1]"

    def following(self, a: str, n: int) -> str:
        return f"({a})[i + 1:i + {n}]"

    def first(self, a: str, n: int) -> str:
        return f"({a})[1:{n}]"

    def joined(self, a: str, by: str) -> str:
        return f"array_to_string({a}, '{by}')"

    def rows(self, columns: str, a: str, name: str, source: str) -> str:
        return f"SELECT {columns}, unnest({a}) AS {name} FROM {source}"

    def nth(self, a: str, k: int) -> str:
        return f"({a})[{k}]"

    def count(self, s: str, p: str) -> str:
        return f"len({self.all(s, p, 0)})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def octets(self, s: str) -> str:
        return f"strlen({s})"

    def split(self, s: str, by: str) -> str:
        return f"string_split({s}, '{by}')"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def starts(self, s: str, x: str) -> str:
        return f"starts_with({s}, {x})"

    def ends(self, s: str, x: str) -> str:
        return f"ends_with({s}, {x})"

    def sorted(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"


class Text:
    """Text and HTML functions in one dialect."""

    def __init__(self, d: Spark):
        self.d = d

    def lower(self, s: str) -> str:
        """A-Z only."""
        return f"translate({s}, '{UPPER}', '{LOWER}')"

    def collapse(self, s: str) -> str:
        return f"trim({self.d.sub(s, SPACE, ' ')})"

    def strip_tags(self, s: str) -> str:
        """What is outside tags, white space collapsed; an open tag hides the rest, a stray ``>`` goes."""
        return self.collapse(f"replace({self.d.sub(s, r'<[^>]*(>|\z)', '')}, '>', '')")

    def trim(self, s: str) -> str:
        return self.d.sub(s, rf"^{SPACE}|{SPACE}$", "")

    def attribute(self, tag: str, name: str) -> str:
        """The value after the leftmost ``name="``, else after ``name='``; null without the closing quote."""
        n = re.escape(name).replace(r"\-", "-").replace(r"\:", ":")
        two, one = rf'{n}="([^"]*)"', rf"{n}='([^']*)'"
        return (
            f"CASE WHEN {self.d.like(tag, n + '=' + chr(34))} THEN CASE WHEN {self.d.like(tag, two)} THEN {self.trim(self.d.one(tag, two, 1))} END "
            f"WHEN {self.d.like(tag, one)} THEN {self.trim(self.d.one(tag, one, 1))} END"
        )

    def tags(self, html: str, name: str) -> str:
        return self.d.all(html, f"<{name}[^>]*>", 0)

    def texts(self, html: str, name: str) -> str:
        """Not empty texts between ``<name...>`` and the next ``</name>``."""
        inner = self.d.all(html, f"(?s)<{name}[^>]*>(.*?)</{name}>", 1)
        return self.d.keep(self.d.each(inner, self.d.fn("x", self.strip_tags("x"))), self.d.fn("y", "y <> ''"))

    def internal(self, href: str) -> str:
        """The route of a root-relative href, or null."""
        cleaned = self.d.one(href, r"^([^#?]*)", 1)
        return f"CASE WHEN {self.d.starts(href, chr(39) + '/' + chr(39))} AND NOT {self.d.starts(href, chr(39) + '//' + chr(39))} THEN trim({cleaned}, '/') END" if self.d.name == "duckdb" else f"CASE WHEN startswith({href}, '/') AND NOT startswith({href}, '//') THEN trim(BOTH '/' FROM {cleaned}) END"

    def urlish(self, value: str) -> str:
        """The route of an address or a root-relative href."""
        rest = self.d.sub(value, r"^[\s\S]*?://", "")
        path = f"CASE WHEN {self.d.like(rest, '/')} THEN {self.d.one(rest, r'^[^/]*(/[\s\S]*)$', 1)} ELSE '/' END"
        return f"coalesce({self.internal(value)}, {self.internal(path)})"

    def unscripted(self, html: str) -> str:
        """Without scripts, then without styles; one that is not closed hides the rest."""
        return self.d.sub(self.d.sub(html, r"(?s)<script.*?(?:</script>|\z)", " "), r"(?s)<style.*?(?:</style>|\z)", " ")

    def page_kind(self, relative: str, route: str) -> str:
        r, low = self.d, self.lower(route)
        return f"""CASE WHEN {relative} = '404.html' OR {route} = '404' THEN 'not_found' WHEN {route} = '' THEN 'home'
            WHEN {r.like(low, '^admin|/admin/')} THEN 'admin'
            WHEN {r.like(low, '^(legal|privacy|terms|mentions-legales|politique-de-confidentialite)(/|$)')} THEN 'legal'
            WHEN {r.like(low, '[.]xml$|^feed|/feed$')} THEN 'feed'
            WHEN {r.like(low, '^docs/|^guide|/docs/|/guide/')} THEN 'docs'
            WHEN {r.like(low, '^(skills|features|maintainers)$|^(category|tag|maintainer)/')} THEN 'listing'
            WHEN {r.like(low, '^(skill|features|product|service)/')} THEN 'detail'
            WHEN {r.like(low, '(^|/)search(/|$)')} THEN 'search'
            WHEN {low} IN ('submit', 'ops', 'status') THEN 'utility' ELSE 'generic' END"""
