"""CNT006: copy that tells what readers need in abstract words alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.dialect import LOWER, UPPER
from spanlight.operators import rules

#: What comes before a need, abstract words, and words that make it concrete.
TRIGGERS = ("needs ", "wants ", "looking for ", "is seeking ", "audience needs", "user needs", "team needs", "designed for ")
ABSTRACT = ("speed", "clarity", "efficiency", "productivity", "simplicity", "focus", "growth", "success", "peace of mind", "ease", "confidence", "control", "flexibility", "agility", "scalability", "transparency", "reliability", "performance")
CONCRETE = ("study", "research", "case", "example", "report", "survey", "according", "team", "team's", "ceo", "vp", "company", "customer", "client", "users")
#: Characters looked at after a trigger, words told, and the message.
WINDOW, TOLD = 80, 6
BEFORE, AFTER = "page has generic-beneficiary copy near '", "' — abstract audience needs without concrete examples (numbers, names, quotes); editors should anchor with specifics or suppress via a route_kind"
SPECIFIC = "[0-9\"']"


def any_word(words) -> str:
    return f"(^|[^a-z])({'|'.join(words)})($|[^a-z])"


def generic(sample: Column) -> Column:
    return sample.rlike(any_word(ABSTRACT)) & ~sample.rlike(any_word(CONCRETE)) & ~sample.rlike(SPECIFIC)


def generic_findings(pages: DataFrame) -> DataFrame:
    """(site, rule_id, severity, path, message), one a page at most: the first trigger by order whose following characters are generic.

    The window counts characters, not bytes.  A page without text gives none.
    """
    text = F.translate("visible", UPPER, LOWER)
    rows = pages.where(f"page_kind NOT IN {rules.THIN}").select("site", "path", text.alias("t"))
    after = lambda trigger: F.regexp_extract_all("t", F.lit(rf"{trigger}(?=([\s\S]{{0,{WINDOW}}}))"), 1)
    words = lambda s: F.array_join(F.slice(F.filter(F.split(s, r"\s+"), lambda w: w != ""), 1, TOLD), " ")
    told = lambda trigger: F.transform(F.filter(after(trigger), generic), lambda s: F.concat(F.lit(trigger), words(s)))
    first = F.get(F.concat(*map(told, TRIGGERS)), F.lit(0))
    found = rows.select("site", F.lit("CNT006").alias("rule_id"), F.lit("warning").alias("severity"), "path", F.concat(F.lit(BEFORE), first, F.lit(AFTER)).alias("message"))
    return found.where("message IS NOT NULL")
