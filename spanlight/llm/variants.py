"""Spelling variants: words one edit apart, and the form that each goes back to.

The dictionary is counted first.  Bigrams are put in one order by how many
words have them, rare first.  One edit spoils at most two bigrams of a word, so
of the three rarest of each of two near words one at least stands in both, and
as the edit is on one side of it, what is left of it or what is right of it is
the same in both.  A word so is joined on its three rarest bigrams, each once
with all before it and once with all after it, which holds its place from the
start or from the end to the same one, and only with words as long or one
longer.  Where the third rarest occurs more than once in a word, all its places
count, else the lemma would not hold.  An edit inside a word leaves its ends, so
the letter at the other end is part of the key; an edit at an end leaves all
the rest, which is a key by itself.  Keys are joined by 64 bits of their hash,
as rows with a number are half as wide and sort faster than rows with a text;
each pair so found, by chance too, is verified by its lengths and edit distance.

Bigrams of an alphabet of 90 letters are 8,100 at most, so their order is an
array in the expression; nothing else is gathered.  Texts are counted with
partial sums before the shuffle.  All joins ask for a merge: Spark sizes a table
of words by its packed file, and one of exploded keys no larger, so it would
broadcast what does not fit the driver.  Null texts have no words, a null id counts as
an empty one in a run's hash, repeated rows count each, ties go to the smaller
word, an empty table gives none, and other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Scratch

LEAST_LENGTH, LEAST_COUNT, SPOILT, TIMES = 5, 3, 97, 2
#: Whole runs of letters that may be words (a letter can only be lost, so shorter ones are none), and the letters that remain after lowering A-Z, by code point.
RUN, LATIN = rf"[A-Za-z\u00C0-\u00FF]{{{LEAST_LENGTH},}}", (0xC0, 0xFF)
LETTERS = 26 + LATIN[1] - LATIN[0] + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): distinct words of at least LEAST_LENGTH letters and LEAST_COUNT occurrences.

    A run whose hash with its document's id is divisible by SPOILT loses the
    letter that the hash points to.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), 0)).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    spoilt = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % SPOILT == 0, spoilt).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def lowered(run: Column) -> Column:
    """A-Z in lower case; where all letters are among those and a-z, the faster function does the same."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def letter(word: Column, at: Column) -> Column:
    code = F.ascii(F.substr(word, at, F.lit(1)))
    return F.when(code < 128, code - ord("a")).otherwise(code - LATIN[0] + 26)


def bigrams(word: Column) -> Column:
    """(at, gram) of each place of a word."""
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.struct(i.alias("at"), (letter(word, i) * LETTERS + letter(word, i + 1)).alias("gram")))


def rare_first(words: DataFrame) -> list[int]:
    """The place of every possible bigram in the order by the number of words that have it, then by itself."""
    counts = words.select(F.explode(F.array_distinct(F.transform(bigrams(F.col("word")), lambda g: g.gram))).alias("gram")).groupBy("gram").count().collect()  # LETTERS^2 rows at most
    known = {r.gram: r["count"] for r in counts}
    place = [0] * (LETTERS * LETTERS)
    for k, gram in enumerate(sorted(range(len(place)), key=lambda g: (known.get(g, 0), g))):
        place[gram] = k
    return place


def rarest(words: DataFrame, order: list[int]) -> DataFrame:
    """(word, n, keys): the three rarest bigrams of each word with all before them and the last letter, and with all after them and the first."""
    ranks = F.split(F.lit(",".join(map(str, order))), ",").cast("array<int>")  # folded to one literal
    ranked = words.select("word", "n", F.array_sort(F.transform(bigrams(F.col("word")), lambda g: F.struct(F.get(ranks, g.gram).alias("rank"), g.at.alias("at")))).alias("grams"))
    rare = ranked.select("word", "n", F.filter("grams", lambda g: g.rank <= F.get("grams", F.lit(2)).rank).alias("grams"))
    first, last = F.substr("word", F.lit(1), F.lit(1)), F.substr("word", F.length("word"), F.lit(1))
    # What would hold the whole word is left out: an edit beyond it is one at the end.
    left = F.transform(F.filter("grams", lambda g: g.at < F.length("word") - 1), lambda g: F.concat(F.lit("<"), last, F.substr("word", F.lit(1), g.at + 1)))
    right = F.transform(F.filter("grams", lambda g: g.at > 1), lambda g: F.concat(F.lit(">"), first, F.substr("word", g.at)))
    return rare.select("word", "n", F.concat(left, right).alias("keys"))


def joined_by(length: Column, key: Column) -> Column:
    """What rows of a key and the shorter word's length meet on, as others may by chance."""
    return F.xxhash64(length, key)


def near_pairs(words: DataFrame, order: list[int]) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart, once."""
    size, word = F.length("word"), F.col("word")
    rows = rarest(words, order)
    but_last, but_first = F.substr(word, F.lit(1), size - 1), F.substr(word, F.lit(2))
    key = lambda mark, text: F.concat(F.lit(mark), text)
    at = lambda length, keys: F.transform(keys, lambda k: joined_by(length, k))
    # A letter replaced at an end, and one added there.
    ends = F.array(key("$", but_last), key("^", but_first))
    mine = at(size, F.concat("keys", ends, F.array(key("+", word), key("*", word))))
    longer = at(size - 1, F.concat("keys", F.array(key("+", but_last), key("*", but_first))))
    short = rows.select(word.alias("a"), F.col("n").alias("n_a"), F.explode(mine).alias("key"))
    long = rows.select(word.alias("b"), F.col("n").alias("n_b"), F.explode(F.concat(at(size, F.concat("keys", ends)), longer)).alias("key"))
    more = F.length("b") - F.length("a")
    met = short.join(long.hint("merge"), "key").where((more == 1) | (more == 0) & (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def with_roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): what following forms from a word ends at, for (word, form) of words that have one.

    A form has at least twice its word's count, so chains are short; each round
    halves what is left of them.
    """
    links = scratch.save(forms.select("word", F.col("form").alias("root")), "roots0")
    step = 0
    while True:
        step += 1
        on = links.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        new = links.join(on.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        new = scratch.save(new, f"roots{step}")
        scratch.drop(f"roots{step - 1}")
        links = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return links


def spelling_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    scratch = Scratch(spark, "variants")
    words = scratch.save(dictionary(docs), "words")
    pairs = scratch.save(near_pairs(words, rare_first(words)), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    # The struct's least is the greatest count, of equals the smallest word.
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= TIMES * F.col("n"), F.col("best")).alias("best"))
    rows = scratch.save(rows.select("word", F.col("best.other").alias("form"), "n", "n_near", (-F.col("best.m")).alias("form_n")), "forms")
    scratch.drop("pairs")
    roots = with_roots(rows.where("form is not null").select("word", "form"), scratch)
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
