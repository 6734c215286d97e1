"""Links that a site's pages lack: for each route the few others that fit it best.

A pair's points are the words that both have, PREFIX for one first part of the
route and up to three for a target that few pages link to; at least LEAST_POINTS
are needed.  All pairs of a site are never formed:

1. Words that at most ``rare`` of a site's routes have are an inverted index.
   Its lists are short, so every pair that shares one of them is met, and gets
   all its points, the frequent words of both included.
2. A route whose n-th best of those has more points than its frequent words and
   the bonus could give is done: no other pair can reach it.
3. What is left can only share frequent words.  Targets with one set of those,
   one bonus and, if need be, one prefix differ in nothing but their name, so
   of each such class the first few names stand for all: as many as are told,
   and as many more as the source already links to.  Sources meet what remains
   of their site, and of their prefix, in blocks that give their best few, so
   no pairs are written.  A word that all routes share so costs a handful of
   targets for each route.

A site without a name takes part in no join; a page without words gets targets
by prefix and bonus alone; no pages give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.functions.dialect import LOWER, UPPER
from spanlight.operators.reports import best

#: Points for one prefix, points by the number of pages that link to a target, least points of a suggestion.
PREFIX, FEW_LINKS, LEAST_POINTS = 3, ((2, 3), (4, 1)), 3
#: Words of a block that count, and bytes from which one without a heading counts.
BLOCK_WORDS, BLOCK_BYTES = 80, 80
#: Targets told of a route; routes of an index list; links up to which a source goes by shortened classes; rows of a block.
TOLD, RARE, LINKS, BLOCK = 3, 64, 64, 512


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), 0))


def route_tokens(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(site, route, token), each once: words of a route, of its title, description, headings and of its blocks."""
    pages = pages.where("route <> '404'")
    own = pages.select("site", "route", F.explode(tokens(F.concat_ws(" ", "route", "title", "description", F.array_join("h1_texts", " ")))).alias("token"))
    first = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, BLOCK_WORDS), " ")
    said = F.concat_ws(" ", "data_ui", F.when(F.col("has_heading") | (F.octet_length("text") > BLOCK_BYTES), first))
    shown = blocks.join(pages.select("site", "path", "route"), ["site", "path"]).select("site", "route", F.explode(tokens(said)).alias("token"))
    return own.union(shown).distinct()


def route_features(pages: DataFrame, links: DataFrame, common: DataFrame) -> DataFrame:
    """(site, route, prefix, bonus, linked, common) of each route."""
    pages = pages.where("route <> '404'").select("site", "route", "relative_path")
    aimed = links.where("target IS NOT NULL").select("site", "relative_path", "target", "place").distinct()
    inbound = aimed.select("site", "relative_path", F.col("target").alias("route")).distinct().join(pages.select("site", "route", F.col("relative_path").alias("own")), ["site", "route"])
    inbound = inbound.where("relative_path <> own").groupBy("site", "route").agg(F.count("*").alias("inbound"))
    linked = aimed.where("place = 1").groupBy("site", "relative_path").agg(F.array_sort(F.collect_set("target")).alias("linked"))
    rows = pages.join(inbound, ["site", "route"], "left").join(linked, ["site", "relative_path"], "left").join(common, ["site", "route"], "left")
    n = F.coalesce("inbound", F.lit(0))
    (few, high), (some, low) = FEW_LINKS
    none = F.array().cast("array<string>")
    return rows.select(
        "site", "route", F.substring_index("route", "/", 1).alias("prefix"), F.when(n < few, high).when(n < some, low).otherwise(0).alias("bonus"),
        F.coalesce("linked", none).alias("linked"), F.coalesce("common", none).alias("common"),
    )


def met_in_blocks(sources: DataFrame, targets: DataFrame, zone: list[str], top: int) -> DataFrame:
    """(site, route, target, score): the best of the targets of a source's zone, from each block of them."""
    parts = targets.groupBy(*zone).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("target_blocks"))
    mine = sources.groupBy(*zone).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("source_blocks"))
    sizes = parts.join(mine, zone)
    deal = lambda rows, n: F.pmod(F.xxhash64(*[F.col(c) for c in ("site", "route")]), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sources.join(sizes, zone).select("site", "route", "prefix", "common", "linked", deal(sources, "source_blocks").alias("i"), each("target_blocks").alias("j"))
    right = targets.join(sizes, zone).select("site", "route", "prefix", "common", "bonus", deal(targets, "target_blocks").alias("j"), each("source_blocks").alias("i"))
    keys = [*zone, "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_search(top), "site string, route string, target string, score long")


def block_search(top: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        columns = ["site", "route", "target", "score"]
        if not len(s) or not len(t):
            return pd.DataFrame(columns=columns)
        t = t.sort_values("route").reset_index(drop=True)
        number: dict[str, int] = {}
        for words in (*s["common"], *t["common"]):
            for w in words:
                number.setdefault(w, len(number))

        def matrix(rows: pd.Series) -> np.ndarray:
            out = np.zeros((len(rows), max(1, len(number))), np.float32)
            for k, words in enumerate(rows):
                out[k, [number[w] for w in words]] = 1
            return out

        score = (matrix(s["common"]) @ matrix(t["common"]).T).astype(np.int64)
        score += PREFIX * (s["prefix"].to_numpy()[:, None] == t["prefix"].to_numpy()[None, :]) + t["bonus"].to_numpy(np.int64)[None, :]
        place = {r: k for k, r in enumerate(t["route"])}
        for k, (route, linked) in enumerate(zip(s["route"], s["linked"], strict=True)):
            score[k, [place[r] for r in (route, *linked) if r in place]] = -1
        # Targets are in the order of their names and the sort is stable.
        order = np.argsort(-score, axis=1, kind="stable")[:, :top]
        found = np.take_along_axis(score, order, 1)
        rows, at = np.nonzero(found >= LEAST_POINTS)
        return pd.DataFrame({"site": s["site"].to_numpy()[rows], "route": s["route"].to_numpy()[rows], "target": t["route"].to_numpy()[order[rows, at]], "score": found[rows, at]}, columns=columns)

    return search


def link_suggestions(pages: DataFrame, blocks: DataFrame, links: DataFrame, save: Callable[[DataFrame, str], DataFrame], top: int = TOLD, rare: int = RARE) -> DataFrame:
    """(site, route, target, score, place) of the ``top`` best targets of each route.

    ``save(rows, name)`` writes rows once and gives them back, as several steps
    read them.
    """
    words = save(route_tokens(pages, blocks), "words")
    often = words.groupBy("site", "token").agg(F.count("*").alias("routes"))
    counted = save(words.join(often, ["site", "token"]), "counted")
    common = counted.where(F.col("routes") > rare).groupBy("site", "route").agg(F.array_sort(F.collect_list("token")).alias("common"))
    features = save(route_features(pages, links, common), "features")

    listed = counted.where(F.col("routes") <= rare).select("site", "token", "route")
    pairs = listed.join(listed.select("site", "token", F.col("route").alias("target")), ["site", "token"]).where("route <> target").groupBy("site", "route", "target").agg(F.count("*").alias("shared"))
    source = features.select("site", "route", "prefix", "common", "linked")
    target = features.select("site", F.col("route").alias("target"), F.col("prefix").alias("t_prefix"), F.col("common").alias("t_common"), "bonus")
    scored = pairs.join(source, ["site", "route"]).join(target, ["site", "target"]).where(~F.array_contains("linked", F.col("target")))
    points = F.col("shared") + F.size(F.array_intersect("common", "t_common")) + F.when(F.col("prefix") == F.col("t_prefix"), PREFIX).otherwise(0) + F.col("bonus")
    scored = scored.select("site", "route", "target", points.cast("long").alias("score")).where(F.col("score") >= LEAST_POINTS)
    near = save(best(scored, ["site", "route"], [F.desc("score"), "target"], top), "near")

    bound = near.where(F.col("place") == top).select("site", "route", F.col("score").alias("bound"))
    most = F.size("common") + PREFIX + FEW_LINKS[0][1]
    left = save(features.join(bound, ["site", "route"], "left").where(F.col("bound").isNull() | (F.col("bound") <= most)).drop("bound"), "left")
    light, heavy = left.where(F.size("linked") <= LINKS), left.where(F.size("linked") > LINKS)
    first = lambda *by: F.row_number().over(Window.partitionBy("site", "common", "bonus", *by).orderBy("route"))
    shortened = lambda *by: features.withColumn("nr", first(*by)).where(F.col("nr") <= top + 1 + LINKS).drop("nr")
    far = met_in_blocks(light, shortened(), ["site"], top).union(met_in_blocks(light, shortened("prefix"), ["site", "prefix"], top)).union(met_in_blocks(heavy, features, ["site"], top))
    # A pair found twice has all its points in the index's row.
    merged = near.select("site", "route", "target", "score").union(far).groupBy("site", "route", "target").agg(F.max("score").alias("score"))
    return best(merged, ["site", "route"], [F.desc("score"), "target"], top)
