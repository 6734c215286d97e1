"""Joins whose sides Spark sizes too low stay out of the driver."""

import re

from spanlight.llm import variants


def broadcasts(df):
    return re.findall("BroadcastHashJoin", df._jdf.queryExecution().executedPlan().toString())


def test_joins_of_words_are_not_broadcast(spark, tmp_path):
    words = [(a + b + c, 3 + len(a)) for a in ("hou", "hoouu", "mou") for b in ("sel", "rel", "zzel") for c in ("ing", "ings", "ong")]
    spark.createDataFrame(words, "word string, n long").write.parquet(f"{tmp_path}/words")
    table = spark.read.parquet(f"{tmp_path}/words")
    pairs = variants.near_pairs(table, variants.rare_first(table))
    assert not broadcasts(pairs) and pairs.count() > 9
    rows = spark.createDataFrame([(i, "houses house shouses houses Houser") for i in range(9)], "doc_id long, text string")
    found = variants.spelling_variants(spark, rows)
    assert not broadcasts(found) and {(r.word, r.root, r.n_near) for r in found.collect()} >= {("houses", "houses", 3), ("house", "houses", 2)}
