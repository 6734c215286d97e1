"""Fan-out queries against all pairs of a site, on few words that most routes share."""

import random
import re

import duckdb
import pytest

from spanlight.operators import intelligence
from spanlight.plans import intelligence_sql

COLUMNS = "site, family, topic, query, expected_surface, coverage, routes, gaps"
GROUND = "site string, route string, primary_topic string, secondary_topics array<string>, intents array<string>, answer_blocks int, heading_count int, schema_types array<string>"


@pytest.mark.parametrize("rare", [0, 3, 1000])
def test_best_routes_equal_all_pairs_without_broadcasts(spark, tmp_path, rare):
    draw = random.Random(7)
    words = "alpha beta gamma delta html the and über x1 of".split()
    topic = lambda n: " ".join(draw.choices(words, range(10, 0, -1), k=draw.randint(1, n)))
    rows = [("big.example", f"en/{'_'.join(draw.choices(words, k=2))}/{k}.html", topic(5), [topic(8) for _ in range(k % 4)], draw.sample(list(intelligence.FAMILIES), 1 + k % 3), k % 4, k % 5, ["Article"] * (k % 3 == 0)) for k in range(150)]
    rows += [("small.example", "a", "(unclassified)", [], ["generic"], 0, 1, []), ("small.example", "b", "", [], ["pricing"], 2, 3, []), ("one.example", "", "of", [], ["generic"], 0, 0, [])]
    rows += [("same.example", f"p/{k}", "one topic", [], ["generic"], 1, 1, []) for k in range(9)]
    spark.createDataFrame(rows, GROUND).write.parquet(f"{tmp_path}/ground")

    def save(table, name):
        table.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    found = intelligence.fanout(spark.read.parquet(f"{tmp_path}/ground"), save=save, rare=rare)
    assert not re.findall("BroadcastHashJoin", found._jdf.queryExecution().executedPlan().toString())
    engine = duckdb.connect()
    engine.execute(f"CREATE TABLE ground AS SELECT * FROM '{tmp_path}/ground/*.parquet'")
    wanted = engine.execute(f"WITH {intelligence_sql.fanout().strip().lstrip(',')} SELECT {COLUMNS} FROM asked").fetchall()
    assert sorted(map(tuple, found.select(*COLUMNS.split(", ")).collect())) == sorted(wanted)


def one_page(spark, folder):
    """The fan-out of a table that Spark sizes by its file."""
    spark.createDataFrame([("s", "a/b", "two words", [], ["generic"], 1, 1, [])], GROUND).write.parquet(f"{folder}/ground")
    return intelligence.fanout(spark.read.parquet(f"{folder}/ground"))


def broadcasts(rows):
    return re.findall("BroadcastHashJoin", rows._jdf.queryExecution().executedPlan().toString())


def test_fanout_queries_are_not_broadcast(spark, tmp_path):
    found = one_page(spark, tmp_path)
    assert not broadcasts(found) and found.count() == len(intelligence.SEEDS)
    assert intelligence.fanout(spark.createDataFrame([], GROUND)).count() == 0


def test_fanout_sites_are_not_broadcast(spark, tmp_path):
    found = intelligence.fanout_by_site(one_page(spark, tmp_path))
    assert not broadcasts(found) and [tuple(r) for r in found.collect()] == [("s", len(intelligence.SEEDS), 0, 0)]


def test_least_covered_queries_are_not_broadcast(spark, tmp_path):
    found = intelligence.least_covered(one_page(spark, tmp_path))
    assert not broadcasts(found) and sorted(r.place for r in found.collect()) == list(range(1, len(intelligence.SEEDS) + 1))
