"""Files in and out, the stream of pages, and the frontier, on small inputs."""

import json

import pytest

from spanlight.sources import config, files, sinks
from spanlight.streaming import audit, frontier


def test_html_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "index.html").write_text("home")
    (tmp_path / "a" / "b" / "index.html").write_text("é")
    (tmp_path / "a" / "x.html").write_text(" ")
    (tmp_path / "a" / "none.html").write_text("")
    (tmp_path / "a" / "x.htm").write_text("no")
    rows = {r.url: r.html for r in files.html_pages(spark, str(tmp_path), "s.example").collect()}
    assert rows == {"https://s.example/": "home", "https://s.example/a/b/": "é", "https://s.example/a/x.html": " "}


def test_citations(spark, tmp_path):
    csv = tmp_path / "c.csv"
    csv.write_text('Page URL,Prompt,Citation Count,Other\nhttps://a/b,"q, r",3,x\nhttps://a/b,,,y\n,q,1,z\n')
    rows = sorted((r.url, r["query"], r.citations, r.clicks) for r in files.citations(spark, str(csv)).na.fill("").collect())
    assert rows == [("https://a/b", "", 1, None), ("https://a/b", "q, r", 3, None)]
    one = tmp_path / "c.json"
    one.write_text(json.dumps({"rows": [{"url": "u", "citations": 2, "clicks": 5}]}))
    assert [(r.url, r.citations, r.clicks) for r in files.citations(spark, str(one), "json").collect()] == [("u", 2, 5)]
    one.write_text(json.dumps([{"url": "u"}]))
    assert [(r.url, r.citations) for r in files.citations(spark, str(one), "json").collect()] == [("u", 1)]


def test_records(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("source_type,url,title,stars,note\ndir,https://a,T,7,x\n")
    (row,) = files.records(spark, str(path)).collect()
    assert (row.source_type, row.title, row.snippet, row.metrics) == ("dir", "T", None, {"stars": 7})
    path.write_text("source_type,url\n,https://a\n")
    with pytest.raises(Exception, match="a record lacks source_type"):
        files.records(spark, str(path)).collect()


def test_findings_out_and_in(spark, tmp_path):
    rows = [("s", f"p{k % 3}", f"R{k:02}", "warning" if k % 2 else "error", 'say "x"') for k in range(20)]
    found = spark.createDataFrame(rows, "site string, path string, rule_id string, severity string, message string")
    documents = [json.loads(r.value) for r in sinks.sarif_documents(found, "t", most=4).collect()]
    results = [r for d in documents for r in d["runs"][0]["results"]]
    assert sorted(r["ruleId"] for r in results) == sorted(r[2] for r in rows) and max(len(d["runs"][0]["results"]) for d in documents) <= 4
    assert results[0]["message"]["text"] == 'say "x"' and results[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    for _ in range(2):
        sinks.write_findings(found, str(tmp_path), "7")
    assert spark.read.json(str(tmp_path)).count() == 20
    path = tmp_path / "old.json"
    for text in (json.dumps([{"rule_id": "R", "path": "p"}]), json.dumps({"version": 2, "findings": [{"rule_id": "R", "path": "p"}]})):
        path.write_text(text)
        assert [(r.rule_id, r.line, r.severity, r.scope) for r in files.audit(spark, str(path)).collect()] == [("R", 1, "error", "page")]


def test_history(spark):
    runs = spark.createDataFrame([(str(k), k, k, 0, 0) for k in range(60)], "run_id string, generated_at long, total long, errors long, warnings long")
    kept = sinks.trend(runs.where("run_id <> '59'"), runs.where("run_id = '59'")).collect()
    assert [r.generated_at for r in kept] == list(range(59, 9, -1))
    old = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], "command string, run_id string, generated_at long")
    assert [r.run_id for r in sinks.expired(old, 1).collect()] == ["1"]


def test_settings(tmp_path):
    (tmp_path / "base.toml").write_text("[rules]\na = 1\nb = 2\n")
    (tmp_path / "own.toml").write_text('extends = "base.toml"\n[rules]\nb = 3\n')
    assert config.settings(tmp_path / "own.toml", {"rules"}) == {"rules": {"a": 1, "b": 3}}
    (tmp_path / "base.toml").write_text('extends = "own.toml"')
    with pytest.raises(ValueError, match="themselves"):
        config.settings(tmp_path / "own.toml")
    with pytest.raises(ValueError, match="unknown"):
        config.settings(tmp_path / "own.toml", set())


def test_stream_of_pages(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(rows, audit.PAGES).coalesce(1).write.mode("append").parquet(source)
        audit.run(spark, source, out)

    def titles():
        return sorted(str(r.path) for r in audit.current(spark, out).where("rule_id = 'SEO001'").collect())

    arrive((1, "https://a.example/x", ""), (2, "https://a.example/y", None), (3, None, None))
    assert titles() == ["None", "crawl/x/index.html", "crawl/y/index.html"]
    arrive((4, "https://a.example/x", "<title>t</title>"))
    assert "crawl/x/index.html" not in titles() and "crawl/y/index.html" in titles()
    audit.run(spark, source, out)
    assert "crawl/y/index.html" in titles()


def test_frontier(spark):
    edges = [("s", a, b) for a, b in [("", "b"), ("", "a"), ("a", "c"), ("b", "c"), ("c", ""), ("c", "admin/x"), ("c", "d"), ("d", "e")]]
    edges = spark.createDataFrame([*edges, ("t", "", "z")], "site string, route string, target string")
    starts = spark.createDataFrame([("s", ""), ("t", "")], "site string, route string")
    found = {(r.site, r.route): (r.depth, r.place) for r in frontier.frontier(spark, starts, edges, 5, exclude=("admin",)).collect()}
    assert found == {("s", ""): (0, 1), ("s", "a"): (1, 2), ("s", "b"): (1, 3), ("s", "c"): (2, 4), ("s", "d"): (3, 5), ("t", ""): (0, 1), ("t", "z"): (1, 2)}
