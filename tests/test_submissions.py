"""Payloads, attempts and retries by hand."""

from pyspark.sql import functions as F

from spanlight.operators import submissions


def test_payloads_attempts_and_retries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(submissions, "PART", 1)  # so that a few addresses are dealt into parts
    rows = [("a", f"https://a/{k:02}") for k in range(11)] + [("a", " https://a/01 "), ("a", ""), ("a", None), (None, "https://a/x"), ("a", "ftp://a/y"), ("a", "https://b/z"), ("a", "z"), ("b", "HTTPS://B:8/q")]
    addresses = spark.createDataFrame(rows, "site string, url string")
    assert {(r.url, r.error) for r in submissions.rejected(addresses).collect()} == {("ftp://a/y", "must use http or https"), ("https://b/z", "is not owned by the site"), ("z", "invalid URL")}
    planned = submissions.batches(addresses, most=3)
    found = planned.collect()
    assert sorted(u for r in found for u in r.urls if r.site == "a") == [f"https://a/{k:02}" for k in range(11)]
    assert all(len(r.urls) <= 3 and r.urls == sorted(r.urls) for r in found) and [r.urls for r in found if r.site == "b"] == [["HTTPS://B:8/q"]]
    again = {(r.part, r.number): r.digest for r in submissions.batches(addresses.union(addresses), most=3).where("site = 'a'").collect()}
    assert again == {(r.part, r.number): r.digest for r in found if r.site == "a"}

    folder = f"{tmp_path}/ledger"
    sent = lambda ledger, status: submissions.attempts(planned, ledger, "e").select(F.current_timestamp().alias("submitted_at"), "attempt", F.lit("e").alias("endpoint"), "site", "digest", "urls", F.lit(status).cast("int").alias("status_code"), F.lit(None).cast("string").alias("error"))
    read = lambda: spark.read.parquet(folder).drop("run_id")
    none = spark.createDataFrame([], submissions.LEDGER)
    for _ in range(2):  # a run that is repeated counts once
        submissions.append(sent(none, 503), folder, "1")
    assert {r.attempt for r in read().collect()} == {1} and read().count() == len(found)
    assert submissions.retries(read(), 2).groupBy("site").count().orderBy("site").collect() == [("a", 2), ("b", 1)]
    assert {r.attempt for r in submissions.attempts(planned, read(), "e").collect()} == {2} and {r.attempt for r in submissions.attempts(planned, read(), "other").collect()} == {1}
    submissions.append(sent(read(), 404), folder, "2")
    assert submissions.retries(read(), 9).count() == 0  # the last attempt of each was turned down for good
    last = submissions.latest(read()).collect()
    assert {(r.attempt, r.success, r.retryable) for r in last} == {(2, False, False)}
    failed = read().withColumn("status_code", F.lit(None).cast("int"))
    assert {r.retryable for r in submissions.latest(failed).collect()} == {True}
    assert submissions.batches(addresses.limit(0)).count() == 0 and submissions.retries(none, 3).count() == 0


def test_payloads_of_a_large_site_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(submissions, "PART", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a few addresses are sorted in several ranges
    try:
        urls = {site: [f"https://{site}/{k * 37 % 1000:03}" for k in range(n)] for site, n in (("a", 100), ("b", 1), ("c", 21))}
        addresses = spark.createDataFrame([(site, url) for site, them in urls.items() for url in them], "site string, url string")
        found = submissions.batches(addresses, most=3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for site, them in urls.items():
        rows = sorted((r.number, r.part, r.urls) for r in found if r.site == site)
        assert rows == [(k, k // 2, sorted(them)[3 * k : 3 * k + 3]) for k in range(-(-len(them) // 3))]
