"""One query for each operator, over its whole table, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decoded, bpe_encoded, id_digest
from .centroids import CENTROIDS, ROUNDS, cluster_report, clusters
from .core import Scratch, label_bucket, table
from .decontamination import contamination
from .fingerprints import fingerprints
from .languages import languages
from .licenses import license_scan
from .mixing import mixed
from .near_dup import near_duplicates
from .quality import quality_scores
from .token_files import read_token_files, write_token_files
from .toxicity import toxicity_scores
from .url_filters import RULES, host_of, url_verdicts
from .variants import spelling_variants

#: Score from which a label of 1 is predicted; id of a document's end.
THRESHOLD, END = 0.3, 2


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def predicted(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = label_bucket(F.col("doc_id"), 5)
    return predicted(quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part != 0), part == 0)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page's address ends in the number of its document, whose labels are the page's outcome."""
    number = F.regexp_extract(F.regexp_replace("url", r"[?#][\s\S]*$", ""), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    rows = pages.select(host_of(F.col("url")).alias("host"), number.try_cast("bigint").alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return rows.where("doc_id is not null").join(known, "doc_id").select("host", "bad")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_verdicts(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark, table(spark, sf_dir, "documents"))
    names = F.array_join(F.transform("matches", lambda m: m["license"]), ",")
    return found.select("doc_id", F.size("matches").alias("n_matches"), names.alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token_files")
    write_token_files(spark, table(spark, sf_dir, "documents"), scratch.root, tokenizer_path(), END)
    scratch.mark()
    return read_token_files(spark, scratch.root, digest=True)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = label_bucket(F.col("doc_id"), 4)
    return predicted(toxicity_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part != 2), part == 2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("item_ids").alias("n_items"), F.array_join("item_ids", ",").alias("items"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark, table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(spark, *clusters(spark, table(spark, sf_dir, "embeddings")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    rows = bpe_decoded(spark, bpe_encoded(spark, table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest(F.col("ids")).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_classifier, op2_url_filters, op3_minhash_near_dedup, op4_license_scans, op5_language_id, op6_token_binary, op7_fingerprints, op8_toxicity, op9_decontamination, op10_source_mixing, op11_spelling_variants, op12_centroid_clustering, op13_bpe)
    return {f.__name__: f for f in own}


#: The hierarchy of op2 in SQL, with the same numbers.
OP2_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path,
         try_cast(nullif(regexp_extract(regexp_replace(url, '[?#][\s\S]*$', ''), '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT) AS doc_id
  FROM pages),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
hosts0 AS (SELECT p.host, count(k.bad) AS n, coalesce(sum(k.bad), 0)::BIGINT AS bad FROM p LEFT JOIN known k ON p.doc_id = k.doc_id GROUP BY p.host),
named AS (SELECT *, string_split(regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g'), '.') AS parts FROM hosts0),
two AS (SELECT *, array_to_string(parts[-2:], '.') AS last2, array_to_string(parts[-3:], '.') AS last3, parts[-1] AS last1 FROM named),
hosts AS (SELECT host, n, bad,
    CASE WHEN last2 IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.in','co.nz','co.za') THEN last3 ELSE last2 END AS domain,
    CASE WHEN last2 IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.in','co.nz','co.za') THEN last2 ELSE last1 END AS suffix FROM two),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
whole AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
s1 AS (SELECT s.*, w.m FROM suffixes s CROSS JOIN whole w),
sk AS (SELECT 1 / least(greatest(coalesce(sum((bad - n*m)*(bad - n*m) - n*m*(1-m)) / nullif(sum(n*(n-1)*(m*(1-m))), 0), 0.5), 0.001), 0.5) - 1 AS k FROM s1),
s2 AS (SELECT suffix, (bad + k*m) / ((bad + k*m) + (n - bad + k*(1-m))) AS m FROM s1 CROSS JOIN sk),
d1 AS (SELECT d.*, s2.m FROM domains d JOIN s2 USING (suffix)),
dk AS (SELECT 1 / least(greatest(coalesce(sum((bad - n*m)*(bad - n*m) - n*m*(1-m)) / nullif(sum(n*(n-1)*(m*(1-m))), 0), 0.5), 0.001), 0.5) - 1 AS k FROM d1),
d2 AS (SELECT domain, (bad + k*m) / ((bad + k*m) + (n - bad + k*(1-m))) AS m FROM d1 CROSS JOIN dk),
h1 AS (SELECT h.host, h.n, h.bad, d2.m FROM hosts h JOIN d2 USING (domain)),
hk AS (SELECT 1 / least(greatest(coalesce(sum((bad - n*m)*(bad - n*m) - n*m*(1-m)) / nullif(sum(n*(n-1)*(m*(1-m))), 0), 0.5), 0.001), 0.5) - 1 AS k FROM h1),
h2 AS (SELECT host, bad + k*m AS alpha, n - bad + k*(1-m) AS beta FROM h1 CROSS JOIN hk),
r AS (SELECT host, alpha / (alpha + beta) AS share,
             greatest(0.0, alpha / (alpha + beta) - 1.645 * sqrt(alpha*beta / ((alpha+beta)*(alpha+beta)*(alpha+beta+1)))) AS low FROM h2),
j AS (SELECT p.page_id, p.host, p.path, r.share, r.low,
  CASE WHEN (p.host = 'example.net' OR ends_with(p.host, '.example.net')) AND starts_with(p.path, '/en/') THEN 'example.net/en/'
       WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(p.path, '/de/') THEN 'example.com/de/'
       WHEN (p.host = 'org' OR ends_with(p.host, '.org')) AND starts_with(p.path, '/fr/') THEN 'org/fr/'
       WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(p.path, '/') THEN 'net/' END AS rule
  FROM p JOIN r USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN low > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


#: op11 in SQL: a run's bytes and their crc32 by a table, near words by one letter blanked or left out, roots by recursion.
OP11_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i) q) z),
runs AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) q WHERE length(run) >= 5 GROUP BY 1, 2),
bytes AS (SELECT run, k, flatten(list_transform(list_transform(string_split(concat(id, ':', run), ''), lambda ch: unicode(ch)), lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + u // 64, 128 + u % 64] END)) AS b FROM runs),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda y: CAST(y AS BIGINT))), lambda a, y: xor(a // 256, tab[1 + xor(a % 256, y)]))) AS h FROM bytes, tab),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN concat(run[:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word FROM hashed) q WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
without AS MATERIALIZED (SELECT DISTINCT word, n, unnest(list_transform(range(length(word)), lambda i: concat(word[:i], word[i + 2:]))) AS v FROM words),
blank AS MATERIALIZED (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: concat(word[:i], '.', word[i + 2:]))) AS v FROM words),
pairs AS MATERIALIZED (SELECT a.word, a.n, b.word AS other, b.n AS m FROM blank a JOIN blank b ON a.v = b.v AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM words a JOIN without b ON a.word = b.v UNION ALL SELECT b.word, b.n, a.word, a.n FROM words a JOIN without b ON a.word = b.v),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS m FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN form END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, form AS here, 1 AS k FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON c.here = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON f.word = e.word
"""


def op12_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """op12 in SQL: every vector meets every centroid whole, a pair of tables for each round."""
    found = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64)""",
        "parts AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS d, unnest(e) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256(concat('2:', CAST(vec_id AS VARCHAR))) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}) q)"]
    for i in range(rounds + 1):
        found.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (SELECT v.r, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist FROM v CROSS JOIN c{i} c) q GROUP BY r)")
        if i < rounds:
            found.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT c, list(x ORDER BY d) AS e FROM (SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT a.c, p.d, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n FROM parts p JOIN a{i} a ON p.r = a.r GROUP BY a.c, p.d) q) z GROUP BY c) n ON c.c = n.c)")
    return f"WITH {', '.join(found)} SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.dist AS distance, CAST(sum(a.dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a ON v.r = a.r JOIN c{rounds} c ON a.c = c.c"


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op11_spelling_variants": OP11_SQL, "op12_centroid_clustering": op12_sql()}
