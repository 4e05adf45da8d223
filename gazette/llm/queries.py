"""The registered queries of the operators, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, bpe, fingerprint, neardup, packing, periodic, quality, sharding, spelling, suffix_dedup, token_count, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), edit=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_quality_rules, op2_token_counts, op3_url_filters, op4_suffix_dedup, op5_fingerprints, op6_packing, op7_byte_bpe, op8_toxicity, op9_near_duplicates, op10_sharding,
    op11_spelling_variants, op12_periodic_runs, op13_best_fit_packing,
)
QUERIES = {f.__name__: f for f in OPERATORS}

FEATURES_SQL = """
words AS (
  SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)
), placed AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM words, unnest(range(1, len(w) - 1)) AS t(i)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM placed) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM repeated, unnest(range(0, 3)) AS t(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), features AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), base AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM features
), hosts AS (
  SELECT source AS host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM base GROUP BY source
), sums AS (
  SELECT CAST(sum(f) AS DOUBLE) / sum(n) AS mean, sum(CAST(f AS DOUBLE) * f / n) / sum(n) AS squares FROM hosts
), prior AS (
  SELECT mean, CASE WHEN squares - mean * mean > 1e-12 THEN least(1e6, greatest(1.0, mean * (1 - mean) / (squares - mean * mean) - 1)) ELSE 1e6 END AS strength FROM sums
), verdicts AS (
  SELECT host, (f + mean * strength) / (n + strength) AS host_rate FROM hosts, prior
)"""

ORACLES = {
    "op1_quality_rules": f"""WITH {FEATURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 6) AS host_rate,
  NOT base_failed AND host_rate <= 0.5 AS kept
FROM base JOIN verdicts ON source IS NOT DISTINCT FROM host""",
    "op3_url_filters": """WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rule, rhost, rpath) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS r
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT urls.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits ON urls.page_id = fits.page_id AND r = 1""",
    "op10_sharding": """WITH keys AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS key FROM documents
), levels AS (
  SELECT doc_id, n_bytes, key, d, sum(n_bytes) OVER (PARTITION BY d, key >> (60 - d)) AS b, count(*) OVER (PARTITION BY d, key >> (60 - d)) AS c
  FROM keys, unnest(range(0, 24)) AS t(d)
), first AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS r FROM levels WHERE b <= 1048576 OR c = 1
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(key >> (60 - d)), CAST(d AS INTEGER), '0') END AS shard,
  CAST(d AS BIGINT) AS depth, CAST(b AS BIGINT) AS shard_bytes, b > 1048576 AS oversize
FROM first WHERE r = 1""",
    "op11_spelling_variants": r"""WITH RECURSIVE bits AS (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM (SELECT unnest(range(0, 256)) AS b)
), crc_table AS (SELECT list(t ORDER BY b) AS t FROM bits
), found AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM found), crc_table
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
  GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3
), cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, min(encode(other)) FILTER (WHERE n = top) AS other FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
), forms AS (
  SELECT words.word, CASE WHEN most >= 2 * n THEN decode(other) END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS last FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON last = forms.word WHERE form IS NOT NULL
)
SELECT forms.word, form, last AS root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word WHERE last IN (SELECT word FROM forms WHERE form IS NULL)""",
}
