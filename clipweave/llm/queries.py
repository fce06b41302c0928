"""The registered queries op1 to op13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filter_audit, html_extract, jaccard_join, minhash, packing, quality, spelling, substring_dedup, token_store, toxicity, url_filter, warc
from .common import new_path, small_batches


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 19, 0))) AS s FROM d),
k AS (SELECT doc_id, s, array_to_string(list_slice(w, s + 1, s + 20), ' ') AS win FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS rn FROM k),
c AS (SELECT DISTINCT doc_id, s + o AS pos FROM r, (SELECT unnest(range(0, 20)) AS o) WHERE rn > 1),
e AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, CASE WHEN gone IS NULL THEN d.w ELSE
        list_transform(list_filter(list_zip(d.w, range(0, len(d.w))), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS kept
      FROM d LEFT JOIN e ON d.doc_id = e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM x
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def _like(glob: str) -> str:
    return "c LIKE '" + glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_") + "' ESCAPE '\\'"


OP5_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages),
u AS (SELECT page_id,
        translate(regexp_extract(r, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
        translate(regexp_extract(r, '^[^#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS c FROM r),
v AS (SELECT page_id, host, path, c, CASE
        WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'example.org/en/1', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN {" OR ".join(_like(g) for g in url_filter.BLOCK_GLOBS)} THEN 'block' ELSE 'allow' END AS verdict FROM v
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, n AS payload_bytes, d.h AS payload_digest,
       CASE WHEN n >= 1000 AND d.page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND d.page_id < top THEN top END AS refers_to
FROM d LEFT JOIN m ON m.h = d.h
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, word_bpe(), end_id=2)
    return token_store.read_digests(spark, path)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, k=3)


OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) END AS sh
  FROM d),
cls AS MATERIALIZED (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS MATERIALIZED (SELECT rep, n, unnest(sh) AS g FROM cls),
p AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(v, c) AS (SELECT rep, rep FROM cls UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v AND r.c < e.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id,
       coalesce(m.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN cls ON cls.sh = s.sh LEFT JOIN m ON m.v = cls.rep
"""


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a test item: one row per document and item, no row for clean documents."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), percent=85, k=4)


OP11_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2], ' ', w[i + 3])))) END AS sh
  FROM d),
cls AS MATERIALIZED (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS MATERIALIZED (SELECT rep, n, unnest(sh) AS g FROM cls),
p AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(v, c) AS (SELECT rep, rep FROM cls UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v AND r.c < e.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM s LEFT JOIN cls ON cls.sh = s.sh LEFT JOIN m ON m.v = cls.rep
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS BIGINT)) AS good, max(CAST(toxic = 1 AS BIGINT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, i AS step, 1 << (instr('ABCDE', substr(filter_order, i, 1)) - 1) AS f,
    CAST(list_sum(list_transform(range(1, i), lambda j: 1 << (instr('ABCDE', substr(filter_order, j, 1)) - 1))) AS INT) AS p
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS i)),
r AS (SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (f | coalesce(p, 0)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & f > 0 AND mask & coalesce(p, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & f > 0 AND mask & coalesce(p, 0) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & f > 0 AND mask & coalesce(p, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & f > 0 AND mask & coalesce(p, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE bits(k, i, v) AS (SELECT 0, i, CAST(i AS UBIGINT) FROM range(256) r(i) UNION ALL
  SELECT k + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= 6 GROUP BY doc_id, w),
c AS (SELECT w, n, xor(list_reduce(list_transform(flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, 128 + (unicode(x) & 63)] END)), lambda b: CAST(b AS UBIGINT)),
    lambda h, b: xor(h >> 8, tab[CAST(xor(h, b) & 255 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM g, tab),
r AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(w, 1, CAST(h % length(w) AS BIGINT)), substr(w, CAST(h % length(w) AS BIGINT) + 2)) ELSE w END AS w, n FROM c),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM r WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
x AS MATERIALIZED (SELECT w, n, i, concat(substr(w, 1, i), substr(w, i + 2)) AS s FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM v)),
p AS MATERIALIZED (
  SELECT DISTINCT x.w AS a, v.w AS b FROM x JOIN v ON v.w = x.s
  UNION SELECT a.w, b.w FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.w <> b.w),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
f AS MATERIALIZED (SELECT e.a AS w, count(*) AS n_near, first(e.b ORDER BY v.n DESC, e.b ) AS b, max(v.n) AS best FROM e JOIN v ON v.w = e.b GROUP BY e.a),
t AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 5 * v.n THEN b END AS form, CASE WHEN best >= 5 * v.n THEN best END AS form_n FROM v LEFT JOIN f ON f.w = v.w),
u(w, root, next) AS (SELECT w, w, form FROM t UNION ALL SELECT u.w, u.next, t.form FROM u JOIN t ON t.w = u.next)
SELECT t.w AS word, t.form, u.root, t.n, t.n_near, t.form_n FROM t JOIN u ON u.w = t.w AND u.next IS NULL
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_html_extraction, op4_substring_dedup, op5_url_filters, op6_warc, op7_best_fit_packing, op8_token_store, op9_minhash_near_dedup, op10_benchmark_decontamination, op11_jaccard_join, op12_filter_audit, op13_spelling_variants)}
SQL = {"op4_substring_dedup": OP4_SQL, "op5_url_filters": OP5_SQL, "op6_warc": OP6_SQL, "op9_minhash_near_dedup": OP9_SQL, "op11_jaccard_join": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_spelling_variants": OP13_SQL}
