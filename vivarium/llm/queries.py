"""The operators as queries over whole tables, and the pipeline. ORACLES has SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vivarium.llm import decontaminate, language_id, lm_score, media, near_dup, packing, pii, repeats, secret_scan, spelling, url_filter, warc, whitening
from vivarium.llm.common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents")).drop("row_id", "n_links")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents"), learned=True)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(read(spark, sf_dir, "documents"), with_bytes=False)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_packing, op3_decontamination, op4_near_duplicates, op5_warc, op6_media, op7_language, op8_secrets, op9_lm_score, op10_urls, op11_whitening, op12_repeats, op13_spelling)
}

SHINGLED = """w AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS words FROM src),
s AS (SELECT id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5))"""

ORACLES = {
    "op3_decontamination": """WITH src AS (SELECT doc_id * 2 AS id, text FROM documents UNION ALL SELECT item_id * 2 + 1, text FROM benchmark),
"""
    + SHINGLED
    + """, u AS (SELECT DISTINCT id, shingle FROM s),
n AS (SELECT id, count(*) AS n FROM u WHERE id % 2 = 1 GROUP BY id)
SELECT d.id // 2 AS doc_id, b.id // 2 AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item, count(*) / any_value(n.n) AS containment
FROM u d JOIN u b ON d.shingle = b.shingle AND d.id % 2 = 0 AND b.id % 2 = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
UNION ALL SELECT d.id // 2, b.id // 2, 1, 1, 1.0::DOUBLE FROM w b JOIN w d ON b.id % 2 = 1 AND d.id % 2 = 0 AND len(b.words) BETWEEN 1 AND 4
 AND contains(' ' || array_to_string(d.words, ' ') || ' ', ' ' || array_to_string(b.words, ' ') || ' ')""",
    "op4_near_duplicates": """WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents),
"""
    + SHINGLED
    + """, whole AS (SELECT id, array_to_string(words, ' ') AS body FROM w WHERE len(words) > 0),
c AS (SELECT id, shingle, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT id, sum(c) AS n FROM c GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS m FROM c a JOIN c b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
near AS (SELECT shared.a, shared.b FROM shared JOIN n x ON x.id = shared.a JOIN n y ON y.id = shared.b WHERE m >= 0.8 * (x.n + y.n - m)
 UNION SELECT x.id, y.id FROM (SELECT body, min(id) AS id FROM whole GROUP BY body) x JOIN whole y ON x.body = y.body AND x.id < y.id),
link AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT id, id AS root FROM src UNION SELECT link.b, reach.root FROM reach JOIN link ON reach.id = link.a),
class AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id)
SELECT id AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, id = class_id AS is_kept FROM class""",
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest,
 CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html""",
    "op8_secrets": secret_scan.oracle(),
    "op12_repeats": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
s AS (SELECT r, i FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i - last <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM s)),
x AS (SELECT r, min(i) AS u, max(i) + 200 AS v FROM g GROUP BY r, g),
k AS (SELECT r, u, v, lag(v, 1, 0) OVER (PARTITION BY r ORDER BY u) AS before, row_number() OVER (PARTITION BY r ORDER BY u DESC) AS from_end FROM x),
j AS (SELECT k.r, count(*) AS n_spans, sum(v - u) AS n_removed,
  string_agg(substr(h, 2 * before + 1, 2 * (u - before)) || CASE WHEN from_end = 1 THEN substr(h, 2 * v + 1) ELSE '' END, '' ORDER BY u) AS kept
 FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, len(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN j ON j.r = d.r""",
    "op13_spelling": """WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM t GROUP BY doc_id, run),
v AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) AS x FROM u, crc),
w AS (SELECT CASE WHEN x % 31 = 0 THEN substr(run, 1, x % len(run)) || substr(run, x % len(run) + 2) ELSE run END AS word, c FROM v),
n AS (SELECT word, sum(c)::BIGINT AS n FROM w WHERE len(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
e AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM n)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND len(a.word) = len(b.word)
 UNION SELECT e.word, n.word, n.n FROM e JOIN n ON n.word = e.rest UNION SELECT n.word, e.word, e.n FROM e JOIN n ON n.word = e.rest),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'other': other}) AS b FROM near GROUP BY word),
f AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * n THEN b.other END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM n LEFT JOIN best ON best.word = n.word),
walk AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word""",
}
