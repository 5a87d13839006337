"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

import public_tokenizers

from . import embedding, html, lm, minhash, mixing, ordinal, packing, rules, suffix, token_output
from .common import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), Scratch(spark), width=2)


def op2_html_extraction(spark, sf_dir):
    return html.extract(_read(spark, sf_dir, "pages"))


def op3_token_output(spark, sf_dir):
    return token_output.digest(_read(spark, sf_dir, "documents"), TOKENIZER)


def op4_embedding_dedup(spark, sf_dir):
    return embedding.near_vectors(_read(spark, sf_dir, "embeddings"), Scratch(spark))


def op5_packing(spark, sf_dir):
    return packing.digest(_read(spark, sf_dir, "documents"), TOKENIZER)


def op6_suffix_dedup(spark, sf_dir):
    return suffix.digest(_read(spark, sf_dir, "documents"), Scratch(spark))


def op7_quality_classifier(spark, sf_dir):
    return ordinal.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_mixing(spark, sf_dir):
    return mixing.digest(_read(spark, sf_dir, "documents"), Scratch(spark))


def op9_quality_rules(spark, sf_dir):
    return rules.digest(_read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    return lm.digest(_read(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_html_extraction, op3_token_output, op4_embedding_dedup, op5_packing, op6_suffix_dedup, op7_quality_classifier, op8_mixing, op9_quality_rules, op10_lm_scoring)}
_REACH = """r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)"""

#: All pairs by shared shingles: exact, for small tables.
OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i+1] END AS g FROM (SELECT id, ws, unnest(generate_series(1, greatest(1, len(ws) - 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT d.id, count(s.g)::BIGINT AS n FROM d LEFT JOIN s ON d.id = s.id GROUP BY d.id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
l AS (SELECT x, y FROM p JOIN n na ON na.id = x JOIN n nb ON nb.id = y WHERE 100 * k >= 80 * (na.n + nb.n - k)),
{_REACH}
SELECT n.id AS doc_id, n.n AS n_shingles, component_id, n.id = component_id AS kept FROM n JOIN c USING (id)
"""

#: The pages of these tables: what stands in the article, without its tags.
OP2_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""

#: All pairs by cosine.
OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT id FROM v), l AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.95),
{_REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM l WHERE l.x = n.id)::BIGINT AS n_links, component_id, n.id = component_id AS kept FROM n JOIN c USING (id)
"""

#: Every 400-byte string (in hexadecimal) and every 50-word string with the number of its places.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 400)) AS i FROM d WHERE length(h) >= 800)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM w) WHERE k > 1),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
sp AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS u FROM sp
      UNION ALL SELECT doc_id, coalesce(z, 0), length(h) // 2 FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM sp GROUP BY doc_id) m USING (doc_id)),
k AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * f + 1, 2 * (u - f)), '' ORDER BY f))) AS kept_sha256 FROM p JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM sp GROUP BY doc_id),
x AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws FROM d),
xw AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM x WHERE len(ws) >= 50)),
xs AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM xw) WHERE k > 1),
xn AS (SELECT doc_id, sum(least(50, coalesce(nxt - i, 50)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM xs) GROUP BY doc_id)
SELECT doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256, coalesce(xn.n, 0) AS n_passage_words
FROM d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN xn USING (doc_id)
"""

ORACLE_SQL = {"op1_minhash_dedup": OP1_SQL, "op2_html_extraction": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op9_quality_rules": rules.ORACLE_SQL, "op10_lm_scoring": lm.ORACLE_SQL}
