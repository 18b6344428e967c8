"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op12_byte_bpe
from .decontaminate import op7_decontamination
from .divergence import op13_source_divergence
from .importance import op11_importance_resampling
from .licenses import op10_license_scans
from .line_dedup import op9_line_dedup
from .mixing import op6_mixing
from .quality import op8_quality_rules
from .secrets import op5_secret_scans
from .sharding import op2_sharding
from .simhash import op3_simhash
from .token_counts import op1_token_counts
from .warc import op4_warc

QUERIES = (
    op1_token_counts, op2_sharding, op3_simhash, op4_warc, op5_secret_scans, op6_mixing, op7_decontamination, op8_quality_rules, op9_line_dedup, op10_license_scans,
    op11_importance_resampling, op12_byte_bpe, op13_source_divergence,
)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
 f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(('0x' || substr(d.h, CAST(5 * (i // 4) + 1 AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1) for i in range(32)], '') AS payload_digest,
 CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (h)"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') for i in range(1, len(w) - least(10, len(w)) + 2)]) AS g FROM b WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT n FROM win),
 pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
 hit AS (SELECT p.doc_id, p.n, p.i, win.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM pos) p JOIN win ON win.n = p.n AND win.g = p.g),
 words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

# The pair part runs over all kept terms of both sources, the ones that only one or none has included.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w,
   row_number() OVER () AS id FROM documents),
 g AS (SELECT DISTINCT lang, source FROM d),
 t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
 c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
 v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS big_n FROM kept GROUP BY lang),
 full_c AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, total FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 sized AS (SELECT f.*, v.v, v.big_n, sum(n) OVER (PARTITION BY f.lang, f.source) AS own_n FROM full_c f JOIN v ON v.lang = f.lang),
 s AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (own_n + 2 * v) AS p, 1 + (1000000000 * (total + 2)) // (big_n + 2 * v) AS q FROM sized),
 two AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(two.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
 own AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM s WHERE n > 0 AND p > q),
 ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM own) WHERE rank <= 10)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL, "op7_decontamination": DECONTAMINATION_SQL, "op13_source_divergence": DIVERGENCE_SQL}
