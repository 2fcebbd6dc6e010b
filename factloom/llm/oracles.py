"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""WITH lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
 keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS k FROM lines),
 often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
 marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

_HEX = "CAST(('0x' || substr(md5(coalesce(source, '')), 1, 5)) AS BIGINT)"

MIXING = f"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS BIGINT) AS size FROM documents),
 sums AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sized GROUP BY source),
 weighed AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM sums),
 levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER prior, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER prior, 0::DOUBLE)) AS lvl FROM weighed
  WINDOW prior AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 targets AS (SELECT source, source_size, CASE WHEN lvl * w >= cap THEN cap ELSE max(CASE WHEN lvl * w < cap THEN lvl END) OVER () * w END AS target FROM levels),
 placed AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(size + 1) * 16), md5(CAST(doc_id AS VARCHAR)), doc_id, size) AS place FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, source_size, target, least(2, floor({_HEX} / 1048576.0::DOUBLE + rate * place) - floor({_HEX} / 1048576.0::DOUBLE + rate * (place - 1)))::BIGINT * size AS taken FROM placed"""

_ESCAPED = "regexp_replace({0}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"

CHAT = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, {_ESCAPED.format("coalesce(text, '')")} AS body FROM conversations WHERE conv_id IS NOT NULL),
 people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
 met AS (SELECT *, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role FROM said JOIN people USING (conv_id)),
 headed AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate({_ESCAPED.format("speaker")}, chr(10) || chr(13), '  ') ELSE '' END || chr(10) AS head FROM met)
 SELECT conv_id, perspective, turn, speaker, role, head || body || '<|im_end|>' || chr(10) AS segment, CAST(length(head) AS INTEGER) AS mask_start,
 CAST(length(head) + CASE WHEN role = 'assistant' THEN length(body) + 10 ELSE 0 END AS INTEGER) AS mask_end FROM headed"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
 win AS (SELECT DISTINCT item, least(8, len(ws)) AS n, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS key FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 6))) AS i FROM b WHERE len(ws) > 0)),
 d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
 spots AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(1, len(ws) - n + 2))) AS i FROM d, (SELECT DISTINCT n FROM win))),
 hits AS (SELECT doc_id, item, n, i FROM spots JOIN win USING (n, key)),
 hit_words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) GROUP BY 1),
 hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
 SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
 FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""
