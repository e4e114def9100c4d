"""DuckDB SQL for the training-data queries that SQL can express. It takes doc_id to be unique."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ALNUM = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
  dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
  cov AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN dup USING (s)) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, len(coalesce(ps, []))::bigint AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id)"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents), b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
  pat AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s FROM (
    SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT size FROM pat),
  win AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
  hit AS (SELECT doc_id, i, win.size, item_id FROM win JOIN pat ON pat.size = win.size AND pat.s = win.s),
  pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
  its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""



def sharding(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::bigint AS bytes, lpad(bin(('0x' || substr(md5(doc_id::varchar), 1, 12))::bigint), 48, '0') AS bits FROM documents),
  lv AS (SELECT *, substr(bits, 1, dep) AS shard FROM (SELECT *, unnest(range(0, 49)) AS dep FROM d)),
  size AS (SELECT shard, sum(bytes)::bigint AS shard_bytes, count(*) AS shard_docs FROM lv GROUP BY shard)
SELECT doc_id, shard, dep::int AS depth, shard_docs, shard_bytes, shard_bytes <= {limit} AS fits
FROM lv JOIN size USING (shard) WHERE shard_bytes <= {limit} OR dep = 48 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dep) = 1"""


LINES = r"""
WITH l AS (SELECT doc_id, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents)),
  r AS (SELECT doc_id, i, doc_id * 1000000 + i AS pos, w, len(w) AS n, array_to_string(w, ' ') AS s FROM l WHERE len(w) > 0),
  d AS (SELECT s, any_value(w) AS w, any_value(n) AS n, min(pos) AS f FROM r GROUP BY s),
  v AS (SELECT s, f, n, j, array_to_string(list_concat(list_slice(w, 1, j - 1), list_slice(w, j + 1, n)), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM d WHERE n >= 8)),
  same_place AS (SELECT v.s, min(m) AS near FROM v JOIN (SELECT n, j, v, min(f) AS m FROM v GROUP BY n, j, v) g ON g.n = v.n AND g.j = v.j AND g.v = v.v GROUP BY v.s),
  shorter AS (SELECT v.s, min(d.f) AS near FROM v JOIN d ON d.s = v.v AND d.n >= 8 GROUP BY v.s),
  longer AS (SELECT d.s, min(v.f) AS near FROM d JOIN v ON d.s = v.v AND d.n >= 8 GROUP BY d.s),
  near AS (SELECT s, min(near) AS near FROM (SELECT * FROM same_place UNION ALL SELECT * FROM shorter UNION ALL SELECT * FROM longer) GROUP BY s),
  gone AS (SELECT doc_id, i FROM r JOIN d USING (s) LEFT JOIN near USING (s) WHERE pos > least(f, coalesce(near, f)))
SELECT doc_id, n_lines, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_removed, string_agg(i::varchar, ',' ORDER BY i) AS removed_lines FROM gone GROUP BY doc_id) USING (doc_id)"""

COMPONENTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach(doc_id, t) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.t)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id FROM (SELECT doc_id, min(t) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

EXACT = f"""
WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""

FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
  e AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::bigint % (len(u) + 1) AS x, ('0x' || h[9:16])::bigint % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::bigint % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::bigint % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
  f AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:], '') AS s FROM e)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f"""

SQL = {
    "op2_substring_dedup": SUBSTRING, "op3_decontamination": CONTAMINATION, "op5_sharding": sharding(64 << 20), "shards_of_100_kb": sharding(100_000),
    "op7_line_dedup": LINES, "op9_ngram_join": COMPONENTS, "op11_exact_dedup": EXACT, "op12_fill_in_middle": FILL_MIDDLE,
}
