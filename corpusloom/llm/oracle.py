"""SQL of the training-data queries that plain SQL can express."""

from __future__ import annotations

_FOLD = lambda x: f"replace(replace(replace(lower(regexp_replace({x}, '[İı]', 'i', 'g')), 'ß', 'ss'), 'ς', 'σ'), chr(775), '')"
_LEAF = lambda x: f"array_to_string(list_filter(list_transform(string_split(regexp_replace({_FOLD(x)}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^[\\p{{P}}|]+|[\\p{{P}}|]+$', '', 'g')), lambda w: w <> ''), ' ')"

_TREES = f"""cut AS (SELECT record_id, dataset, label, CASE WHEN dataset = 'mail_archive' THEN string_split(regexp_replace(raw_text, '(?i)(^|[\\n\\r|;])\\s*(subject|sender|list|body)\\s*:', chr(1) || '\\2' || chr(2), 'g'), chr(1)) ELSE [raw_text] END AS parts FROM external_audited WHERE raw_text IS NOT NULL),
    p AS (SELECT record_id, dataset, label, unnest(parts) AS p FROM cut), l AS (SELECT record_id, dataset, label, CASE WHEN contains(p, chr(2)) THEN {_FOLD("trim(split_part(p, chr(2), 1))")} || '=' || {_LEAF("split_part(p, chr(2), 2)")} ELSE {_LEAF("p")} END AS leaf FROM p),
    trees AS (SELECT record_id, dataset, label, string_agg(leaf, chr(1) ORDER BY leaf) FILTER (leaf <> '' OR dataset <> 'mail_archive') AS tree FROM l GROUP BY ALL),
    sets AS (SELECT *, min(record_id) OVER (PARTITION BY dataset, label, coalesce(tree, '')) AS keeper_id, count(*) OVER (PARTITION BY dataset, label, coalesce(tree, '')) AS n_copies FROM trees)"""

_WORDS = "list_filter(string_split_regex(regexp_replace(regexp_replace(replace(replace(lower(regexp_replace(text, '(?i)<br\\s*/?>', ' ', 'g')), 'ß', 'ss'), 'ı', 'i'), '[\\p{P}<>|`^~]', '', 'g'), chr(775), '', 'g'), '\\s+'), lambda w: w <> '')"

SQL = {
    "p2_found": """WITH RECURSIVE k AS (SELECT DISTINCT group_id, lower(regexp_replace(source_key, '[^\\p{L}\\p{N}]+', '', 'g')) AS key FROM group_sources WHERE group_id IS NOT NULL AND source_key IS NOT NULL),
        usable AS (SELECT * FROM k WHERE key NOT IN ('', 'unknown', 'na', 'none', 'null', 'nan')), e AS (SELECT DISTINCT a.group_id AS a, b.group_id AS b FROM usable a JOIN usable b USING (key)),
        reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT min(b) AS component_id, a AS group_id FROM reach GROUP BY a HAVING min(b) < a""",
    "p7_found": f"WITH {_TREES} SELECT keeper_id, record_id FROM sets WHERE record_id <> keeper_id",
    "p7_collapsed": f"WITH {_TREES} SELECT keeper_id, n_copies FROM sets WHERE record_id = keeper_id",
    "p8_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM heldout_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
        gi AS (SELECT item_id, array_to_string(w[k:k + 15], ' ') AS g FROM i, unnest(range(1, len(w) - 14)) t(k)), gd AS (SELECT doc_id, array_to_string(w[k:k + 15], ' ') AS g FROM d, unnest(range(1, len(w) - 14)) t(k)) SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g)""",
}
