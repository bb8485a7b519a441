"""SQL for DuckDB that gives the same results, where it can over whole tables.

It stands on its own: the tables of zones and subfields are made here once more. Components are found by
widening every node's set until nothing is added, which is for small data only.
"""

from folioforge.llm.confusables import canonical_sql

_CLEAN = "nullif(lower(trim({}, ' ' || chr(9))), '')"
_SUB = """
ent AS (SELECT row_idx, id_entitelrm AS id, json(ltrim(intermarc, chr(65279) || ' ')) AS j FROM test_honorific WHERE intermarc IS NOT NULL),
zl AS (SELECT row_idx, id, CASE json_type(j, '$.zones') WHEN 'ARRAY' THEN json_extract(j, '$.zones[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.zones')] END AS l FROM ent),
zone AS (SELECT row_idx, id, p - 1 AS zp, json_extract_string(l[p], '$.code') AS zcode, l[p] AS z FROM zl, unnest(range(1, len(l) + 1)) t(p) WHERE json_type(l[p]) = 'OBJECT'),
sl AS (SELECT row_idx, id, zp, zcode, CASE json_type(z, '$.sousZones') WHEN 'ARRAY' THEN json_extract(z, '$.sousZones[*]') WHEN 'OBJECT' THEN [json_extract(z, '$.sousZones')] END AS l FROM zone),
sub AS (SELECT row_idx, id, zp, zcode, p - 1 AS sp, json_extract_string(l[p], '$.code') AS code, json_extract_string(l[p], '$.valeur') AS v FROM sl, unnest(range(1, len(l) + 1)) t(p) WHERE json_type(l[p]) = 'OBJECT')"""
_DAY = """coalesce(CASE WHEN regexp_matches(v, '^\\s*\\d{4}-') THEN try_cast(trim(v) AS DATE) END, try_cast(regexp_replace(trim(v), '^(\\d{1,2})[-/.](\\d{1,2})[-/.](\\d{4})$', '\\3-\\2-\\1') AS DATE))"""

ORACLE: dict[str, str] = {
    "p2_found": f"""WITH {_SUB}, own AS (SELECT DISTINCT id, v FROM (SELECT row_idx, id, arg_min(coalesce(v, ''), (zp, sp)) AS v FROM sub WHERE zcode = '150' AND code = '150$a' GROUP BY row_idx, id) WHERE v <> '')
SELECT DISTINCT detection_id FROM detection_record d JOIN own ON own.id = d.id_entitelrm WHERE d.title <> own.v AND {canonical_sql('d.title')} = {canonical_sql('own.v')}""",
    "p5_found": f"""WITH {_SUB},
member AS (SELECT DISTINCT cluster_id, unnest(list_append(coalesce(clustered_ids, []), anchor_id)) AS id FROM cluster_result),
row_ AS (SELECT id_entitelrm AS id, arg_max(row_idx, (loaded_at, row_idx)) AS row_idx FROM test_honorific GROUP BY id_entitelrm),
feat AS (SELECT m.cluster_id, m.id, r.row_idx, l.level FROM member m JOIN row_ r USING (id) JOIN test_honorific h ON h.row_idx = r.row_idx LEFT JOIN provenance_level l ON l.provenance = h.provenance),
zoned AS (SELECT DISTINCT f.cluster_id, f.id, s.zcode FROM feat f JOIN sub s USING (row_idx) WHERE s.zcode <> '90F' AND regexp_matches(s.v, '[\\p{{L}}\\p{{N}}]')),
dated AS (SELECT row_idx, {_DAY} AS day FROM (SELECT row_idx, arg_min(coalesce(v, ''), (zp, sp)) AS v FROM sub WHERE zcode = '001' AND code = '001$d' GROUP BY row_idx)),
f AS (SELECT feat.cluster_id, feat.id, level, day, (SELECT count(*) FROM zoned z WHERE z.cluster_id = feat.cluster_id AND z.id = feat.id) AS k, (SELECT count(DISTINCT zcode) FROM zoned z WHERE z.cluster_id = feat.cluster_id) AS every FROM feat LEFT JOIN dated USING (row_idx)),
w AS (SELECT cluster_id, id, k = every AND day IS NOT DISTINCT FROM max(day) OVER c AND level IS NOT DISTINCT FROM max(level) OVER c AS best, count(*) OVER c AS n FROM f WINDOW c AS (PARTITION BY cluster_id))
SELECT cluster_id, any_value(id) AS best_id FROM w WHERE best AND n > 1 GROUP BY cluster_id HAVING count(*) = 1""",
    "p7_found": f"""WITH RECURSIVE {_SUB.lstrip()},
link AS (SELECT a, b FROM (SELECT {_CLEAN.format('anchor_ark')} AS a, {_CLEAN.format('b')} AS b FROM (SELECT anchor_ark, unnest(clustered_arks) AS b FROM cluster_result)
  UNION SELECT {_CLEAN.format('r.v')}, {_CLEAN.format('t.v')} FROM sub q JOIN sub t ON t.row_idx = q.row_idx AND t.zp = q.zp AND t.code = '90F$a' JOIN (SELECT row_idx, arg_min(coalesce(v, ''), (zp, sp)) AS v FROM sub WHERE zcode = '001' AND code = '001$a' GROUP BY row_idx) r ON r.row_idx = q.row_idx
    WHERE q.zcode = '90F' AND q.code = '90F$q' AND lower(trim(q.v, ' ' || chr(9))) = 'clusterisation script') WHERE a <> b),
both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b)
SELECT a AS ark, least(a, min(b)) AS group_ark FROM reach GROUP BY a""",
}
