"""SQL for DuckDB that gives the results of the queries by other means: relational tables of zones and
subfields instead of higher-order functions. {placeholders} are filled from the parts below.
"""

from __future__ import annotations

from folioforge.functions.text import _EXPAND, _ONE, _TO
from folioforge.operators.authority import HONORIFICS

RUN_DATE = "2026-01-31"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MARKS = r"[\x{0300}-\x{036F}\x{0483}-\x{0487}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]"


def fold(x: str, ligature: bool = True) -> str:
    out = f"regexp_replace(translate({x}, {_q(_ONE)}, {_q(_TO)}), '{_MARKS}', '', 'g')"
    for sign, plain in _EXPAND if ligature else _EXPAND[2:]:
        out = f"replace({out}, {_q(sign)}, {_q(plain)})"
    return out


def title_key(x: str) -> str:
    bare = f"regexp_replace(trim(coalesce({x}, '')), '^(un|une|le|la|les)\\s*\\|\\s*', '', 'i')"
    return f"trim(regexp_replace(lower({fold(f'''regexp_replace(replace({bare}, '|', ' '), '\\p{{P}}', ' ', 'g')''', False)}), '\\s+', ' ', 'g'))"


def match_form(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(x)}), '[^\\p{{L}}\\p{{N}}_'']+', ' ', 'g'))"


def norm_type(x: str) -> str:
    return f"trim(lower({fold(x)}))"


SUFFIX = r"(^|[^\p{L}\p{N}_])(illustrations?|vignettes?|illustré(e|s)?)[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+(de|par)($|[^\p{L}\p{N}_])"


def clean(x: str) -> str:
    return f"nullif(lower(trim({x}, ' ' || chr(9))), '')"


def _model(name: str, rows: str) -> str:
    """CTEs of one set of entity rows: name_ent, name_zone, name_sub."""
    return f"""
{name}_ent AS (SELECT row_idx, id_entitelrm AS id, {norm_type('type_entite')} AS type_norm, intermarc, json(ltrim(intermarc, chr(65279) || ' ')) AS j FROM ({rows})),
{name}_zl AS (SELECT row_idx, id, type_norm, CASE json_type(j, '$.zones') WHEN 'ARRAY' THEN json_extract(j, '$.zones[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.zones')] END AS zl FROM {name}_ent WHERE j IS NOT NULL),
{name}_zone AS (SELECT row_idx, id, type_norm, p - 1 AS zp, json_extract_string(zl[p], '$.code') AS zcode, zl[p] AS zj FROM {name}_zl, unnest(range(1, len(zl) + 1)) t(p) WHERE json_type(zl[p]) = 'OBJECT'),
{name}_sl AS (SELECT row_idx, id, type_norm, zp, zcode, CASE json_type(zj, '$.sousZones') WHEN 'ARRAY' THEN json_extract(zj, '$.sousZones[*]') WHEN 'OBJECT' THEN [json_extract(zj, '$.sousZones')] END AS sl FROM {name}_zone),
{name}_sub AS (SELECT row_idx, id, type_norm, zp, zcode, p - 1 AS sp, json_extract_string(sl[p], '$.code') AS code, json_extract_string(sl[p], '$.valeur') AS v FROM {name}_sl, unnest(range(1, len(sl) + 1)) t(p) WHERE json_type(sl[p]) = 'OBJECT'),
{name}_ark AS (SELECT row_idx, any_value(id) AS id, any_value(type_norm) AS type_norm, arg_min(coalesce(v, ''), (zp, sp)) AS ark FROM {name}_sub WHERE zcode = '001' AND code = '001$a' GROUP BY row_idx),
{name}_rec AS (SELECT e.row_idx, e.id, e.type_norm, a.ark FROM {name}_ent e LEFT JOIN {name}_ark a USING (row_idx))
"""


ALL = "SELECT row_idx, id_entitelrm, type_entite, intermarc FROM test_honorific"
CURATED = ALL + " WHERE row_idx IN (SELECT max(row_idx) FROM test_honorific GROUP BY id_entitelrm)"
ORIGINAL = ALL + " WHERE row_idx IN (SELECT min(row_idx) FROM test_honorific GROUP BY id_entitelrm)"
EVERYTHING = CURATED + " UNION ALL SELECT -CAST(id_entitelrm AS BIGINT), id_entitelrm, type_entite, intermarc FROM authority_core"


def first(m: str, code: str, alias: str = "v") -> str:
    """(row_idx, alias): the first value of a subfield of each record of model m."""
    return f"SELECT row_idx, arg_min(coalesce(v, ''), (zp, sp)) AS {alias} FROM {m}_sub WHERE zcode = '{code[:3]}' AND code = '{code}' GROUP BY row_idx"


def zone_text(m: str, code: str) -> str:
    """(row_idx, title): all of the first zone with a code as text."""
    return f"""SELECT s.row_idx, nullif(trim(regexp_replace(string_agg(trim(v), ' ' ORDER BY sp), '\\s+', ' ', 'g')), '') AS title FROM {m}_sub s
JOIN (SELECT row_idx, min(zp) AS zp FROM {m}_zone WHERE zcode = '{code}' GROUP BY row_idx) f ON s.row_idx = f.row_idx AND s.zp = f.zp WHERE trim(coalesce(v, '')) <> '' GROUP BY s.row_idx"""


def works(m: str) -> str:
    return f"""
{m}_work AS (SELECT r.row_idx, r.id, r.ark, CASE WHEN a.v <> '' AND b.v <> '' THEN a.v END AS c015, CASE WHEN a.v <> '' AND b.v <> '' THEN b.v END AS c700, t.v AS title, {title_key('t.v')} AS title_key,
  regexp_matches(coalesce(t.v, ''), {_q(SUFFIX)}, 'i') AS suffix FROM {m}_rec r LEFT JOIN ({first(m, '015$c')}) a USING (row_idx) LEFT JOIN ({first(m, '700$3')}) b USING (row_idx) LEFT JOIN ({first(m, '150$a')}) t USING (row_idx) WHERE type_norm = 'oeuvre'),
{m}_group AS (SELECT c015, c700, title_key, count(*) AS n, min(row_idx) AS first_row, min(min(row_idx)) OVER (PARTITION BY c015, c700) AS key_row, arg_min(id, (suffix, id, row_idx)) AS anchor_id, arg_min(coalesce(ark, ''), (suffix, id, row_idx)) AS anchor_ark
  FROM {m}_work WHERE c015 IS NOT NULL AND title_key <> '' GROUP BY c015, c700, title_key),
{m}_member AS (SELECT g.anchor_id, g.anchor_ark, w.id AS member_id, coalesce(w.ark, '') AS member_ark, w.row_idx AS member_row, key_row, first_row FROM {m}_work w JOIN {m}_group g USING (c015, c700, title_key) WHERE g.n > 1 AND w.id <> g.anchor_id)"""


def edges(m: str) -> str:
    return f"""
{m}_xw AS (SELECT row_idx, id, zcode, zp, sp, coalesce(v, '') AS work_ark FROM {m}_sub WHERE type_norm = 'expression' AND ((zcode = '140' AND code = '140$3') OR (zcode = '750' AND code = '750$3' AND row_idx NOT IN (SELECT row_idx FROM {m}_sub WHERE zcode = '140' AND code = '140$3')))),
{m}_xe AS (SELECT x.row_idx, x.id, r.ark, row_number() OVER (PARTITION BY x.row_idx ORDER BY zp, sp) - 1 AS ord, work_ark FROM {m}_xw x JOIN {m}_rec r USING (row_idx)),
{m}_me AS (SELECT s.row_idx, s.id, r.ark, row_number() OVER (PARTITION BY s.row_idx ORDER BY zp, sp) - 1 AS ord, coalesce(v, '') AS expression_ark FROM {m}_sub s JOIN {m}_rec r USING (row_idx) WHERE s.type_norm = 'manifestation' AND zcode = '740' AND code = '740$3')"""


def links(m: str) -> str:
    head = lambda letter: f"(SELECT row_idx, zp, arg_min(v, sp) AS {letter} FROM {m}_sub WHERE zcode = '90F' AND code = '90F${letter}' GROUP BY row_idx, zp)"
    return f"""
{m}_raw AS (SELECT z.row_idx, z.id, z.type_norm, z.zp, a, q, d FROM {m}_zone z JOIN {head('a')} USING (row_idx, zp) JOIN {head('q')} USING (row_idx, zp) LEFT JOIN {head('d')} USING (row_idx, zp) WHERE z.zcode = '90F' AND a <> ''),
{m}_link AS (SELECT row_idx, id, type_norm, row_number() OVER (PARTITION BY row_idx ORDER BY zp) - 1 AS ord, a AS ark, d AS date FROM {m}_raw WHERE q = 'Clusterisation script')"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


C, O, A = _model("c", CURATED), _model("o", ORIGINAL), _model("a", ALL)
X = _model("x", EVERYTHING)
CW, CE, CL, OE = works("c"), edges("c"), links("c"), edges("o")
ITEMS = f"""
item AS (SELECT l.id AS anchor_id, coalesce(r.ark, '') AS anchor_ark, l.row_idx AS anchor_row, l.ord, l.ark AS item_ark, l.date, coalesce(k.id, f.id) AS item_id, CASE WHEN k.id IS NOT NULL THEN k.title ELSE f.title END AS item_title
  FROM c_link l JOIN c_rec r USING (row_idx)
  LEFT JOIN (SELECT r.ark, arg_max(r.id, r.row_idx) AS id, arg_max(coalesce(t.title, chr(0)), r.row_idx) AS t0, nullif(arg_max(coalesce(t.title, chr(0)), r.row_idx), chr(0)) AS title FROM c_rec r LEFT JOIN ({zone_text('c', '150')}) t USING (row_idx) WHERE r.type_norm = 'oeuvre' AND r.ark <> '' GROUP BY r.ark) k ON k.ark = l.ark
  LEFT JOIN (SELECT r.ark, arg_max(r.id, r.row_idx) AS id, nullif(arg_max(coalesce(t.v, chr(0)), r.row_idx), chr(0)) AS title FROM (SELECT DISTINCT row_idx, id, v AS ark FROM o_sub WHERE zcode = '001' AND code = '001$a' AND v <> '') r LEFT JOIN ({first('o', '150$a')}) t USING (row_idx) GROUP BY r.ark) f ON f.ark = l.ark
  WHERE l.type_norm = 'oeuvre')"""
EXPRESSIONS = """
own AS (SELECT i.anchor_id, i.anchor_ark, x.row_idx AS x_row, x.ord AS x_ord, x.id AS x_id, x.ark AS x_ark FROM (SELECT DISTINCT anchor_id, anchor_ark FROM item) i JOIN c_xe x ON x.work_ark = i.anchor_ark),
target AS (SELECT r.ark, arg_max(r.id, r.row_idx) AS id, arg_max(coalesce(x.work_ark, ''), r.row_idx) AS w FROM c_rec r LEFT JOIN (SELECT * FROM c_xe WHERE ord = 0) x USING (row_idx) WHERE r.type_norm = 'expression' AND r.ark <> '' GROUP BY r.ark),
expr AS (
  SELECT anchor_id, 'anchor' AS role, x_row AS k1, x_ord AS k2, 0 AS k3, x_id AS expression_id, coalesce(x_ark, x_id) AS expression_ark, anchor_ark AS work_ark FROM own
  UNION ALL SELECT o.anchor_id, 'clustered', x_row, x_ord, l.ord, coalesce(t.id, l.ark), l.ark, coalesce(t.w, '') FROM own o JOIN c_link l ON l.id = o.x_id AND l.type_norm = 'expression' LEFT JOIN target t ON t.ark = l.ark),
free AS (SELECT i.anchor_id, i.ord AS i_ord, x.row_idx AS x_row, x.ord AS x_ord, x.id, x.ark, x.work_ark, row_number() OVER (PARTITION BY i.anchor_id, x.ark ORDER BY i.ord, x.row_idx, x.ord) AS n FROM item i JOIN c_xe x ON x.work_ark = i.item_ark
  WHERE x.ark <> '' AND NOT EXISTS (SELECT 1 FROM expr e WHERE e.role = 'clustered' AND e.anchor_id = i.anchor_id AND e.expression_ark = x.ark)),
every AS (SELECT * FROM expr UNION ALL SELECT anchor_id, 'independent', i_ord, x_row, x_ord, id, ark, work_ark FROM free WHERE n = 1),
manif AS (SELECT e.expression_ark, m.id, m.ark FROM (SELECT DISTINCT expression_ark FROM every WHERE expression_ark <> '') e JOIN c_me m USING (expression_ark)),
cover AS (SELECT DISTINCT kind, key FROM (
  SELECT 'work_id' AS kind, anchor_id AS key FROM item UNION ALL SELECT 'work_id', item_id FROM item UNION ALL SELECT 'work_ark', anchor_ark FROM item UNION ALL SELECT 'work_ark', item_ark FROM item
  UNION ALL SELECT 'expression_id', expression_id FROM every UNION ALL SELECT 'expression_ark', expression_ark FROM every
  UNION ALL SELECT 'manifestation_id', id FROM manif UNION ALL SELECT 'manifestation_ark', ark FROM manif UNION ALL SELECT 'manifestation_of', expression_ark || ' ' || id FROM manif) WHERE key <> '')"""
REVIEW = [C, O, CE, CL, ITEMS, EXPRESSIONS]
LABELS = f"""
part AS (SELECT row_idx, id, type_norm, zcode, code, zp, v, row_number() OVER (PARTITION BY row_idx, zp, code ORDER BY sp) AS n FROM x_sub),
head AS (SELECT row_idx, code, arg_min(v, zp) AS v FROM part WHERE n = 1 AND coalesce(v, '') <> '' AND code LIKE zcode || '$%' GROUP BY row_idx, code),
lab AS (SELECT r.row_idx, r.id, {clean('r.ark')} AS ark, CASE r.type_norm
  WHEN 'oeuvre' THEN max(v) FILTER (code = '150$a') WHEN 'collectivite' THEN max(v) FILTER (code = '110$a') WHEN 'manifestation' THEN max(v) FILTER (code = '245$a')
  WHEN 'identite publique de personne' THEN nullif(concat_ws(' ', max(v) FILTER (code = '100$a'), max(v) FILTER (code = '100$m')), '')
  WHEN 'expression' THEN coalesce(max(v) FILTER (code = '150$a'), max(v) FILTER (code = '245$a'))
  WHEN 'valeur controlee' THEN max(v) FILTER (code = '169$a') WHEN 'marque' THEN max(v) FILTER (code = '163$a')
  WHEN 'concept dewey' THEN nullif(concat_ws(' — ', max(v) FILTER (code = '186$i'), max(v) FILTER (code = '186$a')), '') END AS label
  FROM x_rec r JOIN head USING (row_idx) GROUP BY r.row_idx, r.id, r.ark, r.type_norm),
label AS (SELECT ark, arg_max(id, row_idx) AS id, arg_max(label, row_idx) AS label FROM lab WHERE ark IS NOT NULL AND label IS NOT NULL GROUP BY ark)"""
_HEADING = "trim(regexp_replace(coalesce(v, ''), '[\\s\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), ' ,;:')"


def variants(m: str) -> str:
    """(row_idx, id, variant): forms of a name, and those with one honorific shortened."""
    terms = ", ".join(f"({_q(t)}, {_q(s)})" for t, s in HONORIFICS)
    return f"""
{m}_h AS (SELECT row_idx, id, zcode, zp, sp, code, {_HEADING} AS v FROM {m}_sub WHERE zcode IN ('100', '400')),
{m}_form AS (SELECT DISTINCT row_idx, id, v FROM (
  SELECT row_idx, id, v FROM {m}_h WHERE code = zcode || '$a'
  UNION ALL SELECT a.row_idx, a.id, a.v || ' ' || b.v FROM {m}_h a JOIN {m}_h b USING (row_idx, zp) WHERE a.code = a.zcode || '$a' AND b.code = b.zcode || '$m' AND a.v <> '' AND b.v <> ''
  UNION ALL SELECT a.row_idx, a.id, b.v || ' ' || a.v FROM {m}_h a JOIN {m}_h b USING (row_idx, zp) WHERE a.code = a.zcode || '$a' AND b.code = b.zcode || '$m' AND a.v <> '' AND b.v <> '') WHERE v <> ''),
term(t, s) AS (VALUES {terms}),
{m}_variant AS (SELECT DISTINCT row_idx, id, v AS variant FROM (SELECT row_idx, id, v FROM {m}_form UNION ALL
  SELECT row_idx, id, trim(regexp_replace(' ' || v || ' ', '([^\\p{{L}}\\p{{N}}_])' || t || '([^\\p{{L}}\\p{{N}}_])', '\\1' || s || '\\2', 'gi')) FROM {m}_form, term WHERE contains(lower(v), t)))"""


PAIRS = """
sig AS (SELECT DISTINCT a.id, coalesce(a.v, '') AS s051, coalesce(b.v, '') AS s041 FROM c_sub a JOIN c_sub b USING (row_idx) WHERE a.type_norm = 'expression' AND a.zcode = '051' AND a.code = '051$a' AND b.zcode = '041' AND b.code = '041$a'),
pair AS (SELECT m.anchor_id, m.key_row, m.first_row, m.member_row, x.id AS a_id, x.row_idx AS a_row, x.ord AS a_ord, y.id AS c_id, y.ark AS c_ark, y.row_idx AS c_row, y.ord AS c_ord, count(*) AS shared
  FROM c_member m JOIN c_xe x ON x.work_ark = m.anchor_ark JOIN c_xe y ON y.work_ark = m.member_ark AND m.member_ark <> '' JOIN sig s ON s.id = x.id JOIN sig t ON t.id = y.id AND t.s051 = s.s051 AND t.s041 = s.s041
  WHERE x.id <> y.id GROUP BY ALL)"""
SEEDS = "ids AS (SELECT DISTINCT try_cast(anchor_id AS BIGINT) AS id FROM cluster_result WHERE try_cast(anchor_id AS BIGINT) IS NOT NULL)"
HOP = """
h750 AS (SELECT DISTINCT id_entitelrm_source AS id FROM entitelrm_entitelrm WHERE codesouszone = '750$3' AND id_entitelrm_destination IN (SELECT id FROM ids) AND id_entitelrm_source IS NOT NULL),
h740 AS (SELECT DISTINCT id_entitelrm_source AS id FROM entitelrm_entitelrm WHERE codesouszone = '740$3' AND id_entitelrm_destination IN (SELECT id FROM h750) AND id_entitelrm_source IS NOT NULL),
base AS (SELECT id FROM ids UNION SELECT id FROM h750 UNION SELECT id FROM h740),
brow AS (SELECT row_idx, id_entitelrm, intermarc FROM test_honorific WHERE id_entitelrm IN (SELECT CAST(id AS VARCHAR) FROM base)),
said AS (SELECT DISTINCT try_cast(x[1:-2] AS BIGINT) AS id FROM (SELECT unnest(regexp_extract_all(intermarc, 'ark:/12148/cb([0-9a-z]+)', 1, 'i')) AS x FROM brow) WHERE try_cast(x[1:-2] AS BIGINT) IS NOT NULL)"""
_ESC = lambda x: f"replace(replace(replace(replace(coalesce({x}, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t')"
SERIAL = f"""
ser_z AS (SELECT z.row_idx, z.id, z.zp, '{{"code": "' || {_ESC('z.zcode')} || '", "sousZones": [' || coalesce(string_agg('{{"code": "' || {_ESC('s.code')} || '", "valeur": "' || {_ESC('s.v')} || '"}}', ', ' ORDER BY s.sp) FILTER (s.sp IS NOT NULL), '') || ']}}' AS t
  FROM c_zone z LEFT JOIN c_sub s USING (row_idx, zp) GROUP BY z.row_idx, z.id, z.zp, z.zcode),
ser AS (SELECT row_idx, any_value(id) AS id, '{{"zones": [' || string_agg(t, ', ' ORDER BY zp) || ']}}' AS t FROM ser_z GROUP BY row_idx)"""

_ORPHANS = with_(A, _model("k", "SELECT CAST(id_entitelrm AS BIGINT) AS row_idx, id_entitelrm, type_entite, intermarc FROM authority_core")) + f""",
known AS (SELECT id_entitelrm AS id, min(loaded_at) AS first, bool_or(deleted_at IS NOT NULL) AS gone FROM (SELECT id_entitelrm, loaded_at, deleted_at FROM test_honorific UNION ALL SELECT id_entitelrm, loaded_at, NULL FROM authority_core) GROUP BY id_entitelrm),
arks AS (SELECT DISTINCT {clean('ark')} AS ark, id FROM (SELECT ark, id FROM a_rec UNION ALL SELECT ark, id FROM k_rec) WHERE {clean('ark')} IS NOT NULL),
by_ark AS (SELECT ark, min(first) AS first, bool_or(gone) AS gone FROM arks JOIN known USING (id) GROUP BY ark),
ref AS (SELECT DISTINCT 'test_honorific' AS src_table, s.row_idx AS src_row, {clean('v')} AS ref, h.loaded_at AS seen, true AS is_ark FROM a_sub s JOIN test_honorific h USING (row_idx) WHERE zcode IN ('140', '150', '700', '701', '702', '710', '711', '712', '740', '750') AND code = zcode || '$3' AND {clean('v')} IS NOT NULL
  UNION SELECT 'entitelrm_entitelrm', edge_id, CAST(id_entitelrm_source AS VARCHAR), loaded_at, false FROM entitelrm_entitelrm WHERE id_entitelrm_source IS NOT NULL
  UNION SELECT 'entitelrm_entitelrm', edge_id, CAST(id_entitelrm_destination AS VARCHAR), loaded_at, false FROM entitelrm_entitelrm WHERE id_entitelrm_destination IS NOT NULL
  UNION SELECT 'detection_record', detection_id, id_entitelrm, detected_at, false FROM detection_record WHERE id_entitelrm IS NOT NULL),
met AS (SELECT r.*, coalesce(b.first, k.first) AS first, coalesce(b.gone, k.gone) AS gone FROM ref r LEFT JOIN by_ark b ON r.is_ark AND b.ark = r.ref LEFT JOIN known k ON NOT r.is_ark AND k.id = r.ref),
verdict AS (SELECT src_table, src_row, ref, strftime(seen AT TIME ZONE 'UTC', '%Y-%m') AS period, CASE WHEN gone IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN strftime(first AT TIME ZONE 'UTC', '%Y-%m') > strftime(seen AT TIME ZONE 'UTC', '%Y-%m') THEN 'later' END AS reason FROM met)"""

#: The terms of responsibility and the words that don't tell names apart, as they are sought in matching forms.
_TERMS = "['illustre', 'illustree', 'illustrations', 'ill.', 'illustr.', 'vignettes', 'images', 'gravures', 'dessins', 'photographies', 'lithographies', 'lith.', 'couverture', 'couv.', 'd''après', 'adapt.', 'adaptation', 'tiré', 'traduit', 'traduction', 'presente', 'preface', 'introduction', 'edite', 'edition', 'commentaire', 'accompagne', 'suivi']"
_STOPS = "['', 'de', 'la', 'le', 'les', 'du', 'des', 'd']"
HITS = f"""
own AS (SELECT {clean('r.ark')} AS ark, r.row_idx, variant FROM x_variant v JOIN x_rec r USING (row_idx)), l AS (SELECT ark, max(row_idx) AS row_idx FROM own WHERE ark IS NOT NULL GROUP BY ark),
named AS (SELECT ark, variant FROM own JOIN l USING (ark, row_idx) UNION SELECT {clean('ark')}, variant FROM nes_variant WHERE {clean('ark')} IS NOT NULL AND variant IS NOT NULL),
titled AS (SELECT r.id, r.ark AS work_ark, t.v AS title FROM x_rec r JOIN ({first('x', '150$a')}) t USING (row_idx) WHERE r.type_norm = 'oeuvre' AND r.row_idx >= 0 AND t.v <> ''),
agent AS (SELECT DISTINCT id, {clean("rtrim(regexp_extract(coalesce(v, ''), '(ark:/12148/[^ ]*)', 1), ').,;')")} AS ark FROM x_sub WHERE row_idx >= 0 AND zcode IN ('700', '701', '702', '710', '711', '712')),
pair AS (SELECT id, work_ark, title, ark, variant, {match_form('title')} AS form, {match_form('variant')} AS name FROM titled JOIN agent USING (id) JOIN named USING (ark)),
placed AS (SELECT *, unnest(list_filter(range(0, length(form) - length(name) + 1), lambda p: substr(form, p + 1, length(name)) = name)) AS at0,
  flatten(list_transform(range(0, length(title)), lambda i: list_transform(range(0, length({fold('title[i + 1]')})), lambda k: i))) AS spots FROM pair WHERE name <> '' AND contains(form, name)),
hit AS (SELECT id, work_ark, title, ark, variant, len(list_filter(string_split(name, ' '), lambda t: NOT list_contains({_STOPS}, t))) AS telling, spots[at0 + 1] AS s, spots[at0 + length(name)] + 1 AS e,
  round(CASE WHEN len(list_filter({_TERMS}, lambda t: contains(substr(form, greatest(at0 - 32, 0) + 1, at0 + length(name) + 32 - greatest(at0 - 32, 0)), t))) > 0 THEN 0.3 ELSE 0 END + CASE WHEN at0 <= 5 THEN 0.15 ELSE 0 END, 3)::DOUBLE AS score FROM placed)"""


SQL: dict[str, str] = {
    "p6_found": with_(A) + " SELECT row_idx, CAST(zp AS INTEGER) AS zone_pos, CAST(sp AS INTEGER) AS sub_pos FROM a_sub",
    "p3_found": _ORPHANS + " SELECT src_table, src_row, ref, period FROM verdict WHERE reason IS NOT NULL",
    "p3_report": _ORPHANS + " SELECT src_table, period, reason, count(*) AS n FROM verdict WHERE reason IS NOT NULL GROUP BY ALL",
    "scan_entities": "SELECT row_idx, id_entitelrm, type_entite, length(intermarc) AS n_chars FROM test_honorific",
    "parse_record": with_(A) + " SELECT row_idx, zp AS zone_pos, sp AS sub_pos, zcode AS zone_code, code, v AS valeur FROM a_sub",
    "record_zones": with_(A) + " SELECT z.row_idx, z.zp AS zone_pos, z.zcode AS code, count(s.sp) AS n_subfields FROM a_zone z LEFT JOIN a_sub s USING (row_idx, zp) GROUP BY ALL",
    "index_records": with_(A) + " SELECT row_idx, id, type_norm, ark FROM a_rec",
    "serialize_record": with_(C, SERIAL) + " SELECT id, md5(t) AS digest FROM ser",
    "zone_filter": with_(C) + " SELECT id, count(*) AS n FROM c_zone WHERE zcode = '700' GROUP BY id",
    "subfield_values": with_(C) + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY zp, sp) - 1 AS ord, coalesce(v, '') AS value FROM c_sub WHERE zcode = '701' AND code = '701$3'",
    "first_subfield": with_(C) + " SELECT id, arg_min(v, zp) AS value FROM (SELECT id, zp, arg_min(coalesce(v, ''), sp) AS v FROM c_sub WHERE zcode = '601' AND code = '601$a' GROUP BY id, zp) WHERE v <> '' GROUP BY id",
    "entity_ark": with_(C) + " SELECT id, ark FROM c_rec",
    "title_main": with_(C) + f" SELECT id, v AS title FROM c_rec LEFT JOIN ({first('c', '150$a')}) USING (row_idx) WHERE type_norm = 'oeuvre'",
    "work_group_key": with_(C, CW) + " SELECT id, c015, c700 FROM c_work WHERE c015 IS NOT NULL",
    "append_zone": with_(C) + " SELECT id, count(z.zp) AS before, count(z.zp) + 1 AS after, ark AS target FROM c_rec JOIN c_zone z USING (row_idx, id) WHERE c_rec.type_norm = 'oeuvre' AND ark IS NOT NULL GROUP BY id, ark",
    "display_title": with_(C) + f" SELECT id, title FROM c_rec LEFT JOIN ({zone_text('c', '150')}) USING (row_idx) WHERE type_norm = 'oeuvre'",
    "manifestation_title": with_(C) + f" SELECT id, title FROM c_rec LEFT JOIN ({zone_text('c', '245')}) USING (row_idx) WHERE type_norm = 'manifestation'",
    "expr_work_edges": with_(C, CE) + " SELECT id, ord, work_ark FROM c_xe",
    "manif_expr_edges": with_(C, CE) + " SELECT id, ord, expression_ark FROM c_me",
    "cluster_targets": with_(C, CL) + " SELECT id, ord, ark, date FROM c_link",
    "existing_targets": with_(C, CL) + " SELECT DISTINCT id, a AS ark FROM c_raw WHERE lower(q) = 'clusterisation script'",
    "expr_signature": with_(C) + " SELECT DISTINCT a.id, coalesce(a.v, '') AS s051, coalesce(b.v, '') AS s041 FROM c_sub a JOIN c_sub b USING (row_idx) WHERE a.type_norm = 'expression' AND a.zcode = '051' AND a.code = '051$a' AND b.zcode = '041' AND b.code = '041$a'",
    "rebuild_90f": with_(C, f"q AS (SELECT row_idx, zp, arg_min(v, sp) = 'Clusterisation script' AS script FROM c_sub WHERE zcode = '90F' AND code = '90F$q' GROUP BY row_idx, zp)") + " SELECT z.id, count(*) FILTER (NOT coalesce(script, false)) + 1 AS n_zones, count(*) FILTER (zcode = '90F' AND NOT coalesce(script, false)) + 1 AS n_links FROM c_zone z LEFT JOIN q USING (row_idx, zp) WHERE type_norm = 'oeuvre' GROUP BY z.id",
    "pretty_print": with_(C) + " SELECT id, md5(string_agg(t, chr(10) ORDER BY zp)) AS digest FROM (SELECT z.id, z.zp, z.zcode || coalesce(string_agg(' $' || regexp_extract(s.code, '[^$]*$') || ' ' || coalesce(s.v, ''), '' ORDER BY s.sp) FILTER (s.sp IS NOT NULL), '') AS t FROM c_zone z LEFT JOIN c_sub s USING (row_idx, zp) GROUP BY z.id, z.zp, z.zcode) GROUP BY id",
    "parse_pretty": with_(C) + " SELECT r.id, count(s.sp) AS n, r.ark FROM c_rec r JOIN c_sub s USING (row_idx) GROUP BY r.id, r.ark",
    "extract_arks": with_(C) + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS ord, ark FROM (SELECT id, min(p) AS p, a[p] AS ark FROM (SELECT id, regexp_extract_all(intermarc, '(?i)ark:/[0-9]+/[A-Za-z0-9]+') AS a FROM c_ent), unnest(range(1, len(a) + 1)) t(p) GROUP BY id, a[p])",
    "ark_to_id": with_(C) + " SELECT id, nullif(regexp_extract(ark, '(?i)^.*/cb(.+).$', 1), '') AS from_ark FROM c_rec WHERE ark IS NOT NULL",
    "derive_internal_id": with_(C) + ", t AS (SELECT id, CASE WHEN contains(lower(ark), 'cb') THEN regexp_replace(ark[instr(lower(ark), 'cb') + 2:], '[^0-9A-Za-z]', '', 'g') END AS x FROM c_rec WHERE ark IS NOT NULL) SELECT id, CASE WHEN length(x) > 1 THEN x[1:-2] END AS from_ark FROM t",
    "normalize_type": f"SELECT type_entite, {norm_type('type_entite')} AS type_norm, count(*) AS n FROM test_honorific GROUP BY ALL",
    "validate_record": with_(A) + " SELECT row_idx, coalesce(json_type(j, '$.zones') IN ('ARRAY', 'OBJECT'), false) AS valid FROM a_ent",
    "validate_keys": with_(A) + " SELECT 'repeated id' AS problem, count(*) AS n FROM (SELECT id FROM a_rec GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'ARK of several ids', count(*) FROM (SELECT ark FROM a_rec WHERE ark IS NOT NULL GROUP BY ark HAVING count(DISTINCT id) > 1) UNION ALL SELECT 'no zones', count(*) FROM a_ent WHERE coalesce(json_type(j, '$.zones') NOT IN ('ARRAY', 'OBJECT'), true) UNION ALL SELECT 'no type', count(*) FROM a_rec WHERE type_norm IS NULL",
    "filter_works": with_(C) + " SELECT id FROM c_rec WHERE type_norm = 'oeuvre'",
    "filter_expressions": with_(C) + " SELECT id FROM c_rec WHERE type_norm = 'expression'",
    "has_suffix": with_(C, CW) + " SELECT id, title FROM c_work WHERE suffix",
    "illustration_trigger": with_(C, CW) + f", f AS (SELECT id, lower({fold('title')}) AS t FROM c_work WHERE title IS NOT NULL) SELECT id FROM f WHERE t LIKE '%illustre%' OR t LIKE '%illustrations%' OR t LIKE '%ill.%' OR t LIKE '%illustr.%' OR t LIKE '%vignettes%' OR t LIKE '%images%' OR t LIKE '%gravures%' OR t LIKE '%dessins%' OR t LIKE '%photographies%' OR t LIKE '%lithographies%' OR t LIKE '%lith.%' OR t LIKE '%couverture%' OR t LIKE '%couv.%'",
    "record_source": with_(C) + " SELECT id, row_idx, 'curated' AS source FROM c_rec",
    "hop_750": with_(SEEDS, HOP) + " SELECT id FROM h750",
    "hop_740": with_(SEEDS, HOP) + " SELECT id FROM h740",
    "base_ids": with_(SEEDS, HOP) + " SELECT id FROM base",
    "base_rows": with_(SEEDS, HOP) + " SELECT row_idx, id_entitelrm FROM brow",
    "ark_hits": "SELECT row_idx, hit, count(*) AS n FROM (SELECT row_idx, unnest(regexp_extract_all(intermarc, 'ark:/12148/cb([0-9a-z]+)', 1, 'i')) AS hit FROM test_honorific) GROUP BY ALL",
    "extract_neighbourhood": with_(SEEDS, HOP) + " SELECT row_idx, id_entitelrm, type_entite, row_number() OVER (ORDER BY try_cast(id_entitelrm AS BIGINT), row_idx) AS rank FROM test_honorific WHERE id_entitelrm IN (SELECT CAST(id AS VARCHAR) FROM base UNION SELECT CAST(id AS VARCHAR) FROM said)",
    "stage_counts": with_(SEEDS, HOP) + "".join(f"{' UNION ALL' if i else ''} SELECT '{s}' AS stage, count(*) AS n FROM {t}" for i, (s, t) in enumerate((("ids", "ids"), ("hop_750", "h750"), ("hop_740", "h740"), ("base_ids", "base"), ("base_rows", "brow"), ("mentioned", "said")))),
    "normalize_title": with_(C, CW) + " SELECT id, title_key FROM c_work WHERE title IS NOT NULL",
    "work_groups": with_(C, CW) + " SELECT c015, c700, title_key, n, first_row FROM c_group WHERE n > 1",
    "work_anchors": with_(C, CW) + " SELECT title_key, anchor_id, anchor_ark, n FROM c_group WHERE n > 1",
    "cluster_works": with_(C, CW) + " SELECT anchor_id, anchor_ark, member_id, member_ark, member_row FROM c_member",
    "cluster_sizes": with_(C, CW) + " SELECT anchor_id, count(*) + 1 AS size FROM c_member GROUP BY anchor_id",
    "cluster_works_90f": with_(C, CW) + ", n AS (SELECT id, count(*) AS k FROM c_zone WHERE zcode = '90F' GROUP BY id) SELECT anchor_id AS id, coalesce(max(k), 0) + count(*) AS n_links, arg_max(member_ark, member_row) AS last_target FROM c_member LEFT JOIN n ON n.id = anchor_id GROUP BY anchor_id",
    "expr_pairs": with_(C, CW, CE, PAIRS) + " SELECT DISTINCT anchor_id, a_id, c_id, shared FROM pair",
    "cluster_expressions": with_(C, CW, CE, CL, PAIRS) + ", able AS (SELECT * FROM pair p WHERE c_ark <> '' AND NOT EXISTS (SELECT 1 FROM c_raw l WHERE l.id = p.a_id AND l.a = p.c_ark AND lower(q) = 'clusterisation script')) SELECT arg_min(anchor_id, k) AS anchor_work_id, arg_min(a_id, k) AS anchor_expression_id, c_id AS expression_id, any_value(c_ark) AS expression_ark FROM (SELECT *, (key_row, first_row, member_row, a_row, a_ord, a_id, c_row, c_ord) AS k FROM able) GROUP BY c_id",
    "expressions_by_work": with_(C, CE) + " SELECT work_ark, count(*) AS n, min(row_idx) AS first_row FROM c_xe GROUP BY work_ark",
    "merge_updates": with_(C, CW) + ", n AS (SELECT id, count(*) AS k FROM c_zone WHERE zcode = '90F' GROUP BY id), m AS (SELECT anchor_id AS id, count(*) AS k FROM c_member GROUP BY anchor_id), z AS (SELECT DISTINCT id FROM c_zone) SELECT r.id, CASE WHEN z.id IS NOT NULL THEN coalesce(n.k, 0) + coalesce(m.k, 0) END AS n_links FROM c_rec r LEFT JOIN n USING (id) LEFT JOIN m USING (id) LEFT JOIN z ON z.id = r.id",
    "export_curated": with_(C, CW, SERIAL) + f", m AS (SELECT DISTINCT anchor_id AS id FROM c_member) SELECT h.row_idx, h.id_entitelrm, h.type_entite, CASE WHEN intermarc IS NOT NULL THEN m.id IS NOT NULL END AS updated, CASE WHEN m.id IS NULL THEN md5(coalesce(ser.t, intermarc)) END AS digest FROM ({CURATED}) h LEFT JOIN m ON m.id = h.id_entitelrm LEFT JOIN ser ON ser.id = h.id_entitelrm",
    "detect_clusters": with_(C, O, CL, ITEMS) + " SELECT anchor_id, anchor_ark, ord, item_ark, date, item_id, item_title FROM item",
    "expression_groups": with_(*REVIEW) + " SELECT anchor_id, role, expression_id, expression_ark, work_ark FROM every WHERE role <> 'independent'",
    "independent_expressions": with_(*REVIEW) + " SELECT anchor_id, expression_id, expression_ark, work_ark FROM every WHERE role = 'independent'",
    "coverage": with_(*REVIEW) + " SELECT kind, key FROM cover",
    "is_clustered": with_(*REVIEW, OE) + """, t AS (SELECT *, CASE type_norm WHEN 'oeuvre' THEN 'work' ELSE type_norm END AS k FROM o_rec WHERE type_norm IN ('oeuvre', 'expression', 'manifestation'))
SELECT id, type_norm, (EXISTS (SELECT 1 FROM cover c WHERE c.kind = k || '_id' AND c.key = t.id) OR EXISTS (SELECT 1 FROM cover c WHERE c.kind = k || '_ark' AND c.key = t.ark))
  AND (type_norm <> 'manifestation' OR NOT EXISTS (SELECT 1 FROM o_me m WHERE m.row_idx = t.row_idx AND m.expression_ark <> '' AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.kind = 'manifestation_of' AND c.key = m.expression_ark || ' ' || m.id))) AS clustered FROM t""",
    "unclustered_works": with_(*REVIEW) + f" SELECT r.id, coalesce(title, r.id) AS title, row_number() OVER (ORDER BY lower(coalesce(title, r.id)) COLLATE fr, r.id) AS rank FROM o_rec r LEFT JOIN ({zone_text('o', '150')}) USING (row_idx) WHERE type_norm = 'oeuvre' AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.kind = 'work_id' AND c.key = r.id) AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.kind = 'work_ark' AND c.key = r.ark)",
    "work_counts": with_(*REVIEW) + ", m AS (SELECT expression_ark, count(*) AS k FROM c_me GROUP BY expression_ark) SELECT anchor_id, work_ark, count(*) AS expressions, CAST(sum(coalesce(k, 0)) AS BIGINT) AS manifestations FROM every LEFT JOIN m USING (expression_ark) WHERE work_ark <> '' GROUP BY anchor_id, work_ark",
    "unclustered_counts": with_(*REVIEW, OE) + ", m AS (SELECT expression_ark, count(*) AS k FROM o_me GROUP BY expression_ark), w AS (SELECT work_ark, count(*) AS x, CAST(sum(coalesce(k, 0)) AS BIGINT) AS m FROM o_xe LEFT JOIN m ON m.expression_ark = o_xe.ark GROUP BY work_ark) SELECT id, coalesce(x, 0) AS expressions, coalesce(m, 0) AS manifestations FROM o_rec LEFT JOIN w ON w.work_ark = o_rec.ark WHERE type_norm = 'oeuvre' AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.kind = 'work_id' AND c.key = o_rec.id) AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.kind = 'work_ark' AND c.key = o_rec.ark)",
    "relationship_counts": with_(C) + " SELECT r.id, count(DISTINCT nullif(trim(s.v), '')) AS n FROM c_rec r LEFT JOIN c_sub s ON s.row_idx = r.row_idx AND s.code = s.zcode || '$3' AND ((r.type_norm = 'oeuvre' AND s.zcode IN ('500', '501', '506', '509', '50N', '54T', '550', '551', '552', '553', '554', '555', '556', '557', '559', '55A', '55B', '55C', '55E', '55F', '55M', '55P', '55R', '55S', '55Z')) OR (r.type_norm = 'expression' AND s.zcode IN ('501', '506', '509', '50N', '540', '541', '542', '543', '544', '547', '54C', '54P', '54T')) OR (r.type_norm = 'manifestation' AND s.zcode IN ('501', '506', '509', '50N', '530', '531', '532', '533', '534', '535', '536', '537', '538', '53M'))) GROUP BY r.id",
    "bond_counts": with_(C) + " SELECT r.id, count(DISTINCT nullif(trim(s.v), '')) AS n FROM c_rec r LEFT JOIN c_sub s ON s.row_idx = r.row_idx AND s.code = s.zcode || '$3' AND ((r.type_norm = 'oeuvre' AND s.zcode IN ('700', '701', '702')) OR (r.type_norm = 'expression' AND s.zcode IN ('140', '750')) OR (r.type_norm = 'manifestation' AND s.zcode = '740')) GROUP BY r.id",
    "manifestations_by_expression": with_(C, CE) + " SELECT expression_ark, count(*) AS n, min(id) AS first_id FROM c_me GROUP BY expression_ark",
    "ark_index": with_(O) + f" SELECT ark, arg_max(id, row_idx) AS id, nullif(arg_max(coalesce(t.v, chr(0)), row_idx), chr(0)) AS title FROM (SELECT DISTINCT row_idx, id, v AS ark FROM o_sub WHERE zcode = '001' AND code = '001$a' AND v <> '') LEFT JOIN ({first('o', '150$a')}) t USING (row_idx) GROUP BY ark",
    "original_indexes": with_(O, OE) + " SELECT 'work' AS kind, ark, id FROM o_rec WHERE type_norm = 'oeuvre' UNION ALL SELECT 'expression of', work_ark, id FROM o_xe UNION ALL SELECT 'manifestation of', expression_ark, id FROM o_me",
    "merged_index": with_(C, O) + " SELECT id, coalesce(c.ark, CASE WHEN c.id IS NULL THEN o.ark END) AS ark FROM c_rec c FULL JOIN o_rec o USING (id)",
    "record_lookup": with_(C, O) + ", b AS (SELECT lower(ark) AS ark, id, row_idx, 0 AS k FROM c_rec UNION ALL SELECT lower(ark), id, row_idx, 1 FROM o_rec) SELECT ark, arg_max(id, (k, row_idx)) AS id, arg_max(row_idx, (k, row_idx)) AS row_idx FROM b WHERE ark IS NOT NULL GROUP BY ark",
    "primary_expression": with_(*REVIEW) + " SELECT anchor_id, work_ark, arg_min(expression_id, (CASE role WHEN 'anchor' THEN 0 WHEN 'clustered' THEN 1 ELSE 2 END, k1, k2, k3, expression_id)) AS expression_id FROM every WHERE work_ark <> '' GROUP BY anchor_id, work_ark",
    "inventory_cluster": with_(O, OE) + " SELECT r.id AS work_id, x.id AS expression_id, x.ord FROM o_rec r JOIN o_xe x ON x.work_ark = r.ark WHERE r.type_norm = 'oeuvre'",
    "parent_entity": with_(C, CE) + " SELECT id, expression_ark AS parent_ark FROM c_me WHERE ord = 0 UNION ALL SELECT id, work_ark FROM c_xe WHERE ord = 0",
    "first_child": with_(C, CE) + " SELECT work_ark AS ark, arg_min(id, (row_idx, ord)) AS child_id FROM c_xe GROUP BY work_ark UNION ALL SELECT expression_ark, arg_min(id, (row_idx, ord)) FROM c_me GROUP BY expression_ark",
    "moved_manifestations": with_(C, O, CE, OE) + " SELECT c.id, c.expression_ark AS new_ark, o.expression_ark AS old_ark FROM c_me c JOIN o_me o USING (id) WHERE c.ord = 0 AND o.ord = 0 AND c.expression_ark <> o.expression_ark",
    "move_manifestation": with_(C, CE) + ", f AS (SELECT row_idx, expression_ark AS old FROM c_me WHERE ord = 0), z AS (SELECT DISTINCT row_idx FROM c_zone) SELECT r.id, coalesce(string_agg(CASE WHEN m.expression_ark = f.old THEN 'ark:/12148/cb0x' ELSE m.expression_ark END, '|' ORDER BY m.ord), '') AS parents FROM c_rec r JOIN z USING (row_idx) LEFT JOIN c_me m USING (row_idx) LEFT JOIN f USING (row_idx) WHERE r.type_norm = 'manifestation' GROUP BY r.id",
    "curated_diff": with_(C, O, SERIAL, SERIAL.replace("ser_z", "old_z").replace("ser AS", "old AS").replace("c_zone", "o_zone").replace("c_sub", "o_sub")) + " SELECT id, CASE WHEN old.t IS NULL THEN 'added' WHEN ser.t IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ser FULL JOIN old USING (id) WHERE ser.t IS DISTINCT FROM old.t",
    "sorted_titles": with_(C) + f" SELECT id, coalesce(title, id) AS title, row_number() OVER (ORDER BY lower(coalesce(title, id)) COLLATE fr, id) AS rank FROM c_rec LEFT JOIN ({zone_text('c', '150')}) USING (row_idx) WHERE type_norm = 'oeuvre'",
    "work_list": with_(C, CL) + f" SELECT *, row_number() OVER (ORDER BY lower(title) COLLATE fr, kind, id) AS rank FROM (SELECT r.id, coalesce(title, r.id) AS title, CASE WHEN r.row_idx IN (SELECT row_idx FROM c_link) THEN 'cluster' ELSE 'work' END AS kind FROM c_rec r LEFT JOIN ({zone_text('c', '150')}) USING (row_idx) WHERE type_norm = 'oeuvre')",
    "ark_labels": with_(X, LABELS) + " SELECT ark, id, label FROM label",
    "agent_names": with_(C, X, LABELS) + f""", z AS (SELECT id, row_idx, zp, row_number() OVER (PARTITION BY row_idx ORDER BY zp) - 1 AS ord FROM c_zone WHERE zcode IN ('700', '701', '702', '710', '711', '712')),
s AS (SELECT z.id, z.ord, s.sp, trim(s.v) AS v, lower(regexp_extract(s.code, '[^$]*$')) AS l FROM z JOIN c_sub s USING (row_idx, zp) WHERE trim(coalesce(s.v, '')) <> ''),
own AS (SELECT id, ord, string_agg(v, ' ' ORDER BY sp) AS name FROM s WHERE l IN ('a', 'b', 'c', 'd', 'f', 'g', 'h', 'm', 'n', 'p', 'q') GROUP BY id, ord),
ref AS (SELECT s.id, s.ord, arg_min(label.label, sp) AS name FROM s JOIN label ON label.ark = {clean('s.v')} WHERE l IN ('0', '3') GROUP BY s.id, s.ord),
named AS (SELECT z.id, z.ord, coalesce(own.name, ref.name) AS name FROM z LEFT JOIN own USING (id, ord) LEFT JOIN ref USING (id, ord))
SELECT id, name, min(ord) AS ord FROM named WHERE name IS NOT NULL GROUP BY id, name""",
    "decorate_text": with_(C, X, LABELS) + f", t AS (SELECT id, zp, sp, trim(coalesce(v, '')) AS v, nullif(regexp_extract(coalesce(v, ''), 'ark:/[^\\s]+'), '') AS token, string_agg(trim(coalesce(v, '')), ' ') OVER (PARTITION BY id) AS every FROM c_sub WHERE zcode = '700' AND code = '700$3') SELECT t.id, string_agg(coalesce(replace(v, token, label), v), ' ' ORDER BY zp, sp) AS text FROM t LEFT JOIN label ON label.ark = {clean('token')} WHERE every <> '' GROUP BY t.id",
    "breadcrumbs": with_(C, X, LABELS, CE) + f", me AS (SELECT row_idx, id, label FROM lab) SELECT x.id, concat_ws(' › ', p.label, CASE WHEN p.label IS NULL OR p.label <> coalesce(me.label, x.id) THEN coalesce(me.label, x.id) END) AS path FROM c_xe x LEFT JOIN label p ON p.ark = {clean('x.work_ark')} LEFT JOIN me ON me.row_idx = x.row_idx WHERE x.ord = 0",
    "responsible_arks": with_(C) + ", s AS (SELECT id, zcode, zp, sp, rtrim(regexp_extract(coalesce(v, ''), '(ark:/12148/\\S*)', 1), ').,;') AS ark FROM c_sub WHERE zcode IN ('700', '701', '702', '710', '711', '712')), f AS (SELECT id, ark, min((zcode, zp, sp)) AS k FROM s WHERE ark <> '' GROUP BY id, ark) SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS ord, ark FROM f",
    "honorific_variants": with_(C, variants("c")) + " SELECT id, variant FROM c_variant",
    "person_variants": with_(X, variants("x")) + f", own AS (SELECT {clean('r.ark')} AS ark, r.row_idx, variant FROM x_variant v JOIN x_rec r USING (row_idx)), l AS (SELECT ark, max(row_idx) AS row_idx FROM own WHERE ark IS NOT NULL GROUP BY ark) SELECT DISTINCT ark, variant FROM own JOIN l USING (ark, row_idx) UNION SELECT {clean('ark')}, variant FROM nes_variant WHERE {clean('ark')} IS NOT NULL AND variant IS NOT NULL AND {clean('ark')} NOT IN (SELECT ark FROM l)",
    "nes_upsert": with_(C, variants("c")) + f", own AS (SELECT {clean('r.ark')} AS ark, r.row_idx, variant FROM c_variant v JOIN c_rec r USING (row_idx)), l AS (SELECT ark, max(row_idx) AS row_idx FROM own WHERE ark IS NOT NULL GROUP BY ark) SELECT ark, variant FROM own JOIN l USING (ark, row_idx) UNION SELECT ark, variant FROM nes_variant WHERE ark IS NOT NULL AND variant IS NOT NULL",
    "ark_list": "SELECT DISTINCT trim(ark) AS ark FROM nes_variant WHERE trim(ark) <> ''",
    "ark_sources": "SELECT ark, min(source) AS source FROM (SELECT trim(ark) AS ark, CAST(0 AS BIGINT) AS source FROM nes_variant UNION ALL SELECT trim(work_ark), 1 FROM detection_record) WHERE ark <> '' GROUP BY ark",
    "dedupe_ordered": "SELECT DISTINCT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY p) - 1 AS ord, ark FROM (SELECT cluster_id, min(p) AS p, trim(a[p]) AS ark FROM (SELECT DISTINCT cluster_id, clustered_arks AS a FROM cluster_result), unnest(range(1, len(a) + 1)) t(p) WHERE trim(a[p]) <> '' GROUP BY cluster_id, trim(a[p]))",
    "guess_delimiter": "SELECT file_name, CASE WHEN length(line) - length(replace(line, ',', '')) > length(line) - length(replace(line, ';', '')) THEN ',' ELSE ';' END AS delimiter FROM raw_entity_line WHERE line_no = 1",
    "folded_map": f"""SELECT detection_id, form, length(form) AS n, array_to_string(list_transform(range(0, length(form)), lambda k: coalesce(spots[k + 1], spots[-1])), ' ') AS places FROM (
SELECT detection_id, {match_form('title')} AS form, flatten(list_transform(range(0, length(title)), lambda i: list_transform(range(0, length({fold('title[i + 1]')})), lambda k: i))) AS spots FROM detection_record WHERE title IS NOT NULL)""",
    "work_clusters": with_(*REVIEW) + " SELECT kind, key, arg_min(anchor_id, (anchor_row, p)) AS anchor_id FROM (SELECT 'id' AS kind, anchor_id AS key, anchor_id, anchor_row, 0 AS p FROM item UNION ALL SELECT 'id', item_id, anchor_id, anchor_row, 1 FROM item UNION ALL SELECT 'ark', anchor_ark, anchor_id, anchor_row, 0 FROM item UNION ALL SELECT 'ark', item_ark, anchor_id, anchor_row, 1 FROM item) WHERE key <> '' GROUP BY kind, key",
    "expression_clusters": with_(*REVIEW) + """, e AS (SELECT DISTINCT anchor_id, role, expression_id, expression_ark, anchor_row, CASE role WHEN 'anchor' THEN 0 WHEN 'clustered' THEN 1 ELSE 2 END AS r FROM every JOIN (SELECT DISTINCT anchor_id, anchor_row FROM item) USING (anchor_id))
SELECT kind, key, arg_min(anchor_id, (anchor_row, r)) AS anchor_id, arg_min(role, (anchor_row, r)) AS role FROM (SELECT 'id' AS kind, expression_id AS key, * FROM e UNION ALL SELECT 'ark', expression_ark, * FROM e) WHERE key <> '' GROUP BY kind, key""",
    "tab_lookup": with_(C, O) + " SELECT kind, key, arg_max(row_idx, (k, row_idx)) AS row_idx FROM (SELECT 'id' AS kind, id AS key, row_idx, 0 AS k FROM o_rec UNION ALL SELECT 'ark', lower(ark), row_idx, 0 FROM o_rec UNION ALL SELECT 'id', id, row_idx, 1 FROM c_rec UNION ALL SELECT 'ark', lower(ark), row_idx, 1 FROM c_rec) WHERE key IS NOT NULL GROUP BY kind, key",
    "filter_wem": with_(C) + " SELECT id, type_norm FROM c_rec WHERE type_norm IN ('oeuvre', 'expression', 'manifestation')",
    "filter_equal": "SELECT edge_id FROM entitelrm_entitelrm WHERE codesouszone = '750$3'",
    "detect_hits": with_(X, variants("x"), HITS) + """ SELECT id, ark, variant, score, s AS start, e AS "end", CASE WHEN score >= 0.85 THEN 'high' ELSE 'medium' END AS confidence FROM hit WHERE telling >= 2""",
    "variant_spans": with_(X, variants("x"), HITS) + ' SELECT DISTINCT id, s AS start, e AS "end" FROM hit',
    "merge_ranges": """WITH w AS (SELECT detection_id, title, unnest(regexp_extract_all(title, '(\\w+)', 1)) AS w FROM detection_record WHERE title IS NOT NULL), r AS (SELECT detection_id, instr(title, w) AS s, instr(title, w) + length(w) + 1 AS e FROM w),
m AS (SELECT detection_id, s > max(e) OVER (PARTITION BY detection_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM r)
SELECT d.detection_id, count(m.detection_id) FILTER (WHERE coalesce(later, true)) AS n FROM detection_record d LEFT JOIN m USING (detection_id) WHERE title IS NOT NULL GROUP BY d.detection_id""",
    "name_variants": with_(C, variants("c")) + " SELECT id, v AS variant FROM c_form",
    "apply_work_decisions": with_(C, O, CL, ITEMS) + " SELECT anchor_id, ord, item_ark, item_id IS NOT NULL AS accepted, CASE WHEN item_id IS NOT NULL THEN date END AS date FROM item",
    "apply_expression_decisions": with_(*REVIEW) + " SELECT anchor_id, expression_id, work_ark, NOT EXISTS (SELECT 1 FROM item i WHERE i.anchor_id = every.anchor_id AND i.item_ark = every.work_ark AND i.item_id IS NULL) AS accepted FROM every WHERE role = 'clustered'",
    "fold_diacritics": f"SELECT detection_id, {fold('title')} AS folded FROM detection_record WHERE title IS NOT NULL",
    "normalize_match": f"SELECT detection_id, {match_form('title')} AS form FROM detection_record WHERE title IS NOT NULL",
    "word_tokens": f"SELECT detection_id, len(list_filter(string_split({match_form('title')}, ' '), lambda x: x <> '')) AS n FROM detection_record WHERE title IS NOT NULL",
}
