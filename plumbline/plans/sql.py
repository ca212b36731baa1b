"""SQL text of the DuckDB checks, written from the operators' definitions."""

from __future__ import annotations

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE, Catalogue
from plumbline.functions.lookup import word_positions
from plumbline.functions.text import SPACE_CHARS
from plumbline.plans import derive

SPACES = r"[\t\n\v\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAKS = r"(\r\n|[\n\v\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STRIP_SET = q(SPACE_CHARS)


def strip(x: str) -> str:
    return f"trim({x}, {STRIP_SET})"


def tidy(x: str) -> str:
    x = f"translate({x}, {q(chr(92) + '—–－')}, '/---')"
    x = rf"regexp_replace({x}, '[ \t\r\f\v]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def key(x: str) -> str:
    x = f"trim({upper(x)}, ' :')"
    x = f"regexp_replace({x}, '{SPACES}*/{SPACES}*', '/', 'g')"
    return f"regexp_replace({x}, '{SPACES}+', ' ', 'g')"


def norm(x: str, fix: bool, numeric: bool) -> str:
    if fix:
        x = f"translate({x}, 'OoIlSB', '001158')"
    x = f"replace(replace({upper(x)}, 'KGS', 'KG'), 'KWH/YEAR', 'KWH')"
    x = rf"regexp_replace({x}, '\bLITERS?\b', 'L', 'g')"
    x = f"trim(regexp_replace({x}, '{SPACES}+', '', 'g'), ':：')"
    if numeric:
        x = rf"regexp_replace({x}, '(\d)\.0+(\D|$)', '\1\2', 'g')"
    return x


def candidate(x: str) -> str:
    x = f"trim({tidy(x)}, ' :：|')"
    return strip(f"regexp_replace({x}, '{SPACES}{{2,}}', ' ', 'g')")


def cut(x: str) -> str:
    n = fv.MAX_VALUE_CHARS
    return f"CASE WHEN length({x}) > {n} THEN {strip(f'substr({x}, 1, {n})')} ELSE {x} END"


def noise(k: str, cat: Catalogue = APPLIANCE) -> str:
    stop = ", ".join(q(w) for w in word_positions(cat))
    has = " OR ".join(f"contains({k}, {q(w.upper())})" for w in fv.NOISE_WORDS)
    return f"({k} = '' OR {k} IN ({stop}) OR {has})"


def hits(x: str, words) -> str:
    return " + ".join(f"CASE WHEN contains(lower({x}), {q(w.lower())}) THEN 1 ELSE 0 END" for w in words)


def by_words(x: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} END"


def rule_table(cat: Catalogue = APPLIANCE) -> str:
    rows = ", ".join(f"({i}, {q(f.id)}, {str(f.required).lower()})" for i, f in enumerate(cat.fields))
    return f"rules(ord, field_name, required) AS (VALUES {rows})"


_POS = {name: APPLIANCE.position[name] for name in derive.LABEL_FIELDS}


def _fields(source: str, fields: dict[str, str], keys: str) -> str:
    parts = []
    for name, expr in fields.items():
        f = APPLIANCE.fields[_POS[name]]
        parts.append(
            f"SELECT {keys}, {_POS[name]} AS ord, '{name}' AS field_name, value, "
            f"{norm('value', f.digit_fix, f.numeric)} AS norm "
            f"FROM (SELECT {keys}, {expr} AS value FROM {source})")
    return " UNION ALL ".join(parts)


_ORDER = ", ".join(derive.LABEL_ORDER)

# lab: labels; draw: drawings; lf / df: their field values, '' where absent; used: comparison rows
LAB = f"""WITH {rule_table()},
lab AS MATERIALIZED (SELECT i.*, p_name, p_brand, p_size FROM (
  SELECT l_partkey AS case_id, {derive.LABEL_CLASS} AS h,
   CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY {_ORDER}) AS INT) AS label_no,
   concat('label_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '.jpg') AS label_file,
   l_orderkey, l_linenumber, l_discount, l_tax, l_shipdate
  FROM lineitem) i JOIN part ON p_partkey = case_id),
draw AS (SELECT p_partkey AS case_id, * FROM part)"""

VERDICT = f"""cmp AS (SELECT *, CASE WHEN dv = '' AND lv = '' THEN 'not_applicable' WHEN dv = '' THEN 'drawing_missing'
   WHEN lv = '' THEN 'label_missing' WHEN dn = ln THEN 'match' ELSE 'mismatch' END AS status FROM cmp0),
verdict AS (SELECT case_id, label_no, label_file,
   count(*) FILTER (status = 'match') AS n_pass, count(*) FILTER (status = 'mismatch') AS n_fail,
   count(*) FILTER (status NOT IN ('match', 'mismatch')) AS n_unknown,
   CASE WHEN count(*) FILTER (status = 'mismatch') > 0 THEN 'FAIL'
        WHEN count(*) FILTER (status NOT IN ('match', 'mismatch')) > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict
  FROM cmp GROUP BY ALL)"""

BASE = LAB + f""",
lf AS MATERIALIZED ({_fields('lab', derive.LABEL_FIELDS, 'case_id, label_no, label_file')}),
df AS MATERIALIZED ({_fields('draw', derive.DRAWING_FIELDS, 'case_id')}),
pairs AS (SELECT lf.case_id, lf.label_no, lf.label_file, lf.ord, lf.field_name,
   df.value AS dv, lf.value AS lv, df.norm AS dn, lf.norm AS ln
  FROM lf JOIN df ON lf.case_id = df.case_id AND lf.ord = df.ord),
used AS MATERIALIZED (SELECT * FROM pairs WHERE dv <> '' OR lv <> ''),
cmp0 AS MATERIALIZED (SELECT * FROM used UNION ALL
  SELECT l.case_id, l.label_no, l.label_file, r.ord, r.field_name, '', '', '', ''
  FROM lab l JOIN rules r ON r.ord < {fv.DEFAULT_FIELD_COUNT}
  LEFT JOIN (SELECT case_id, label_no, count(*) AS n FROM used GROUP BY ALL) u ON u.case_id = l.case_id AND u.label_no = l.label_no
  WHERE u.n IS NULL),
{VERDICT},
filled AS (SELECT DISTINCT case_id, ord FROM lf WHERE value <> ''),
active AS (SELECT case_id, ord FROM filled UNION ALL
  SELECT c.case_id, r.ord FROM (SELECT DISTINCT case_id FROM lab) c CROSS JOIN rules r
  WHERE r.ord < {fv.DEFAULT_FIELD_COUNT} AND c.case_id NOT IN (SELECT case_id FROM filled)),
grid AS MATERIALIZED (SELECT l.case_id, l.label_no, l.label_file, a.ord, r.field_name,
   coalesce(f.value, '') AS value, coalesce(f.norm, '') AS norm
  FROM lab l JOIN active a ON a.case_id = l.case_id JOIN rules r ON r.ord = a.ord
  LEFT JOIN lf f ON f.case_id = l.case_id AND f.label_no = l.label_no AND f.ord = a.ord),
hcmp AS MATERIALIZED (SELECT t.case_id, t.label_no, t.label_file, t.ord, t.field_name, b.label_file AS baseline_label,
   b.value AS bv, b.norm AS bn, t.value AS tv, t.norm AS tn,
   CASE WHEN b.value = '' AND t.value = '' THEN 'not_applicable' WHEN b.value = '' THEN 'baseline_missing'
    WHEN t.value = '' THEN 'target_missing' WHEN b.norm = t.norm THEN 'match' ELSE 'mismatch' END AS status
  FROM grid t JOIN grid b ON b.case_id = t.case_id AND b.ord = t.ord AND b.label_no = 1),
hsum AS (SELECT case_id, label_no, label_file,
   count(*) FILTER (status = 'match') AS n_pass, count(*) FILTER (status = 'mismatch') AS n_fail,
   count(*) FILTER (status NOT IN ('match', 'mismatch')) AS n_unknown,
   CASE WHEN count(*) FILTER (status = 'mismatch') > 0 THEN 'FAIL'
        WHEN count(*) FILTER (status NOT IN ('match', 'mismatch')) > 0 THEN 'REVIEW' ELSE 'PASS' END AS verdict
  FROM hcmp GROUP BY ALL),
bverdict AS (SELECT p_partkey AS case_id, CASE
   WHEN max(verdict) IS NULL OR bool_or(verdict = 'FAIL') THEN 'FAIL'
   WHEN bool_or(verdict <> 'PASS') THEN 'REVIEW' ELSE 'PASS' END AS verdict
  FROM part LEFT JOIN hsum ON case_id = p_partkey GROUP BY 1),
issues AS (SELECT case_id, ord, field_name, count(DISTINCT nullif(norm, '')) AS n_values,
   count(*) FILTER (norm = '') AS n_missing, count(*) AS n_labels
  FROM grid GROUP BY ALL HAVING count(DISTINCT nullif(norm, '')) > 1 OR count(*) FILTER (norm = '') > 0),
issue AS (SELECT *, CASE WHEN n_values > 1 AND n_missing > 0 THEN 'missing_and_differs'
   WHEN n_missing > 0 THEN 'missing' ELSE 'differs' END AS issue FROM issues)
"""

RESULT = "CASE WHEN status = 'match' THEN 'PASS' WHEN status = 'mismatch' THEN 'FAIL' ELSE 'UNKNOWN' END"
