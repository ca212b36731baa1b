"""Queries: text scalars, look-ups, lines and field extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE as CAT, SIX
from plumbline.functions import lookup, text as T
from plumbline.operators import extract as E, records as R
from plumbline.plans import derive, sql as S
from plumbline.plans.registry import ORACLE, query, table, text_table
from plumbline.session import new_folder
from plumbline.sources import cases, records


def docs(spark, sf):
    return text_table(spark, sf, "documents", "doc_id")


# --- scalars over whole document texts --------------------------------------------

@query("clean_text_docs", f"SELECT doc_id, md5({S.tidy('text')}) AS clean_md5, length({S.tidy('text')}) AS n_clean FROM documents")
def clean_text_docs(spark, sf):
    return (docs(spark, sf).select("doc_id", T.clean_text("text").alias("c"))
            .select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").cast("long").alias("n_clean")))


@query("compact_text_docs", f"SELECT doc_id, md5({S.upper(chr(40) + 'regexp_replace(' + S.tidy('text') + ', ' + S.q(S.SPACES + '+') + ', ' + S.q('') + ', ' + S.q('g') + '))')}) AS compact_md5 FROM documents")
def compact_text_docs(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.compact_text("text")).alias("compact_md5"))


@query("clean_line_docs", f"SELECT doc_id, md5({S.strip('regexp_replace(text, ' + S.q(S.SPACES + '+') + ', ' + S.q(' ') + ', ' + S.q('g') + ')')}) AS line_md5 FROM documents")
def clean_line_docs(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.clean_line("text")).alias("line_md5"))


@query("split_lines_docs", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS line_no, x AS line
FROM (SELECT doc_id, n, {S.tidy('raw')} AS x FROM (
 SELECT doc_id, unnest(regexp_split_to_array(text, '{S.BREAKS}')) AS raw,
  generate_subscripts(regexp_split_to_array(text, '{S.BREAKS}'), 1) AS n FROM documents)) WHERE x <> ''""")
def split_lines_docs(spark, sf):
    return (docs(spark, sf).select("doc_id", F.posexplode(T.split_lines(T.nfkc("text"))).alias("i", "line"))
            .select("doc_id", (F.col("i") + 1).alias("line_no"), "line"))


@query("keyword_hits", f"""
SELECT doc_id, {S.hits('text', fv.PAGE_KEYWORDS)} AS page_hits, {S.hits('text', fv.LABEL_KEYWORDS)} AS label_hits FROM documents""")
def keyword_hits(spark, sf):
    return docs(spark, sf).select("doc_id", T.keyword_hits("text", fv.PAGE_KEYWORDS).alias("page_hits"),
                                  T.keyword_hits("text", fv.LABEL_KEYWORDS).alias("label_hits"))


@query("trim_for_export", f"""
SELECT doc_id, CASE WHEN length(text) > 30000 THEN concat(substr(text, 1, 30000), chr(10), '...[trimmed ',
 CAST(length(text) - 30000 AS STRING), ' chars]') ELSE text END AS shown FROM documents""")
def trim_for_export(spark, sf):
    return docs(spark, sf).select("doc_id", T.trim_for_export("text").alias("shown"))


@query("safe_text", f"SELECT conv_id, turn, {S.strip('coalesce(text, ' + S.q('') + ')')} AS stripped, coalesce(text, '') AS kept, coalesce(nullif(text, ''), role, '') AS first_present FROM conversations")
def safe_text(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.safe_text("text").alias("stripped"),
        T.safe_text("text", stripped=False).alias("kept"),
        T.first_present(F.nullif("text", F.lit("")), "role").alias("first_present"))


# --- scalars over label lines --------------------------------------------------------

KEYS = ["case_id", "label_no"]
#: A text of a case with the labels that have it.
SAME = ["case_id", "labels"]
K = "case_id, label_no"
SRC = f"src AS (SELECT {K}, {derive.LABEL_TEXT} AS text FROM lab)"

_POSMAP = ", ".join(f"({S.q(w)}, {p})" for w, p in lookup.word_positions(CAT).items())
_WORDS = ", ".join(f"({p}, {r}, {S.q(w.upper())}, {len(w)})" for p, r, w in CAT.label_words)


def lines_ctes(keys: str) -> str:
    return f"""
posmap(word, pos) AS (VALUES {_POSMAP}), words(ord, rnk, word, n) AS (VALUES {_WORDS}),
lines AS (SELECT *, {S.key('x')} AS k FROM (
 SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY n) AS INT) AS line, x FROM (
  SELECT {keys}, n, {S.tidy('raw')} AS x FROM (
   SELECT {keys}, unnest(regexp_split_to_array(text, '{S.BREAKS}')) AS raw,
    generate_subscripts(regexp_split_to_array(text, '{S.BREAKS}'), 1) AS n FROM src)) WHERE x <> '')),
kp AS (SELECT {keys}, line, min(pos) AS pos FROM (
  SELECT {keys}, line, k AS part FROM lines UNION ALL
  SELECT {keys}, line, {S.strip("unnest(string_split(k, '/'))")} FROM lines WHERE contains(k, '/')) JOIN posmap ON word = part GROUP BY ALL),
p AS (SELECT lines.*, kp.pos, {S.noise('k')} AS noise FROM lines LEFT JOIN kp USING ({keys}, line)),
inl0 AS (SELECT {keys}, ord, line, rnk, coalesce(
   nullif(regexp_extract(rest, '^\\s*[:：]\\s*(.+)$', 1), ''), nullif(regexp_extract(rest, '^\\s{{2,}}(.+)$', 1), ''),
   nullif(regexp_extract(rest, '^\\s+([A-Za-z0-9][A-Za-z0-9./ _()~:-]{{0,60}})$', 1), '')) AS v
  FROM (SELECT {keys}, line, ord, rnk, substr(x, n + 1) AS rest FROM lines JOIN words ON starts_with(upper(x), word))),
inl1 AS (SELECT {keys}, ord, line, rnk, {S.candidate('v')} AS v FROM inl0 WHERE v IS NOT NULL),
inl AS (SELECT {keys}, ord, arg_min({S.cut('v')}, line * 1000 + rnk) AS v FROM inl1
  WHERE NOT {S.noise(S.key('v'))} GROUP BY ALL),
adj0 AS (SELECT a.*, b.x FROM (
  SELECT {', '.join('a.' + x.strip() for x in keys.split(','))}, a.pos AS ord, a.line, min(b.line) AS nl FROM p a JOIN p b USING ({keys})
  WHERE a.pos IS NOT NULL AND b.line > a.line AND b.line <= a.line + 5 AND (b.pos IS NOT NULL OR NOT b.noise) GROUP BY ALL) a
 JOIN p b ON {' AND '.join(f'a.{x.strip()} = b.{x.strip()}' for x in keys.split(','))} AND b.line = a.nl WHERE b.pos IS NULL),
adj AS (SELECT {keys}, ord, arg_min({S.cut('v')}, line) AS v FROM (SELECT *, {S.candidate('x')} AS v FROM adj0)
  WHERE NOT {S.noise(S.key('v'))} GROUP BY ALL)"""


def pattern_ctes(keys: str) -> str:
    parts = []
    for pos, f in enumerate(CAT.fields):
        if f.patterns:
            found = ", ".join(f"nullif(regexp_extract(j, {S.q('(?i)' + p)}, 1), '')" for p in f.patterns)
            parts.append(f"SELECT {keys}, {pos} AS ord, coalesce({found}) AS v FROM joined")
    made, brand, label, project = (CAT.position[i] for i in ("made_in", "brand", "label_name", "project_name"))
    names = " ".join(f"WHEN regexp_matches(c, {S.q('(?i)' + p)}) THEN {S.q(v)}" for p, v in fv.LABEL_NAME_RULES)
    brands = " ".join(f"WHEN regexp_matches(c, '(?i)\\b{b}\\b') THEN '{b}'" for b in fv.KNOWN_BRANDS)
    return f"""
cleaned AS (SELECT {keys}, {S.tidy('text')} AS c FROM src),
joined AS (SELECT {keys}, array_to_string([{S.tidy('x')} for x in regexp_split_to_array(c, '{S.BREAKS}') if {S.tidy('x')} <> ''], chr(10)) AS j FROM cleaned),
reg AS (SELECT {keys}, ord, {S.cut('v')} AS v FROM (SELECT {keys}, ord, {S.candidate('v')} AS v FROM (
  {' UNION ALL '.join(parts)}) WHERE v IS NOT NULL) WHERE NOT {S.noise(S.key('v'))}),
phr AS (SELECT {keys}, {made} AS ord, 'China' AS v FROM cleaned WHERE regexp_matches(c, {S.q('(?i)' + fv.MADE_IN_CHINA_PATTERN)})
 UNION ALL SELECT * FROM (SELECT {keys}, {brand}, CASE {brands} END AS v FROM cleaned) WHERE v IS NOT NULL
 UNION ALL SELECT * FROM (SELECT {keys}, {label}, CASE {names} END AS v FROM cleaned) WHERE v IS NOT NULL
 UNION ALL SELECT {keys}, {project}, {S.cut('v')} FROM (SELECT {keys}, {S.candidate("regexp_extract(c, " + S.q(fv.PROJECT_NAME_PATTERN) + ", 1)")} AS v FROM cleaned)
  WHERE NOT {S.noise(S.key('v'))}),
won AS (SELECT {keys}, ord, arg_min(v, stage) AS v FROM (
  SELECT *, 1 AS stage FROM inl UNION ALL SELECT *, 2 FROM adj UNION ALL SELECT *, 3 FROM reg
  UNION ALL SELECT *, 4 FROM phr) GROUP BY ALL),
rec AS (SELECT {keys}, ord, v FROM won UNION ALL
  SELECT {keys}, CASE ord WHEN 1 THEN 7 ELSE 1 END, min(v) FROM won WHERE ord IN (1, 7)
  GROUP BY {keys}, ord HAVING ({keys}, CASE ord WHEN 1 THEN 7 ELSE 1 END) NOT IN (SELECT ({keys}, ord) FROM won))"""


def out(cte: str, keys: str) -> str:
    return f" SELECT {keys}, field_name, v AS value FROM {cte} JOIN rules USING (ord)"


LINES = S.BASE + ", " + SRC + ", " + lines_ctes(K)
FULL = LINES + ", " + pattern_ctes(K)


def label_lines(spark, sf):
    """Lines of the distinct texts; ``of_labels`` gives those of every label."""
    return (derive.distinct_texts(spark, sf)
            .select(*SAME, F.posexplode(T.split_lines(T.nfkc("text"))).alias("i", "line"))
            .select(*SAME, (F.col("i") + 1).alias("line_no"), "line"))


def of_labels(rows):
    """What was found in distinct texts, for every label."""
    found = E.each_row(rows)
    return found.select(*KEYS, *[c for c in found.columns if c not in KEYS])


@query("normalize_label", LINES + f" SELECT {K}, line AS line_no, k AS label_key FROM lines")
def normalize_label(spark, sf):
    return of_labels(label_lines(spark, sf).withColumn("label_key", T.label_key("line")).drop("line"))


@query("find_field", LINES + f""" SELECT {K}, line AS line_no, r.field_name FROM p JOIN rules r ON r.ord = p.pos""")
def find_field(spark, sf):
    return of_labels(label_lines(spark, sf).withColumn("field_name", lookup.find_field("line", CAT))
                     .filter(F.col("field_name").isNotNull()).drop("line"))


@query("noise_flag", LINES + f" SELECT {K}, line AS line_no, noise AS is_noise FROM p")
def noise_flag(spark, sf):
    return of_labels(label_lines(spark, sf).withColumn("is_noise", lookup.is_noise("line", CAT)).drop("line"))


@query("candidate_value", LINES + f" SELECT {K}, line AS line_no, {S.cut(S.candidate('x'))} AS candidate FROM lines")
def candidate_value(spark, sf):
    return of_labels(label_lines(spark, sf)
                     .withColumn("candidate", T.cut_value(T.tidy_candidate("line"))).drop("line"))


@query("six_field_word", LINES + f""" SELECT {K}, line AS line_no, translate({S.upper('x')}, '：／', ':/') AS label_key,
 translate({S.upper('x')}, '：／', ':/') IN ({', '.join(S.q(a.upper()) for f in SIX.fields for a in f.aliases)}) AS is_field_word FROM lines""")
def six_field_word(spark, sf):
    return of_labels(label_lines(spark, sf).withColumn("label_key", T.six_field_key("line"))
                     .withColumn("is_field_word", lookup.is_six_field_word("line", SIX)).drop("line"))


@query("value_lines", LINES + f""" SELECT {K}, line AS line_no, x AS line FROM lines WHERE k NOT IN (SELECT word FROM posmap)""")
def value_lines(spark, sf):
    """Lines that are no label word: an anti join with the catalogue's words."""
    words = spark.createDataFrame([(w,) for w in lookup.word_positions(CAT)], "label_key string")
    keyed = label_lines(spark, sf).withColumn("label_key", T.label_key("line"))
    return of_labels(keyed.join(F.broadcast(words), "label_key", "left_anti").drop("label_key"))


@query("fix_digits", "SELECT p_partkey, translate(p_name, 'OoIlSB', '001158') AS fixed_name, translate(p_brand, 'OoIlSB', '001158') AS fixed_brand FROM part")
def fix_digits(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.fix_ocr_digits("p_name").alias("fixed_name"),
                                           T.fix_ocr_digits("p_brand").alias("fixed_brand"))


@query("normalize_value", S.BASE + "SELECT case_id, label_no, lf.field_name, value, norm FROM lf")
def normalize_value(spark, sf):
    src = derive.label_source(spark, sf)
    pairs = F.array(*[F.struct(F.lit(k).alias("field_name"), F.expr(v).alias("value"))
                      for k, v in derive.LABEL_FIELDS.items()])
    rows = src.select(*KEYS, F.inline(pairs))
    return lookup.normalize_value(rows, CAT)


@query("normalize_compare_value", S.BASE + "SELECT case_id, df.field_name, value, norm FROM df")
def normalize_compare_value(spark, sf):
    src = derive.drawing_source(spark, sf)
    pairs = F.array(*[F.struct(F.lit(k).alias("field_name"), F.expr(v).alias("value"))
                      for k, v in derive.DRAWING_FIELDS.items()])
    return lookup.normalize_compare_value(src.select("case_id", F.inline(pairs)), CAT)


_RULES = ", ".join(f"({i}, '{f.id}', '{f.kind}', {str(f.required).lower()}, {str(f.digit_fix).lower()})"
                   for i, f in enumerate(CAT.fields))
_ALIASES = ", ".join(f"('{f.id}', {n}, {S.q(a)})" for f in CAT.fields for n, a in enumerate(f.aliases))


@query("rule_lookup", S.BASE + f""", ruled(ord, field_name, kind, required, digit_fix) AS (VALUES {_RULES}),
names AS (SELECT case_id, label_no, lf.field_name FROM lf UNION ALL SELECT case_id, label_no, concat('label_', h) FROM lab)
SELECT case_id, label_no, n.field_name, coalesce(r.kind, 'text') AS kind, coalesce(r.required, false) AS required,
 coalesce(r.digit_fix, false) AS digit_fix FROM names n LEFT JOIN ruled r ON r.field_name = n.field_name""")
def rule_lookup(spark, sf):
    """Rules of known fields, defaults for unknown ones (here: the deviation class)."""
    names = derive.label_source(spark, sf).select(*KEYS, F.explode(F.array(
        *[F.lit(k) for k in derive.LABEL_FIELDS], F.concat(F.lit("label_"), F.col("h").cast("string"))))
        .alias("field_name"))
    return lookup.with_rule(names, CAT).drop("field_ord")


@query("alias_lookup", f"""WITH aliases(field_name, alias_no, alias) AS (VALUES {_ALIASES}),
names AS (SELECT p_partkey AS case_id, unnest(['serial_no', 'rated_voltage', p_type]) AS field_name FROM part)
SELECT case_id, n.field_name, coalesce(alias_no, 0) AS alias_no, coalesce(alias, n.field_name) AS alias
FROM names n LEFT JOIN aliases a ON a.field_name = n.field_name""")
def alias_lookup(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.explode(F.array(
        F.lit("serial_no"), F.lit("rated_voltage"), F.col("p_type"))).alias("field_name"))
    return lookup.with_aliases(names, CAT)


# --- extraction ------------------------------------------------------------------------

@query("extract_inline", LINES + out("inl", K))
def extract_inline(spark, sf):
    return of_labels(E.stage_values(derive.distinct_texts(spark, sf), SAME, E.INLINE, CAT))


@query("extract_adjacent", LINES + out("adj", K))
def extract_adjacent(spark, sf):
    return of_labels(E.stage_values(derive.distinct_texts(spark, sf), SAME, E.ADJACENT, CAT))


@query("extract_regex", FULL + out("reg", K))
def extract_regex(spark, sf):
    return of_labels(E.stage_values(derive.distinct_texts(spark, sf), SAME, E.PATTERN, CAT))


@query("extract_fallback", FULL + out("phr", K))
def extract_fallback(spark, sf):
    return of_labels(E.stage_values(derive.distinct_texts(spark, sf), SAME, E.PHRASE, CAT))


@query("extract_record", FULL + out("rec", K))
def extract_record(spark, sf):
    rows = E.extract_fields(derive.distinct_texts(spark, sf), CAT)
    return of_labels(R.to_long(rows, SAME, CAT).drop("field_ord", "norm"))


# Documents with label lines at their end; equal texts stay equal.
DOC_TEXT = ("concat(text, chr(10), 'Model: L', CAST(length(text) % 97 AS STRING), chr(10), 'S/N', chr(10), 'SN-', "
            "CAST(length(text) % 53 AS STRING), CASE WHEN length(text) % 3 = 0 THEN concat(chr(10), 'MADE IN CHINA') ELSE '' END)")
DOC_FULL = (f"WITH {S.rule_table()}, src AS (SELECT doc_id, {DOC_TEXT} AS text FROM documents), "
            + lines_ctes("doc_id") + ", " + pattern_ctes("doc_id"))


@query("extract_record_docs", DOC_FULL + out("rec", "doc_id"))
def extract_record_docs(spark, sf):
    texts = docs(spark, sf).select("doc_id", F.expr(DOC_TEXT).alias("text"))
    return R.to_long(E.extract_fields(texts, CAT), ["doc_id"], CAT).drop("field_ord", "norm")


@query("extract_distinct_docs", DOC_FULL + out("rec", "doc_id"))
def extract_distinct_docs(spark, sf):
    """The same records, each distinct text read once."""
    texts = docs(spark, sf).select("doc_id", F.expr(DOC_TEXT).alias("text"))
    return R.to_long(cases.extract_distinct(texts, "doc_id", "text", CAT), ["doc_id"], CAT).drop("field_ord", "norm")


@query("content_store", DOC_FULL + """ SELECT doc_id, count(ord) AS n_fields, coalesce(string_agg(v, ';' ORDER BY ord), '') AS field_values, known
FROM (SELECT doc_id, text IN (SELECT text FROM src WHERE doc_id % 2 = 0) AS known FROM src) LEFT JOIN rec USING (doc_id) GROUP BY ALL""")
def content_store(spark, sf):
    """Contents of half of the documents are stored by a first run; the second reads the others only."""
    texts = docs(spark, sf).select("doc_id", F.expr(DOC_TEXT).alias("text"))
    path = new_folder(spark)
    records.extract_with_store(texts.filter("doc_id % 2 = 0"), "doc_id", "text", path, CAT, "first")
    rows = records.extract_with_store(texts, "doc_id", "text", path, CAT, "second")
    return rows.select("doc_id", R.n_filled().alias("n_fields"), F.array_join("vals", ";").alias("field_values"), "known")


@query("missing_fields", FULL + f""" SELECT {K}, count(*) AS n_missing, string_agg(r.field_name, '、' ORDER BY r.ord) AS missing
FROM src CROSS JOIN rules r LEFT JOIN rec USING ({K}, ord) WHERE v IS NULL GROUP BY ALL""")
def missing_fields(spark, sf):
    """Fields of the whole catalogue that a label's text does not give."""
    rows = E.extract_fields(derive.distinct_texts(spark, sf), CAT)
    return of_labels(R.missing_fields(rows, SAME, CAT, required_only=False))


@query("summarize_fields", FULL + f" SELECT {K}, count(*) AS n_fields, string_agg(field_name, '、' ORDER BY ord) AS fields FROM rec JOIN rules USING (ord) GROUP BY ALL")
def summarize_fields(spark, sf):
    rows = E.extract_fields(derive.distinct_texts(spark, sf), CAT)
    return of_labels(rows.select(*SAME, R.n_filled().alias("n_fields"),
                                 F.array_join(R.names_of("ords", CAT), fv.LIST_SEPARATOR).alias("fields")).filter("n_fields > 0"))


_SIXMAP = ", ".join(f"({S.q(a.upper())}, {i})" for i, f in enumerate(SIX.fields) for a in f.aliases)
_SIXWORDS = ", ".join(f"({i}, {n}, {S.q(a.upper())}, {len(a)})" for i, f in enumerate(SIX.fields)
                      for n, a in enumerate(f.aliases))
_SIXNAMES = ", ".join(f"({i}, '{f.id}')" for i, f in enumerate(SIX.fields))


@query("extract_legacy6", S.BASE + f""", {SRC}, sixmap(word, pos) AS (VALUES {_SIXMAP}),
sixwords(ord, rnk, word, n) AS (VALUES {_SIXWORDS}), sixnames(ord, field_name) AS (VALUES {_SIXNAMES}),
l AS (SELECT a.*, s.pos FROM (SELECT {K}, CAST(row_number() OVER (PARTITION BY {K} ORDER BY n) AS INT) AS line, x FROM (
 SELECT {K}, n, {S.strip(f"regexp_replace(raw, '{S.SPACES}+', ' ', 'g')")} AS x FROM (
  SELECT {K}, unnest(regexp_split_to_array(text, '{S.BREAKS}')) AS raw,
   generate_subscripts(regexp_split_to_array(text, '{S.BREAKS}'), 1) AS n FROM src)) WHERE x <> '') a
 LEFT JOIN sixmap s ON s.word = {S.upper('x')}),
near AS (SELECT case_id, label_no, ord, arg_max(x, line) AS v FROM (
  SELECT a.case_id, a.label_no, a.pos AS ord, a.line, arg_min(b.x, b.line) AS x FROM l a JOIN l b
   ON b.case_id = a.case_id AND b.label_no = a.label_no AND b.line > a.line AND b.line <= a.line + 3
  WHERE a.pos IS NOT NULL AND b.pos IS NULL GROUP BY ALL) GROUP BY ALL),
same AS (SELECT {K}, ord, arg_min(v, line * 1000 + rnk) AS v FROM (
  SELECT {K}, ord, line, rnk, coalesce(nullif(regexp_extract(rest, '^\\s*[:：]\\s*(.+)$', 1), ''),
   nullif(regexp_extract(rest, '^\\s+(.+)$', 1), '')) AS v
  FROM (SELECT {K}, line, ord, rnk, substr(x, n + 1) AS rest FROM l JOIN sixwords ON starts_with(upper(x), word))) WHERE v IS NOT NULL GROUP BY ALL)
SELECT {K}, field_name, arg_min(v, stage) AS value FROM (SELECT *, 1 AS stage FROM near UNION ALL SELECT *, 2 FROM same)
JOIN sixnames USING (ord) GROUP BY ALL""")
def extract_legacy6(spark, sf):
    rows = E.extract_six_fields(derive.distinct_texts(spark, sf), SIX)
    return of_labels(R.to_long(rows, SAME, SIX).drop("field_ord", "norm"))


@query("missing_six", ORACLE["extract_legacy6"].replace("SELECT case_id, label_no, field_name, arg_min(v, stage) AS value FROM", ", six AS (SELECT case_id, label_no, field_name FROM", 1) + """)
SELECT l.case_id, l.label_no, count(*) AS n_missing, string_agg(n.field_name, '、' ORDER BY n.ord) AS missing
FROM lab l CROSS JOIN sixnames n LEFT JOIN (SELECT *, 1 AS found FROM six) s ON s.case_id = l.case_id AND s.label_no = l.label_no AND s.field_name = n.field_name
WHERE found IS NULL GROUP BY ALL""")
def missing_six(spark, sf):
    """The same for the six-field profile."""
    rows = E.extract_six_fields(derive.distinct_texts(spark, sf), SIX)
    return of_labels(R.missing_fields(rows, SAME, SIX, required_only=False))
