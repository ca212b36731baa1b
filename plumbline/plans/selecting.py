"""Queries: choosing among candidate texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE as CAT
from plumbline.operators import candidates as X, extract as E, records as R, rollup
from plumbline.plans import derive, sql as S
from plumbline.plans.extracting import lines_ctes, pattern_ctes
from plumbline.plans.registry import query, table, text_table

# Four texts per document: as is; upper case, for some with a model; with more
# lines, for others with two fields; one word per line.
MODES = [
    ("normal", "text"),
    ("sorted", "concat(upper(replace(text, 'ß', 'SS')), CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), 'MODEL: B2') ELSE '' END)"),
    ("blocks", "concat(text, CASE WHEN doc_id % 3 = 1 THEN concat(chr(10), 'Model: A1', chr(10), 'NAME: pump') ELSE '' END)"),
    ("words", "replace(text, ' ', chr(10))"),
]
_MODE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS mode_ord, '{m}' AS mode, {x} AS text FROM documents" for i, (m, x) in enumerate(MODES))
_PAGES = f"""WITH {S.rule_table()}, modes AS ({_MODE_SQL}), src AS (SELECT doc_id, mode_ord, text FROM modes), """
_SCORED = (_PAGES + lines_ctes("doc_id, mode_ord") + ", " + pattern_ctes("doc_id, mode_ord") + f""",
scored AS (SELECT m.doc_id, m.mode_ord, m.mode, m.text, coalesce(n, 0) AS n_fields, coalesce(names, '') AS names,
 {S.hits('text', fv.PAGE_KEYWORDS)} AS kw, length(text) AS len
 FROM modes m LEFT JOIN (SELECT doc_id, mode_ord, count(*) AS n, string_agg(field_name, '、' ORDER BY ord) AS names
  FROM rec JOIN rules USING (ord) GROUP BY ALL) r ON r.doc_id = m.doc_id AND r.mode_ord = m.mode_ord)""")


def pages(spark, sf):
    texts = F.array(*[F.struct(F.lit(m).alias("mode"), F.expr(x).alias("text")) for m, x in MODES])
    return text_table(spark, sf, "documents", "doc_id").select("doc_id", texts.alias("texts"))


@query("page_best_text", _SCORED + """
SELECT doc_id, mode, md5(text) AS text_md5, n_fields, CAST(kw AS INT) AS n_keywords, CAST(len AS INT) AS n_chars FROM scored
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_fields DESC, kw DESC, len DESC, mode_ord) = 1""")
def page_best_text(spark, sf):
    best = X.best_page_text(pages(spark, sf), ["doc_id"], CAT)
    return best.withColumn("text_md5", F.md5("text")).drop("text")


@query("page_longest_text", _PAGES.rstrip(", ") + """
SELECT doc_id, mode, md5(text) AS text_md5 FROM modes
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, mode_ord) = 1""")
def page_longest_text(spark, sf):
    return (X.longest_page_text(pages(spark, sf), ["doc_id"])
            .withColumn("text_md5", F.md5("text")).drop("text"))


@query("mode_ranking", _SCORED + """
SELECT doc_id, mode, n_fields, names AS fields, len AS n_chars, CAST(row_number() OVER (
 PARTITION BY doc_id ORDER BY n_fields DESC, len DESC, mode_ord) AS INT) AS rank FROM scored""")
def mode_ranking(spark, sf):
    return X.rank_modes(pages(spark, sf), ["doc_id"], CAT)


@query("page_concat", """
SELECT conv_id, CAST(floor(turn / 10000) AS INT) AS block_no, string_agg(concat('===== 第 ', CAST(turn + 1 AS STRING), ' 页 =====', chr(10), text),
 concat(chr(10), chr(10)) ORDER BY turn) AS text FROM conversations GROUP BY ALL""")
def page_concat(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("page_no"), "text")
    return X.concat_pages(turns, ["conv_id"], "page_no")


_CONV = (f"WITH {S.rule_table()}, src AS (SELECT conv_id, turn, concat(role, ': ', text, chr(10), "
         "CASE WHEN turn % 2 = 0 THEN concat('Model: M', CAST(turn AS STRING)) ELSE concat('S/N', chr(10), 'SN-', CAST(turn AS STRING)) END) AS text "
         "FROM conversations), ")


@query("document_fields", _CONV + lines_ctes("conv_id, turn") + ", " + pattern_ctes("conv_id, turn") + f""",
staged AS (SELECT *, 1 AS stage, 0 AS pick FROM inl UNION ALL SELECT *, 2, 0 FROM adj UNION ALL SELECT *, 3, 0 FROM reg UNION ALL SELECT *, 4, 0 FROM phr),
doc AS (SELECT conv_id, ord, arg_min(v, stage * 1000000 + turn) AS v FROM staged GROUP BY ALL),
twin AS (SELECT * FROM doc UNION ALL SELECT conv_id, CASE ord WHEN 1 THEN 7 ELSE 1 END, min(v) FROM doc WHERE ord IN (1, 7)
 GROUP BY conv_id, ord HAVING (conv_id, CASE ord WHEN 1 THEN 7 ELSE 1 END) NOT IN (SELECT (conv_id, ord) FROM doc))
SELECT conv_id, field_name, v AS value FROM twin JOIN rules USING (ord)""")
def document_fields(spark, sf):
    """Conversations as documents, turns as pages: one record per document."""
    text = F.expr("concat(role, ': ', text, chr(10), CASE WHEN turn % 2 = 0 THEN concat('Model: M', cast(turn AS STRING)) "
                  "ELSE concat('S/N', chr(10), 'SN-', cast(turn AS STRING)) END)")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))
    return R.to_long(E.extract_document_fields(turns, ["conv_id"], "turn", CAT), ["conv_id"], CAT).drop("field_ord", "norm")


_ENDS = ("CASE WHEN turn % 2 = 0 THEN concat('Model: M', CAST(turn AS STRING)) WHEN turn % 4 = 1 THEN concat('x', chr(10), 'S/N') "
         "ELSE concat('S/N', chr(10), 'SN-', CAST(turn AS STRING)) END")


@query("document_fields_headed", f"""WITH {S.rule_table()}, src AS (SELECT conv_id, string_agg(concat('===== 第 ', CAST(turn + 1 AS STRING), ' 页 =====', chr(10),
 text, chr(10), {_ENDS}), concat(chr(10), chr(10)) ORDER BY turn) AS text FROM conversations GROUP BY ALL), """
       + lines_ctes("conv_id") + ", " + pattern_ctes("conv_id") + " SELECT conv_id, field_name, v AS value FROM rec JOIN rules USING (ord)")
def document_fields_headed(spark, sf):
    """Page by page, the record of the joined text: some pages end with a label word."""
    turns = table(spark, sf, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("page_no"), F.expr(f"concat(text, chr(10), {_ENDS})").alias("text"))
    record = E.extract_document_fields(turns, ["conv_id"], "page_no", CAT, headers=True)
    return R.to_long(record, ["conv_id"], CAT).drop("field_ord", "norm")


# --- one drawing per part: text layer against recognised text ---------------------------

_DIRECT = (f"CASE case_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('NAME: ', p_name) "
           f"WHEN 2 THEN concat('NAME: ', p_name, chr(10), repeat(concat('drawn in ', p_type, ' '), 12)) ELSE {derive.DRAWING_TEXT} END")
_OCR = f"CASE WHEN case_id % 3 = 0 THEN concat('NAME ', p_name) ELSE {derive.DRAWING_TEXT} END"
_BOTH = "SELECT case_id, 0 AS kind, " + _DIRECT + " AS text FROM draw UNION ALL SELECT case_id, 1, " + _OCR + " FROM draw"
_N = ("nf AS (SELECT s.case_id, s.kind, s.text, count(r.ord) AS n FROM src s LEFT JOIN rec r "
      "ON r.case_id = s.case_id AND r.kind = s.kind GROUP BY ALL)")
_DRAW = (f"WITH {S.rule_table()}, draw AS (SELECT p_partkey AS case_id, * FROM part), src AS ({_BOTH}), "
         + lines_ctes("case_id, kind") + ", " + pattern_ctes("case_id, kind") + ", " + _N)


def drawing_choice(spark, sf):
    both = derive.drawing_source(spark, sf).select(
        "case_id", F.expr(_DIRECT).alias("direct_text"), F.expr(_OCR).alias("ocr_text"))
    return X.choose_drawing_text(both, CAT)


@query("ocr_fallback", _DRAW + f""",
d AS (SELECT d.case_id, d.text AS dt, o.text AS ot, d.n AS nd, o.n AS no, length({S.strip('d.text')}) < 80 AS short,
  length({S.strip('d.text')}) < 80 OR d.n < 4 AS needs FROM nf d JOIN nf o ON o.case_id = d.case_id AND o.kind = 1 AND d.kind = 0)
SELECT case_id, CASE WHEN needs AND no >= nd THEN ot ELSE dt END AS raw_text,
 CASE WHEN needs AND no >= nd THEN 'ocr' ELSE 'text' END AS parse_mode,
 CASE WHEN NOT needs THEN '' WHEN short THEN {S.q(fv.WARN_TEXT_TOO_SHORT)} ELSE {S.q(fv.WARN_TOO_FEW_FIELDS)} END AS warnings FROM d""")
def ocr_fallback(spark, sf):
    return drawing_choice(spark, sf).select(
        "case_id", "raw_text", "parse_mode",
        F.array_join("warnings", fv.MESSAGE_SEPARATOR).alias("warnings"))


@query("drawing_record", _DRAW + f""",
d AS (SELECT d.case_id, CASE WHEN (length({S.strip('d.text')}) < 80 OR d.n < 4) AND o.n >= d.n THEN 1 ELSE 0 END AS kind
 FROM nf d JOIN nf o ON o.case_id = d.case_id AND o.kind = 1 AND d.kind = 0)
SELECT case_id, field_name, v AS value FROM d JOIN rec USING (case_id, kind) JOIN rules USING (ord)""")
def drawing_record(spark, sf):
    """The record of whichever text was chosen."""
    return R.to_long(drawing_choice(spark, sf), ["case_id"], CAT).drop("field_ord", "norm")


# --- three recognitions of one label per part ---------------------------------------------

_CAND = [derive.DRAWING_TEXT.replace("'NAME: '", "CASE WHEN case_id % 2 = 0 THEN 'NAME; ' ELSE 'NAME: ' END").replace(
            "'SERIAL NO '", "CASE WHEN case_id % 2 = 0 THEN 'SERIES' ELSE 'SERIAL NO ' END"),
         f"upper({derive.DRAWING_TEXT})",
         f"concat({derive.DRAWING_TEXT}, chr(10), ' ', chr(10), 'FREQUENCY: 50Hz')"]
_SCORE = "CAST((case_id * 31 + ln * 17 + cand * 41) % 100 AS DOUBLE) / 100"


def candidates(spark, sf):
    def lines(cand, text):
        return F.transform(F.split(F.expr(text), "\n"), lambda x, i: F.struct(
            (i + 1).alias("line_no"), x.alias("text"),
            (F.pmod(F.col("case_id") * 31 + (i + 1) * 17 + cand * 41, F.lit(100)).cast("double") / 100).alias("score")))
    rows = F.array(*[F.struct(F.lit(c).alias("candidate_no"), F.lit(f"variant_{c}").alias("candidate_name"),
                              lines(c, t).alias("lines")) for c, t in enumerate(_CAND)])
    return derive.drawing_source(spark, sf).select("case_id", F.inline(rows))


_CTEXT = " UNION ALL ".join(f"SELECT case_id, {c} AS cand, {t} AS text FROM draw" for c, t in enumerate(_CAND))
_KEPT = f"""WITH {S.rule_table()}, draw AS (SELECT p_partkey AS case_id, * FROM part), ctext AS ({_CTEXT}),
kept AS (SELECT case_id, cand, ln, x, score FROM (SELECT case_id, cand, ln, {S.strip('raw')} AS x, {_SCORE} AS score FROM (
 SELECT case_id, cand, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM ctext))
 WHERE x <> '' AND score >= 0.30),
stat AS (SELECT c.case_id, c.cand, coalesce(string_agg(x, chr(10) ORDER BY ln), '') AS raw_text, coalesce(avg(score), 0.0) AS confidence,
 count(x) AS n_lines FROM ctext c LEFT JOIN kept k ON k.case_id = c.case_id AND k.cand = c.cand GROUP BY ALL)"""
_CSCORE = (_KEPT + ", src AS (SELECT case_id, cand, raw_text AS text FROM stat), " + lines_ctes("case_id, cand") + ", "
           + pattern_ctes("case_id, cand") + f""",
sc AS (SELECT s.*, n AS n_fields, n * 20 + ({S.hits('raw_text', fv.LABEL_KEYWORDS)}) * 4 + confidence * 10 + least(length(raw_text), 2000) / 1000 AS score
 FROM (SELECT s.case_id, s.cand, s.raw_text, s.confidence, count(r.ord) AS n FROM stat s LEFT JOIN rec r ON r.case_id = s.case_id AND r.cand = s.cand GROUP BY ALL) s),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY (cand = 0 AND n_fields >= 4) DESC, score DESC, cand) = 1)""")


@query("ocr_filter_stats", _KEPT + """
SELECT case_id, cand AS candidate_no, raw_text, round(confidence, 4) AS confidence, n_lines FROM stat""")
def ocr_filter_stats(spark, sf):
    return X.with_line_stats(candidates(spark, sf)).select(
        "case_id", "candidate_no", "raw_text", F.round("confidence", 4).alias("confidence"),
        F.size("kept").cast("long").alias("n_lines"))


@query("ocr_lines", _KEPT + """
SELECT case_id, cand AS candidate_no, concat('variant_', cand) AS preprocess,
 CAST(row_number() OVER (PARTITION BY case_id, cand ORDER BY ln) AS INT) AS seq, x AS text, round(score, 4) AS score FROM kept""")
def ocr_lines(spark, sf):
    rows = X.ocr_rows(X.with_line_stats(candidates(spark, sf)), ["case_id", "candidate_no"], "candidate_name")
    own = rows.withColumn("preprocess", F.lit(None).cast("string"))
    return X.default_provenance(own, "preprocess", "candidate_name").drop("candidate_name")


@query("candidate_score", _CSCORE + " SELECT case_id, cand AS candidate_no, n_fields, round(score, 6) AS score FROM sc")
def candidate_score(spark, sf):
    return X.score_candidates(candidates(spark, sf), CAT).select(
        "case_id", "candidate_no", "n_fields", F.round("score", 6).alias("score"))


def chosen(spark, sf):
    scored = X.score_candidates(candidates(spark, sf), CAT)
    return X.best_candidate(scored.drop("lines"), ["case_id"])


@query("best_candidate", _CSCORE + """
SELECT case_id, cand AS candidate_no, raw_text, n_fields, round(confidence, 4) AS confidence, round(score, 4) AS score FROM best""")
def best_candidate(spark, sf):
    return chosen(spark, sf).select(
        "case_id", "candidate_no", "raw_text", "n_fields",
        F.round("confidence", 4).alias("confidence"), F.round("score", 4).alias("score"))


@query("quality_warnings", _CSCORE + f"""
SELECT case_id, concat_ws('；', CASE WHEN n_fields = 0 THEN {S.q(fv.WARN_NO_FIELDS)} END,
 CASE WHEN round(confidence, 4) < 0.65 THEN {S.q(fv.WARN_LOW_CONFIDENCE)} END) AS warnings FROM best""")
def quality_warnings(spark, sf):
    return chosen(spark, sf).select("case_id", F.array_join("warnings", fv.MESSAGE_SEPARATOR).alias("warnings"))


@query("reextract_empty", _CSCORE + " SELECT case_id, field_name, v AS value FROM best JOIN rec USING (case_id, cand) JOIN rules USING (ord)")
def reextract_empty(spark, sf):
    """Records emptied for odd cases come back from the text."""
    best = chosen(spark, sf)
    for c, none in (("ords", R.no_ords()), ("vals", R.no_strings()), ("norms", R.no_strings())):
        best = best.withColumn(c, F.when(F.col("case_id") % 2 == 1, none).otherwise(F.col(c)))
    return R.to_long(X.reextract_empty(best, CAT), ["case_id"], CAT).drop("field_ord", "norm")


@query("page_confidence", """
SELECT l_orderkey AS doc_id, round(avg(m), 4) AS confidence, count(*) AS n_pages FROM (
 SELECT l_orderkey, l_linenumber, coalesce(list_avg(list_filter([l_quantity / 53, l_discount * 9.713177, l_tax * 4.397753], lambda s: s >= 0.25)), 0.0) AS m
 FROM lineitem) GROUP BY 1""")
def page_confidence(spark, sf):
    """Line items as pages of their order, with three lines each; some pages keep none."""
    scores = [F.col("l_quantity") / 53, F.col("l_discount") * 9.713177, F.col("l_tax") * 4.397753]
    lines = F.array(*[F.struct(F.lit(i + 1).alias("line_no"), F.lit("line").alias("text"), s.cast("double").alias("score"))
                      for i, s in enumerate(scores)])
    pages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), lines.alias("lines"))
    return X.page_confidence(pages, ["doc_id"])


@query("low_confidence", """
SELECT l_orderkey AS doc_id, round(avg(l_quantity / 50), 6) AS mean_score, count(*) FILTER (l_quantity / 50 < 0.8) AS n_low
FROM lineitem GROUP BY 1""")
def low_confidence(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") / 50).alias("score"))
    return rollup.confidence_stats(lines, ["doc_id"]).withColumn("mean_score", F.round("mean_score", 6))


@query("percent_format", """
SELECT l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n, printf('%.2f%%', round(avg(l_quantity) / 50 * 100, 2)) AS mean_percent,
 round(avg(l_quantity) / 50, 4) AS mean_score FROM lineitem GROUP BY 1""")
def percent_format(spark, sf):
    from plumbline.functions import text as T
    mean = (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"))
            .agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m")))
    return mean.select("doc_id", "n", T.percent(F.col("m") / 50).alias("mean_percent"),
                       F.round(F.col("m") / 50, 4).alias("mean_score"))


@query("percent_exact", """
SELECT l_orderkey AS doc_id, format('{:.2f}%', avg(l_quantity) / 50 * 100) AS mean_percent,
 CAST(format('{:.4f}', avg(l_quantity) / 50) AS DOUBLE) AS mean_score,
 CAST(format('{:.4f}', avg(l_quantity) / 32) AS DOUBLE) AS mean_of_32 FROM lineitem GROUP BY 1""")
def percent_exact(spark, sf):
    from plumbline.functions import text as T
    mean = (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.avg("l_quantity").alias("m")))
    return mean.select("doc_id", T.percent_exact(F.col("m") / 50).alias("mean_percent"),
                       T.round_exact(F.col("m") / 50, 4).alias("mean_score"),
                       T.round_exact(F.col("m") / 32, 4).alias("mean_of_32"))
