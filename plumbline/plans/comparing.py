"""Queries: comparison, roll-ups, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE as CAT
from plumbline.operators import compare as C, records as R, rollup
from plumbline.plans import derive, sql as S
from plumbline.plans.registry import ORACLE, query
from plumbline.session import saved


def compared(spark, sf):
    return C.compare_to_drawing(derive.labels(spark, sf), derive.drawings(spark, sf), CAT)


def horizontal(spark, sf):
    return C.compare_to_baseline(derive.labels(spark, sf), CAT)


VERDICT_COLS = ["case_id", "label_no", "n_pass", "n_fail", "n_unknown", "verdict"]


@query("case_verdict", S.BASE + f"SELECT {', '.join(VERDICT_COLS)} FROM verdict")
def case_verdict(spark, sf):
    return compared(spark, sf).select(*VERDICT_COLS)


@query("field_compare", S.BASE + f"""
SELECT case_id, label_no, cmp.field_name, dv AS drawing_value, lv AS label_value, dv AS drawing_raw,
 dn AS drawing_norm, lv AS label_raw, ln AS label_norm, status, {S.RESULT} AS result,
 {S.by_words('status', fv.SPEC_REASONS)} AS reason,
 CASE WHEN required THEN '是' ELSE '否' END AS required,
 CASE status WHEN 'match' THEN 0.98::DOUBLE WHEN 'mismatch' THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM cmp JOIN rules USING (ord)""")
def field_compare(spark, sf):
    return C.field_comparison(compared(spark, sf), ["case_id", "label_no"], CAT).drop("field_ord")


@query("compare_counts", S.BASE + f"""
SELECT case_id, count(*) FILTER (r = 'PASS') AS n_pass, count(*) FILTER (r = 'FAIL') AS n_fail,
 count(*) FILTER (r NOT IN ('PASS', 'FAIL')) AS n_unknown
FROM (SELECT case_id, {S.RESULT} AS r FROM cmp) GROUP BY 1""")
def compare_counts(spark, sf):
    rows = C.field_comparison(compared(spark, sf), ["case_id"], CAT)
    return rollup.result_counts(rows, ["case_id"])


@query("report_counts", S.BASE + f"""
SELECT case_id, label_no, count(*) FILTER (r = 'PASS') AS n_pass, count(*) FILTER (r = 'FAIL') AS n_fail,
 count(*) FILTER (r = 'UNKNOWN') AS n_unknown
FROM (SELECT case_id, label_no, {S.RESULT} AS r FROM cmp) GROUP BY 1, 2""")
def report_counts(spark, sf):
    rows = C.field_comparison(compared(spark, sf), ["case_id", "label_no"], CAT)
    return rollup.report_counts(rows, ["case_id", "label_no"])


@query("overall_verdict", S.BASE + "SELECT case_id, label_no, verdict FROM verdict")
def overall_verdict(spark, sf):
    rows = C.field_comparison(compared(spark, sf), ["case_id", "label_no"], CAT)
    return rollup.verdicts(rows, ["case_id", "label_no"])


@query("baseline_compare", S.BASE + f"""
SELECT case_id, label_no, field_name, baseline_label, bv AS baseline_value, bn AS baseline_norm,
 label_file AS target_label, tv AS target_value, tn AS target_norm, status, {S.RESULT} AS result,
 {S.by_words('status', fv.LABEL_REASONS)} AS reason
FROM hcmp WHERE label_no <> 1""")
def baseline_compare(spark, sf):
    return C.label_comparison(horizontal(spark, sf), CAT).drop("field_ord")


@query("label_summary", S.BASE + """
SELECT case_id, label_no, label_file, CASE WHEN label_no = 1 THEN '是' ELSE '否' END AS is_baseline,
 n_pass, n_fail, n_unknown, verdict FROM hsum""")
def label_summary(spark, sf):
    return C.label_summary(horizontal(spark, sf))


@query("batch_verdict", S.BASE + "SELECT case_id, verdict FROM bverdict")
def batch_verdict(spark, sf):
    return C.batch_verdict(horizontal(spark, sf), derive.cases(spark, sf))


@query("label_verdict_counts", S.BASE + """
SELECT case_id, count(*) FILTER (verdict = 'PASS') AS n_label_pass, count(*) FILTER (verdict = 'FAIL') AS n_label_fail,
 count(*) FILTER (verdict NOT IN ('PASS', 'FAIL')) AS n_label_unknown FROM verdict GROUP BY 1""")
def label_verdict_counts(spark, sf):
    return rollup.verdict_counts(compared(spark, sf))


@query("active_fields", S.BASE + "SELECT case_id, ord AS field_ord, field_name FROM active JOIN rules USING (ord)")
def active_fields(spark, sf):
    return rollup.active_fields(derive.labels(spark, sf), CAT)


@query("inconsistent_fields", S.BASE + """
SELECT case_id, field_name, issue, n_values, n_missing, n_labels FROM issue""")
def inconsistent_fields(spark, sf):
    return rollup.inconsistent_fields(derive.labels(spark, sf), CAT).drop("field_ord")


@query("inconsistency_report", S.BASE + f"""
SELECT i.case_id, i.field_name, coalesce(m.block_no, 0) AS block_no, i.issue,
 {S.by_words('i.issue', fv.ISSUE_WORDS)} AS issue_type, coalesce(m.missing_labels, '') AS missing_labels
FROM issue i LEFT JOIN (
 SELECT case_id, ord, CAST(floor((label_no - 1) / 10000) AS INT) AS block_no,
  string_agg(CAST(label_no AS STRING), '、' ORDER BY label_no) AS missing_labels
 FROM grid WHERE norm = '' GROUP BY ALL) m ON m.case_id = i.case_id AND m.ord = i.ord""")
def inconsistency_report(spark, sf):
    return rollup.inconsistency_report(derive.labels(spark, sf), CAT)


@query("inconsistent_values", S.BASE + """
SELECT g.case_id, g.label_no, g.label_file, g.field_name, g.value, g.norm = '' AS is_missing
FROM grid g JOIN issue i ON i.case_id = g.case_id AND i.ord = g.ord""")
def inconsistent_values(spark, sf):
    labels = derive.labels(spark, sf)
    return rollup.label_values(labels, CAT, rollup.inconsistent_fields(labels, CAT))


@query("batch_overview", S.BASE + """
SELECT v.case_id, v.n_label_pass, v.n_label_fail, v.n_label_unknown, v.n_labels, b.verdict,
 coalesce(i.n_inconsistent, 0) AS n_inconsistent
FROM (SELECT case_id, count(*) FILTER (verdict = 'PASS') AS n_label_pass,
  count(*) FILTER (verdict = 'FAIL') AS n_label_fail,
  count(*) FILTER (verdict NOT IN ('PASS', 'FAIL')) AS n_label_unknown, count(*) AS n_labels
 FROM verdict GROUP BY 1) v JOIN bverdict b ON b.case_id = v.case_id
LEFT JOIN (SELECT case_id, count(*) AS n_inconsistent FROM issue GROUP BY 1) i ON i.case_id = v.case_id""")
def batch_overview(spark, sf):
    labels = derive.labels(spark, sf)
    against_drawing = C.compare_to_drawing(labels, derive.drawings(spark, sf), CAT)
    return rollup.batch_overview(against_drawing, C.compare_to_baseline(labels, CAT),
                                 rollup.inconsistent_fields(labels, CAT))


@query("batch_overview_sheet", ORACLE["batch_overview"].replace("SELECT v.case_id,", """SELECT v.case_id, strftime(t.at, '%Y-%m-%d %H:%M:%S') AS detection_time,
 concat('drawing_', CAST(v.case_id AS STRING), '.pdf') AS drawing_file,""", 1) + " JOIN (SELECT case_id, max(l_shipdate) AS at FROM lab GROUP BY 1) t ON t.case_id = v.case_id")
def batch_overview_sheet(spark, sf):
    """The overview with the time of the detection and the drawing's file."""
    labels = derive.labels(spark, sf)
    against_drawing = saved(C.compare_to_drawing(labels, derive.drawings(spark, sf), CAT).select("case_id", "verdict", "l_shipdate", "drawing_file"))
    return rollup.batch_overview(against_drawing, C.compare_to_baseline(labels, CAT),
                                 rollup.inconsistent_fields(labels, CAT), "l_shipdate")


@query("field_unpivot", S.BASE + """
SELECT case_id, label_no, lf.field_name, value FROM lf WHERE value <> ''""")
def field_unpivot(spark, sf):
    return R.to_long(derive.labels(spark, sf), ["case_id", "label_no"], CAT).drop("field_ord", "norm")


@query("field_table", S.BASE + """
SELECT case_id, label_no, field_name, value, '成功' AS recognised FROM lf WHERE value <> ''
UNION ALL SELECT l.case_id, l.label_no, r.field_name, '', '未识别' FROM lab l JOIN rules r ON r.ord < 6
LEFT JOIN (SELECT case_id, label_no, count(*) AS n FROM lf WHERE value <> '' GROUP BY ALL) f ON f.case_id = l.case_id AND f.label_no = l.label_no
WHERE f.n IS NULL""")
def field_table(spark, sf):
    return R.field_table(derive.labels(spark, sf), ["case_id", "label_no"], CAT).drop("field_ord")


@query("field_table_all", S.BASE + """
SELECT d.case_id, r.field_name, coalesce(df.value, '') AS value,
 CASE WHEN coalesce(df.value, '') <> '' THEN '成功' ELSE '未识别' END AS recognised
FROM draw d CROSS JOIN rules r LEFT JOIN df ON df.case_id = d.case_id AND df.ord = r.ord""")
def field_table_all(spark, sf):
    return R.field_table(derive.drawings(spark, sf), ["case_id"], CAT, all_fields=True).drop("field_ord")


@query("missing_required", S.BASE + """
SELECT l.case_id, l.label_no, count(*) AS n_missing, string_agg(r.field_name, '、' ORDER BY r.ord) AS missing
FROM lab l CROSS JOIN rules r LEFT JOIN lf f ON f.case_id = l.case_id AND f.label_no = l.label_no AND f.ord = r.ord
WHERE r.required AND coalesce(f.value, '') = '' GROUP BY ALL""")
def missing_required(spark, sf):
    ords = R.missing_ords(CAT)
    return (derive.labels(spark, sf)
            .select("case_id", "label_no", F.size(ords).cast("long").alias("n_missing"),
                    F.array_join(R.names_of(ords, CAT), fv.LIST_SEPARATOR).alias("missing"))
            .filter("n_missing > 0"))


@query("record_from_long", S.BASE + """
SELECT case_id, label_no, count(*) AS n_fields, string_agg(lf.field_name, '、' ORDER BY ord) AS fields,
 string_agg(value, '；' ORDER BY ord) AS field_values FROM lf WHERE value <> '' GROUP BY ALL""")
def record_from_long(spark, sf):
    long = R.to_long(derive.labels(spark, sf), ["case_id", "label_no"], CAT)
    back = R.from_long(long, ["case_id", "label_no"], CAT)
    return back.select("case_id", "label_no", R.n_filled().alias("n_fields"),
                       F.array_join(R.names_of("ords", CAT), fv.LIST_SEPARATOR).alias("fields"),
                       F.array_join("vals", fv.MESSAGE_SEPARATOR).alias("field_values"))
