"""Truth rows for comparison and roll-ups."""

import pytest
from pyspark.sql import functions as F

from plumbline.catalogue import APPLIANCE as CAT
from plumbline.operators import compare as C, history as H, records as R, reports as P, rollup


def labels_of(spark, rows):
    """rows: (case, label_no, {field: value})"""
    df = spark.createDataFrame([(c, n, f"l{n}.jpg", m) for c, n, m in rows],
                               "case_id int, label_no int, label_file string, m map<string,string>")
    return R.record_from_map(df, "m", CAT).drop("m")


def drawings_of(spark, rows):
    df = spark.createDataFrame(rows, "case_id int, m map<string,string>")
    return R.record_from_map(df, "m", CAT).drop("m").withColumn("drawing_file", F.lit("d.pdf"))


def test_field_states(spark):
    drawings = drawings_of(spark, [(1, {"product_name": "a", "product_model": "M-1", "rated_voltage": "220V", "brand": ":"})])
    labels = labels_of(spark, [(1, 1, {"product_model": "m-1", "rated_voltage": "11O V", "serial_no": "5", "brand": "："})])
    rows = {r["field_name"]: r for r in C.field_comparison(
        C.compare_to_drawing(labels, drawings, CAT), ["label_no"], CAT).collect()}
    assert {k: (r["status"], r["result"], r["confidence"]) for k, r in rows.items()} == {
        "product_name": ("label_missing", "UNKNOWN", 0.0), "product_model": ("match", "PASS", 0.98),
        "rated_voltage": ("mismatch", "FAIL", 0.95), "serial_no": ("drawing_missing", "UNKNOWN", 0.0),
        "brand": ("match", "PASS", 0.98)}  # both values non-empty, both comparison forms empty
    assert rows["rated_voltage"]["label_norm"] == "110V" and rows["rated_voltage"]["required"] == "是"


def test_nothing_recognised_shows_six_fields(spark):
    compared = C.compare_to_drawing(labels_of(spark, [(1, 1, {})]), drawings_of(spark, [(1, {})]), CAT)
    r = compared.first()
    assert (r["n_pass"], r["n_fail"], r["n_unknown"], r["verdict"]) == (0, 0, 6, "REVIEW")
    assert [c["status"] for c in r["cmp"]] == ["not_applicable"] * 6


def test_label_without_drawing_is_kept(spark):
    compared = C.compare_to_drawing(labels_of(spark, [(9, 1, {"brand": "x"})]), drawings_of(spark, [(1, {})]), CAT)
    assert [(r["case_id"], r["verdict"]) for r in compared.collect()] == [(9, "REVIEW")]


@pytest.mark.parametrize("results,want", [
    (["PASS", "UNKNOWN"], "REVIEW"), (["FAIL", "UNKNOWN"], "FAIL"), (["PASS"], "PASS")])
def test_verdict(spark, results, want):
    rows = spark.createDataFrame([(1, r) for r in results], "id int, result string")
    assert rollup.verdicts(rows, ["id"]).first()["verdict"] == want


def test_baseline_comparison_and_batch_verdict(spark):
    labels = labels_of(spark, [
        (1, 1, {"brand": "A", "serial_no": "1"}), (1, 2, {"brand": "a"}), (1, 3, {"brand": "B", "serial_no": "1"}),
        (2, 1, {"brand": "A"}), (2, 2, {"brand": "A"}), (3, 1, {})])
    compared = C.compare_to_baseline(labels, CAT)
    got = {(r["case_id"], r["label_no"]): (r["n_pass"], r["n_fail"], r["n_unknown"], r["verdict"]) for r in compared.collect()}
    assert got == {(1, 1): (2, 0, 0, "PASS"), (1, 2): (1, 0, 1, "REVIEW"), (1, 3): (1, 1, 0, "FAIL"),
                   (2, 1): (1, 0, 0, "PASS"), (2, 2): (1, 0, 0, "PASS"), (3, 1): (0, 0, 6, "REVIEW")}
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case_id int")
    verdicts = {r["case_id"]: r["verdict"] for r in C.batch_verdict(compared, cases).collect()}
    assert verdicts == {1: "FAIL", 2: "PASS", 3: "REVIEW", 4: "FAIL"}
    assert C.label_comparison(compared, CAT).filter("label_no = 1").count() == 0
    other = C.compare_to_baseline(labels.filter("case_id = 1"), CAT, baseline_no=2)
    assert {r["label_no"]: r["verdict"] for r in other.collect()} == {1: "REVIEW", 2: "REVIEW", 3: "FAIL"}


def test_baseline_out_of_range(spark):
    labels = labels_of(spark, [(1, 1, {"brand": "A"}), (2, 1, {}), (2, 2, {})])
    with pytest.raises(Exception, match="baseline label out of range"):
        C.compare_to_baseline(labels, CAT, baseline_no=2).collect()
    assert C.compare_to_baseline(labels, CAT, 2, strict=False).count() == 2
    assert [r["case_id"] for r in C.baseline_violations(labels, 2).collect()] == [1]


def test_inconsistent_fields(spark):
    def case(c, values):
        return [(c, n + 1, {"brand": v} if v else {}) for n, v in enumerate(values)]
    labels = labels_of(spark, case(1, ["A", "", "B"]) + case(2, ["A", ""]) + case(3, ["A", "B"]) + case(4, ["A", "a"]))
    got = {r["case_id"]: (r["issue"], r["missing_labels"]) for r in rollup.inconsistency_report(labels, CAT).collect()}
    assert got == {1: ("missing_and_differs", "2"), 2: ("missing", "2"), 3: ("differs", "")}
    sheet = P.inconsistent_sheet(rollup.inconsistency_report(labels, CAT), spark.createDataFrame([(4,)], "case_id int"))
    assert sheet.first()["field_name"] == "未发现标签之间存在字段差异。"


def test_swapping_sides_only_renames_states(spark):
    a, b = {"brand": "x", "serial_no": "1"}, {"brand": "y", "version": "2"}
    def states(first, second):
        c = C.compare_to_drawing(labels_of(spark, [(1, 1, second)]), drawings_of(spark, [(1, first)]), CAT).first()["cmp"]
        return [x["status"] for x in c]
    swap = {"drawing_missing": "label_missing", "label_missing": "drawing_missing"}
    assert [swap.get(s, s) for s in states(a, b)] == states(b, a)


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_partitioning_does_not_matter(spark, partitions):
    labels = labels_of(spark, [(c, n, {"brand": "ABC"[n % 3], "version": str(c)} if n % 4 else {})
                               for c in range(5) for n in range(1, 9)])
    def run(df):
        rows = rollup.inconsistency_report(df, CAT).collect()
        return sorted((r["case_id"], r["field_name"], r["issue"], r["missing_labels"]) for r in rows)
    want = run(labels)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert run(labels.repartition(partitions)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_failure_reasons(spark):
    labels = (labels_of(spark, [(1, 1, {"brand": "b"})]).withColumn("confidence", F.lit(0.5))
              .withColumn("preprocess", F.lit("turned_90")).withColumn("label_warnings", F.array(F.lit("w"))))
    drawings = (drawings_of(spark, [(1, {"brand": "a"})]).withColumn("parse_mode", F.lit("ocr"))
                .withColumn("raw_text", F.lit(" ")).withColumn("drawing_warnings", F.array(F.lit("w"))))
    got = P.failure_reasons(C.compare_to_drawing(labels, drawings, CAT), CAT).first()["failure_reasons"]
    assert got == sorted({"PDF 是扫描件或关键字段需要 OCR 补充", "PDF 没有解析出文字", "w", "OCR 不确定",
                          "品牌 字段值没有标准化或真实不一致", "标签图片旋转"})


def test_localized_history(spark):
    df = spark.createDataFrame([("x", "REVIEW")], "drawing_file string, result string")
    shown = H.localize(df, {"drawing_file": "图纸文件名", "result": "总体结果"})
    assert shown.columns == ["图纸文件名", "总体结果"] and shown.first()[1] == "待人工确认"


def test_no_error_label_or_block_is_cut(spark, monkeypatch):
    from plumbline.operators import skew
    monkeypatch.setattr(skew, "BLOCK_ROWS", 2)
    rows = [(1, n, {"brand": "A"} if n == 1 else {"serial_no": str(n)}) for n in range(1, 8)] + [(2, 1, {"brand": "B"})]
    labels = labels_of(spark, rows)
    report = rollup.inconsistency_report(labels, CAT)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    sheet = P.inconsistent_sheet(report, cases).collect()
    brand = sorted((r["block_no"], r["missing_labels"]) for r in sheet if r["field_name"] == "brand")
    assert brand == [(0, "2"), (1, "3、4"), (2, "5、6"), (3, "7")]
    assert sorted((r["case_id"], r["block_no"], r["issue_type"]) for r in sheet if r["case_id"] > 1) == [(2, 0, ""), (3, 0, "")]
    values = P.label_value_columns(rollup.label_values(labels, CAT, rollup.inconsistent_fields(labels, CAT)))
    serial = {r["block_no"]: [r[f"label_{i}"] for i in range(1, 6)] for r in values.filter("field_name = 'serial_no'").collect()}
    assert serial == {0: ["", "2", "3", "4", "5"], 1: ["6", "7", None, None, None]}
    faults = labels.withColumn("error", F.concat(F.lit("e"), F.col("label_no").cast("string"))).filter("case_id = 1")
    drawings = drawings_of(spark, [(1, {}), (2, {"brand": "B"})]).withColumns(
        {"parse_mode": F.lit("text"), "page_count": F.lit(1), "error": F.lit(None).cast("string")})
    summary = P.case_summary(drawings, C.label_summary(C.compare_to_baseline(labels, CAT)), P.error_rows(drawings, faults),
                             spark.createDataFrame([(1, 0.5)], "case_id int, seconds double")).collect()
    texts = [r["errors"] for r in sorted(summary, key=lambda r: (r["case_id"], r["block_no"])) if r["case_id"] == 1]
    assert [t.count("；") + 1 for t in texts] == [1, 2, 2, 2] and "；".join(texts).count("OCR失败") == 7
    assert [(r["block_no"], r["errors"]) for r in summary if r["case_id"] == 2] == [(0, "")]
    nested = P.nested_case(C.compare_to_drawing(labels, drawings, CAT)).collect()
    assert sum(len(r["labels"]) for r in nested) == 8 and max(len(r["labels"]) for r in nested) == 2


def test_cases_without_the_baseline_label(spark):
    labels = labels_of(spark, [(1, 1, {"brand": "A"}), (1, 2, {"brand": "B"}), (2, 1, {"brand": "A"})])
    loose = C.compare_to_baseline(labels, CAT, baseline_no=2, strict=False)
    assert {r["case_id"] for r in loose.collect()} == {1}
    with pytest.raises(Exception, match="baseline label out of range"):
        C.compare_to_baseline(labels, CAT, baseline_no=2).collect()
