"""What shows only on larger tables, in small."""

from pyspark.sql import functions as F

import __spark_entry__
from plumbline.catalogue import APPLIANCE as CAT
from plumbline.functions import text as T
from plumbline.operators import extract as E, history as H
from plumbline.operators import records as R, reports as P, rollup, skew
from plumbline.plans import chain, derive, reporting


def test_broadcast_by_measured_size(spark):
    """A small file can hold many rows: no side is sent to the driver by the size of its file."""
    found = __spark_entry__.queries()
    for name in ("case_verdict", "detail_records"):
        plan = found[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_details_of_shared_ids(spark):
    history = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "event_id int, detection_id string")
    details = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "detection_id string, props string")
    got = H.with_details(history, details, every=True).select("event_id", F.col("detail.props").alias("p")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, None)]


def test_same_texts_once(spark):
    """Equal texts of a case are read once, in lists of bounded length, and every label comes back."""
    rows = [(k % 2, n, f"f{k}{n}", f"Model: A{n % 3}") for k in range(2) for n in range(1, 8)] + [(0, 10_001, "late", "Model: A0")]
    labels = spark.createDataFrame(rows, "case_id int, label_no int, label_file string, text string")
    same = E.same_texts(labels, ["case_id"], "label_no")
    assert same.count() == 7
    got = E.each_row(E.extract_fields(same, CAT)).select("case_id", "label_no", "label_file", "text", "vals")
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(rows)
    assert all(r["vals"][0] == r["text"][7:] for r in got.collect())


def test_lines_of_odd_texts(spark):
    """Lines tidied as a whole text are those tidied one by one."""
    texts = ["", " \t\n\x0b ", "a \xa0 \t b\r\n\r\n c\\d — e\x1f\x1fz \x85 x　y \t", "\x1ca\r\tb\x0c\xa0\xa0c  d  e\n\n\n\nf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    def each(tidied, c):
        return F.filter(F.transform(F.split(c, T.LINE_BREAK), tidied), lambda x: x != "")
    for new, tidied, c in ((T.split_lines, T.tidy, T.nfkc("t")), (T.plain_lines, T.clean_line, F.coalesce("t", F.lit("")))):
        for a, b in df.select(new(c), each(tidied, c)).collect():
            assert a == b


def test_numbering_of_usual_keys_is_one_hash_exchange(spark, monkeypatch):
    """Neither sampled nor sent through Python; the same numbers on either path, and a join by the key adds no exchange."""
    rows = spark.range(3000).select((F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 3001).alias("at"), "id")
    got = skew.number_small_groups(rows, ["k"], ["at", "id"], "n")
    joined = got.join(rows.groupBy("k").agg(F.max("id").alias("m")).hint("merge"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "MapInArrow" not in plan and plan.count("Exchange hashpartitioning") == 2
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    hot = skew.number_small_groups(rows, ["k"], ["at", "id"], "n")
    assert "Window" not in hot._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hot.collect()))


def test_value_columns_without_a_row_per_label_and_field(spark):
    """As from the long form: odd values, missing fields, a last block that is not full, a case without issues."""
    rows = [(c, n, f"f{n}", {"serial_no": "" if n % 4 == 0 else f"SN{n % 3}", "rated_voltage": "220 V", "product_name": " a  b " if n == 2 else "x"})
            for c, last in ((1, 7), (2, 5), (3, 1)) for n in range(1, last + 1)]
    labels = R.record_from_map(spark.createDataFrame(rows, "case_id bigint, label_no int, label_file string, m map<string,string>"), "m", CAT)
    issues = rollup.inconsistent_fields(labels, CAT)
    got = rollup.label_value_blocks(labels, CAT, issues)
    want = P.label_value_columns(rollup.label_values(labels, CAT, issues))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 4 + 2


def test_records_of_known_columns_and_of_long_rows(spark):
    """The same records by either way, from odd and missing values; long rows are dealt once."""
    texts = [None, "", " ", "a  b", "3.0 LITERS", "LITERX 2.50", "x5.00", "5.0.0", "１２０Ｖ", "a\\b", "KGS\t5", " -LITER-", "1O KWH/YEAR", "tab\n\n\nend ", "é.0"]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "id bigint, a string, b string")
    fields = {"product_name": F.col("a"), "rated_voltage": F.col("b")}
    want = R.record_from_map(rows.withColumn("m", F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])), "m", CAT).select("id", *R.RECORD).collect()
    assert sorted(R.record_from_columns(rows, fields, CAT).select("id", *R.RECORD).collect()) == sorted(want)
    long = rows.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), v.alias("value")) for k, v in [*fields.items(), ("unknown", F.col("a"))]])).alias("r")).select("id", "r.*")
    back = R.from_long(long, ["id"], CAT)
    assert back._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(back.collect()) == sorted(want)
    up = F.upper("a")
    for new, old in ((T.LITERS, r"(?U)\bLITERS?\b"), (T.ZERO_DECIMALS, r"(?U)(?<=\d)\.0+(?=\D|$)")):
        assert rows.where(F.regexp_replace(up, new, "L") != F.regexp_replace(up, old, "L")).count() == 0
    assert rows.where(~F.col("a").rlike(T.PLAIN) != F.col("a").rlike(r"[^ -\[\]-~]|  |^ | \z")).count() == 0


def test_run_export_makes_only_what_a_table_needs(spark, monkeypatch):
    """Labels are numbered once for a run, and not at all for its drawing table."""
    numbered = []
    keep = derive.numbered_lineitem
    monkeypatch.setattr(derive, "numbered_lineitem", lambda *a: numbered.append(1) or keep(*a))
    reporting.export_drawing_fields(spark, "/root/testdata/sf0.001")
    assert not numbered
    reporting.label_export(spark, "/root/testdata/sf0.001")
    assert len(numbered) == 1


def test_detail_records_write_nothing_aside(spark, monkeypatch):
    """Labels are dealt once, as line items, and nothing is written; cases of very many labels give the same rows."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, reporting.detail_records(spark, sf).collect()))
    with monkeypatch.context() as no_files:
        for module in (derive, reporting, skew):
            no_files.setattr(module, "saved", None)
        plan = reporting.detail_records(spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(exchanged) == 4 and sum("l_partkey" in line for line in exchanged) == 1  # the others: parts, drawings
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    assert sorted(map(str, reporting.detail_records(spark, sf).collect())) == want


def test_texts_are_compared_once_where_they_lie(spark, monkeypatch):
    """Equal texts of a case are compared once and nothing is written; cases of very many labels give the same rows."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    want = sorted(map(str, chain.text_case_verdict(spark, sf).collect()))
    with monkeypatch.context() as no_files:
        for module in (derive, chain, skew):
            no_files.setattr(module, "saved", None)
        once = chain.compared_texts(spark, sf)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert len(want) == labels and once.count() < labels and plan.count("Exchange hashpartitioning") == 4
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    assert sorted(map(str, chain.text_case_verdict(spark, sf).collect())) == want
