"""Truth rows for text functions and look-ups."""

import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.catalogue import APPLIANCE, SIX
from plumbline.functions import lookup, text as T


def run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_clean_text(spark):
    got = run(spark, ["　ＭＯＤＥＬ：Ａ－１＼ｘ　", "a\n\n\n\nb", None, "a\t \r b", "x—y–z", "plain text", " lead", "two  blanks"],
              T.clean_text)
    assert got == ["MODEL:A-1/x", "a\n\nb", "", "a b", "x-y-z", "plain text", "lead", "two blanks"]


def test_clean_text_long_plain_text(spark):
    text = "word " * 50_000
    assert run(spark, [text], T.clean_text) == [text.strip()]


def test_nfkc_matches_unicode(spark):
    values = ["ﬁ①㎏ é", "ｶﾞ", "２２０Ｖ", "x²", "Å", "…"]
    assert run(spark, values, T.nfkc) == [unicodedata.normalize("NFKC", v) for v in values]


def test_clean_text_idempotent(spark):
    values = ["  A：B ／ C ", "x\r\n\r\n\r\ny", "～—\\", " q　"]
    once = run(spark, values, T.clean_text)
    assert run(spark, once, T.clean_text) == once


def test_label_key(spark):
    assert run(spark, ["产品型号 / Model :", " serial   no: ", ":", "a /b"], lambda c: T.label_key(T.clean_text(c))) == [
        "产品型号/MODEL", "SERIAL NO", "", "A/B"]


@pytest.mark.parametrize("field,value,want", [
    ("rated_voltage", "22O.0 V", "220V"), ("version", "V1.0", "V1.0"),
    ("rated_capacity", "7 KGS", "7KG5"), ("rated_capacity", "7 kgs", "7KG"),
    ("wash_ratio", "1.00", "1"), ("product_model", " a - 1 ", "A-1"), ("annual_energy", "5 kwh/year", "5KWH"),
    ("unknown", "S 1.0:", "S1.0"), ("annual_water", "5 Liter", "5L"), ("annual_water", "5 LITERS", "5L1TER5"), ("rated_voltage", None, ""),
])
def test_normalize_value(spark, field, value, want):
    df = spark.createDataFrame([(field, value)], "field_name string, value string")
    assert lookup.normalize_value(df, APPLIANCE).first()["norm"] == want


def test_find_field(spark):
    got = run(spark, ["产品型号 / MODEL", "MODEL", "model no", "S/N", "洗涤 / 脱水容量", "x / POWER", "nothing", ""],
              lambda c: lookup.find_field(T.clean_text(c), APPLIANCE))
    assert got == ["product_model", "product_model", "product_model", "serial_no", "wash_spin_capacity",
                   "rated_power", None, None]


def test_noise(spark):
    got = run(spark, ["QRS-100", "cmyk 4", "比例 1:2", "MODEL", "", " : ", "A-100"],
              lambda c: lookup.is_noise(T.clean_text(c), APPLIANCE))
    assert got == [True, True, True, True, True, True, False]


def test_split_lines(spark):
    got = run(spark, ["a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\n\n  \ni"], lambda c: T.split_lines(T.nfkc(c)))
    assert got == [list("abcdefghi")]


def test_candidate_and_cut(spark):
    assert run(spark, [": 220V |", "：a   b|", "||"], T.tidy_candidate) == ["220V", "a b", ""]
    long = "x" * 89 + " y"
    assert run(spark, [long, "z" * 95], T.cut_value) == ["x" * 89, "z" * 90]


def test_paths(spark):
    got = run(spark, ["c/a.PDF", ".bashrc", "x/y.tar.gz", "z."], T.file_suffix)
    assert got == [".pdf", "", ".gz", ""]
    assert run(spark, ["c/a.PDF", ".bashrc", "x/y.tar.gz"], T.file_stem) == ["a", ".bashrc", "y.tar"]
    assert run(spark, ["/r/c/a", "q/a"], lambda c: T.relative_path(c, "/r")) == ["c/a", "q/a"]


def test_export_and_flags(spark):
    assert run(spark, ["abcdef", "abc", None], lambda c: T.trim_for_export(c, 3)) == [
        "abc\n...[trimmed 3 chars]", "abc", ""]
    assert run(spark, ["x", "", None], T.recognised) == ["成功", "未识别", "未识别"]
    assert run(spark, ["0.12345"], lambda c: T.percent(c.cast("double"))) == ["12.35%"]


TIES = [2.675, 0.5, 1.5, 2.5, 0.125, 0.375, 0.03125, 1.00005, -2.675, -0.00001, 0.0, 5e-324, 1e300, 2.0 ** 52 / 100,
        2.0 ** 53 / 100, 90071992547409.9, 45035996273704.985]


def test_round_exact_special_values(spark):
    df = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(T.round_exact("x", 4)).collect()]
    assert got[:3] == [None, float("inf"), float("-inf")] and got[3] != got[3]
    with pytest.raises(ValueError):
        T.round_exact("x", 9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e13, 1e13), st.floats(-2, 2), st.integers(-10 ** 9, 10 ** 9).map(lambda n: n / 64),
                          st.integers(-10 ** 9, 10 ** 9).map(lambda n: n / 10 ** 5 * 0.5)), min_size=1, max_size=200))
def test_round_exact_is_rounding_of_the_binary_value(spark, values):
    values = values + TIES
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i")
    for digits in (0, 2, 4, 8):
        got = [r[0] for r in df.select(T.round_exact("x", digits)).collect()]
        assert list(map(repr, got)) == [repr(float(round(v, digits))) for v in values]
    small = [v for v in values if abs(v) < 1e11]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(small)], "i int, x double").orderBy("i")
    assert [r[0] for r in df.select(T.percent_exact("x")).collect()] == [f"{v:.2%}" for v in small]


def test_six_field_words(spark):
    assert run(spark, ["产品名称 ／ NAME", "name", "SERIAL"], lambda c: lookup.is_six_field_word(c, SIX)) == [True, True, False]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \t\n\\/：／—　oOIl.", max_size=30), min_size=1, max_size=20))
def test_clean_text_property(spark, values):
    once = run(spark, values, T.clean_text)
    assert run(spark, once, T.clean_text) == once
    assert all(v == v.strip() and "\\" not in v for v in once)


def test_catalogue_shape():
    assert len(APPLIANCE) == 28 and sum(f.required for f in APPLIANCE.fields) == 16
    assert sum(f.digit_fix for f in APPLIANCE.fields) == 17
    assert sum(len(f.aliases) for f in APPLIANCE.fields) == 93
    assert sum(len(f.patterns) for f in APPLIANCE.fields) == 30
