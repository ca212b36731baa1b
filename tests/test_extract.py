"""Truth rows for field extraction."""

import pytest
from pyspark.sql import functions as F

from plumbline.catalogue import APPLIANCE, SIX
from plumbline.operators import extract as E, records as R


def fields(spark, text, cat=APPLIANCE, six=False):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = E.extract_six_fields(df, cat) if six else E.extract_fields(df, cat)
    return rows.select(R.to_map("ords", "vals", cat).alias("m")).first()["m"]


def stage(spark, text, which):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return {r["field_name"]: r["value"] for r in E.stage_values(df, ["id"], which).collect()}


def test_inline_takes_shared_words_for_both_fields(spark):
    got = stage(spark, "MODEL NUMBER: X", E.INLINE)
    assert got == {"spec_model": "X", "product_model": "NUMBER: X"}


def test_inline_noise_falls_through_to_next_word(spark):
    assert stage(spark, "SERIAL NO: QR1\nSERIAL: A1", E.INLINE) == {"serial_no": "A1"}


def test_inline_first_line_wins(spark):
    assert stage(spark, "NAME: a\nname：b", E.INLINE) == {"product_name": "a"}


def test_inline_bilingual_word_is_not_recognised(spark):
    assert stage(spark, "产品名称 / NAME: X", E.INLINE) == {}


def test_adjacent_skips_noise(spark):
    assert stage(spark, "额定电压\n日期\n220V", E.ADJACENT) == {"rated_voltage": "220V"}


def test_adjacent_stops_at_label(spark):
    assert stage(spark, "额定功率\n额定电压\n220V", E.ADJACENT) == {"rated_voltage": "220V"}


def test_adjacent_looks_five_lines_ahead(spark):
    assert stage(spark, "NAME\n" + "日期\n" * 4 + "pump", E.ADJACENT) == {"product_name": "pump"}
    assert stage(spark, "NAME\n" + "日期\n" * 5 + "pump", E.ADJACENT) == {}


def test_pattern_stage(spark):
    got = stage(spark, "x Rated Voltage 22O V~ y", E.PATTERN)
    assert got == {"rated_voltage": "22O V~"}


def test_pattern_noise_stops_the_field(spark):
    # The first matching pattern gives a noise value: no later pattern is tried.
    assert "product_model" not in stage(spark, "x Model QR-55\n规格型号 A-77", E.PATTERN)


def test_phrases(spark):
    got = stage(spark, "Made  in  China by defy, rating label", E.PHRASE)
    assert got == {"made_in": "China", "brand": "DEFY", "label_name": "铭牌"}


def test_backfill(spark):
    got = fields(spark, "型号规格: Z9")
    assert got["product_model"] == "Z9" and got["spec_model"] == "Z9"


def test_precedence_inline_over_pattern(spark):
    got = fields(spark, "Rated Voltage: 230V\nother Rated Voltage 110V")
    assert got["rated_voltage"] == "230V"


def test_empty_and_null_text(spark):
    assert fields(spark, "") == {} and fields(spark, None) == {}


def test_long_value_is_cut(spark):
    assert fields(spark, "NAME: " + "a" * 95)["product_name"] == "a" * 90


def test_six_field_profile(spark):
    assert fields(spark, "额定功率\n额定电压\n220V", SIX, True) == {"rated_power": "220V", "rated_voltage": "220V"}
    assert fields(spark, "NAME\na\nNAME\nb", SIX, True) == {"product_name": "b"}
    assert fields(spark, "name pump 7\nname x", SIX, True) == {"product_name": "pump 7"}


def test_document_fold_equals_first_page_by_stage(spark):
    df = spark.createDataFrame(
        [(1, 1, "x Model A7"), (1, 2, "MODEL: B8"), (1, 3, "MODEL: C9"), (2, 1, "nothing")],
        "doc int, page int, text string")
    got = {r["doc"]: r["m"] for r in E.extract_document_fields(df, ["doc"], "page")
           .select("doc", R.to_map("ords", "vals", APPLIANCE).alias("m")).collect()}
    assert got[1]["product_model"] == "B8" and got[2] == {}


def test_filter_after_extraction_keeps_the_plan_small(spark):
    df = spark.createDataFrame([(1, "MODEL: x1"), (2, "nothing")], "id int, text string")
    rows = E.extract_fields(df).withColumn("n", F.size("ords")).filter("n > 0")
    assert [r["id"] for r in rows.collect()] == [1]
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 60_000


@pytest.mark.parametrize("pattern,hint", [
    (r"\bModel\s*[:：]?\s*([A-Z])", "Model"), (r"规格型号\s*(x)", "规格型号"),
    (r"(?:A|B)\D(x)", None), (r"([1-5])级", None), (r"编码\s*(x)", "编码"),
    (r"Rated\s+Frequency", "Rated"), (r"colou?r (x)", "colo")])
def test_pattern_hint(pattern, hint):
    assert E._hint(pattern) == hint


def test_line_position_equals_key_position(spark):
    values = ["MODEL", " : MODEL : ", "x" * 200, "a / MODEL", "long " * 30 + "/ MODEL", "RATED\x1fPOWER",
              "RATED" + "\u1680" * 60 + "POWER", "annual energy consumption kwh", "straße", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    from plumbline.functions import lookup, text as T
    rows = df.select("i", lookup.line_position("v", APPLIANCE).alias("a"),
                     lookup.field_position(T.label_key("v"), APPLIANCE).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert sum(r["b"] is not None for r in rows) == 7


def test_pattern_words_hold_in_matches(spark):
    """A text a pattern matches holds one of its words, so the guard loses nothing."""
    texts = {"serial_no": ["x sn: ABC1", "s/n 1234", "Serial No A-77"], "energy_class": ["2 级", "a class", "B等級"],
             "annual_energy": ["annual energy consumption 35", "kwh 1.5"], "annual_water": ["liter 12", "Annual Water Consumption: 9"],
             "part_code": ["x 10012345 y"], "label_name": ["铭牌 rating label", "能效标签 label-energy"]}
    for field, values in texts.items():
        for v in values:
            assert field in stage(spark, v, E.PATTERN), (field, v)
