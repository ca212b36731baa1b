"""Documents derived from the given tables.

Every part is a case with one drawing, every line item a photographed label of
its part. A class ``h`` computed from the line item's keys says in which way the
label deviates. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE
from plumbline.functions import text as T
from plumbline.operators import extract as E, records as R
from plumbline.operators.skew import has_large_group, number_small_groups
from plumbline.plans.registry import table, text_table
from plumbline.session import saved

LABEL_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

LABEL_CLASS = "cast((l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 12 as int)"

# Field values by deviation class (shared text: both engines read it alike).
LABEL_FIELDS = {
    "product_name": "CASE WHEN h IN (0, 9) THEN '' WHEN h = 5 THEN upper(p_name) ELSE p_name END",
    "product_model": "CASE WHEN h = 9 THEN '' WHEN h = 1 THEN concat(p_brand, '_', cast(case_id AS STRING)) "
                     "WHEN h = 5 THEN lower(concat(p_brand, ' - ', cast(case_id AS STRING))) "
                     "ELSE concat(p_brand, '-', cast(case_id AS STRING)) END",
    "rated_voltage": "CASE WHEN h = 9 THEN '' WHEN h = 2 THEN concat(replace(cast(p_size * 10 AS STRING), '0', 'O'), 'V') "
                     "WHEN h = 3 THEN concat(cast(p_size * 10 AS STRING), '.0 V') "
                     "WHEN h = 4 THEN concat(cast(p_size * 10 + 1 AS STRING), 'V') "
                     "ELSE concat(cast(p_size * 10 AS STRING), 'V') END",
    "serial_no": "CASE WHEN h IN (6, 9) THEN '' WHEN h = 10 THEN ':' "
                 "ELSE concat('SN', cast(100000 + case_id AS STRING)) END",
    "rated_capacity": "CASE WHEN h = 9 THEN '' WHEN h = 7 THEN concat(cast(p_size AS STRING), ' KGS') "
                      "WHEN h = 8 THEN concat(cast(p_size AS STRING), ' kgs') "
                      "ELSE concat(cast(p_size AS STRING), ' kg') END",
}
DRAWING_FIELDS = {
    "product_name": "CASE WHEN case_id % 50 = 7 THEN '' ELSE p_name END",
    "product_model": "CASE WHEN case_id % 50 = 7 THEN '' ELSE concat(p_brand, '-', cast(case_id AS STRING)) END",
    "rated_voltage": "CASE WHEN case_id % 50 = 7 THEN '' ELSE concat(cast(p_size * 10 AS STRING), 'V') END",
    "serial_no": "CASE WHEN case_id % 50 = 7 THEN '' ELSE concat('SN', cast(100000 + case_id AS STRING)) END",
    "rated_capacity": "CASE WHEN case_id % 50 = 7 OR p_size % 10 = 0 THEN '' "
                      "ELSE concat(cast(p_size AS STRING), ' kg') END",
}

# A rendered label: inline words, words with their value on a later line, a
# noise line between, a word not at the line start, CR LF, a tab, blank lines.
LABEL_TEXT = (
    "concat(CASE WHEN h % 2 = 0 THEN concat('NAME: ', p_name) "
    "ELSE concat('NAME', chr(10), 'QR', chr(10), p_name) END, chr(10), "
    "CASE WHEN h % 3 = 0 THEN concat('MODEL', chr(10), p_brand, '-', cast(case_id AS STRING)) "
    "WHEN h % 3 = 1 THEN concat('Model: ', p_brand, '-', cast(case_id AS STRING)) "
    "ELSE concat('x Model ', replace(p_brand, '#', ''), '-', cast(case_id AS STRING)) END, chr(10), chr(10), "
    "CASE WHEN h = 4 THEN 'RATED CAPACITY' ELSE 'Rated Voltage : ' END, "
    "cast(p_size * 10 AS STRING), 'V~', chr(13), chr(10), "
    "CASE WHEN h = 7 THEN 'Capacity about 5 kg' ELSE 'MADE IN CHINA' END, chr(10), "
    "CASE WHEN h = 8 THEN concat('POWER', chr(10), 'CODE', chr(10), '10012345') ELSE '' END, chr(10), "
    "'S/N', chr(9), 'SN', cast(100000 + case_id AS STRING))"
)
#: What a label's text needs besides its class and case.
TEXT_FROM = ("p_name", "p_brand", "p_size")
DRAWING_TEXT = (
    "concat('NAME: ', p_name, chr(10), 'MODEL', chr(10), p_brand, '-', cast(case_id AS STRING), chr(10), "
    "'Rated Voltage: ', cast(p_size * 10 AS STRING), 'V', chr(10), "
    "CASE WHEN p_size % 10 = 0 THEN '' ELSE concat('Capacity: ', cast(p_size AS STRING), ' kg') END, chr(10), "
    "'SERIAL NO ', 'SN', cast(100000 + case_id AS STRING))"
)


def large_cases(spark: SparkSession, sf_dir: str) -> bool:
    """Does a case hold more labels than a task may number?"""
    return has_large_group(table(spark, sf_dir, "lineitem"), ["l_partkey"])


def numbered_lineitem(spark: SparkSession, sf_dir: str, large: bool | None = None) -> DataFrame:
    """Line items with ``label_no`` by ship date."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", *LABEL_ORDER)
    return number_small_groups(items, ["l_partkey"], LABEL_ORDER, "label_no", 2, large).withColumn(
        "label_no", F.col("label_no").cast("int"))


def label_rows(spark: SparkSession, sf_dir: str, large: bool | None = None) -> DataFrame:
    """Numbered line items with their part; worked out anew by every use. If no case is
    ``large`` they lie by case."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("case_id"), "p_name", "p_brand", "p_size")
    items = numbered_lineitem(spark, sf_dir, large).select(
        F.col("l_partkey").alias("case_id"), "label_no",
        F.expr(LABEL_CLASS).alias("h"),
        F.expr("concat('label_', cast(l_orderkey as string), '_', cast(l_linenumber as string), '.jpg')")
        .alias("label_file"), "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_shipdate")
    return items.join(part, "case_id")


def label_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label_rows``, written once."""
    return saved(label_rows(spark, sf_dir))


def label_records(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = (), large: bool | None = None) -> DataFrame:
    """Label records with case_id, label_no, label_file, h and the columns ``more``; see ``label_rows``."""
    rows = R.record_from_columns(label_rows(spark, sf_dir, large),
                                 {k: F.expr(v) for k, v in LABEL_FIELDS.items()}, APPLIANCE)
    return rows.select("case_id", "label_no", "label_file", "h", "l_shipdate", "l_discount", *more, *R.RECORD)


def labels(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``label_records``, written once."""
    return saved(label_records(spark, sf_dir, more))


def drawing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "case_id")


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawing records with case_id, drawing_file."""
    rows = R.record_from_columns(drawing_source(spark, sf_dir),
                                 {k: F.expr(v) for k, v in DRAWING_FIELDS.items()}, APPLIANCE)
    file = F.concat(F.lit("drawing_"), F.col("case_id").cast("string"), F.lit(".pdf"))
    return rows.select("case_id", file.alias("drawing_file"), "p_size", "p_name", *R.RECORD)


# What recognition reported about each drawing and label.
PARSE_MODE = "CASE WHEN case_id % 50 = 7 THEN 'error' WHEN p_size % 10 = 0 THEN 'ocr' ELSE 'text' END"
DRAWING_ERROR = "CASE WHEN case_id % 50 = 7 THEN concat('cannot open drawing ', cast(case_id AS STRING)) END"
LABEL_CONFIDENCE = "0.6 + l_discount"
PREPROCESS = "CASE WHEN h = 3 THEN 'rotate_90' ELSE 'original' END"
LABEL_ERROR = "CASE WHEN h = 11 THEN concat('cannot decode ', label_file) END"


def drawing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.expr(PARSE_MODE)
    return (drawings(spark, sf_dir)
            .withColumn("parse_mode", mode).withColumn("error", F.expr(DRAWING_ERROR))
            .withColumn("raw_text", F.when(mode == "error", "").otherwise(F.col("p_name")))
            .withColumn("page_count", F.when(mode == "error", 0).otherwise(F.col("p_size")))
            .withColumn("drawing_warnings", F.array_compact(F.array(
                F.col("error"), F.when(mode == "ocr", fv.WARN_TOO_FEW_FIELDS)))))


def label_facts(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    low = F.col("confidence") < fv.LOW_MEAN_CONFIDENCE
    return (labels(spark, sf_dir, more)
            .withColumn("confidence", F.round(F.expr(LABEL_CONFIDENCE), 4))
            .withColumn("preprocess", F.expr(PREPROCESS)).withColumn("error", F.expr(LABEL_ERROR))
            .withColumn("label_warnings", F.array_compact(F.array(
                F.when(F.size("ords") == 0, fv.WARN_NO_FIELDS),
                F.when(low, fv.WARN_LOW_CONFIDENCE)))))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"))


def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_source(spark, sf_dir).select(
        "case_id", "label_no", F.expr(LABEL_TEXT).alias("text"))


def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, text, labels): the texts of a case's labels, each with the labels that have it."""
    return E.same_texts(label_texts(spark, sf_dir), ["case_id"], "label_no")


# Recognised lines of a label: those of its text, each with a score of its own.
LINE_SCORE = "(h * 7 + i * 3) % 100 / 100.0D"


def with_lines(df: DataFrame) -> DataFrame:
    """Adds ``label_text`` and ``lines`` to rows that have ``h``, ``case_id`` and TEXT_FROM."""
    return T.fence(df, "label_text", F.expr(LABEL_TEXT)).withColumn("lines", F.expr(
        f"transform(split(label_text, '\\n'), (x, i) -> struct(x AS text, {LINE_SCORE} AS score))"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, label_no, label_file, label_text, lines)"""
    return with_lines(label_source(spark, sf_dir)).select("case_id", "label_no", "label_file", "label_text", "lines")
