"""Report tables: per label, per case, and the flat export of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import Catalogue
from plumbline.functions import lookup, text as T
from plumbline.operators import compare as C, records as R
from plumbline.operators import skew
from plumbline.operators.skew import ordered_concat

LABEL_KEYS = ["case_id", "label_no"]


# --- per label ---------------------------------------------------------------------

def report_header(compared: DataFrame, detected_at: str) -> DataFrame:
    at = F.col(detected_at)
    word = T.words("verdict", fv.VERDICT_WORDS)
    return compared.select(
        *LABEL_KEYS, T.detection_id(at, micros=False).alias("detection_id"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("detection_time"),
        "drawing_file", "label_file", word.alias("result"), "n_pass", "n_fail", "n_unknown",
        T.report_name(at, word).alias("report_name"))


def report_detail(compared: DataFrame, cat: Catalogue) -> DataFrame:
    """Five of the comparison columns."""
    return C.field_comparison(compared, LABEL_KEYS, cat).select(
        *LABEL_KEYS, "field_name", "drawing_value", "label_value", "result", "reason")


def report_lines(lines: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Recognised lines; a score that is no number counts as 0."""
    numeric = F.coalesce(F.expr(f"try_cast({score} as double)"), F.lit(0.0))
    return lines.select(*keys, "seq", "text", numeric.alias("score"),
                        (numeric < fv.LOW_LINE_CONFIDENCE).alias("is_low"))


def report_text(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, T.safe_text("drawing_text").alias("drawing_text"),
                        T.safe_text("label_text").alias("label_text"))


def non_pass(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("result") != "PASS")


def non_pass_message(cat: Catalogue) -> Column:
    display = F.create_map(*[F.lit(x) for f in cat.fields for x in (f.id, f.display)])
    return F.format_string(fv.NON_PASS_FORMAT, F.try_element_at(display, F.col("field_name")),
                           "drawing_value", "label_value", "reason")


# --- per case ------------------------------------------------------------------------

def drawing_sheet(compared: DataFrame, cat: Catalogue) -> DataFrame:
    """Seven columns: every label against the drawing."""
    return C.field_comparison(compared, [*LABEL_KEYS, "label_file"], cat).select(
        *LABEL_KEYS, "label_file", "field_name", "drawing_value", "label_value", "result", "reason")


def horizontal_sheet(horizontal: DataFrame, cat: Catalogue) -> DataFrame:
    """Eight columns: every label against the baseline."""
    return C.label_comparison(horizontal, cat).select(
        *LABEL_KEYS, "field_name", "baseline_label", "baseline_value", "target_label",
        "target_value", "result", "reason")


def ocr_sheet(labels: DataFrame, lines: str = "lines") -> DataFrame:
    """Recognised lines of all labels of a case, in the labels' order, numbered from 1 within
    each: (case_id, label_no, label_file, seq, text, score). Labels without lines have no row."""
    return (labels.select(*LABEL_KEYS, "label_file", F.posexplode(lines).alias("_i", "_l"))
            .select(*LABEL_KEYS, T.safe_text("label_file", stripped=False).alias("label_file"), (F.col("_i") + 1).alias("seq"),
                    F.coalesce("_l.text", F.lit("")).alias("text"), F.col("_l.score").alias("score")))


def field_matrix(labels: DataFrame, cat: Catalogue, fields: list[str] | None = None) -> DataFrame:
    """Row per label, column per field: NULL where the case does not use the field.

    Fields sit in the row, so the matrix needs no pivot and no shuffle beyond the
    case context.
    """
    context = C.case_context(labels, cat).select("case_id", "last_label_no", "active")
    joined = C.with_case_context(labels, context)
    cells = [F.when(F.array_contains("active", cat.position[f]),
                    R.value_at("ords", "vals", F.lit(cat.position[f]))).alias(f)
             for f in (fields or cat.ids)]
    return joined.select(*LABEL_KEYS, "label_file", *cells)


def pivot_fields(long: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The same matrix from long (field_name, value) rows."""
    return long.groupBy(*keys).pivot("field_name", fields).agg(F.first("value"))


def inconsistent_sheet(issues: DataFrame, cases: DataFrame) -> DataFrame:
    """Issue rows; a case without any gets one row saying so. A field whose missing labels
    fill several blocks has one row per block."""
    rows = cases.select("case_id").join(issues, "case_id", "left")
    return rows.select("case_id", F.coalesce("field_name", F.lit(fv.NO_DIFFERENCE_TEXT)).alias("field_name"),
                       F.coalesce("block_no", F.lit(0)).alias("block_no"),
                       *[F.coalesce(c, F.lit("")).alias(c) for c in ("issue_type", "missing_labels")])


def label_value_columns(values: DataFrame, n: int = fv.MAX_LABELS_PER_CASE) -> DataFrame:
    """Values of all labels in columns label_1..label_n (the sheet's width): labels
    1..n in block 0, the next ``n`` in block 1, and so on."""
    at = F.col("label_no") - 1
    cells = [F.max(F.when(F.pmod(at, F.lit(n)) == i, F.col("value"))).alias(f"label_{i + 1}")
             for i in range(n)]
    block = F.floor(at / F.lit(n)).cast("int")
    return values.groupBy("case_id", "field_name", block.alias("block_no")).agg(*cells)


def union_rows(*parts: DataFrame) -> DataFrame:
    """Union of differently shaped rows: columns in first-seen order, blanks for gaps."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill("")


def enrich_summary(summary: DataFrame, label_facts: DataFrame) -> DataFrame:
    """Add preprocess, confidence and joined warnings by label number."""
    facts = label_facts.select(*LABEL_KEYS, "preprocess", "confidence",
                               F.array_join("warnings", fv.MESSAGE_SEPARATOR).alias("warnings"))
    return summary.join(facts, LABEL_KEYS, "left")


# --- failure reasons and errors --------------------------------------------------------

def failure_reasons(compared: DataFrame, cat: Catalogue) -> DataFrame:
    """Sorted distinct reasons of every label, joined.

    Needs parse_mode, raw_text, drawing_warnings, confidence, label_warnings,
    label_file and preprocess beside the comparison; all row-local.
    """
    display = F.array(*[F.lit(f.display) for f in cat.fields])
    by_status = F.transform("cmp", lambda c: F.concat(
        F.get(display, c["field_ord"]), F.coalesce(*[
            F.when(c["status"] == s, t) for s, t in fv.REASON_BY_STATUS.items()])))
    rotated = (T.file_suffix("label_file").isin(fv.ROTATABLE_SUFFIXES)
               & F.col("preprocess").contains(fv.ROTATION_MARK))
    single = F.array(
        F.when(F.col("parse_mode") == "ocr", fv.REASON_SCANNED),
        F.when(T.strip(F.coalesce("raw_text", F.lit(""))) == "", fv.REASON_NO_TEXT),
        F.when(F.size("drawing_ords") == 0, fv.REASON_DRAWING_UNMATCHED),
        F.when(F.size("ords") == 0, fv.REASON_LABEL_UNMATCHED),
        F.when(F.col("confidence") < fv.LOW_MEAN_CONFIDENCE, fv.REASON_UNSURE),
        F.when(rotated, fv.REASON_ROTATED))
    every = F.concat(single, F.col("drawing_warnings"), F.col("label_warnings"), by_status)
    kept = F.filter(every, lambda r: r.isNotNull() & (r != ""))
    return compared.withColumn("failure_reasons", F.array_sort(F.array_distinct(kept)))


def empty_on_error(df: DataFrame, error: str, cat: Catalogue) -> DataFrame:
    """A failed document keeps its row: empty record, no text, its message as warning."""
    failed = F.col(error).isNotNull()
    blanks = {"ords": R.no_ords(), "vals": R.no_strings(), "norms": R.no_strings(),
              "raw_text": F.lit(""), "parse_mode": F.lit("error"), "confidence": F.lit(0.0),
              "preprocess": F.lit("error"), "page_count": F.lit(0)}
    for c, blank in blanks.items():
        if c in df.columns:
            df = df.withColumn(c, F.when(failed, blank).otherwise(F.col(c)))
    warned = F.when(failed, F.array(F.col(error))).otherwise(
        F.col("warnings") if "warnings" in df.columns else R.no_strings())
    return df.withColumn("warnings", warned)


def error_rows(drawings: DataFrame, labels: DataFrame) -> DataFrame:
    """Errors of a case in order: the drawing's first, then the labels'."""
    first = drawings.filter(F.col("error").isNotNull()).select(
        "case_id", F.lit(0).alias("label_no"), F.concat(F.lit(fv.ERROR_DRAWING), "error").alias("error"))
    rest = labels.filter(F.col("error").isNotNull()).select(
        "case_id", "label_no", F.concat("label_file", F.lit(fv.ERROR_LABEL), "error").alias("error"))
    return first.unionByName(rest)


def case_errors(errors: DataFrame) -> DataFrame:
    """Joined error text per case (very long lists in blocks)."""
    return ordered_concat(errors.withColumn("_at", F.col("label_no") + 1), ["case_id"], "_at", "error",
                          fv.MESSAGE_SEPARATOR, "errors")


def case_summary(drawings: DataFrame, summary: DataFrame, errors: DataFrame, seconds: DataFrame) -> DataFrame:
    """Per case: parse mode, pages, fields, labels, batch verdict, errors, seconds.

    A case whose errors fill several blocks has one row per block, so none is cut.
    """
    n_labels = summary.groupBy("case_id").agg(F.count("*").alias("n_labels"))
    all_errors = case_errors(errors)
    return (drawings.select("case_id", "drawing_file", "parse_mode", "page_count",
                            R.n_filled().alias("n_drawing_fields"))
            .join(n_labels, "case_id", "left").join(C.batch_verdict(summary), "case_id", "left")
            .join(all_errors, "case_id", "left").join(seconds, "case_id", "left")
            .withColumn("block_no", F.coalesce("block_no", F.lit(0)))
            .withColumn("n_labels", F.coalesce("n_labels", F.lit(0).cast("long")))
            .withColumn("batch_verdict", F.coalesce("verdict", F.lit("FAIL"))).drop("verdict")
            .withColumn("errors", F.coalesce("errors", F.lit(""))))


def input_violations(cases: DataFrame, labels: DataFrame, baseline_no: int = 1,
                     cap: int = fv.MAX_LABELS_PER_CASE) -> DataFrame:
    """One row per broken input rule: no drawing, no label, too many labels, no baseline."""
    counts = labels.groupBy("case_id").agg(
        F.count("*").alias("n_labels"),
        F.max(F.when(F.col("label_no") == baseline_no, 1).otherwise(0)).alias("_base"))
    joined = cases.join(counts, "case_id", "left").withColumn(
        "n_labels", F.coalesce("n_labels", F.lit(0).cast("long")))
    broken = F.array_compact(F.array(
        F.when(~F.col("has_drawing"), "missing_drawing"),
        F.when(F.col("n_labels") == 0, "missing_labels"),
        F.when(F.col("n_labels") > cap, "too_many_labels"),
        F.when((F.col("n_labels") > 0) & (F.col("_base") == 0), "baseline_out_of_range")))
    return joined.select("case_id", "n_labels", F.explode(broken).alias("violation"))


def drawing_fields(drawings: DataFrame, cat: Catalogue) -> DataFrame:
    return R.to_long(drawings, ["case_id", "drawing_file"], cat).select("case_id", "drawing_file", "field_name", "value")


def export_tables(drawings: DataFrame, compared: DataFrame, horizontal: DataFrame,
                  case_rows: DataFrame, cat: Catalogue) -> dict[str, DataFrame]:
    """The five flat tables of a run."""
    return {
        "case_summary": case_rows,
        "drawing_fields": drawing_fields(drawings, cat),
        "label_ocr": compared.select(
            *LABEL_KEYS, "label_file", "preprocess", "confidence", F.col("verdict").alias("result"),
            F.array_join("failure_reasons", fv.MESSAGE_SEPARATOR).alias("failure_reasons"),
            T.trim_for_export("label_text").alias("raw_text")),
        "comparisons": C.field_comparison(compared, [*LABEL_KEYS, "label_file"], cat).drop("field_ord"),
        "horizontal": C.label_comparison(horizontal, cat).drop("field_ord"),
    }


def nested_case(compared: DataFrame, block_rows: int | None = None, more: list[str] | None = None) -> DataFrame:
    """Case results as nested documents: labels with their comparison rows and the columns
    ``more``, in blocks of at most ``block_rows`` labels."""
    block = F.floor((F.col("label_no") - 1) / F.lit(block_rows or skew.BLOCK_ROWS)).cast("int")
    label = F.struct("label_no", "label_file", "verdict", "cmp", *(more or []))
    return compared.groupBy("case_id", block.alias("block_no")).agg(
        F.sort_array(F.collect_list(label)).alias("labels"))


def nested_run(compared: DataFrame, summary: DataFrame, more: list[str] | None = None) -> DataFrame:
    """The full result of a run as nested documents: each case's summary row with its labels,
    their comparison rows and the columns ``more``; a case without labels has one block
    without any. ``summary`` has one row per case and block of errors."""
    blocks = nested_case(compared, more=more)
    head = F.struct(*[c for c in summary.columns if c not in ("case_id", "block_no")])
    return (summary.select("case_id", "block_no", head.alias("summary")).join(blocks, ["case_id", "block_no"], "full")
            .withColumn("labels", F.coalesce("labels", F.array().cast(blocks.schema["labels"].dataType))))
