"""Comparison: specification against label, label against baseline label.

Labels are rows ``(case_id, label_no, label_file)`` with a record (see records)
and ``label_no`` dense from 1 within the case; drawings ``(case_id)`` with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import Catalogue
from plumbline.functions import lookup, text as T
from plumbline.operators import records as R
from plumbline.operators.skew import by_label_block, spread_over_blocks


def field_status(first, second, first_norm, second_norm,
                 first_missing: str, second_missing: str) -> Column:
    """State of one field: emptiness by cleaned value, equality by comparison form."""
    return (F.when((first == "") & (second == ""), "not_applicable")
             .when(first == "", first_missing)
             .when(second == "", second_missing)
             .when(first_norm == second_norm, "match")
             .otherwise("mismatch"))


def status_result(status) -> Column:
    status = T.col(status)
    return F.when(status == "match", "PASS").when(status == "mismatch", "FAIL").otherwise("UNKNOWN")


def status_confidence(status) -> Column:
    status = T.col(status)
    return (F.when(status == "match", fv.MATCH_CONFIDENCE)
             .when(status == "mismatch", fv.MISMATCH_CONFIDENCE).otherwise(0.0))


def verdict_of(n_fail, n_unknown) -> Column:
    return (F.when(T.col(n_fail) > 0, "FAIL")
             .when(T.col(n_unknown) > 0, "REVIEW").otherwise("PASS"))


def severity(verdict) -> Column:
    verdict = T.col(verdict)
    return F.when(verdict == "FAIL", 2).when(verdict == "PASS", 0).otherwise(1)


def verdict_of_severity(level) -> Column:
    level = T.col(level)
    return F.when(level == 2, "FAIL").when(level == 1, "REVIEW").when(level == 0, "PASS")


def _statuses(ords, a: str, b: str, a_missing: str, b_missing: str) -> Column:
    """(field_ord, a, b, a_norm, b_norm, status) of two records at the given positions.

    ``a`` and ``b`` are the column prefixes of the two records.
    """
    def pair(o):
        return F.struct(o.alias("field_ord"),
                        R.value_at(f"{a}ords", f"{a}vals", o).alias("a"),
                        R.value_at(f"{b}ords", f"{b}vals", o).alias("b"),
                        R.value_at(f"{a}ords", f"{a}norms", o).alias("a_norm"),
                        R.value_at(f"{b}ords", f"{b}norms", o).alias("b_norm"))
    return F.transform(F.transform(ords, pair), lambda p: F.struct(
        p["field_ord"].alias("field_ord"), p["a"].alias("a"), p["b"].alias("b"),
        p["a_norm"].alias("a_norm"), p["b_norm"].alias("b_norm"),
        field_status(p["a"], p["b"], p["a_norm"], p["b_norm"], a_missing, b_missing)
        .alias("status")))


def _count(rows, *statuses) -> Column:
    return F.size(F.filter(T.col(rows), lambda r: r["status"].isin(*statuses))).cast("long")


def with_counts(df: DataFrame, rows: str = "cmp") -> DataFrame:
    """n_pass / n_fail / n_unknown and the verdict of a nested comparison."""
    return (df.withColumn("n_pass", _count(rows, "match"))
              .withColumn("n_fail", _count(rows, "mismatch"))
              .withColumn("n_unknown", F.size(rows) - F.col("n_pass") - F.col("n_fail"))
              .withColumn("verdict", verdict_of("n_fail", "n_unknown")))


def compare_records(df: DataFrame, cat: Catalogue, drawing: str = "drawing_", label: str = "",
                    out: str = "cmp") -> DataFrame:
    """Compare the two records of each row: fields filled on either side, else the defaults."""
    used = F.array_sort(F.array_union(f"{drawing}ords", f"{label}ords"))
    ords = T.let(used, lambda u: R.shown_ords(u, cat))
    return T.fence(df, out, _statuses(ords, drawing, label, "drawing_missing", "label_missing"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    for c in R.RECORD:
        df = df.withColumnRenamed(c, prefix + c)
    return df


def join_drawing(labels: DataFrame, drawings: DataFrame, blocks: bool = True) -> DataFrame:
    """Every label with its case's drawing; a case without one gets the empty record.

    The drawing is repeated per block of label numbers, so a case holding a large
    share of all labels is met by many tasks. Without ``blocks`` (no case holds more
    labels than a block) labels are read once and need no exchange if they lie by case.
    """
    if blocks:
        extent = labels.groupBy("case_id").agg(F.max("label_no").alias("_last"))
        spread = spread_over_blocks(
            prefixed(drawings, "drawing_").join(extent, "case_id"), "_last").drop("_last")
        met = (labels.withColumn("_block", by_label_block("label_no"))
               .join(spread, ["case_id", "_block"], "left").drop("_block"))
    else:
        met = labels.join(prefixed(drawings, "drawing_"), "case_id", "left")
    return (met.withColumn("drawing_ords", F.coalesce("drawing_ords", R.no_ords()))
            .withColumn("drawing_vals", F.coalesce("drawing_vals", R.no_strings()))
            .withColumn("drawing_norms", F.coalesce("drawing_norms", R.no_strings())))


def compare_to_drawing(labels: DataFrame, drawings: DataFrame, cat: Catalogue, blocks: bool = True) -> DataFrame:
    """One row per label: nested comparison ``cmp``, counts and verdict."""
    return with_counts(compare_records(join_drawing(labels, drawings, blocks), cat))


def field_comparison(compared: DataFrame, keys: list[str], cat: Catalogue) -> DataFrame:
    """Field rows of a drawing comparison, with every reported column."""
    c = F.col("_c")
    status = c["status"]
    required = F.array(*[F.lit(f.required) for f in cat.fields])
    return (compared.select(*keys, F.explode("cmp").alias("_c"))
            .select(*keys, c["field_ord"].alias("field_ord"),
                    lookup.field_name_at(c["field_ord"], cat).alias("field_name"),
                    c["a"].alias("drawing_value"), c["b"].alias("label_value"),
                    c["a"].alias("drawing_raw"), c["a_norm"].alias("drawing_norm"),
                    c["b"].alias("label_raw"), c["b_norm"].alias("label_norm"),
                    status.alias("status"), status_result(status).alias("result"),
                    T.words(status, fv.SPEC_REASONS).alias("reason"),
                    T.yes_no(F.get(required, c["field_ord"])).alias("required"),
                    status_confidence(status).alias("confidence")))


# --- label against baseline label ----------------------------------------------

def case_context(labels: DataFrame, cat: Catalogue, *more: Column) -> DataFrame:
    """Per case: label count, last label number, fields filled by any label, and what
    the ``more`` aggregates say."""
    return labels.groupBy("case_id").agg(
        F.count("*").alias("n_labels"), F.max("label_no").alias("last_label_no"),
        R.any_filled(cat).alias("_words"), *more
    ).withColumn("active", R.active_ords("_words", cat)).drop("_words")


def with_case_context(labels: DataFrame, context: DataFrame) -> DataFrame:
    spread = spread_over_blocks(context, "last_label_no")
    return (labels.withColumn("_block", by_label_block("label_no"))
            .join(spread, ["case_id", "_block"]).drop("_block"))


def compare_to_baseline(labels: DataFrame, cat: Catalogue, baseline_no: int = 1,
                        strict: bool = True) -> DataFrame:
    """One row per label: comparison to the case's baseline over the active fields.

    The baseline's own row compares it to itself, which yields exactly its
    summary: filled active fields PASS, missing ones UNKNOWN. ``strict`` fails on
    a case without that label; otherwise such cases drop out here and are listed
    by ``baseline_violations``.
    """
    own = F.max(F.when(F.col("label_no") == baseline_no, F.struct("label_file", *R.RECORD)))
    context = case_context(labels, cat, own.alias("_own"))
    context = context.select("*", F.col("_own.label_file").alias("baseline_file"),
                             *[F.col(f"_own.{c}").alias(f"baseline_{c}") for c in R.RECORD])
    if not strict:
        context = context.filter(F.col("_own").isNotNull())
    context = context.drop("_own")
    if strict:
        context = context.withColumn("baseline_vals", F.when(
            F.col("baseline_vals").isNull(),
            F.raise_error(F.concat(F.lit("baseline label out of range for case "),
                                   F.col("case_id").cast("string"))).cast("array<string>"))
            .otherwise(F.col("baseline_vals")))
    joined = with_case_context(labels, context)
    compared = T.fence(joined, "cmp", _statuses(
        F.col("active"), "baseline_", "", "baseline_missing", "target_missing"))
    return with_counts(compared.withColumn("is_baseline", F.col("label_no") == baseline_no))


def baseline_violations(labels: DataFrame, baseline_no: int) -> DataFrame:
    """Cases that have no label with the baseline number."""
    per_case = labels.groupBy("case_id").agg(
        F.max(F.when(F.col("label_no") == baseline_no, 1).otherwise(0)).alias("found"),
        F.count("*").alias("n_labels"))
    return per_case.filter(F.col("found") == 0).select("case_id", "n_labels")


def label_comparison(compared: DataFrame, cat: Catalogue) -> DataFrame:
    """Field rows of every non-baseline label."""
    c = F.col("_c")
    return (compared.filter(~F.col("is_baseline"))
            .select("case_id", "label_no", "baseline_file", "label_file",
                    F.explode("cmp").alias("_c"))
            .select("case_id", "label_no", c["field_ord"].alias("field_ord"),
                    lookup.field_name_at(c["field_ord"], cat).alias("field_name"),
                    F.col("baseline_file").alias("baseline_label"),
                    c["a"].alias("baseline_value"), c["a_norm"].alias("baseline_norm"),
                    F.col("label_file").alias("target_label"),
                    c["b"].alias("target_value"), c["b_norm"].alias("target_norm"),
                    c["status"].alias("status"), status_result(c["status"]).alias("result"),
                    T.words(c["status"], fv.LABEL_REASONS).alias("reason")))


def label_summary(compared: DataFrame) -> DataFrame:
    return compared.select("case_id", "label_no", "label_file",
                           T.yes_no("is_baseline").alias("is_baseline"),
                           "n_pass", "n_fail", "n_unknown", "verdict")


def batch_verdict(summary: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Worst verdict per case; a case without labels FAILs."""
    worst = summary.groupBy("case_id").agg(F.max(severity("verdict")).alias("_s"))
    out = worst.select("case_id", verdict_of_severity("_s").alias("verdict"))
    if cases is None:
        return out
    return (cases.select("case_id").join(out, "case_id", "left")
                 .withColumn("verdict", F.coalesce("verdict", F.lit("FAIL"))))
