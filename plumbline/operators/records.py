"""Field records.

A record holds one document's filled fields as three parallel arrays in catalogue
order: ``ords`` (field positions), ``vals`` (cleaned values, never '') and
``norms`` (comparison forms, which may be ''). They are made once per document,
before any join, so a comparison is row-local work on short arrays and a shuffled
record costs only what it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import Catalogue
from plumbline.functions import lookup, text as T


RECORD = ["ords", "vals", "norms"]


def ids_array(cat: Catalogue) -> Column:
    return F.array(*[F.lit(i) for i in cat.ids])


def no_strings() -> Column:
    return F.array().cast("array<string>")


def no_ords() -> Column:
    return F.array().cast("array<int>")


def norm_at(value, position, cat: Catalogue) -> Column:
    """Comparison form of a value by the rule of its field."""
    fix = F.array(*[F.lit(f.digit_fix) for f in cat.fields])
    numeric = F.array(*[F.lit(f.numeric) for f in cat.fields])
    return T.normal_form(value, F.get(fix, position), F.get(numeric, position))


def with_record(df: DataFrame, values, cat: Catalogue, cleaned: bool = False,
                positions: list[int] | None = None) -> DataFrame:
    """Add a record from an array of (maybe empty) values, one per catalogue field
    or per given position (rising)."""
    places = F.array(*[F.lit(p) for p in (positions or range(len(cat)))])

    def value(v):
        return v if cleaned else F.when(F.coalesce(v, F.lit("")) != "", T.clean_text(v)).otherwise("")

    def filled(every):
        return F.struct(
            F.filter(places, lambda p, i: F.get(every, i) != "").alias("ords"),
            F.filter(every, lambda v: v != "").alias("vals"))

    # Bound step by step: a column used inside a lambda would be copied into it.
    all_values = F.transform(T.col(values), value)
    out = T.fence(df, "_record", T.let(all_values, filled))
    out = out.withColumn("ords", F.col("_record.ords")).withColumn("vals", F.col("_record.vals"))
    norms = T.let(F.col("_record"), lambda r: F.transform(
        r["vals"], lambda v, i: norm_at(v, F.get(r["ords"], i), cat)))
    return T.fence(out, "norms", norms).drop("_record")


def record_from_map(df: DataFrame, fields: str, cat: Catalogue) -> DataFrame:
    """Record of a MAP<field id, value>."""
    return with_record(df, F.transform(ids_array(cat), lambda i: F.try_element_at(F.col(fields), i)), cat)


def record_from_columns(df: DataFrame, columns: dict[str, Column], cat: Catalogue) -> DataFrame:
    """Record of one column per named field. The fields are known beforehand, so each has an
    expression of its own and nothing is done by lambdas, value by value."""
    positions = sorted(cat.position[name] for name in columns)
    at = {p: f"f{p}" for p in positions}

    def each(of) -> Column:
        return F.struct(*[of(p).alias(name) for p, name in at.items()])

    def kept(of) -> Column:  # of the filled fields
        return F.array_compact(F.array(*[F.when(F.col("_clean")[at[p]] != "", of(p)) for p in positions]))

    out = T.fence(df, "_raw", each(lambda p: F.coalesce(columns[cat.ids[p]].cast("string"), F.lit(""))))
    out = T.fence(out, "_clean", each(lambda p: T.clean_text(F.col("_raw")[at[p]]))).drop("_raw")
    out = T.fence(out, "_norm", each(lambda p: T.normal_form(
        F.col("_clean")[at[p]], cat.fields[p].digit_fix, cat.fields[p].numeric)))
    out = T.fence(out, "ords", kept(F.lit))
    out = T.fence(out, "vals", F.array_remove(F.array(*[F.col("_clean")[at[p]] for p in positions]), ""))
    return T.fence(out, "norms", kept(lambda p: F.col("_norm")[at[p]])).drop("_clean", "_norm")


def value_at(ords, values, position) -> Column:
    """Value of a field in parallel arrays, '' where absent."""
    return F.coalesce(F.get(T.col(values), F.array_position(T.col(ords), position).cast("int") - 1),
                      F.lit(""))


def names_of(ords, cat: Catalogue) -> Column:
    ids = ids_array(cat)
    return F.transform(T.col(ords), lambda o: F.get(ids, o))


def to_map(ords, vals, cat: Catalogue) -> Column:
    """Filled fields as MAP<field id, value>."""
    return F.map_from_arrays(names_of(ords, cat), T.col(vals))


def n_filled() -> Column:
    return F.size("ords").cast("long")


def missing_ords(cat: Catalogue, required_only: bool = True) -> Column:
    """Positions of the unfilled (required) fields in catalogue order."""
    wanted = F.array(*[F.lit(i) for i, f in enumerate(cat.fields) if f.required or not required_only])
    return F.filter(wanted, lambda o: ~F.array_contains("ords", o))


def missing_fields(df: DataFrame, keys: list[str], cat: Catalogue, required_only: bool = True) -> DataFrame:
    """(keys, n_missing, missing): names of the unfilled fields, of all or the required ones, of
    every record that lacks any."""
    return (df.select(*keys, missing_ords(cat, required_only).alias("_m")).filter(F.size("_m") > 0)
            .select(*keys, F.size("_m").cast("long").alias("n_missing"),
                    F.array_join(names_of("_m", cat), fv.LIST_SEPARATOR).alias("missing")))


def to_long(df: DataFrame, keys: list[str], cat: Catalogue) -> DataFrame:
    """One row per filled field."""
    rows = F.arrays_zip("ords", "vals", "norms")
    return (df.select(*keys, F.explode(rows).alias("_r"))
              .select(*keys, F.col("_r.ords").alias("field_ord"),
                      lookup.field_name_at("_r.ords", cat).alias("field_name"),
                      F.col("_r.vals").alias("value"), F.col("_r.norms").alias("norm")))


def from_long(df: DataFrame, keys: list[str], cat: Catalogue) -> DataFrame:
    """Record per key of (field_name, value) rows; repeated fields keep the smallest value."""
    places = F.create_map(*[x for i, name in enumerate(cat.ids) for x in (F.lit(name), F.lit(i))])
    # dealt by the keys once, for both groupings; the smallest value is found row by row
    one = df.repartition(*keys).groupBy(*keys, "field_name").agg(F.min("value").alias("value"))
    one = T.fence(one.withColumn("_ord", F.try_element_at(places, F.col("field_name"))), "_value", T.clean_text("value"))
    one = T.fence(one, "_norm", F.when(F.col("_value") != "", norm_at("_value", F.col("_ord"), cat)))
    field = F.struct(F.col("_ord").alias("ord"), F.col("_value").alias("val"), F.col("_norm").alias("norm"))
    filled = F.when(F.col("_ord").isNotNull() & (F.col("_value") != ""), field)
    held = one.groupBy(*keys).agg(F.sort_array(F.collect_list(filled)).alias("_f"))
    return held.select(*keys, *[F.col("_f")[c].alias(c + "s") for c in ("ord", "val", "norm")])


def shown_ords(ords, cat: Catalogue) -> Column:
    """The given positions, or the default ones if there are none."""
    ords = T.col(ords)
    return F.when(F.size(ords) > 0, ords).otherwise(
        F.array(*[F.lit(i) for i in range(min(cat.default_count, len(cat)))]))


def field_table(df: DataFrame, keys: list[str], cat: Catalogue, all_fields: bool = False) -> DataFrame:
    """(field, value, recognised) rows: filled fields, else the default ones."""
    every = F.sequence(F.lit(0), F.lit(len(cat) - 1))
    shown = every if all_fields else shown_ords("ords", cat)
    return (df.select(*keys, "ords", "vals", F.explode(shown).alias("field_ord"))
              .withColumn("value", value_at("ords", "vals", F.col("field_ord")))
              .withColumn("field_name", lookup.field_name_at("field_ord", cat))
              .withColumn("recognised", T.recognised("value"))
              .drop("ords", "vals"))


# --- which fields does any record of a group fill? -----------------------------
# One bit per field, in as many BIGINT words as the catalogue needs, so the group
# aggregate is a plain bit_or over fixed-width buffers.

WORD_BITS = 62


def fill_words(cat: Catalogue) -> list[Column]:
    words = []
    for start in range(0, len(cat), WORD_BITS):
        here = F.filter("ords", lambda o: (o >= start) & (o < start + WORD_BITS))
        words.append(F.aggregate(here, F.lit(0).cast("long"), lambda w, o: w.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), o - start))))
    return words


def any_filled(cat: Catalogue) -> Column:
    """Aggregate: array of words saying which fields some record of the group fills."""
    return F.array(*[F.bit_or(w) for w in fill_words(cat)])


def active_ords(words, cat: Catalogue) -> Column:
    """Positions set in the words; with none set, the default ones."""
    words = T.col(words)
    return T.let(F.filter(F.sequence(F.lit(0), F.lit(len(cat) - 1)), lambda i: F.bit_get(
        F.get(words, F.floor(i / WORD_BITS).cast("int")), i % WORD_BITS) == 1),
        lambda found: shown_ords(found, cat))
