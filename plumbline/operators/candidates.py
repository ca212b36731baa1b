"""Choosing among several recognised texts of one document.

A page row carries its competing texts as ``texts ARRAY<STRUCT<mode,text>>`` and a
candidate row its recognised lines as ``lines ARRAY<STRUCT<line_no,text,score>>``,
as upstream recognisers emit them: filtering, renumbering, joining and averaging
are then row-local, and only the choice itself groups rows, by a key under which
the candidates are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import APPLIANCE, Catalogue
from plumbline.functions import text as T
from plumbline.operators import extract as E, records as R
from plumbline.operators.skew import ordered_concat


def _scored_texts(cat: Catalogue) -> Column:
    """Every text of a page with what its choice goes by, inside the row: the four texts
    of a page never leave it, so choosing one needs no shuffle."""
    def score(t, i):
        return T.let(E.ords_of_hits(E.hits_in_row(t["text"], cat), cat), lambda ords: F.struct(
            F.size(ords).cast("long").alias("n_fields"), T.keyword_hits(t["text"], fv.PAGE_KEYWORDS).alias("n_keywords"),
            F.length(t["text"]).alias("n_chars"), (-i).alias("first"), t["mode"].alias("mode"), t["text"].alias("text"), ords.alias("ords")))
    return F.transform("texts", score)


def best_page_text(pages: DataFrame, keys: list[str], cat: Catalogue = APPLIANCE) -> DataFrame:
    """Per page the text with most fields, then key words, then length; first mode on ties.
    Keys name a page; a page without texts gives no row."""
    best = F.array_max(_scored_texts(cat))
    return (T.fence(pages.filter(F.size("texts") > 0), "_b", best)
            .select(*keys, "_b.mode", "_b.text", "_b.n_fields", "_b.n_keywords", "_b.n_chars"))


def longest_page_text(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per page the longest text, first mode on ties; never leaves the row."""
    ranked = F.transform("texts", lambda t, i: F.struct(
        F.length(t["text"]).alias("n"), (-i).alias("first"), t["mode"].alias("mode"),
        t["text"].alias("text")))
    return (pages.select(*keys, F.array_max(ranked).alias("_b"))
            .select(*keys, "_b.mode", "_b.text"))


def concat_pages(pages: DataFrame, keys: list[str], page_no: str, ocr: bool = False) -> DataFrame:
    """Pages of a document in order under header lines (very long documents in blocks)."""
    before, after = fv.OCR_PAGE_HEADER if ocr else fv.PAGE_HEADER
    headed = pages.withColumn("_page_text", F.concat(
        F.lit(before), F.col(page_no).cast("string"), F.lit(after), F.col("text")))
    return ordered_concat(headed, keys, page_no, "_page_text", fv.PAGE_SEPARATOR, "text")


def rank_modes(pages: DataFrame, keys: list[str], cat: Catalogue = APPLIANCE) -> DataFrame:
    """How each mode did: fields found, their names, length; best first. Ranked in the row."""
    shown = F.transform(_scored_texts(cat), lambda t: F.struct(
        t["n_fields"].alias("n_fields"), t["n_chars"].alias("n_chars"), t["first"].alias("first"), t["mode"].alias("mode"),
        R.names_of(t["ords"], cat).alias("names")))
    ranked = T.fence(pages.filter(F.size("texts") > 0), "_r", F.sort_array(shown, asc=False))
    return (ranked.select(*keys, F.posexplode("_r").alias("_i", "_t"))
            .select(*keys, "_t.mode", "_t.n_fields", F.array_join("_t.names", fv.LIST_SEPARATOR).alias("fields"),
                    F.col("_t.n_chars").cast("long").alias("n_chars"), (F.col("_i") + 1).alias("rank")))


def choose_drawing_text(df: DataFrame, cat: Catalogue = APPLIANCE) -> DataFrame:
    """Text layer or recognised text: (direct_text, ocr_text) -> raw_text, parse_mode, warnings
    and the record of the chosen text, which need not be extracted again.

    Recognised text is looked at only where the text layer is short or poor in
    fields, and taken if it yields at least as many fields. An ``ocr_error``
    column, if there, keeps the text layer and adds its message.
    """
    direct = (E.extract_fields(df, cat, "direct_text").withColumn("n_direct", R.n_filled())
              .withColumn("_direct", F.struct(*R.RECORD)).drop(*R.RECORD))
    short = F.length(T.strip("direct_text")) < fv.MIN_DIRECT_TEXT_CHARS
    needs = short | (F.col("n_direct") < fv.ENOUGH_FIELDS)
    direct = direct.withColumn("_needs", needs).withColumn(
        "_ocr", F.when(F.col("_needs"), F.coalesce("ocr_text", F.lit(""))).otherwise(""))
    both = E.extract_fields(direct, cat, "_ocr").withColumn("n_ocr", R.n_filled())
    error = F.col("ocr_error") if "ocr_error" in df.columns else F.lit(None).cast("string")
    failed = F.concat(F.lit(fv.WARN_OCR_FAILED), error)
    take = F.col("_needs") & failed.isNull() & (F.col("n_ocr") >= F.col("n_direct"))
    warning = F.when(F.col("_needs"), F.when(short, fv.WARN_TEXT_TOO_SHORT)
                     .otherwise(fv.WARN_TOO_FEW_FIELDS))
    return (both.withColumn("raw_text", F.when(take, F.col("_ocr")).otherwise(F.col("direct_text")))
            .withColumn("parse_mode", F.when(take, "ocr").otherwise("text"))
            .withColumn("warnings", F.array_compact(F.array(
                warning, F.when(F.col("_needs"), failed))))
            .withColumns({c: F.when(take, F.col(c)).otherwise(F.col(f"_direct.{c}")) for c in R.RECORD})
            .drop("_needs", "_ocr", "_direct"))


# --- recognised lines ---------------------------------------------------------------

def keep_lines(lines, floor: float = fv.LABEL_SCORE_FLOOR) -> Column:
    """Stripped non-blank lines at or above the score floor, renumbered from 1."""
    read = F.transform(T.col(lines), lambda s: F.struct(
        T.strip(F.coalesce(s["text"], F.lit(""))).alias("text"),
        F.coalesce(s["score"], F.lit(0.0)).alias("score")))
    kept = F.filter(read, lambda s: (s["text"] != "") & (s["score"] >= floor))
    return F.transform(kept, lambda s, i: F.struct(
        (i + 1).alias("seq"), s["text"].alias("text"), s["score"].alias("score")))


def with_line_stats(df: DataFrame, floor: float = fv.LABEL_SCORE_FLOOR) -> DataFrame:
    """kept lines, raw_text and mean confidence of a candidate ('' and 0.0 when nothing is left)."""
    out = T.fence(df, "kept", keep_lines("lines", floor))
    total = F.aggregate(F.col("kept")["score"], F.lit(0.0), lambda a, s: a + s)
    return (out.withColumn("raw_text", F.array_join(F.col("kept")["text"], "\n"))
               .withColumn("confidence", F.when(F.size("kept") > 0, total / F.size("kept")).otherwise(0.0)))


def ocr_rows(df: DataFrame, keys: list[str], provenance: str | None = None) -> DataFrame:
    """Line rows with the score to four decimals; keeps a row's own provenance if it has one."""
    rows = (df.select(*keys, *([provenance] if provenance else []), F.explode("kept").alias("_l"))
            .withColumn("seq", F.col("_l.seq")).withColumn("text", F.col("_l.text"))
            .withColumn("score", F.round("_l.score", 4)).drop("_l"))
    return rows


def default_provenance(rows: DataFrame, own: str, selected: str) -> DataFrame:
    return rows.withColumn(own, F.coalesce(own, selected))


def candidate_score(n_fields, text, confidence) -> Column:
    return (T.col(n_fields) * fv.SCORE_PER_FIELD
            + T.keyword_hits(text, fv.LABEL_KEYWORDS) * fv.SCORE_PER_KEYWORD
            + T.col(confidence) * fv.SCORE_PER_CONFIDENCE
            + F.least(F.length(text), F.lit(fv.SCORE_TEXT_CAP)) / fv.SCORE_TEXT_UNIT)


def score_candidates(candidates: DataFrame, cat: Catalogue = APPLIANCE,
                     floor: float = fv.LABEL_SCORE_FLOOR) -> DataFrame:
    """Add kept lines, text, confidence, record and score to each candidate row."""
    read = E.extract_fields(with_line_stats(candidates, floor), cat, "raw_text")
    return read.withColumn("n_fields", R.n_filled()).withColumn(
        "score", candidate_score("n_fields", "raw_text", "confidence"))


def quality_warnings(n_fields, confidence) -> Column:
    return F.array_compact(F.array(
        F.when(T.col(n_fields) == 0, fv.WARN_NO_FIELDS),
        F.when(F.round(T.col(confidence), 4) < fv.LOW_MEAN_CONFIDENCE, fv.WARN_LOW_CONFIDENCE)))


def best_candidate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate 0 if it already yields enough fields, else the best score, first on ties.

    The early stop is the leading part of the order, so one aggregate decides.
    """
    stop = (F.col("candidate_no") == 0) & (F.col("n_fields") >= fv.ENOUGH_FIELDS)
    payload = [c for c in scored.columns if c not in keys]
    best = F.max_by(F.struct(*payload), F.struct(
        stop.alias("stop"), F.col("score").alias("score"), (-F.col("candidate_no")).alias("first")))
    out = scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
    return out.withColumn("warnings", quality_warnings("n_fields", "confidence"))


def page_confidence(pages: DataFrame, keys: list[str], floor: float = fv.PAGE_SCORE_FLOOR) -> DataFrame:
    """Unweighted mean of the page means, from page rows with their ``lines``; a page
    without a kept line counts as 0."""
    per_page = with_line_stats(pages, floor).select(*keys, "confidence")
    return per_page.groupBy(*keys).agg(F.round(F.avg("confidence"), 4).alias("confidence"),
                                       F.count("*").alias("n_pages"))


def reextract_empty(df: DataFrame, cat: Catalogue = APPLIANCE, text: str = "raw_text") -> DataFrame:
    """Extract again, from the text, the records that hold no field."""
    old = df.select("*", F.struct(*R.RECORD).alias("_old")).drop(*R.RECORD)
    old = old.withColumn("_again", F.when(F.size("_old.ords") == 0, F.col(text)).otherwise(""))
    new = E.extract_fields(old, cat, "_again")
    keep = F.size("_old.ords") > 0
    chosen = [F.when(keep, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) for c in R.RECORD]
    rest = [c for c in df.columns if c not in R.RECORD]
    return new.select(*rest, *chosen)
