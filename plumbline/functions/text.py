"""Text scalars as Column expressions.

Nothing here runs Python per row. Compatibility normalisation (NFKC) has no SQL
function in Spark, but the ICU library Spark ships is reachable through
``reflect``, so even that stays in the JVM.

``clean_text`` normalises and tidies raw input; it is meant to run once, where
text enters. NFKC is closed under substrings, so anything cut out of a cleaned
text only needs ``tidy`` afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv

# White space as str.strip() and \s see it (Java's \s and trim() differ).
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# No letter, digit or sign of ASCII: one range passes most places, where SPACE tries all of its own.
_ODD = "(?![!-~])"
SPACES, BLANKS = _ODD + SPACE + "+", _ODD + SPACE + "{2,}"
# Runs of white space, and single ones that are no plain blank.
SQUEEZE = _ODD + "(?:" + SPACE + "{2,}|" + SPACE.replace("\\x1c- ", "\\x1c-\\x1f") + ")"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
# Line breaks but for the usual one, and the white space that breaks no line.
ODD_BREAK = r"(?![\n -~])[\x0b-\r\x1c-\x1e\x85\u2028\u2029]"
INNER_SPACE = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
INNER_SQUEEZE = _ODD + "(?:" + INNER_SPACE + "{2,}|" + INNER_SPACE.replace(" ", "") + ")"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def fence(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column in a form the optimizer computes once per row and never copies.

    Without it a filter on something made from a costly column is rewritten into
    (many copies of) the column's definition, and a column used inside a lambda
    is computed once per element. An unused fenced column is still pruned away. Filters
    on other columns stay above as well: set them before, or read stored records
    (``sources.records``), where they reach the scan.
    """
    return df.withColumn(name, F.when(F.spark_partition_id() >= 0, value))


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def nfkc(c) -> Column:
    """Compatibility composition; text of one byte per character is its own."""
    c = F.coalesce(col(c).cast("string"), F.lit(""))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(composed)


def replace_each(c, pairs: dict[str, str]) -> Column:
    """Plain replacements: a byte search each, where translate() boxes every character."""
    c = col(c)
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def tidy(c) -> Column:
    """Unify slashes and dashes, squeeze blanks and empty lines, strip.

    Takes NFKC text. A single blank is left alone rather than replaced by itself,
    so usual text passes without being rebuilt.
    """
    c = replace_each(c, {"\\": "/", "—": "-", "–": "-"})
    c = F.regexp_replace(c, r"[ \t\r\f\x0b]{2,}|[\t\r\f\x0b]", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


# Printable ASCII without a backslash and with single inner blanks is clean already. Possessive:
# read in one go, whatever the length.
PLAIN = r"\A(?:[!-\[\]-~]++(?: [!-\[\]-~]++)*+)?\z"


def clean_text(c) -> Column:
    c = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(c.rlike(PLAIN), c).otherwise(tidy(nfkc(c)))


def compact_text(c) -> Column:
    return F.upper(F.regexp_replace(clean_text(c), SPACES, ""))


def label_key(c) -> Column:
    """Comparison form of a label word; takes cleaned text."""
    c = F.btrim(F.upper(col(c)), F.lit(" :"))
    return let(c, lambda k: F.regexp_replace(F.when(
        k.contains("/"), F.regexp_replace(k, f"{SPACE}*/{SPACE}*", "/")).otherwise(k), SQUEEZE, " "))


def fix_ocr_digits(c) -> Column:
    return F.translate(col(c), "OoIlSB", "001158")


# What precedes is looked at behind the first letters, so that most places are passed at once.
LITERS = r"(?U)LITER(?<=\bLITER)S?\b"
ZERO_DECIMALS = r"(?U)\.0(?<=\d\.0)0*(?=\D|$)"


def normal_form(c, digit_fix=False, numeric=False) -> Column:
    """Comparison form of a cleaned value; the flags may be bools or Columns."""
    c = col(c)
    if isinstance(digit_fix, Column):
        c = F.when(digit_fix, fix_ocr_digits(c)).otherwise(c)
    elif digit_fix:
        c = fix_ocr_digits(c)
    c = F.upper(c)
    c = F.replace(c, F.lit("KGS"), F.lit("KG"))
    c = F.replace(c, F.lit("KWH/YEAR"), F.lit("KWH"))
    c = F.regexp_replace(c, LITERS, "L")
    c = F.btrim(F.regexp_replace(c, SPACES, ""), F.lit(":："))
    if numeric is False:
        return c
    if numeric is True:
        return F.regexp_replace(c, ZERO_DECIMALS, "")
    bare = F.regexp_replace(c, ZERO_DECIMALS, "")
    return F.when(F.lit(numeric), bare).otherwise(c)


def tidy_candidate(c) -> Column:
    """A value cut out of cleaned text, without its separators."""
    c = F.btrim(tidy(c), F.lit(" :：|"))
    return strip(F.regexp_replace(c, BLANKS, " "))


def tidy_piece(c) -> Column:
    """``tidy_candidate`` of a piece of tidied text (or of tidied lines), which needs no
    tidying but at its ends."""
    c = F.btrim(strip(c), F.lit(" :：|"))
    return strip(F.regexp_replace(c, BLANKS, " "))


def cut_value(c) -> Column:
    c = col(c)
    return F.when(F.length(c) > fv.MAX_VALUE_CHARS,
                  strip(F.substring(c, 1, fv.MAX_VALUE_CHARS))).otherwise(c)


def _lines_of(c) -> Column:
    """Stripped non-blank lines of a text; what else a line needs is done on the whole text."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, ODD_BREAK, "\n"), "\n"), strip), lambda x: x != "")


def split_lines(c) -> Column:
    """Clean (see ``tidy``) non-blank lines of a cleaned or NFKC-normalised text, in order."""
    c = replace_each(c, {"\\": "/", "—": "-", "–": "-"})
    return _lines_of(F.regexp_replace(c, r"[ \t]{2,}|\t", " "))


def plain_lines(c) -> Column:
    """Non-blank lines of a text, each as ``clean_line`` gives it."""
    return _lines_of(F.regexp_replace(F.coalesce(col(c), F.lit("")), INNER_SQUEEZE, " "))


def clean_line(c) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), SQUEEZE, " "))


def six_field_key(c) -> Column:
    return F.upper(replace_each(clean_line(c), {"：": ":", "／": "/"}))


def keyword_hits(c, words) -> Column:
    low = F.lower(col(c))
    hits = [F.when(low.contains(w.lower()), 1).otherwise(0) for w in words]
    return reduce(lambda a, b: a + b, hits)


def trim_for_export(c, limit: int = fv.EXPORT_TEXT_CHARS) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    before, after = fv.TRIM_NOTE
    note = F.concat(F.lit(before), (F.length(c) - limit).cast("string"), F.lit(after))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), note)).otherwise(c)


def safe_text(c, stripped: bool = True) -> Column:
    c = F.coalesce(col(c).cast("string"), F.lit(""))
    return strip(c) if stripped else c


def detection_id(ts, micros: bool = True, key=None) -> Column:
    """``key`` adds a hash suffix: microseconds alone collide across rows."""
    form = "'OCR-'yyyyMMdd-HHmmss" + ("-SSSSSS" if micros else "")
    made = F.date_format(col(ts), form)
    if key is None:
        return made
    return F.concat(made, F.lit("-"), F.lower(F.hex(F.xxhash64(*[col(k) for k in key]))))


def report_name(ts, verdict_word, prefix: str = fv.REPORT_NAME_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.date_format(col(ts), "yyyyMMdd_HHmmss"), F.lit("_"),
                    col(verdict_word), F.lit(fv.REPORT_NAME_SUFFIX))


def percent(c) -> Column:
    return F.format_string("%.2f%%", F.round(col(c) * 100, 2))


def round_exact(c, digits: int) -> Column:
    """The double ``c`` rounded to ``digits`` (0 to 8) decimals by its exact binary value, half to even.

    ``F.round`` goes by the printed decimal instead: it takes 2.675 to 2.68, although the
    double lies below it. The product with 10^digits is held as a rounded double plus its
    error, so the side of a tie is known. From 2^53 / 10^digits on doubles are too far
    apart to be rounded and stay as they are, like NaN and infinities; null stays null.
    """
    if not 0 <= digits <= 8:
        raise ValueError("digits must lie between 0 and 8, so that products of half doubles are exact")
    x, scale = col(c).cast("double"), float(10 ** digits)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper 26 bits of x
    error = (high * scale - product) + (x - high) * scale
    whole = F.rint(product)
    rest = product - whole
    whole = (F.when((rest == 0.5) & (error > 0), whole + 1).when((rest == -0.5) & (error < 0), whole - 1)
             .when((F.abs(error) == 0.5) & (F.abs(whole % 2) == 1), whole + error * 2).otherwise(whole))
    return F.when(F.abs(product) >= 2.0 ** 53, x).otherwise(whole / scale)


def percent_exact(c) -> Column:
    """A share as a percentage of two decimals, rounded by ``round_exact`` (shares below 10^11)."""
    return F.format_string("%.2f%%", round_exact(col(c).cast("double") * 100, 2))


def words(c, mapping: dict[str, str]) -> Column:
    """Show a code by its word; unknown codes pass through."""
    c = col(c)
    out = c
    for code, word in mapping.items():
        out = F.when(c == code, F.lit(word)).otherwise(out)
    return out


def yes_no(flag) -> Column:
    yes, no = fv.YES_NO
    return F.when(col(flag), yes).otherwise(no)


def recognised(value) -> Column:
    done, missing = fv.RECOGNISED_WORDS
    return F.when(F.coalesce(col(value), F.lit("")) != "", done).otherwise(missing)


def first_present(*cs) -> Column:
    return F.coalesce(*[col(c).cast("string") for c in cs], F.lit(""))


# --- paths -------------------------------------------------------------------

def file_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def file_suffix(path) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def file_stem(path) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def relative_path(path, root: str) -> Column:
    root = root if root.endswith("/") else root + "/"
    path = col(path)
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 2147483647)).otherwise(path)


def path_order(path) -> Column:
    """Paths sort by their components, not as one string."""
    return F.split(col(path), "/")
