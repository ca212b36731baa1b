"""Catalogue look-ups: label words, rules and noise."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.catalogue import Catalogue
from plumbline.functions import text as T


def word_key(word: str) -> str:
    """``label_key`` of a catalogue word, at plan time."""
    key = unicodedata.normalize("NFKC", word).replace("\\", "/").upper().strip(" :")
    return re.sub(r"\s+", " ", re.sub(r"\s*/\s*", "/", key)).strip()


def word_positions(cat: Catalogue) -> dict[str, int]:
    """Label word -> lowest field position; catalogue order decides shared words."""
    first: dict[str, int] = {}
    for pos, f in enumerate(cat.fields):
        for a in f.aliases:
            first.setdefault(word_key(a), pos)
    return first


class WordTable:
    """Values of known words. A map is searched entry by entry, so there is one for each
    length of words, and a look-up passes the few words that are as long."""

    def __init__(self, values: dict[str, Column]):
        by_length: dict[int, list[Column]] = {}
        for word, value in values.items():
            by_length.setdefault(len(word), []).extend((F.lit(word), value))
        self.maps = F.array(*[F.create_map(*by_length[n]) if n in by_length else F.lit(None)
                              for n in range(max(by_length) + 1)])

    def of(self, word: Column) -> Column:
        """The value of a word, NULL if it is none."""
        return F.try_element_at(F.get(self.maps, F.length(word)), word)


def field_position(key, cat: Catalogue) -> Column:
    """Position of the field a label key names (whole or one of its '/' parts), else NULL."""
    key = T.col(key)
    one = WordTable({word: F.lit(at) for word, at in word_positions(cat).items()}).of
    parts = F.array_min(F.transform(F.split(key, "/"), lambda p: one(T.strip(p))))
    return F.least(one(key), F.when(key.contains("/"), parts))


def line_position(line, cat: Catalogue) -> Column:
    """``field_position`` of a clean line, skipping the many lines too long to be a word.

    Exact: upper case never shortens, so without a '/' (whose blanks go) or odd
    white space (which is squeezed) a key is at least as long as its stripped line.
    """
    return key_position(line, T.label_key(line), cat)


def key_position(line, key: Column, cat: Catalogue) -> Column:
    """``line_position`` of a line whose label key is ``key``."""
    line = T.col(line)
    longest = max(map(len, word_positions(cat)))
    may_be = ((F.length(F.btrim(line, F.lit(" :"))) <= longest) | line.contains("/")
              | line.rlike("[\x1f\u1680]"))
    return F.when(may_be, T.let(key, lambda k: field_position(k, cat)))


def word_trie(words) -> str:
    """One pattern for all words: letters that words begin with in common are tested once, and
    the longest word that fits what follows the pattern is tried first."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(letter) + pattern(below) for letter, below in node.items() if letter]
        if not branches:
            return ""
        if len(branches) == 1 and "" not in node:
            return branches[0]
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")
    return pattern(root)


def field_name_at(position, cat: Catalogue) -> Column:
    return F.try_element_at(F.array(*[F.lit(i) for i in cat.ids]), T.col(position) + 1)


def find_field(value, cat: Catalogue) -> Column:
    """Field named by a cleaned label text, else NULL."""
    return T.let(T.label_key(value), lambda k: field_name_at(field_position(k, cat), cat))


def noise_key(key, cat: Catalogue) -> Column:
    """Is a label key no value: empty, itself a label word, or with a noise word?"""
    key = T.col(key)
    stop = list(word_positions(cat))
    def has(words):
        return reduce(lambda a, b: a | b, [key.contains(w) for w in words], F.lit(False))
    words = [w.upper() for w in fv.NOISE_WORDS]
    beyond = has([w for w in words if not w.isascii()])  # no key of ASCII only holds one of them
    return (key == "") | key.isin(stop) | has([w for w in words if w.isascii()]) | ((F.octet_length(key) != F.length(key)) & beyond)


def is_noise(value, cat: Catalogue) -> Column:
    return T.let(T.label_key(value), lambda k: noise_key(k, cat))


def six_field_position(key, cat: Catalogue) -> Column:
    """Position by whole label key only; a later field wins a shared word."""
    known = {re.sub(r"\s+", " ", a).strip().replace("：", ":").replace("／", "/").upper(): pos
             for pos, f in enumerate(cat.fields) for a in f.aliases}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), T.col(key))


def is_six_field_word(line, cat: Catalogue) -> Column:
    return T.let(T.six_field_key(line), lambda k: six_field_position(k, cat).isNotNull())


# --- look-ups as joins against the (fixed-size) catalogue tables ---------------

def with_rule(df: DataFrame, cat: Catalogue, name_col: str = "field_name") -> DataFrame:
    """Add kind, required, digit_fix; unknown fields count as optional text."""
    dim = cat.field_dim(df.sparkSession).select(
        F.col("field_name").alias(name_col), "field_ord", "kind", "required", "digit_fix")
    out = df.join(F.broadcast(dim), name_col, "left")
    return (out.withColumn("kind", F.coalesce("kind", F.lit("text")))
               .withColumn("required", F.coalesce("required", F.lit(False)))
               .withColumn("digit_fix", F.coalesce("digit_fix", F.lit(False))))


def with_aliases(df: DataFrame, cat: Catalogue, name_col: str = "field_name") -> DataFrame:
    """One row per label word of the named field; an unknown field names itself."""
    dim = cat.field_alias(df.sparkSession).select(
        F.col("field_name").alias(name_col), "alias_no", "alias")
    out = df.join(F.broadcast(dim), name_col, "left")
    return (out.withColumn("alias", F.coalesce("alias", F.col(name_col)))
               .withColumn("alias_no", F.coalesce("alias_no", F.lit(0))))


def normalize_value(df: DataFrame, cat: Catalogue, name_col: str = "field_name",
                    value_col: str = "value", out: str = "norm") -> DataFrame:
    """Comparison form of (field name, value) rows by the field's rule."""
    ruled = with_rule(df, cat, name_col)
    norm = T.normal_form(T.clean_text(value_col), F.col("digit_fix"),
                         F.col("kind").isin("unit", "number"))
    return ruled.withColumn(out, norm).drop("kind", "required", "digit_fix", "field_ord")


def normalize_compare_value(df: DataFrame, cat: Catalogue, value_col: str = "value",
                            name_col: str = "field_name", out: str = "norm") -> DataFrame:
    """``normalize_value`` with the arguments in the older order."""
    return normalize_value(df, cat, name_col, value_col, out)
