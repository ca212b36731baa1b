"""The field catalogue: an ordered, replaceable list of field rules.

Every operator takes a ``Catalogue``. Its size (tens of fields) is a constant of
the domain and does not grow with the data, so it travels inside the plan as
literals; ``field_dim`` / ``field_alias`` / ``field_pattern`` give it as tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from plumbline import fixed_values as fv

VALUE_KINDS = ("text", "model", "code", "number", "unit", "version")


@dataclass(frozen=True)
class Field:
    id: str
    display: str
    kind: str = "text"
    required: bool = False
    digit_fix: bool = False
    aliases: tuple[str, ...] = ()
    patterns: tuple[str, ...] = dc_field(default_factory=tuple)
    # Optional, per pattern: words of which a matching text holds at least one.
    pattern_words: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self):
        if self.kind not in VALUE_KINDS:
            raise ValueError(f"{self.id}: unknown value kind {self.kind!r}")

    @property
    def numeric(self) -> bool:
        """Kinds whose normal form drops a trailing ``.0``."""
        return self.kind in ("unit", "number")


@dataclass(frozen=True)
class Catalogue:
    fields: tuple[Field, ...]
    default_count: int = fv.DEFAULT_FIELD_COUNT
    twins: tuple[str, str] | None = None

    def __len__(self) -> int:
        return len(self.fields)

    @cached_property
    def ids(self) -> list[str]:
        return [f.id for f in self.fields]

    @cached_property
    def position(self) -> dict[str, int]:
        return {f.id: i for i, f in enumerate(self.fields)}

    @cached_property
    def label_words(self) -> list[tuple[int, int, str]]:
        """(field position, rank of the word by falling length, word)."""
        rows = []
        for pos, f in enumerate(self.fields):
            by_length = sorted(f.aliases, key=len, reverse=True)
            rows += [(pos, rank, word) for rank, word in enumerate(by_length)]
        return rows

    def field_dim(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.id, f.display, f.kind, f.required, f.digit_fix)
                for i, f in enumerate(self.fields)]
        return spark.createDataFrame(
            rows, "field_ord int, field_name string, display_name string, "
                  "kind string, required boolean, digit_fix boolean")

    def field_alias(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.id, n, a) for i, f in enumerate(self.fields)
                for n, a in enumerate(f.aliases)]
        return spark.createDataFrame(
            rows, "field_ord int, field_name string, alias_no int, alias string")

    def field_pattern(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f.id, n, p) for i, f in enumerate(self.fields)
                for n, p in enumerate(f.patterns)]
        return spark.createDataFrame(
            rows, "field_ord int, field_name string, pattern_no int, pattern string")


def appliance_catalogue() -> Catalogue:
    return Catalogue(
        tuple(Field(i, d, k, r, x, tuple(a), tuple(p),
                    tuple(tuple(fv.PATTERN_WORDS.get((i, n), ())) for n in range(len(p))))
              for i, d, k, r, x, a, p in fv.APPLIANCE_FIELDS),
        twins=fv.MODEL_PAIR)


def six_field_catalogue() -> Catalogue:
    return Catalogue(tuple(Field(i, d, aliases=tuple(a)) for i, d, a in fv.SIX_FIELDS))


APPLIANCE = appliance_catalogue()
SIX = six_field_catalogue()
