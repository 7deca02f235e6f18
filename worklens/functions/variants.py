"""Typed access to the top-level fields of a parsed JSON row.

A field tells a missing value, an explicit null and a value of the wrong type apart,
which ``from_json`` with a fixed schema does not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklens import fixed
from worklens.functions.text import let, strip


def document(text: Column, names: Iterable[str]) -> Column:
    """The named fields of a JSON object as a struct of VARIANTs; NULL if ``text`` is none.

    A missing field is NULL and an explicit null is a VARIANT null. The text is read as
    the only element of an array, so anything after the object makes it malformed.
    """
    fields = ", ".join(f"`{n}`: variant" for n in names)
    only = let(
        F.from_json(
            F.concat(F.lit("["), text, F.lit("]")),
            f"array<struct<{fields}>>",
            {"allowSingleQuotes": "false"},
        ),
        lambda found: F.when(F.size(found) == 1, found[0]),
    )
    return only


def shape_error(text: Column, doc: Column) -> Column:
    """Why there is no document; NULL when there is one."""
    return F.when(
        doc.isNull(),
        F.when(F.try_parse_json(text).isNull() | text.startswith("{"), "not JSON").otherwise(
            "not an object"
        ),
    )


def facts(values: dict[str, Column]) -> Column:
    """Kind, text and number of each VARIANT, as one struct."""

    def fact(name: str, value: Column) -> Column:
        return F.struct(
            F.coalesce(F.schema_of_variant(value), F.lit("MISSING")).alias("kind"),
            value.try_cast("string").alias("text"),
            value.try_cast("double").alias("number"),
        ).alias(name)

    return F.struct(*[fact(n, v) for n, v in values.items()])


class Field:
    """Tests and conversions of one field of a struct made by :func:`facts`."""

    def __init__(self, known: Column, name: str):
        fact = known[name]
        self.kind = fact["kind"]
        self.text = fact["text"]
        self.number = fact["number"]
        self.missing = self.kind == "MISSING"
        self.null = self.kind == "VOID"
        self.absent = self.missing | self.null
        self.is_text = self.kind == "STRING"
        self.is_bool = self.kind == "BOOLEAN"
        self.is_number = self.kind.startswith("BIGINT") | self.kind.startswith("D") | self.kind.startswith("FLOAT")
        self.is_object = self.kind.startswith("OBJECT")
        self.is_nested = self.is_object | self.kind.startswith("ARRAY")
        self.is_empty = self.kind.isin("ARRAY<VOID>", "OBJECT<>")

    def truthy(self) -> Column:
        return (
            F.when(self.absent | self.is_empty, False)
            .when(self.is_text, self.text != "")
            .when(self.is_bool, self.text == "true")
            .when(self.is_number, self.number != 0)
            .otherwise(True)
        )

    def as_double(self) -> Column:
        """NULL when the value is no number."""
        return (
            F.when(self.is_number, self.number)
            .when(self.is_text, strip(self.text).try_cast("double"))
            .when(self.is_bool, F.when(self.text == "true", 1.0).otherwise(0.0))
        )

    def optional_double(self) -> tuple[Column, Column]:
        """Value, and whether it is acceptable."""
        return self.as_double(), self.absent | self.as_double().isNotNull()

    def optional_text(self) -> tuple[Column, Column]:
        return F.when(self.is_text, self.text), self.absent | self.is_text

    def text_or(self, default: str | Column) -> tuple[Column, Column]:
        """Text with a default for a missing field; an explicit null is not acceptable."""
        fallback = default if isinstance(default, Column) else F.lit(default)
        return F.when(self.missing, fallback).otherwise(self.text), self.missing | self.is_text

    def optional_long(self) -> tuple[Column, Column]:
        whole = self.is_number & (self.number == F.floor(self.number))
        digits = strip(self.text)
        value = (
            F.when(whole, F.coalesce(self.text.try_cast("bigint"), self.number.try_cast("bigint")))
            .when(self.is_text & digits.rlike(r"^[+-]?\d+(\.0*)?$"), digits.try_cast("decimal(38,0)").try_cast("bigint"))
            .when(self.is_bool, F.when(self.text == "true", 1).otherwise(0))
        )
        return value, self.absent | value.isNotNull()

    def bool_or(self, default: bool) -> tuple[Column, Column]:
        word = F.lower(self.text)
        value = (
            F.when(self.missing, default)
            .when(self.is_bool, self.text == "true")
            .when(self.is_number & self.number.isin(0.0, 1.0), self.number == 1.0)
            .when(self.is_text & word.isin(*fixed.TRUE_WORDS), True)
            .when(self.is_text & word.isin(*fixed.FALSE_WORDS), False)
        )
        return value, value.isNotNull()


def first_failure(checks: dict[str, Column]) -> Column:
    """Name of the first check that does not hold, NULL when all do."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(list(checks.items())):
        reason = F.when(F.coalesce(holds, F.lit(False)), reason).otherwise(f"bad {name}")
    return reason
