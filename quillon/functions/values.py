"""How document values compare, as Column expressions.

Numbers compare as doubles; a boolean counts as 0 or 1 in ranges and sorts; everything else is no number and
never matches a range. For sorting, what is no number counts as 0. A missing field matches nothing. Literals
are settled on the driver, so predicates on typed columns stay plain and reach the Parquet scan.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN|INT|SMALLINT|TINYINT)"


def named(name: str) -> Column:
    """The top-level column of this very name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def number(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return None if text.strip() != text or "_" in text else x


def shortest(x: float) -> str:
    """Shortest text that reads back as the double; with an exponent below 1e-4 and from 1e21 on."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    if x != 0 and not 1e-4 <= abs(x) < 1e21:
        return next(s for k in range(18) if float(s := f"{x:.{k}e}") == x)
    return next(s for k in range(350) if float(s := f"{x:.{k}f}") == x)


def typed_equals(column: Column, kind: T.DataType, value: Any) -> Column:
    """column = value for a typed column. A literal of another type matches by its text where that can be."""
    if value is None:
        return column.isNull()
    if isinstance(kind, T.StringType):
        return column == F.lit("true" if value is True else "false" if value is False else shortest(float(value)) if isinstance(value, (int, float)) else str(value))
    if isinstance(kind, T.BooleanType):
        text = str(value).lower() if isinstance(value, bool) else value
        return column == F.lit(text == "true") if text in ("true", "false") else F.lit(False)
    if isinstance(kind, T.NumericType):
        x = None if isinstance(value, bool) else float(value) if isinstance(value, (int, float)) else number(value)
        if x is None or math.isnan(x):
            return F.lit(False)
        exact = isinstance(kind, T.IntegralType) and x.is_integer() and abs(x) < 2**53
        return column == F.lit(int(x) if exact else x)
    return column.cast("string") == F.lit(str(value))


def typed_number(column: Column, kind: T.DataType) -> Column:
    """The value as a number; null if it is none."""
    if isinstance(kind, T.NumericType):
        return column
    return column.cast("int") if isinstance(kind, T.BooleanType) else F.lit(None).cast("double")


def path(name: str) -> str:
    """Path of a top-level key. Spark's paths cannot escape the quote they are written in."""
    if "'" in name and '"' in name:
        raise ValueError(f"a field name with both kinds of quotes cannot be addressed: {name}")
    return f"$['{name}']" if '"' in name else f'$["{name}"]'


def present(doc: Column, name: str) -> Column:
    """The field is in the VARIANT document, be it null."""
    return F.variant_get(doc, path(name), "variant").isNotNull()


def variant_number(doc: Column, name: str) -> Column:
    """The field as a double if it is a number or boolean; strings are not parsed."""
    kind = F.schema_of_variant(F.variant_get(doc, path(name), "variant"))
    return F.when(kind.rlike(NUMERIC), F.try_variant_get(doc, path(name), "double"))


def variant_equals(doc: Column, name: str, value: Any) -> Column:
    """Equality by type: numbers as doubles, strings and booleans as such; a text also matches the number or
    boolean that it spells."""
    got = F.variant_get(doc, path(name), "variant")
    kind = F.schema_of_variant(got)
    if value is None:
        return F.coalesce(F.is_variant_null(got), F.lit(False))
    text = "true" if value is True else "false" if value is False else shortest(float(value)) if isinstance(value, (int, float)) else str(value)
    same = (kind == "STRING") & (F.try_variant_get(doc, path(name), "string") == F.lit(text))
    if text in ("true", "false"):
        same = same | ((kind == "BOOLEAN") & (F.try_variant_get(doc, path(name), "boolean") == F.lit(text == "true")))
    x = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else number(text)
    if x is not None:
        same = same | (kind.rlike(NUMERIC) & (kind != "BOOLEAN") & (F.try_variant_get(doc, path(name), "double") == F.lit(x)))
    return F.coalesce(same, F.lit(False))
