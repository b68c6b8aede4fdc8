"""Compile a FindRequest to a lazy DataFrame, over typed columns or over (_id, doc VARIANT)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import values as V
from quillon.plans.request import Filter, FindRequest


def is_variant(df: DataFrame) -> bool:
    return "doc" in df.columns and isinstance(df.schema["doc"].dataType, T.VariantType)


def _compare(x: Column, f: Filter) -> Column:
    if f.op == "between":
        return x.between(*map(F.lit, f.value))
    return {"gt": x > f.value, "gte": x >= f.value, "lt": x < f.value, "lte": x <= f.value}[f.op]


def predicate(df: DataFrame, f: Filter, id_field: str = "_id") -> Column:
    """The filter as a boolean Column. A field that df does not have matches nothing."""
    if is_variant(df) and f.field != id_field:
        doc = F.col("doc")
        if f.op == "exists":
            return V.present(doc, f.field)
        if f.op == "eq":
            return V.variant_equals(doc, f.field, f.value)
        # the plain comparison holds wherever the gated one does, and reaches the scan
        return _compare(F.try_variant_get(doc, V.path(f.field), "double"), f) & _compare(V.variant_number(doc, f.field), f)
    if f.field not in df.columns:
        return F.lit(False)
    column, kind = V.named(f.field), df.schema[f.field].dataType
    if f.op == "exists":
        return column.isNotNull()
    if f.op == "eq":
        return V.typed_equals(column, kind, f.value)
    return _compare(V.typed_number(column, kind), f)


def sort_key(df: DataFrame, name: str, native: bool = False) -> Column:
    """What rows sort by: the number in the field, 0 where there is none; native: the column's own order."""
    if is_variant(df):
        return F.coalesce(V.variant_number(F.col("doc"), name), F.lit(0.0))
    if name not in df.columns:
        return F.lit(0)
    return V.named(name) if native else F.coalesce(V.typed_number(V.named(name), df.schema[name].dataType), F.lit(0))


def project(df: DataFrame, fields: tuple[str, ...], id_field: str = "_id") -> DataFrame:
    """Keep the id and those of the fields that exist. Documents become one column per field."""
    if not fields:
        return df
    if is_variant(df):
        return df.select(id_field, *[F.variant_get("doc", V.path(f), "variant").alias(f) for f in fields if f != id_field])
    return df.select(*[V.named(c) for c in dict.fromkeys((id_field, *fields)) if c in df.columns])


def find(df: DataFrame, request: FindRequest, id_field: str = "_id", native_sort: bool = False) -> DataFrame:
    """Filter, then sort or limit (ties and unsorted limits in the order of the id as text), then project.
    Sort with limit compiles to a top-k that never sorts everything."""
    out = df
    if request.filters:
        out = out.where(reduce(lambda a, b: a & b, (predicate(df, f, id_field) for f in request.filters)))
    by_id = V.named(id_field).cast("string")
    if request.sort_by:
        key = sort_key(df, request.sort_by, native_sort)
        out = out.orderBy(key.asc() if request.ascending else key.desc(), by_id)
    elif request.limit > 0:
        out = out.orderBy(by_id)
    if request.limit > 0:
        out = out.limit(request.limit)
    return project(out, request.projection, id_field)


def get(df: DataFrame, key, id_field: str = "_id") -> DataFrame:
    """The row of one id; the predicate reaches the scan with its statistics and Bloom filters."""
    return df.where(V.named(id_field) == F.lit(key))
