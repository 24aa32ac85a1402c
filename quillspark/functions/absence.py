"""Which values count as answers, and field-by-field merging built on it.

A value is absent if it is null, an empty string or an empty list; 0, false, NaN, empty structs and
empty maps (an object without fields) are answers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_absent(value: Column, kind: T.DataType) -> Column:
    """True where a value of this type is no answer."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    if isinstance(kind, T.ArrayType):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def merge_value(before: Column, after: Column, kind: T.DataType) -> Column:
    """The later value if it is an answer, else the earlier one; structs are merged by field, lists whole.

    Where neither is an answer the earlier stays unless it is null.
    """
    if isinstance(kind, T.StructType):
        fields = F.struct(*[merge_value(before[f.name], after[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(after.isNull(), before).when(before.isNull(), after).otherwise(fields)
    return F.when(is_absent(after, kind), F.coalesce(before, after)).otherwise(after)


def merge_structs(before: Column, after: Column, kind: T.StructType, keep: dict[str, Column] | None = None) -> Column:
    """A struct of all fields merged; keep gives fields that follow another rule."""
    keep = keep or {}
    return F.struct(*[
        keep.get(f.name, merge_value(before[f.name], after[f.name], f.dataType)).alias(f.name) for f in kind.fields
    ])


def sticky(fresh: Column, stored: Column, kind: T.DataType) -> Column:
    """The fresh value unless it is absent."""
    return F.when(is_absent(fresh, kind), stored).otherwise(fresh)
