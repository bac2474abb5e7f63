"""Whole rows as hashes and as what can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _has_map(t: T.DataType) -> bool:
    inner = [f.dataType for f in t.fields] if isinstance(t, T.StructType) else [t.elementType] if isinstance(t, T.ArrayType) else []
    return isinstance(t, (T.MapType, T.VariantType)) or any(map(_has_map, inner))


def comparable(docs: DataFrame, prefix: str = "") -> list[Column]:
    """The columns of docs (fields of `prefix`); maps, which have neither hash nor order, as JSON."""
    each = {f.name: F.col(f"{prefix}`{f.name}`") for f in docs.schema.fields}
    return [F.to_json(F.struct(each[f.name].alias("x"))) if _has_map(f.dataType) else each[f.name] for f in docs.schema.fields]


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row as columns."""
    # a null leaves Spark's hash as it was, so which columns are null goes in beside the values
    null = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns])
    return [F.xxhash64(F.lit(i), null, *comparable(docs)) for i in (1, 2)]
