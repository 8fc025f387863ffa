"""Joins that keep their shape when the data grows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DataType, MapType, NumericType, StringType,
                               StructType)

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 16


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, as it does in a grouping; one copy of the keys is kept."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and arrays by their length, nested values as JSON."""
    def width(name: str, kind: DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (NumericType, BooleanType)):
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8
        if isinstance(kind, (ArrayType, MapType, StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(8)

    return reduce(lambda a, b: a + b, [width(f.name, f.dataType) for f in df.schema.fields], F.lit(16)).cast("bigint")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast, by its rows and bytes; looks at ``max_rows + 1`` rows at most."""
    seen = df.limit(max_rows + 1).agg(F.count("*"), F.sum(row_bytes(df))).head()
    return seen[0] <= max_rows and (seen[1] or 0) <= max_bytes


def lookup_join(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, salts: int = SALTS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join facts to a dimension with unique keys, whatever the key frequencies; null equals null.

    A dimension of at most ``max_rows`` and ``max_bytes`` is broadcast. A larger one is shuffled;
    facts are then spread over ``salts`` copies of each key so that one frequent
    key does not end up in one task.
    """
    if is_small(dimension, max_rows, max_bytes):
        return null_safe_join(facts, F.broadcast(dimension), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copies = dimension.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(salted, copies, [*on, "_salt"], how).drop("_salt")
