"""Sparse vectors ``{dim, indices, values}`` as columns: reading, checking, converting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

SPARSE = T.StructType([
    T.StructField("dim", T.IntegerType()),
    T.StructField("indices", T.ArrayType(T.IntegerType())),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])


def parse_sparse(c) -> Column:
    return F.from_json(c, SPARSE)


def sparse_error(v: Column, expected_dim: int | None = None) -> Column:
    """Why a sparse vector is not valid; null where it is."""
    ind, val = v["indices"], v["values"]
    checks = (
        F.when(v.isNull() | v["dim"].isNull() | ind.isNull() | val.isNull(), "unreadable")
        .when(F.size(ind) != F.size(val), "length mismatch")
        .when(F.exists(ind, lambda i: (i < 0) | (i >= v["dim"])), "index out of range")
        .when(F.size(F.array_distinct(ind)) != F.size(ind), "duplicate index")
    )
    return checks if expected_dim is None else checks.when(v["dim"] != expected_dim, "wrong dimension")


def ml_vector(dim: Column, indices: Column, values: Column) -> Column:
    """The storage form of an ML sparse vector; read it back from Parquet with a vector schema."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), dim.cast("int").alias("size"),
        indices.alias("indices"), values.alias("values"),
    )
