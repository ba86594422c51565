"""Rules for names, dimensions, metrics and ids; for values and for columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import VectorError

MAX_DIM = 4096
MAX_ID = 256
METRICS = {"l2": 0, "cosine": 1, "dot": 2}
NAME = r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,63}\z"


def collection_name(name: str) -> str:
    if not re.fullmatch(NAME.removeprefix(r"\A").removesuffix(r"\z"), name or ""):
        raise VectorError("INVALID_NAME", repr(name))
    return name


def dimension(dim: int) -> int:
    if dim < 1:
        raise VectorError("DIM_TOO_SMALL", str(dim))
    if dim > MAX_DIM:
        raise VectorError("DIM_TOO_LARGE", str(dim))
    return dim


def metric(value: str | int) -> str:
    """The metric's name, given its name or code."""
    names = {code: name for name, code in METRICS.items()}
    if value in METRICS:
        return value
    if not isinstance(value, bool) and value in names:
        return names[value]
    raise VectorError("INVALID_METRIC", repr(value))


def name_is_valid(name: Column) -> Column:
    return F.coalesce(F.rlike(name, F.lit(NAME)), F.lit(False))


def dim_error(dim: Column) -> Column:
    """The kind of error of a dimension, or null."""
    return F.when(dim < 1, F.lit("DIM_TOO_SMALL")).when(dim > MAX_DIM, F.lit("DIM_TOO_LARGE"))


def metric_code(name: Column) -> Column:
    """The code of a metric's name, or null."""
    return F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[name]


def vector_error(vector: Column, dim: int | Column) -> Column:
    """The kind of error of a vector for a collection of this dimension, or null."""
    return F.when(vector.isNull() | (F.size(vector) < 1), F.lit("DIM_TOO_SMALL")).when(F.size(vector) != dim, F.lit("DIM_MISMATCH"))


def id_is_valid(id_: Column) -> Column:
    return F.coalesce(F.length(id_).between(1, MAX_ID), F.lit(False))
