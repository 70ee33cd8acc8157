"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns (JVM-side but for `cosines_to`).

All arithmetic is done in DOUBLE.  A zero-norm vector on either side gives
cosine 0, and a missing vector behaves as a zero vector.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank


def _dbl(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: _dbl(x) * _dbl(y))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + _dbl(x) * _dbl(x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL or zero-norm vectors give 0.0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_to(a: Column, target: Sequence[float]) -> Column:
    """Cosine similarity to one fixed vector: its norm is a literal, and the
    row's own norm is computed once."""
    length = math.sqrt(sum(float(v) * float(v) for v in target))
    if length == 0.0:
        return F.lit(0.0)
    return F.coalesce(F.try_divide(dot(a, literal_vector(target)), norm(a) * F.lit(length)), F.lit(0.0))


#: Vectors that one matrix of `cosines_to` holds.
_ROWS = 1024


def cosines_to(a: Column, target: Sequence[float]) -> Column:
    """`cosine_to` in Arrow batches, for vectors too wide for a lambda an
    element.  Sums run along the elements in their order, for many rows at a
    time, so the values are the same bits."""
    aim = np.array(target, float)
    length = math.sqrt(sum(float(v) * float(v) for v in target))
    if length == 0.0:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def near(vecs: pa.Array) -> pa.Array:
        parts = [_cosines(vecs.slice(i, _ROWS), aim, length) for i in range(0, len(vecs), _ROWS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return near(a)


def _cosines(vecs: pa.Array, aim: np.ndarray, length: float) -> np.ndarray:
    sizes = pc.list_value_length(vecs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vecs.flatten()  # null vectors hold nothing
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    rows, width = len(vecs), max(len(aim), int(sizes.max(initial=0)))
    owner = None
    if len(flat) == rows * width:
        x = values.reshape(rows, width).T
    else:  # vectors of other lengths end in zeros
        owner = np.repeat(np.arange(rows), sizes)
        x = np.zeros((width, rows))
        x[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = values
    x = np.ascontiguousarray(x)
    dot, square = np.zeros(rows), np.zeros(rows)
    for j, one in enumerate(x):
        if j < len(aim):
            dot += one * aim[j]
        square += one * one
    norms = np.sqrt(square) * length
    known = norms != 0.0
    if flat.null_count:  # a vector with a null has no norm
        owner = np.repeat(np.arange(rows), sizes) if owner is None else owner
        known[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    return np.divide(dot, norms, out=np.zeros(rows), where=known)


def literal_vector(values: Sequence[float]) -> Column:
    """A fixed vector as an ARRAY<DOUBLE> literal (for one broadcast target)."""
    return F.array(*[F.lit(float(v)) for v in values])


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim))


def blank_to_zero_vector(text: Column, vec: Column, dim: int) -> Column:
    """M3: a blank text maps to the zero vector, otherwise the given vector."""
    return F.when(is_blank(text), zero_vector(dim)).otherwise(vec)
