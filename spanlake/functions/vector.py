"""Vector columns: arrays of float or double, accumulated in double."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def _d(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, not once per use."""
    return F.transform(F.array(value), body)[0]


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v, floor: float = 1e-12, keep_below: float | None = None) -> Column:
    """v / max(norm, floor); with ``keep_below`` a shorter vector is returned unchanged."""
    def scaled(n):
        out = F.transform(_d(v), lambda x: x / F.greatest(n, F.lit(floor)))
        return out if keep_below is None else F.when(n < keep_below, _d(v)).otherwise(out)

    return let(norm(v), scaled)


def inner_product(a, b) -> Column:
    return dot(a, b)


def cosine(a, b) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def alpha_blend(text, image, alpha: float = 0.5) -> Column:
    mixed = F.zip_with(l2_normalize(text), l2_normalize(image), lambda t, i: t * alpha + i * (1 - alpha))
    return let(mixed, lambda m: l2_normalize(m))


def valid_vector(v, dim: int | None = None) -> Column:
    ok = F.forall(_d(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(v) > 1e-12)
    if dim is not None:
        ok = ok & (F.size(v) == dim)
    return F.coalesce(ok, F.lit(False))


def is_unit(v, tolerance: float = 1e-3) -> Column:
    return F.coalesce(F.abs(norm(v) - 1.0) <= tolerance, F.lit(False))


def face_confidence(c) -> Column:
    """Logistic curve centred at cosine 0.45 with slope 12."""
    return 1.0 / (1.0 + F.exp(-12.0 * (c - 0.45)))


def visual_confidence(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1.0) / 2.0))


@F.pandas_udf(ArrayType(FloatType()))
def decode_f32_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(BinaryType())
def encode_f32_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
