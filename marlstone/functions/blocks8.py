"""Measures of 8x8 blocks held as arrays of 64 samples in row order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.scalars import dct_basis, psnr


def ssd(a: Column, b: Column) -> Column:
    """Sum of squared differences; stays in generated code's reach as plain array functions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def block_psnr(a: Column, b: Column, peak: float = 255.0) -> Column:
    return psnr(ssd(a, b) / F.size(a), peak)


def _hadamard8() -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    return h


def _blocks(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64).reshape(-1, 8, 8)


@F.pandas_udf(T.DoubleType())
def satd8(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum of absolute Hadamard coefficients of the difference, a quarter of it as is customary for 8x8."""
    if not len(a):
        return pd.Series([], dtype="float64")
    h = _hadamard8()
    return pd.Series(np.abs(h @ (_blocks(a) - _blocks(b)) @ h).sum(axis=(1, 2)) / 4)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def dct8(a: pd.Series) -> pd.Series:
    """Orthonormal two-dimensional DCT-II."""
    if not len(a):
        return pd.Series([], dtype="object")
    d = np.array(dct_basis(8))
    return pd.Series(list((d @ _blocks(a) @ d.T).reshape(-1, 64)))


@F.pandas_udf(T.DoubleType())
def ssim8(a: pd.Series, b: pd.Series) -> pd.Series:
    """Structural similarity of the blocks as one window each, for a peak of 255."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = _blocks(a).reshape(-1, 64), _blocks(b).reshape(-1, 64)
    mx, my = x.mean(1), y.mean(1)
    vx, vy = x.var(1), y.var(1)
    cov = (x * y).mean(1) - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return pd.Series((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2)))
