"""Tensor voting in the plane, one slice a task.

Votes are circular convolutions with the fields w_2k = f(r) (cos 2k a + i sin 2k a), f(r) = exp(-r^2 / 2 sigma^2) / 16
without the middle, done by FFT of the whole slice; that has no relational form, so a slice is the unit of the work
(``applyInPandas``), as large as an image is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fields(ny: int, nx: int, sigma: float, hole: float, centre: float, terms: int) -> np.ndarray:
    """FFTs of the fields of order 0, 2, 4, ...: zero where r^2 < ``hole``; ``centre`` is the phase at the middle."""
    x = np.fft.fftfreq(nx, 1 / nx)[None, :]
    y = np.fft.fftfreq(ny, 1 / ny)[:, None]
    r2 = x * x + y * y
    decay = np.where(r2 < hole, 0.0, np.exp(-r2 / (2 * sigma * sigma)) / 16)
    turn = np.exp(2j * np.arctan2(y, x))
    turn[0, 0] = centre
    return np.stack([np.fft.fft2(decay * turn**k) for k in range(terms)])


def stick(saliency: np.ndarray, orient: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Saliency and orientation after stick voting."""
    w = fields(*saliency.shape, sigma, 1, 1, 5)
    total = np.zeros(saliency.shape, complex)
    for k, binomial in enumerate((1, 4, 6, 4, 1)):
        votes = saliency * np.exp(-2j * (k - 1) * orient)
        total += binomial * np.fft.ifft2(w[k] * np.fft.fft2(votes))
    return np.abs(total), 0.5 * np.angle(total)


def ball(saliency: np.ndarray, orient: np.ndarray, sigma: float) -> np.ndarray:
    """Saliency after ball voting."""
    w = fields(*saliency.shape, sigma, 3, 0, 3)
    total = np.zeros(saliency.shape)
    for k, factor in enumerate((6, 8, 2)):
        votes = saliency * np.exp(-2j * k * orient)
        total += factor * np.real(np.fft.ifft2(w[k] * np.fft.fft2(votes)))
    return total


def _dense(pdf: pd.DataFrame, columns: list[str], shape: tuple[int, int]) -> list[np.ndarray]:
    out = []
    for c in columns:
        a = np.zeros(shape)
        a[pdf["y"], pdf["x"]] = pdf[c]
        out.append(a)
    return out


def vote(df: DataFrame, sigma: float, shape: tuple[int, int], kind: str = "stick", by: tuple[str, ...] = ("z",), saliency: str = "s", orient: str = "o") -> DataFrame:
    """``by, y, x, s, o`` of every place after voting, from slices (dense or sparse) of the given shape; ``o`` is 0 for balls."""
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField(c, T.IntegerType()) for c in ("y", "x")] + [T.StructField(c, T.DoubleType()) for c in ("s", "o")])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _dense(pdf, [saliency, orient], shape)
        s, o = stick(a, b, sigma) if kind == "stick" else (ball(a, b, sigma), np.zeros(shape))
        y, x = np.indices(shape)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "s": s.ravel(), "o": o.ravel()})

    return df.select(*by, "y", "x", saliency, orient).groupBy(*by).applyInPandas(one, schema)
