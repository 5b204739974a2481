"""Interpolating B-splines with centripetal parameters, in numpy."""

from __future__ import annotations

import numpy as np


def centripetal(points: np.ndarray, exponent: float = 0.5) -> np.ndarray:
    """Parameters from 0 to 1 by running sums of step lengths to a power; evenly spaced if all points are one."""
    step = np.linalg.norm(np.diff(points, axis=0), axis=-1) ** exponent
    if step.sum() == 0:
        return np.linspace(0, 1, len(points))
    return np.concatenate([[0.0], np.cumsum(step) / step.sum()])


def knot_vector(t: np.ndarray, degree: int) -> np.ndarray:
    """Zeros, the means of ``degree`` inner parameters in a row, ones."""
    inner = [t[k : k + degree].mean() for k in range(1, len(t) - degree)]
    return np.concatenate([np.zeros(degree + 1), inner, np.ones(degree + 1)])


def basis(u: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Values of all basis functions at each ``u``, by the recursion of Cox and de Boor."""
    u = np.atleast_1d(np.asarray(u, float))
    n = len(knots) - 1
    b = np.zeros((len(u), n))
    last = np.searchsorted(knots, knots[-1]) - 1
    at = np.clip(np.searchsorted(knots, u, side="right") - 1, 0, last)
    b[np.arange(len(u)), at] = 1
    for d in range(1, degree + 1):
        new = np.zeros((len(u), n - d))
        for k in range(n - d):
            left, right = knots[k + d] - knots[k], knots[k + d + 1] - knots[k + 1]
            if left > 0:
                new[:, k] += (u - knots[k]) / left * b[:, k]
            if right > 0:
                new[:, k] += (knots[k + d + 1] - u) / right * b[:, k + 1]
        b = new
    return b


class Curve:
    """A curve through points in order; its degree is lowered where there are too few of them."""

    def __init__(self, points: np.ndarray, degree: int = 2):
        points = np.asarray(points, float)
        if len(points) <= 1:
            raise ValueError("a curve needs two points or more")
        self.degree = min(degree, len(points) - 1)
        t = centripetal(points)
        self.knots = knot_vector(t, self.degree)
        self.control = np.linalg.lstsq(basis(t, self.knots, self.degree), points, rcond=None)[0]

    def __call__(self, u: np.ndarray) -> np.ndarray:
        return basis(u, self.knots, self.degree) @ self.control


class Surface:
    """A surface through a net of points (rows, columns, coordinates)."""

    def __init__(self, net: np.ndarray, degree: int = 2):
        net = np.asarray(net, float)
        if min(net.shape[:2]) <= 1:
            raise ValueError("a surface needs two rows and two columns or more")
        self.degrees = [min(degree, n - 1) for n in net.shape[:2]]
        t = [np.mean([centripetal(line) for line in lines], axis=0) for lines in (net.transpose(1, 0, 2), net)]
        self.knots = [knot_vector(p, d) for p, d in zip(t, self.degrees, strict=True)]
        a, b = (np.linalg.pinv(basis(p, k, d)) for p, k, d in zip(t, self.knots, self.degrees, strict=True))
        self.control = np.einsum("ui,ijc,vj->uvc", a, net, b)

    def __call__(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        a, b = (basis(p, k, d) for p, k, d in zip((u, v), self.knots, self.degrees, strict=True))
        return np.einsum("iu,uvc,jv->ijc", a, self.control, b)

    def area(self, n: int = 64) -> float:
        """The area, as that of the triangles of an evenly spaced net."""
        p = self(np.linspace(0, 1, n), np.linspace(0, 1, n))
        a, b, c, d = p[:-1, :-1], p[1:, :-1], p[:-1, 1:], p[1:, 1:]
        half = lambda q, r, s: np.linalg.norm(np.cross(r - q, s - q), axis=-1).sum() / 2
        return float(half(a, b, c) + half(d, b, c))


def wire_length(points: np.ndarray) -> float:
    return float(np.linalg.norm(np.diff(np.asarray(points, float), axis=0), axis=-1).sum())
