"""Linear algebra on small matrices: numpy in Arrow batches, one matrix a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Pivots under these count as zero.
SINGULAR, RANK = 1e-12, 1e-10


def _pivoted(a: np.ndarray, tolerance: float) -> tuple[np.ndarray, int, float]:
    """Row echelon form by partial pivoting, the rank and the product of pivots with its sign."""
    a, rank, product = a.astype(float).copy(), 0, 1.0
    for c in range(a.shape[1]):
        if rank == len(a):
            break
        p = rank + int(np.argmax(np.abs(a[rank:, c])))
        if abs(a[p, c]) < tolerance:
            continue
        if p != rank:
            a[[p, rank]] = a[[rank, p]]
            product = -product
        product *= a[rank, c]
        a[rank + 1 :] -= np.outer(a[rank + 1 :, c] / a[rank, c], a[rank])
        rank += 1
    return a, rank, product


def _square(a: np.ndarray, what: str) -> int:
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"{what} requires a square matrix")
    return len(a)


def det(a: np.ndarray) -> float:
    n = _square(a, "determinant")
    _, rank, product = _pivoted(a, SINGULAR)
    return product if rank == n else 0.0


def rank(a: np.ndarray) -> float:
    return float(_pivoted(a, RANK)[1])


def inv(a: np.ndarray) -> np.ndarray:
    if _pivoted(a, SINGULAR)[1] < _square(a, "inverse"):
        raise ValueError("matrix is singular")
    return np.linalg.inv(a)


def pinv(a: np.ndarray) -> np.ndarray:
    """By the normal equations, added up in row order; two unknowns by Cramer's rule. Rank-deficient matrices are an error."""
    if a.shape[0] < a.shape[1]:
        return pinv(a.T).T
    gram = np.zeros((a.shape[1], a.shape[1]))
    for row in a:
        gram += np.outer(row, row)
    if len(gram) != 2:
        return inv(gram) @ a.T
    if _pivoted(gram, SINGULAR)[1] < 2:
        raise ValueError("matrix is singular")
    (p, q), (_, s) = gram
    x, y = a.T
    return np.array([s * x - q * y, p * y - q * x]) / (p * s - q * q)


def power(a: np.ndarray, p: int) -> np.ndarray:
    _square(a, "power")
    if p < 0 or p != int(p):
        raise ValueError("matrix power needs a whole exponent that isn't negative")
    return np.linalg.matrix_power(a, int(p))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in falling order and vectors as columns, by at most 128 QR steps; true vectors for symmetric input only."""
    n = _square(a, "eigenvalues")
    a, v = a.astype(float), np.eye(n)
    for _ in range(128 if n > 1 else 0):
        q, r = np.linalg.qr(a)
        sign = np.where(np.diag(r) < 0, -1.0, 1.0)
        if np.abs(np.diag(r)).min() < SINGULAR:
            raise ValueError("no eigenvalues: a zero pivot in a QR step")
        q, r = q * sign, sign[:, None] * r
        a, v = r @ q, v @ q
        if np.abs(a - np.diag(np.diag(a))).sum() < 1e-10:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


def _udf(f: Callable[[np.ndarray], object], kind: str) -> Callable[[Column], Column]:
    def run(column):
        def apply(s: pd.Series) -> pd.Series:
            return pd.Series([None if m is None else f(np.array([np.asarray(r, float) for r in m])) for m in s])

        def shaped(s: pd.Series) -> pd.Series:
            out = apply(s)
            return out.map(lambda x: x.tolist() if isinstance(x, np.ndarray) else x)

        shaped.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return F.pandas_udf(shaped, kind)(column)

    return run


det_col = _udf(det, "double")
rank_col = _udf(rank, "double")
inv_col = _udf(inv, "array<array<double>>")
pinv_col = _udf(pinv, "array<array<double>>")
eigenvalues_col = _udf(lambda a: eigen(a)[0], "array<double>")
eigenvectors_col = _udf(lambda a: eigen(a)[1], "array<array<double>>")


def power_col(m: Column, p: int) -> Column:
    return _udf(lambda a: power(a, p), "array<array<double>>")(m)
