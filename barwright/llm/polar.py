"""Leading eigenvectors of a small symmetric matrix by spectral divide and conquer over polar decompositions.

The polar factor U of A - s I maps eigenvectors above the shift s to +1 and those below to -1, so (U + I) / 2 projects on the space of
the larger eigenvalues. An orthonormal basis of that space and of its complement cuts A in two blocks, and each block is cut again until it
has one or two rows. U comes from the QR-based dynamically weighted Halley iteration, which takes about six steps at any condition number.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
SEED = 20240607


def polar(a: np.ndarray) -> np.ndarray | None:
    """Orthogonal polar factor of a symmetric matrix; None where the matrix is singular to working precision."""
    d = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))  # at most the smallest singular value
    except np.linalg.LinAlgError:
        return None
    if not low > EPS:
        return None
    eye = np.eye(d)
    for _ in range(40):
        square = low * low
        g = np.cbrt(4 * (1 - square) / square ** 2)
        h = np.sqrt(1 + g) + 0.5 * np.sqrt(8 - 4 * g + 8 * (2 - square) / (square * np.sqrt(1 + g)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = b / c * x + (h - b / c) / np.sqrt(c) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (h + b * square) / (1 + c * square))
        step, x = np.linalg.norm(new - x), new
        if step <= np.cbrt(EPS) and 1 - low <= 10 * EPS:
            return x
    return x


def _shifts(a: np.ndarray) -> list[float]:
    mean = float(np.trace(a)) / len(a)
    spread = float(np.linalg.norm(a - mean * np.eye(len(a)))) / np.sqrt(len(a))
    return [float(np.median(np.diag(a))), mean] + [mean + t * spread for k in range(1, 10) for t in (k / 10, -k / 10)]


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant spaces above and below a shift; None where no shift separates eigenvalues."""
    d, best, least = len(a), None, np.inf
    start = np.random.default_rng(SEED).standard_normal((d, d))
    for shift in _shifts(a):
        u = polar(a - shift * np.eye(d)) if np.any(a != shift * np.eye(d)) else None
        if u is None:
            continue
        above = (u + np.eye(d)) / 2
        k = int(round(float(np.trace(above))))
        if not 0 < k < d or abs(np.trace(above) - k) > 0.01:
            continue
        q, _ = np.linalg.qr(above @ start[:, :k])
        q, _ = np.linalg.qr(above @ q, mode="complete")
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if left < least:
            best, least = (q[:, :k], q[:, k:]), left
        if left <= 10 * EPS * np.sqrt(d) * scale:
            break
    return best


def leading(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues in falling order and their unit eigenvectors as columns. A zero matrix gives unit vectors."""
    a = (a + a.T) / 2
    d = len(a)
    scale = float(np.linalg.norm(a))
    found: list[np.ndarray] = []
    parts = [np.eye(d)]  # the space of the largest eigenvalues is on top
    while parts and sum(f.shape[1] for f in found) < want:
        basis = parts.pop()
        b = basis.T @ a @ basis
        b = (b + b.T) / 2
        k = len(b)
        if k == 2 and b[0, 1]:
            turn = (b[1, 1] - b[0, 0]) / (2 * b[0, 1])
            t = (1.0 if turn >= 0 else -1.0) / (abs(turn) + np.hypot(turn, 1.0))
            c = 1 / np.hypot(t, 1.0)
            found.append(basis @ np.array([[c, t * c], [-t * c, c]]))
            continue
        off = np.linalg.norm(b - np.diag(np.diag(b)))
        cut = None if k == 1 or off <= EPS * scale else split(b, scale)
        if cut is None:
            found.append(basis)
        else:
            parts += [basis @ cut[1], basis @ cut[0]]
    vectors = np.hstack(found)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors, optimize=True)
    order = np.argsort(-values, kind="stable")[:want]
    return values[order], vectors[:, order]
