"""Right singular vectors of a small matrix: Householder bidiagonal form, dqds, twisted factorisations.

These run on the driver over the d x d triangle that remains of a table of
vectors; its size depends on the vectors' length alone.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 2.0 ** -52
TINY = 2.0 ** -1000


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): diagonal and superdiagonal of u' r v = B, and the orthogonal v,
    by Householder reflections from the left and the right in turn."""
    m = np.array(r, float)
    d = m.shape[1]
    v = np.eye(d)

    def reflector(x):
        norm = np.linalg.norm(x)
        if norm == 0.0:
            return None
        h = x.copy()
        h[0] += math.copysign(norm, x[0])
        return h / np.linalg.norm(h)

    for k in range(d):
        h = reflector(m[k:, k])
        if h is not None:
            m[k:, k:] -= 2.0 * np.outer(h, h @ m[k:, k:])
        if k + 2 <= d - 1:
            h = reflector(m[k, k + 1:])
            if h is not None:
                m[k:, k + 1:] -= 2.0 * np.outer(m[k:, k + 1:] @ h, h)
                v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ h, h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float):
    """One differential qd transform with a shift: (q, e, None) or, where an entry
    turns negative, (None, None, (its index, its value))."""
    n = len(q)
    q2, e2 = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return None, None, (i, d)
        q2[i] = d + e[i]
        t = q[i + 1] / q2[i] if q2[i] > 0.0 else 0.0
        e2[i] = e[i] * t
        d = d * t - shift
    if d < 0.0:
        return None, None, (n - 1, d)
    q2[-1] = d
    return q2, e2, None


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A safe shift: one over the trace of the inverse, from a transform without shift."""
    d, inverse = q[0], 0.0
    for i in range(len(q)):
        if d <= 0.0:
            return 0.0
        inverse += 1.0 / d
        if i < len(e):
            d *= q[i + 1] / (d + e[i])
    return (1.0 - 4 * len(q) * EPS) / inverse


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal matrix whose squared diagonal is
    ``q`` and whose squared superdiagonal is ``e``, each to high relative accuracy."""
    out: list[float] = []
    blocks = [(list(q), list(e), 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        while q:
            n = len(q)
            if n == 1:
                out.append(base + q[0])
                break
            cut = next((i for i in range(n - 1) if e[i] <= EPS * EPS * (base + min(q[i], q[i + 1])) or e[i] < TINY), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] < q[-1]:  # the least values belong at the end
                q, e = q[::-1], e[::-1]
            a, c = q[-2] + (e[-2] if n > 2 else 0.0), q[-1] + e[-1]
            off = q[-2] * e[-1]
            half = (a - c) / 2.0
            guess = c - off / (half + math.copysign(math.sqrt(half * half + off), half)) if off > 0.0 else min(a, c)
            safe = _lower_bound(q, e)
            shift = max(safe, guess * (1.0 - 8 * EPS)) if guess > 0.0 else safe
            q2, e2, failed = _sweep(q, e, shift)
            if failed and failed[0] == n - 1 and shift + failed[1] > safe:
                shift += failed[1]
                shift *= 1.0 - 8 * EPS
                q2, e2, failed = _sweep(q, e, shift)
            while failed and safe > 0.0:
                shift, safe = safe, (safe / 2.0 if safe > TINY else 0.0)
                q2, e2, failed = _sweep(q, e, shift)
            if failed:
                shift = 0.0
                q2, e2, _ = _sweep(q, e, 0.0)
            q, e, base = q2, e2, base + shift
    return sorted(out, reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, lam: float) -> tuple[np.ndarray, list[float], list[float], list[float]]:
    """Twisted factorisations of B'B - lam: the size of each possible twist, and the
    multipliers of the factorisations from the top and from the bottom."""
    n = len(a)
    q, e, t = a * a, b * b, a[:-1] * b
    floor = EPS * EPS * max(float(q.max()), float(e.max()) if n > 1 else 0.0, TINY)
    up, down, s, p = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    s[0], p[-1] = -lam, q[-1] - lam
    for i in range(n - 1):
        d = s[i] + q[i]
        d = d if abs(d) > floor else math.copysign(floor, d)
        up[i] = t[i] / d
        s[i + 1] = e[i] * (s[i] / d) - lam
    for i in range(n - 2, -1, -1):
        d = p[i + 1] + e[i]
        d = d if abs(d) > floor else math.copysign(floor, d)
        down[i] = t[i] / d
        p[i] = p[i + 1] * (q[i] / d) - lam
    return np.abs(np.array(s) + np.array(p) + lam), s, up, down


def _solved(k: int, n: int, up: list[float], down: list[float]) -> np.ndarray:
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _vector(a: np.ndarray, b: np.ndarray, lam: float, near: list[np.ndarray]) -> np.ndarray:
    """The unit vector of ``lam`` from the twist of the least size. Beside vectors of
    nearly the same value (``near``) it is made orthogonal; if little of it is left, the
    next twist is taken."""
    sizes, _, up, down = _twisted(a, b, lam)
    best, kept = None, -1.0
    for k in np.argsort(sizes, kind="stable"):
        z = _solved(int(k), len(a), up, down)
        if not np.isfinite(z).all():
            continue
        rest = z.copy()
        for _ in range(2):
            for other in near:
                rest -= (other @ rest) * other
        left = float(np.linalg.norm(rest))
        if left > kept:
            best, kept = rest / left if left > 0 else z, left
        if left > 0.5:
            break
    return best


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all squared singular values of ``r``, falling; the right singular vectors, as
    columns, of the first ``k`` that are not zero to working precision)."""
    d = r.shape[1]
    scale = float(np.abs(r).max()) if r.size else 0.0
    if scale == 0.0:
        return np.zeros(d), np.zeros((d, 0))
    a, b, v = bidiagonal(r / scale)
    cuts = [i + 1 for i in range(d - 1) if b[i] == 0.0 or b[i] * b[i] <= EPS * EPS * abs(a[i] * a[i + 1])]
    found: list[tuple[float, int, int]] = []
    for low, high in zip([0, *cuts], [*cuts, d], strict=True):
        found += [(lam, low, high) for lam in dqds((a[low:high] ** 2).tolist(), (b[low:high - 1] ** 2).tolist())]
    found.sort(key=lambda f: -f[0])
    values = np.array([f[0] for f in found])
    vectors: list[tuple[float, int, np.ndarray]] = []
    for lam, low, high in found[:k]:
        if lam <= (64 * d * EPS) ** 2 * values[0]:
            break
        near = [z for other, at, z in vectors if at == low and other - lam <= 1e-3 * lam]
        vectors.append((lam, low, _vector(a[low:high], b[low:high - 1], lam, near)))
    out = np.zeros((d, len(vectors)))
    for j, (_, low, z) in enumerate(vectors):
        out[low:low + len(z), j] = z
    return values * scale * scale, v @ out
