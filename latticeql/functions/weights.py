"""Weights of finite-difference, interpolation, prolongation and integration formulas, solved exactly from their moment
conditions in rational arithmetic. A row of weights is a dict from offset to Fraction."""

from __future__ import annotations

from fractions import Fraction
from math import factorial, lcm


def solve(matrix: list, right: list) -> list:
    """The solution of a small regular linear system, exact."""
    rows = [[Fraction(x) for x in r] + [Fraction(y)] for r, y in zip(matrix, right, strict=True)]
    n = len(rows)
    for c in range(n):
        p = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [r[-1] for r in rows]


def derivative(points: list, order: int, at: Fraction = Fraction(0)) -> dict:
    """Weights of the derivative of an order at a place, exact for polynomials through all the points."""
    n = len(points)
    matrix = [[(Fraction(p) - at) ** m for p in points] for m in range(n)]
    found = solve(matrix, [factorial(order) if m == order else 0 for m in range(n)])
    return {p: w for p, w in zip(points, found, strict=True) if w}


def centred(accuracy: int, order: int) -> dict:
    h = accuracy // 2
    return derivative(list(range(-h, h + 1)), order)


def upwind(accuracy: int) -> dict:
    """The first derivative for a positive velocity: the stencil leans one point forward; mirrored for a negative one."""
    h = accuracy // 2
    return derivative(list(range(1 - h, h + 2)), 1)


def dissipation(accuracy: int) -> dict:
    """Kreiss-Oliger dissipation: the even difference of order accuracy + 2, over 2 to that power."""
    n = accuracy + 2
    row, sign = [1], -1 if n % 4 == 0 else 1
    for _ in range(n):
        row = [a - b for a, b in zip([*row, 0], [0, *row], strict=True)]
    return {k - n // 2: Fraction(sign * w, 2**n) for k, w in enumerate(row)}


def between(points: int) -> dict:
    """Interpolation to the middle between coarse vertices 0 and 1 from so many vertices around it."""
    return derivative(list(range(1 - points // 2, points // 2 + 1)), 0, Fraction(1, 2))


def cell_left(order: int) -> dict:
    """Interpolation of point values at cell centres to the left child's centre, at -1/4."""
    first = -((order + 1) // 2)
    return derivative(list(range(first, first + order + 1)), 0, Fraction(-1, 4))


def average_left(order: int, first: int | None = None) -> dict:
    """Conservative prolongation: the average over the left half of a cell from cell averages."""
    first = -((order + 1) // 2) if first is None else first
    cells, half = list(range(first, first + order + 1)), Fraction(1, 2)

    def mean(m: int, a: Fraction, b: Fraction) -> Fraction:
        return (b ** (m + 1) - a ** (m + 1)) / ((m + 1) * (b - a))

    matrix = [[mean(m, c - half, c + half) for c in cells] for m in range(order + 1)]
    found = solve(matrix, [mean(m, -half, Fraction(0)) for m in range(order + 1)])
    return {c: w for c, w in zip(cells, found, strict=True) if w}


def mirrored(row: dict, sign: int = 1) -> dict:
    return {-k: sign * w for k, w in row.items()}


def product(*rows: dict) -> dict:
    """The tensor product of rows, one for each axis."""
    out = {(): Fraction(1)}
    for row in rows:
        out = {(*k, o): w * v for k, w in out.items() for o, v in row.items()}
    return out


def whole(row: dict) -> tuple[dict, int]:
    """(integer weights, their common denominator)."""
    den = lcm(1, *(Fraction(w).denominator for w in row.values()))
    return {k: int(w * den) for k, w in row.items()}, den


def lobatto(n: int) -> list:
    """The n Gauss-Lobatto nodes on [-1, 1]: the ends and the roots of the Legendre polynomial's derivative."""
    import numpy as np

    inner = np.polynomial.legendre.Legendre.basis(n - 1).deriv().roots() if n > 2 else np.zeros(0)
    inner = np.sort(np.real(inner))
    return [-1.0, *((inner - inner[::-1]) / 2).tolist(), 1.0]


def collocation(n: int) -> list:
    """The matrix of derivatives at the Gauss-Lobatto nodes from values there, by barycentric weights."""
    from math import prod

    x = lobatto(n)
    w = [1 / prod(a - b for b in x if b != a) for a in x]
    rows = [[w[q] / w[p] / (x[p] - x[q]) if p != q else 0.0 for q in range(n)] for p in range(n)]
    for p, row in enumerate(rows):
        row[p] = -sum(row)
    return rows
