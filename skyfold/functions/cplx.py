"""Complex numbers as pairs of double Columns, and 1, 2 or 2 x 2 matrices of them.

Spark has no complex type; at rest a number is ``struct<re: double, im: double>``.
Expressions stay in whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Complex:
    re: Column
    im: Column

    def __add__(self, o: Complex) -> Complex:
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Complex) -> Complex:
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Complex) -> Complex:
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __neg__(self) -> Complex:
        return Complex(-self.re, -self.im)

    def scale(self, x: Column | float) -> Complex:
        return Complex(self.re * x, self.im * x)

    def conj(self) -> Complex:
        return Complex(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def over(self, o: Complex) -> Complex:
        """Quotient; null where the divisor is zero."""
        n = o.abs2()
        p = self * o.conj()
        return Complex(F.try_divide(p.re, n), F.try_divide(p.im, n))

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))


def real(x: Column | float) -> Complex:
    return Complex(x if isinstance(x, Column) else F.lit(float(x)), F.lit(0.0))


def imag(x: Column | float) -> Complex:
    return Complex(F.lit(0.0), x if isinstance(x, Column) else F.lit(float(x)))


def col(name: str | Column) -> Complex:
    """Complex number of a struct column."""
    c = F.col(name) if isinstance(name, str) else name
    return Complex(c["re"], c["im"])


def expi(phase: Column) -> Complex:
    """exp(i * phase)"""
    return Complex(F.cos(phase), F.sin(phase))


Matrix = Sequence[Complex]  # 1 (scalar), 2 (diagonal) or 4 (row-major 2 x 2) numbers


def entries(column: Column, n: int) -> list[Complex]:
    """The first ``n`` numbers of an array of complex structs."""
    return [col(F.get(column, F.lit(i))) for i in range(n)]


def hermitian(a: Matrix) -> list[Complex]:
    if len(a) == 4:
        return [a[0].conj(), a[2].conj(), a[1].conj(), a[3].conj()]
    return [x.conj() for x in a]


def matmul(a: Matrix, b: Matrix) -> list[Complex]:
    """Product of scalars, diagonals and full matrices; the larger form results."""
    if len(a) == 1 or len(b) == 1:
        s, m = (a[0], b) if len(a) == 1 else (b[0], a)
        return [s * x for x in m]
    if len(a) == 2 and len(b) == 2:
        return [a[0] * b[0], a[1] * b[1]]
    if len(a) == 2:
        return [a[0] * b[0], a[0] * b[1], a[1] * b[2], a[1] * b[3]]
    if len(b) == 2:
        return [a[0] * b[0], a[1] * b[1], a[2] * b[0], a[3] * b[1]]
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]


def inverse(a: Matrix) -> list[Complex]:
    """Inverse; null entries where the matrix is singular."""
    if len(a) < 4:
        one = real(1.0)
        return [one.over(x) for x in a]
    det = a[0] * a[3] - a[1] * a[2]
    return [a[3].over(det), (-a[1]).over(det), (-a[2]).over(det), a[0].over(det)]


def jones_multiply(left: Matrix | None, mid: Matrix, right: Matrix | None) -> list[Complex]:
    """left . mid . right^H; with two correlations all three are diagonals."""
    out = list(mid)
    if left is not None:
        out = matmul(left, out)
    if right is not None:
        out = matmul(out, hermitian(right))
    return out
