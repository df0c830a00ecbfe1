"""Exact algebra of a symmetric integer matrix: characteristic polynomial, roots, eigenvectors.

All sizes here follow from the matrix's dimension alone. Numbers are whole until a component is
returned: residues modulo primes, a polynomial with whole coefficients, dyadic bounds of its roots.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, localcontext
from math import comb

import numpy as np

#: Primes stay below 2**31, so that a product of two residues fits into a signed 64-bit number.
_LARGEST = 1 << 31
_WITNESSES = (2, 3, 5, 7)


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these witnesses decide every n below 3,215,031,751."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in _WITNESSES:
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Largest primes below 2**31 whose product is more than ``bound``."""
    found, product, n = [], 1, _LARGEST - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(trace: int, size: int) -> int:
    """No coefficient of the polynomial of a positive semidefinite matrix is beyond this.

    Elementary symmetric sums of nonnegative roots of a given sum are largest where all are equal.
    """
    return max(comb(size, k) * trace**k // size**k + 1 for k in range(size + 1)) if size else 1


def polynomial_residues(matrix: Sequence[Sequence[int]], primes: Sequence[int]) -> np.ndarray:
    """det(x - matrix) modulo every prime, lowest power first: (primes, size + 1).

    All primes are worked on at once. Similarity steps bring the matrix to Hessenberg form: below a
    pivot of the subdiagonal rows are cleared and the columns get the inverse step. The polynomial
    then follows from those of the leading blocks.
    """
    p = np.array(primes, dtype=np.int64)
    size = len(matrix)
    h = np.array([[[v % q for v in row] for row in matrix] for q in primes], dtype=np.int64)
    h = h.reshape(len(primes), size, size)
    every = np.arange(len(primes))
    one, two = p[:, None], p[:, None, None]
    for k in range(size - 2):
        below = h[:, k + 1 :, k] != 0
        pivot = np.where(below.any(axis=1), below.argmax(axis=1), 0) + k + 1
        rows = h[every, pivot].copy()
        h[every, pivot] = h[:, k + 1]
        h[:, k + 1] = rows
        columns = h[every, :, pivot].copy()
        h[every, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = columns
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, k + 1, k], primes)])
        factor = h[:, k + 2 :, k] * inverse[:, None] % one
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, None, k + 1] % two) % two
        moved = (h[:, :, k + 2 :] * factor[:, None] % two).sum(axis=2)
        h[:, :, k + 1] = (h[:, :, k + 1] + moved) % one
    leading = np.zeros((len(primes), size + 1, size + 1), dtype=np.int64)
    leading[:, 0, 0] = 1
    for k in range(1, size + 1):
        grown = np.zeros((len(primes), size + 1), dtype=np.int64)
        grown[:, 1:] = leading[:, k - 1, :-1]
        weight = h[:, k - 1, k - 1].copy()
        grown -= weight[:, None] * leading[:, k - 1] % one
        chain = np.ones(len(primes), dtype=np.int64)
        for back in range(1, k):
            chain = chain * h[:, k - back, k - back - 1] % p
            weight = chain * h[:, k - back - 1, k - 1] % p
            grown -= weight[:, None] * leading[:, k - back - 1] % one
        leading[:, k] = grown % one
    return leading[:, size]


def combine(residues: np.ndarray, primes: Sequence[int]) -> list[int]:
    """The whole numbers of least absolute value with these residues (Chinese remainders)."""
    product = 1
    for q in primes:
        product *= q
    parts = [(product // q) * pow(product // q, -1, q) for q in primes]
    sums = [sum(int(r) * part for r, part in zip(column, parts)) % product for column in residues.T]
    return [s - product if 2 * s > product else s for s in sums]


def roots_above(poly: Sequence[int], numerator: int, bits: int) -> int:
    """How many roots, with multiplicity, exceed ``numerator / 2**bits``.

    The polynomial is moved there; as all its roots are real, its sign changes count exactly those
    that are positive then.
    """
    degree = len(poly) - 1
    moved = [c << bits * (degree - k) for k, c in enumerate(poly)]
    for first in range(degree):
        for k in range(degree - 1, first - 1, -1):
            moved[k] += numerator * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: Sequence[int], numerator: int, bits: int) -> int:
    value = 0
    for place, c in enumerate(reversed(poly)):
        value = value * numerator + (c << bits * place)
    return (value > 0) - (value < 0)


def isolate(poly: Sequence[int], place: int, digits: int) -> tuple[Decimal, int, int] | None:
    """The ``place``-th largest root, and the first and last place of the roots that equal it.

    Counts of roots halve an interval until one root is alone in it; from then on the polynomial's
    sign does, until the interval is below 10**-digits of the root. Roots that are still together then
    count as one repeated root. None if that root is not positive.
    """
    over_low, over_high = roots_above(poly, 0, 0), 0
    if over_low < place:
        return None
    low, high, bits = 0, 1, 0
    while roots_above(poly, high, 0):
        high *= 2
    right = 0  # the sign at the upper end, once one root is alone and does not lie there
    while (high - low) * 10**digits > low:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        if right:
            over = over_high if _sign(poly, middle, bits) in (right, 0) else over_low
        else:
            over = roots_above(poly, middle, bits)
        if over >= place:
            low, over_low = middle, over
        else:
            high, over_high, right = middle, over, 0
        if not right and over_low - over_high == 1:
            right = _sign(poly, high, bits)
    with localcontext() as context:
        context.prec = 2 * digits
        return Decimal(low + high) / 2 / Decimal(2) ** bits, over_high + 1, over_low


def component(
    matrix: Sequence[Sequence[int]], root: Decimal, order: int, digits: int
) -> list[Decimal]:
    """A unit vector of the null space of ``matrix - root``: the ``order``-th of a repeated root.

    Inverse iteration: the nearly singular system is factored once, with row exchanges, and solved
    from fixed starting vectors; the vectors of one root are made orthogonal to those before them.
    The sign is such that the entry of largest size is positive.
    """
    size = len(matrix)
    with localcontext() as context:
        context.prec = 2 * digits
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object).reshape(size, size)
        scale = max((abs(v) for v in a.ravel()), default=Decimal(1)) or Decimal(1)
        a[np.arange(size), np.arange(size)] -= root
        tiny = scale * Decimal(10) ** (-2 * digits)
        order_of = list(range(size))
        for k in range(size):
            pivot = k + int(np.argmax(np.abs(a[k:, k])))
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
                order_of[k], order_of[pivot] = order_of[pivot], order_of[k]
            if a[k, k] == 0:
                a[k, k] = tiny
            if k + 1 < size:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        found: list[np.ndarray] = []
        for turn in range(order):
            draw = np.random.RandomState(turn).randint(1, 1 << 30, size)
            v = np.array([Decimal(int(x)) for x in draw], dtype=object)
            for _ in range(3):
                v = v[order_of]
                for k in range(1, size):
                    v[k] -= a[k, :k].dot(v[:k])
                for k in range(size - 1, -1, -1):
                    rest = a[k, k + 1 :].dot(v[k + 1 :]) if k + 1 < size else 0
                    v[k] = (v[k] - rest) / a[k, k]
                for _ in range(2):
                    v = v / v.dot(v).sqrt()
                    for other in found:
                        v = v - other * other.dot(v)
                v = v / v.dot(v).sqrt()
            found.append(v)
        last = found[-1]
        return list(last if last[int(np.argmax(np.abs(last)))] > 0 else -last)
