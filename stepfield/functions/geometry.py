"""Simplex geometry on lists of scalar columns (H-05 … H-09, H-25, H-27).

A point is a list of columns, a simplex a list of points; every result is a plain expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfield.functions.vec import total


def sub(a, b):
    return [x - y for x, y in zip(a, b)]


def inner(a, b) -> Column:
    return total(x * y for x, y in zip(a, b))


def length(a) -> Column:
    return F.sqrt(inner(a, a))


def cross3(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def det(m) -> Column:
    """Determinant of a small square matrix, by expansion along the first row."""
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    out = None
    for j, x in enumerate(m[0]):
        term = x * det([[v for k, v in enumerate(row) if k != j] for row in m[1:]])
        out = term if out is None else (out - term if j % 2 else out + term)
    return out


def over(a, b) -> Column:
    """Quotient, NULL for a zero divisor."""
    return a / F.nullif(b, F.lit(0.0))


def signed_volume(verts) -> Column:
    """Determinant of the edges from the first vertex, over d!."""
    return det([sub(v, verts[0]) for v in verts[1:]]) / float(math.factorial(len(verts) - 1))


def volume(verts) -> Column:
    return F.abs(signed_volume(verts))


def bary(p, verts) -> list[Column]:
    """Barycentric coordinates as ratios of signed volumes."""
    whole = signed_volume(verts)
    return [over(signed_volume([p if i == k else v for i, v in enumerate(verts)]), whole) for k in range(len(verts))]


def inverse(m) -> list[list[Column]]:
    """Inverse of a small matrix by its cofactors; NULL entries for a singular one."""
    n, whole = len(m), det(m)
    if n == 1:
        return [[over(F.lit(1.0), whole)]]

    def minor(i, j):
        return det([[x for c, x in enumerate(row) if c != j] for k, row in enumerate(m) if k != i])

    return [[over(minor(j, i) * (1.0 if (i + j) % 2 == 0 else -1.0), whole) for j in range(n)] for i in range(n)]


def tri_area(a, b, c) -> Column:
    """Area of a triangle in two or three dimensions."""
    u, v = sub(b, a), sub(c, a)
    if len(u) == 2:
        return F.abs(u[0] * v[1] - u[1] * v[0]) / 2.0
    return length(cross3(u, v)) / 2.0


def _facets(verts) -> list[Column]:
    """Size of the face opposite to each vertex."""
    d = len(verts) - 1
    others = [[v for i, v in enumerate(verts) if i != k] for k in range(d + 1)]
    if d == 1:
        return [F.lit(1.0), F.lit(1.0)]
    if d == 2:
        return [length(sub(o[1], o[0])) for o in others]
    return [tri_area(*o) for o in others]


def in_radius(verts) -> Column:
    return over((len(verts) - 1.0) * volume(verts), total(_facets(verts)))


def in_centre(verts) -> list[Column]:
    w = _facets(verts)
    return [over(total(a * v[i] for a, v in zip(w, verts)), total(w)) for i in range(len(verts) - 1)]


def circum_radius(verts) -> Column:
    """From the edge products; a flat simplex gives NULL."""
    d = len(verts) - 1
    return radius_of(edge_products(lambda i, j: length(sub(verts[i], verts[j])), d), volume(verts), d)


def edge_products(edge, dim: int) -> list[Column]:
    """What the circumscribed radius needs of the edge lengths ``edge(i, j)``, i < j: in three dimensions the products of
    opposite edges, in two the product of all, in one the length."""
    if dim == 1:
        return [edge(0, 1)]
    if dim == 2:
        return [edge(0, 1) * edge(1, 2) * edge(0, 2)]
    return [edge(0, 1) * edge(2, 3), edge(0, 2) * edge(1, 3), edge(0, 3) * edge(1, 2)]


def radius_of(products: list[Column], volume, dim: int) -> Column:
    if dim == 1:
        return products[0] / 2.0
    if dim == 2:
        return over(products[0], 4.0 * volume)
    p, q, r = products
    square = (p + q + r) * (p + q - r) * (p - q + r) * (q + r - p)
    return over(F.sqrt(F.greatest(square, F.lit(0.0))), 24.0 * volume)


def shell_size(verts) -> Column:
    """Sum of the sizes of all faces."""
    return total(_facets(verts))


def circum_centre(verts) -> list[Column]:
    """Cramer's rule on the perpendicular bisectors."""
    d = len(verts) - 1
    rows = [sub(v, verts[0]) for v in verts[1:]]
    half = [inner(r, r) / 2.0 for r in rows]
    whole = det(rows)
    out = []
    for k in range(d):
        swapped = [[half[i] if j == k else x for j, x in enumerate(r)] for i, r in enumerate(rows)]
        out.append(verts[0][k] + over(det(swapped), whole))
    return out


def quality(verts) -> Column:
    """d · in-radius / circum-radius: 1 for a regular simplex, 0 for a flat one."""
    d = len(verts) - 1
    return _quality(volume(verts), in_radius(verts), circum_radius(verts), d)


def quality_of(volume: str, shell: str, products: list[Column], dim: int) -> Column:
    """``quality`` from columns with the volume, ``shell_size`` and ``edge_products``."""
    v = F.col(volume)
    return _quality(v, over(dim * 1.0 * v, F.col(shell)), radius_of(products, v, dim), dim)


def _quality(volume, inner_radius, outer_radius, dim: int) -> Column:
    ratio = F.abs(dim * 1.0 * inner_radius / outer_radius)
    return F.when(volume == 0, F.lit(0.0)).otherwise(F.when(outer_radius == 0, F.lit(0.0)).otherwise(ratio))


def clamp(x, lo=-1.0, hi=1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def angle(u, v) -> Column:
    """Angle in radians; NULL when a vector is zero."""
    n = length(u) * length(v)
    return F.when(n > 0, F.acos(clamp(inner(u, v) / n)))


def tri_angles(a, b, c) -> list[Column]:
    """Inner angles in degrees at a, b, c."""
    return [F.degrees(angle(sub(b, a), sub(c, a))), F.degrees(angle(sub(a, b), sub(c, b))),
            F.degrees(angle(sub(a, c), sub(b, c)))]


def solid_angle(o, a, b, c) -> Column:
    """Unsigned solid angle of triangle abc seen from o; 0 for a degenerate view."""
    u, v, w = sub(a, o), sub(b, o), sub(c, o)
    la, lb, lc = length(u), length(v), length(w)
    ab, bc, ca = inner(u, v), inner(v, w), inner(w, u)
    num = la * lb * lc + ab * lc + bc * la + ca * lb
    den2 = 2.0 * (la * lb + ab) * (lb * lc + bc) * (lc * la + ca)
    return F.when(den2 > 0, 2.0 * F.acos(clamp(num / F.sqrt(F.abs(den2))))).otherwise(F.lit(0.0))


def face_normal(verts, k: int) -> list[Column]:
    """Face vector (length = face size) opposite to vertex k, pointing away from it."""
    d = len(verts) - 1
    o = [v for i, v in enumerate(verts) if i != k]
    if d == 3:
        n = [x / 2.0 for x in cross3(sub(o[1], o[0]), sub(o[2], o[0]))]
    elif d == 2:
        e = sub(o[1], o[0])
        n = [e[1], -e[0]]
    else:
        n = [F.lit(1.0)]
    sign = F.when(inner(n, sub(verts[k], o[0])) > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [x * sign for x in n]


# Body levels: positive inside, negative outside, zero on the surface.

def in_box(p, low, high) -> Column:
    """1 at the centre, falling to 0 at the nearest wall, relative to the half widths."""
    rel = [F.abs(x - (a + b) / 2.0) / abs((b - a) / 2.0) for x, a, b in zip(p, low, high)]
    return 1.0 - (F.greatest(*rel) if len(rel) > 1 else rel[0])


def in_ellipsoid(p, radii) -> Column:
    return 1.0 - total((x / float(r)) * (x / float(r)) for x, r in zip(p, radii))


def _along(p, c1, c2):
    """Fraction of the way from c1 to c2, and the level of the two end planes."""
    axis = [float(b) - float(a) for a, b in zip(c1, c2)]
    t = total(a * (x - float(c)) for a, x, c in zip(axis, p, c1)) / sum(a * a for a in axis)
    return axis, t, 1.0 - 2.0 * F.abs(t - 0.5)


def in_frustum(p, c1, r1, c2, r2) -> Column:
    """Frustum with end centres c1, c2 and radii r1, r2; covers cone and cylinder."""
    axis, t, ends = _along(p, c1, c2)
    off = length([x - float(c) - a * t for x, c, a in zip(p, c1, axis)])
    return F.least(ends, float(r1) + (float(r2) - float(r1)) * t - off)


def in_helix(p, c1, spiral, c2, tube) -> Column:
    """Four turns around the axis c1 to c2 in the x-y directions; spiral and tube radius shrink to 0."""
    axis, t, ends = _along(p, c1, c2)
    left = 1.0 - t
    turn = 8.0 * math.pi * t
    offset = [F.cos(turn), F.sin(turn), F.lit(0.0)]
    away = [x - (float(c) + a * t + float(spiral) * left * o) for x, c, a, o in zip(p, c1, axis, offset)]
    return F.least(ends, (float(tube) * left) * (float(tube) * left) - inner(away, away))


def either(*levels) -> Column:
    return F.greatest(*levels)


def both(*levels) -> Column:
    return F.least(*levels)


def without(a, b) -> Column:
    return F.least(a, -b)
