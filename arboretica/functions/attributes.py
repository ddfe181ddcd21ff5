"""The 18 attributes of a node as Columns over its sums; users may register more."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Attribute:
    """index and short name, the group of sums it reads, and its Column for pixel dimensions (px, py, pz)."""

    index: int
    name: str
    group: int
    value: Callable[[tuple[float, float, float]], Column]


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _extent(axis: str, p: float) -> Column:
    return (_d(f"max{axis}") - _d(f"min{axis}")) * p


def _moments(pd):
    """(A, Mxx, Myy, Mzz, Mxy, Myz, Mxz): area and central second moments, each pixel with its own extent."""
    a, voxel = _d("area"), pd[0] * pd[1] * pd[2]
    own = lambda c, s, p: (_d(c) - _d(s) * _d(s) / a + a / 12) * (p * p * voxel)
    mixed = lambda c, s, t, p, q: (_d(c) - _d(s) * _d(t) / a) * (p * q * voxel)
    x, y, z = pd
    return (a * voxel, own("sxx", "sx", x), own("syy", "sy", y), own("szz", "sz", z), mixed("sxy", "sx", "sy", x, y), mixed("syz", "sy", "sz", y, z), mixed("sxz", "sx", "sz", x, z))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: the formulas below would else repeat it many times in generated code."""
    return F.transform(F.array(value), use)[0]


def _inertia(pd, use: Callable[[Column], Column]) -> Column:
    """``use`` over a struct of the area ``a``, the 2-D eigenvalues ``l1 <= l2`` and the 3-D ones ``m1 <= m2 <= m3``.

    Two dimensions have the closed form, three the trigonometric formula of a symmetric matrix.
    """
    names = ("a", "xx", "yy", "zz", "xy", "yz", "xz")
    moments = F.struct(*[m.alias(n) for n, m in zip(names, _moments(pd))])

    def eigen(m: Column) -> Column:
        d = F.sqrt((m.xx - m.yy) * (m.xx - m.yy) + 4 * m.xy * m.xy)
        q = (m.xx + m.yy + m.zz) / 3
        p = F.sqrt(((m.xx - q) * (m.xx - q) + (m.yy - q) * (m.yy - q) + (m.zz - q) * (m.zz - q) + 2 * (m.xy * m.xy + m.yz * m.yz + m.xz * m.xz)) / 6)
        det = (m.xx - q) * ((m.yy - q) * (m.zz - q) - m.yz * m.yz) - m.xy * (m.xy * (m.zz - q) - m.yz * m.xz) + m.xz * (m.xy * m.yz - (m.yy - q) * m.xz)
        return F.struct(m.a.alias("a"), ((m.xx + m.yy - d) / 2).alias("l1"), ((m.xx + m.yy + d) / 2).alias("l2"), q.alias("q"), p.alias("p"), det.alias("det"))

    def angle(e: Column) -> Column:
        r = F.when(e.p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e.det / (2 * e.p * e.p * e.p)))).otherwise(F.lit(1.0))
        return F.struct(e.a.alias("a"), e.l1.alias("l1"), e.l2.alias("l2"), e.q.alias("q"), e.p.alias("p"), (F.acos(r) / 3).alias("phi"))

    def three(e: Column) -> Column:
        high, low = e.q + 2 * e.p * F.cos(e.phi), e.q + 2 * e.p * F.cos(e.phi + 2 * math.pi / 3)
        return F.struct(e.a.alias("a"), e.l1.alias("l1"), e.l2.alias("l2"), low.alias("m1"), (3 * e.q - low - high).alias("m2"), high.alias("m3"))

    return _let(moments, lambda m: _let(eigen(m), lambda e: _let(angle(e), lambda f: _let(three(f), use))))


def _by_dims(two: Column, three: Column) -> Column:
    return F.when(F.col("is3d"), three).otherwise(two)


def _elong(pd):
    return _inertia(pd, lambda e: _by_dims(e.l2 / e.l1, e.m3 / e.m2))


def _flat(pd):
    return _inertia(pd, lambda e: _by_dims(F.lit(-1.0), e.m2 / e.m1))


def _spars(pd):
    return _inertia(pd, lambda e: _by_dims(
        math.pi * F.sqrt(4 * e.l2 / e.a) * F.sqrt(4 * e.l1 / e.a) / e.a,
        math.pi * F.sqrt(20 * e.m1 / e.a) * F.sqrt(20 * e.m2 / e.a) * F.sqrt(20 * e.m3 / e.a) / (6 * e.a),
    ))


def _trace(pd):
    _, xx, yy, zz, *_ = _moments(pd)
    return _by_dims(xx + yy, xx + yy + zz)


def _ncomp(pd):
    a, xx, yy, zz, *_ = _moments(pd)
    return _by_dims((xx + yy) / (a * a), (xx + yy + zz) / F.pow(a, 5 / 3))


def _square(c: Column) -> Column:
    return c * c


ATTRIBUTES: dict[str, Attribute] = {}


def register_attribute(name: str, group: int, value: Callable[[tuple[float, float, float]], Column]) -> Attribute:
    """Add an attribute; ``value(pixel_dim)`` is a Column over the columns of a tree."""
    if name in ATTRIBUTES:
        raise ValueError(f"there is an attribute {name!r} already")
    ATTRIBUTES[name] = Attribute(len(ATTRIBUTES), name, group, value)
    return ATTRIBUTES[name]


for _name, _group, _value in (
    ("area", 0, lambda p: _d("area") * (p[0] * p[1] * p[2])),
    ("rectarea", 1, lambda p: _extent("x", p[0]) * _extent("y", p[1]) * _extent("z", p[2])),
    ("rectdiag", 1, lambda p: _square(_extent("x", p[0])) + _square(_extent("y", p[1])) + _square(_extent("z", p[2]))),
    ("xext", 1, lambda p: _extent("x", p[0])),
    ("yext", 1, lambda p: _extent("y", p[1])),
    ("zext", 1, lambda p: _extent("z", p[2])),
    ("xmean", 2, lambda p: _d("sx") / _d("area") * p[0]),
    ("ymean", 2, lambda p: _d("sy") / _d("area") * p[1]),
    ("zmean", 2, lambda p: _d("sz") / _d("area") * p[2]),
    ("xwmean", 3, lambda p: F.when(F.col("sg") != 0, _d("sgx") / F.col("sg") * p[0])),
    ("ywmean", 3, lambda p: F.when(F.col("sg") != 0, _d("sgy") / F.col("sg") * p[1])),
    ("zwmean", 3, lambda p: F.when(F.col("sg") != 0, _d("sgz") / F.col("sg") * p[2])),
    ("flux", 3, lambda p: _d("sg")),
    ("inertiatrace", 4, _trace),
    ("elong", 4, _elong),
    ("flat", 4, _flat),
    ("spars", 4, _spars),
    ("ncomp", 4, _ncomp),
):
    register_attribute(_name, _group, _value)


def attribute(which: int | str) -> Attribute:
    """The attribute of an index or a name."""
    if isinstance(which, str):
        if which not in ATTRIBUTES:
            raise ValueError(f"unknown attribute {which!r}; there are {', '.join(ATTRIBUTES)}")
        return ATTRIBUTES[which]
    for a in ATTRIBUTES.values():
        if a.index == which:
            return a
    raise ValueError(f"there is no attribute {which}")


def attribute_column(which: int | str, pixel_dim: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    return attribute(which).value(pixel_dim)


def scale_index(value: Column, lambdas: list[float]) -> Column:
    """The largest k with value >= lambdas[k], 0 below all; lambdas ascend and begin with 0."""
    out = F.lit(0)
    for k, lam in enumerate(lambdas):
        out = F.when(value >= lam, F.lit(k)).otherwise(out)
    return out


def csl_scale_index(value: Column, lambdas: list[float]) -> Column:
    """As ``scale_index``, but one past the end from the last threshold on."""
    return F.when(value >= lambdas[-1], F.lit(len(lambdas))).otherwise(scale_index(value, lambdas))


def check_lambdas(lambdas, imscale: float = 1.0) -> list[float]:
    """The thresholds divided by ``imscale``, with 0 before them; they must ascend and be positive."""
    if imscale <= 0:
        raise ValueError("imscale must be positive")
    out = [0.0, *(float(x) / imscale for x in lambdas)]
    if len(out) < 2 or any(not b > a for a, b in zip(out, out[1:])):
        raise ValueError("thresholds must be positive and ascending")
    return out
