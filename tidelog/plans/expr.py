"""Predicate language: an expression tree with two-valued null logic, compiled to Column.

A filter cannot tell NULL from FALSE, so ``to_filter`` emits plain comparisons (they push down to
Parquet) and moves every NOT to the leaves, where the rows with nulls are added back explicitly.
``to_bool`` is for projection: never NULL.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"GT": "LE", "GE": "LT", "LT": "GE", "LE": "GT"}


class Expr:
    """Base of all nodes; use ``& | ~`` and ``.isin``: Python's and/or/not/in cannot be overloaded."""

    def __bool__(self):
        raise TypeError("a predicate has no truth value here; combine with & | ~ and use .isin()")

    __hash__ = object.__hash__

    def __eq__(self, other):  # type: ignore[override]
        return IsNull(self) if other is None else Bin("EQ", self, wrap(other))

    def __ne__(self, other):  # type: ignore[override]
        return Not(IsNull(self)) if other is None else Bin("NEQ", self, wrap(other))

    def __gt__(self, other):
        return Bin("GT", self, wrap(other))

    def __ge__(self, other):
        return Bin("GE", self, wrap(other))

    def __lt__(self, other):
        return Bin("LT", self, wrap(other))

    def __le__(self, other):
        return Bin("LE", self, wrap(other))

    def __and__(self, other):
        return Bin("AND", self, wrap(other))

    __rand__ = __and__

    def __or__(self, other):
        return Bin("OR", self, wrap(other))

    __ror__ = __or__

    def __invert__(self):
        return Not(self)

    def is_null(self):
        return IsNull(self)

    def is_not_null(self):
        return Not(IsNull(self))

    def isin(self, box):
        """Membership: list/tuple/set, range, (lo, hi) as ``between``, dict keys, or another column."""
        return In(self, box)

    def notin(self, box):
        return Not(In(self, box))

    def between(self, lo, hi):
        return In(self, Between(lo, hi))

    def startswith(self, s):
        return Text("startswith", self, wrap(s))

    def endswith(self, s):
        return Text("endswith", self, wrap(s))

    def contains(self, s):
        return Text("contains", self, wrap(s))


class Lit(Expr):
    def __init__(self, value: Any):
        self.value = value


class Col(Expr):
    """A column; ``Col("a.b")`` reads a nested field."""

    def __init__(self, name: str):
        self.name = name


class Param(Expr):
    """A captured value, bound when the query is compiled."""

    def __init__(self, name: str):
        self.name = name


class Bin(Expr):
    def __init__(self, op, left, right):
        self.op, self.left, self.right = op, left, right


class Not(Expr):
    def __init__(self, arg):
        self.arg = arg


class IsNull(Expr):
    def __init__(self, arg):
        self.arg = arg


class Between:
    def __init__(self, lo, hi):
        self.lo, self.hi = lo, hi


class In(Expr):
    """kind: "array", "map" or "string" if the container is a column; found from the value otherwise."""

    def __init__(self, arg, box, kind: str | None = None):
        self.arg, self.box, self.kind = arg, box, kind


class Text(Expr):
    def __init__(self, op, arg, other):
        self.op, self.arg, self.other = op, arg, other


def wrap(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def in_array(x: Any, arr: Expr) -> In:
    return In(wrap(x), arr, "array")


def in_map_keys(x: Any, m: Expr) -> In:
    return In(wrap(x), m, "map")


def in_string(x: Any, s: Expr) -> In:
    return In(wrap(x), s, "string")


def value(e: Expr, params: dict) -> Column:
    """The column of an operand."""
    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Col):
        return F.col(e.name)
    if isinstance(e, Param):
        if e.name not in params:
            raise KeyError(f"no value was bound for parameter {e.name!r}")
        return F.lit(params[e.name])
    return to_bool(e, params)


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _in(e: In, neg: bool, params: dict) -> Column:
    box, x = e.box, value(e.arg, params)
    if isinstance(box, Param):
        box = params[box.name]
    if isinstance(box, Lit):
        box = box.value
    if box is None:
        return F.lit(neg)
    if isinstance(box, Between):
        lo, hi = value(wrap(box.lo), params), value(wrap(box.hi), params)
        return (~x.between(lo, hi) | x.isNull() | lo.isNull() | hi.isNull()) if neg else x.between(lo, hi)
    if isinstance(box, range) and box.step == 1 and len(box):
        return _in(In(e.arg, Between(box.start, box.stop - 1)), neg, params)
    if isinstance(box, Expr):
        c = value(box, params)
        hit = {"array": lambda: F.exists(c, lambda y: y.eqNullSafe(x)), "map": lambda: F.map_contains_key(c, x), "string": lambda: F.contains(c, x.cast("string"))}[e.kind or "array"]()
        hit = F.coalesce(F.when(x.isNotNull(), hit) if e.kind == "map" else hit, F.lit(False))
        return ~hit if neg else hit
    if isinstance(box, str):
        hit = F.coalesce(F.contains(F.lit(box), x.cast("string")), F.lit(False))
        return ~hit if neg else hit
    items = list(box)  # a dict gives its keys
    plain, has_null = [i for i in items if i is not None], any(i is None for i in items)
    if not neg:
        parts = ([x.isin(plain)] if plain else []) + ([x.isNull()] if has_null else [])
        return _any(parts) if parts else F.lit(False)
    if has_null:
        return (~x.isin(plain) & x.isNotNull()) if plain else x.isNotNull()
    return (~x.isin(plain) | x.isNull()) if plain else F.lit(True)


def to_filter(e: Expr, params: dict | None = None, neg: bool = False) -> Column:
    """A column that is TRUE just where the two-valued predicate (or with neg its negation) holds."""
    params = params or {}
    if isinstance(e, Not):
        return to_filter(e.arg, params, not neg)
    if isinstance(e, IsNull):
        c = value(e.arg, params)
        return c.isNotNull() if neg else c.isNull()
    if isinstance(e, In):
        return _in(e, neg, params)
    if isinstance(e, Text):
        c = getattr(F, e.op)(value(e.arg, params), value(e.other, params))
        return (~c | c.isNull()) if neg else c
    if isinstance(e, Bin):
        if e.op in ("AND", "OR"):
            a, b = to_filter(e.left, params, neg), to_filter(e.right, params, neg)
            return a & b if (e.op == "AND") != neg else a | b
        a, b = value(e.left, params), value(e.right, params)
        if e.op in ("EQ", "NEQ"):
            same = a.eqNullSafe(b)
            return same if (e.op == "EQ") != neg else ~same
        op = COMPARE[e.op] if neg else e.op
        c = {"GT": a > b, "GE": a >= b, "LT": a < b, "LE": a <= b}[op]
        return (c | a.isNull() | b.isNull()) if neg else c
    if isinstance(e, Lit):
        return F.lit((e.value is True) != neg)
    c = value(e, params)
    return (~c | c.isNull()) if neg else c


def to_bool(e: Expr, params: dict | None = None) -> Column:
    """The predicate as a column that is never NULL."""
    return F.coalesce(to_filter(e, params), F.lit(False))
