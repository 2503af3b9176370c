"""Band algebra with masked-array semantics.

Every helper takes Columns, column names or numbers and returns a Column that
is NULL (masked) when any argument is masked, unless its text says otherwise.
Arithmetic is done in DOUBLE, so integer bands do not wrap around.

Values outside a function's domain become NULL or NaN and stay so; comparisons
and mask functions count NaN and infinities as masked, and ``evaluate`` masks
what is left of them at the end, so that long expressions stay plain
arithmetic for the code generator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastertable.functions.masks import as_column, finite, guard


def _raw(x) -> Column:
    return as_column(x).cast("double")


def _num(x) -> Column:
    """An operand of a comparison or a mask: double, without NaN or infinities."""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return F.lit(float(x)) if math.isfinite(x) else F.lit(None).cast("double")
    return finite(x)


def evaluate(expression) -> Column:
    """Finish an expression: mask the NaN and infinite values it produced."""
    return finite(expression)


# --- arithmetic -----------------------------------------------------------

def add(a, b) -> Column:
    return _raw(a) + _raw(b)


def subtract(a, b) -> Column:
    return _raw(a) - _raw(b)


def multiply(a, b) -> Column:
    return _raw(a) * _raw(b)


def divide(a, b) -> Column:
    """True division; a zero divisor is masked."""
    return F.try_divide(_raw(a), _raw(b))


def mod(a, b) -> Column:
    """Remainder with the sign of the divisor; a zero divisor is masked."""
    a, b = _raw(a), _raw(b)
    return a - F.floor(F.try_divide(a, b)).cast("double") * b


def power(a, b) -> Column:
    return F.pow(_raw(a), _raw(b))


def negate(a) -> Column:
    return -_raw(a)


def absolute(a) -> Column:
    return F.abs(_raw(a))


# --- logic ----------------------------------------------------------------

def and_(a, b) -> Column:
    """Not three-valued: a masked side masks the result even if the other is false."""
    a, b = as_column(a), as_column(b)
    return guard(a & b, a, b)


def or_(a, b) -> Column:
    """Not three-valued: a masked side masks the result even if the other is true."""
    a, b = as_column(a), as_column(b)
    return guard(a | b, a, b)


def not_(a) -> Column:
    return ~as_column(a)


def bit_and(a, b) -> Column:
    return as_column(a).bitwiseAND(as_column(b))


def bit_or(a, b) -> Column:
    return as_column(a).bitwiseOR(as_column(b))


def bit_not(a) -> Column:
    return F.bitwise_not(as_column(a))


def equal(a, b) -> Column:
    return _num(a) == _num(b)


def not_equal(a, b) -> Column:
    return _num(a) != _num(b)


def less(a, b) -> Column:
    return _num(a) < _num(b)


def less_equal(a, b) -> Column:
    return _num(a) <= _num(b)


def greater(a, b) -> Column:
    return _num(a) > _num(b)


def greater_equal(a, b) -> Column:
    return _num(a) >= _num(b)


# --- masks ----------------------------------------------------------------

def where(condition, a, b) -> Column:
    """Choose per pixel. A masked condition masks; the branch not taken may be masked."""
    c = as_column(condition)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(c, _num(a)).otherwise(_num(b))


def getmask(a) -> Column:
    """True where masked; never masked itself."""
    return finite(as_column(a)).isNull()


def setmask(a, mask) -> Column:
    """Add to the mask. It cannot unmask a pixel; a masked mask entry masks."""
    return F.when(~F.coalesce(as_column(mask), F.lit(True)), _num(a))


def masked_where(condition, a) -> Column:
    return F.when(~as_column(condition), _num(a))


def masked_equal(a, b) -> Column:
    return F.when(not_equal(a, b), _num(a))


def masked_not_equal(a, b) -> Column:
    return F.when(equal(a, b), _num(a))


def masked_greater(a, b) -> Column:
    return F.when(less_equal(a, b), _num(a))


def masked_greater_equal(a, b) -> Column:
    return F.when(less(a, b), _num(a))


def masked_less(a, b) -> Column:
    return F.when(greater_equal(a, b), _num(a))


def masked_less_equal(a, b) -> Column:
    return F.when(greater(a, b), _num(a))


def _between(a, lo, hi) -> Column:
    lo, hi = _num(lo), _num(hi)
    return _num(a).between(F.least(lo, hi), F.greatest(lo, hi))


def masked_inside(a, lo, hi) -> Column:
    """Mask the closed interval; reversed bounds are swapped."""
    return F.when(~_between(a, lo, hi), _num(a))


def masked_outside(a, lo, hi) -> Column:
    return F.when(_between(a, lo, hi), _num(a))


def masked_invalid(a) -> Column:
    return _num(a)


# --- functions ------------------------------------------------------------

def minimum(a, b) -> Column:
    a, b = _num(a), _num(b)
    return guard(F.least(a, b), a, b)


def maximum(a, b) -> Column:
    a, b = _num(a), _num(b)
    return guard(F.greatest(a, b), a, b)


def _unary(fn):
    def apply(a) -> Column:
        return fn(_raw(a))

    apply.__name__ = fn.__name__
    return apply


sqrt = _unary(F.sqrt)
log = _unary(F.ln)
log10 = _unary(F.log10)
exp = _unary(F.exp)
sin = _unary(F.sin)
cos = _unary(F.cos)
tan = _unary(F.tan)
sinh = _unary(F.sinh)
cosh = _unary(F.cosh)
tanh = _unary(F.tanh)
arcsin = _unary(F.asin)
arccos = _unary(F.acos)
arctan = _unary(F.atan)
arcsinh = _unary(F.asinh)
arccosh = _unary(F.acosh)


def arctanh(a) -> Column:
    return finite(F.atanh(_raw(a)))


def pi() -> Column:
    return F.lit(math.pi)


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def nomask() -> Column:
    return F.lit(False)
