"""Cell functions: NoData is NULL and every function passes it on.

``UNARY``, ``CONSTANT`` (a cell and a number) and ``BINARY`` (two cells) hold them by name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _flag(c: Column) -> Column:
    return c.cast("double")


def _whole(c: Column) -> Column:
    return c.cast("long")


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


UNARY = {
    **{n: getattr(F, n) for n in ("sin", "cos", "tan", "sinh", "cosh", "tanh", "asin", "acos", "atan", "log10", "sqrt", "cbrt", "abs", "signum")},
    "ceil": lambda v: F.ceil(v).cast("double"),
    "floor": lambda v: F.floor(v).cast("double"),
    "round": lambda v: F.floor(v + 0.5).cast("double"),  # half up, negatives as well
    "log": lambda v: F.log(v),
    "not": lambda v: _flag(v == 0),
    "bitwise_not": lambda v: F.bitwise_not(_whole(v)).cast("double"),
    "remove_zero": lambda v: F.when(v != 0, v),
}

CONSTANT = {
    "add_num": lambda v, c: v + c,
    "subtract_num": lambda v, c: v - c,
    "multiply_num": lambda v, c: v * c,
    "divide_num": lambda v, c: v / F.nullif(F.lit(float(c)), F.lit(0.0)),
    "mod_num": lambda v, c: v % F.nullif(F.lit(float(c)), F.lit(0.0)),
    "pow_num": lambda v, c: F.pow(v, F.lit(float(c))),
    "binarization": lambda v, c: F.when(v.isNotNull(), F.when(v > c, 255.0).otherwise(0.0)),
    "gte_value": lambda v, c: _flag(v >= c),
    "lte_value": lambda v, c: _flag(v <= c),
}

BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: a / F.nullif(b, F.lit(0.0)),
    "mod": lambda a, b: a % F.nullif(b, F.lit(0.0)),
    "pow": F.pow,
    "atan2": F.atan2,
    "mini": lambda a, b: _both(a, b, F.least(a, b)),
    "maxi": lambda a, b: _both(a, b, F.greatest(a, b)),
    "eq": lambda a, b: _flag(a == b),
    "neq": lambda a, b: _flag(a != b),
    "gt": lambda a, b: _flag(a > b),
    "gte": lambda a, b: _flag(a >= b),
    "lt": lambda a, b: _flag(a < b),
    "lte": lambda a, b: _flag(a <= b),
    "and": lambda a, b: _both(a, b, _flag((a != 0) & (b != 0))),
    "or": lambda a, b: _both(a, b, _flag((a != 0) | (b != 0))),
    "bitwise_and": lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double"),
    "bitwise_or": lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double"),
    "bitwise_xor": lambda a, b: _whole(a).bitwiseXOR(_whole(b)).cast("double"),
    "raster_union": lambda a, b: (a + b) - a,
}

# Cell types: least value, greatest value, Spark type and the value that stands for NoData.
CELL_TYPES = {
    "int8": (-128, 127, "tinyint", -128),
    "uint8": (0, 255, "smallint", 0),
    "int16": (-32768, 32767, "smallint", -32768),
    "uint16": (0, 65535, "int", 0),
    "int32": (-(2**31), 2**31 - 1, "int", -(2**31)),
    "float": (None, None, "float", None),
    "double": (None, None, "double", None),
}


def to_type(v: Column, kind: str) -> Column:
    """Cast to a cell type; what doesn't fit, NaN and the type's NoData value become NULL."""
    low, high, spark, none = CELL_TYPES[kind]
    if low is None:
        return F.when(~F.isnan(v), v.cast(spark))
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    return F.when((whole >= low) & (whole <= high) & (whole != none) & ~F.isnan(v), whole.cast(spark))


def reclass(v: Column, rules: list[tuple[float, float, float]], otherwise: float | None = None) -> Column:
    """The value of the first rule (low, high, value) with low <= v <= high, else ``otherwise``."""
    out = F.lit(otherwise).cast("double")
    for low, high, value in reversed(rules):
        out = F.when((v >= low) & (v <= high), float(value)).otherwise(out)
    return F.when(v.isNotNull(), out)


def remap(v: Column, old: list[int], new: list[float], default: float | None = None) -> Column:
    """New value by the whole part; without a match ``default``, or the value itself."""
    if len(old) != len(new):
        raise ValueError("old and new values differ in number")
    out = v if default is None else F.lit(float(default))
    for a, b in zip(reversed(old), reversed(new)):
        out = F.when(v.cast("int") == a, float(b)).otherwise(out)
    return F.when(v.isNotNull(), out)


def polynomial(v: Column, coefficients: list[float]) -> Column:
    """sum of c_i v^i, by Horner's rule."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * v + float(c)
    return F.when(v.isNotNull(), out)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def within(v: Column, low: float, high: float) -> Column:
    return F.when((v >= low) & (v <= high), v)
