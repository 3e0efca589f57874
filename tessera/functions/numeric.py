"""Number helpers that keep the meaning of single precision and of NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def f32(x: Column) -> Column:
    """Round to single precision, which Spark leaves at a division or a product with a literal."""
    return x.cast("float")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is 0; ANSI mode would raise."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(empty))


def _magnitude(x: Column, digits: int) -> Column:
    """|x| * 10^digits as a whole number. Each part stands here as seldom as can be, for Spark's generated code repeats it."""
    a, scale = F.abs(x.cast("double")), F.lit(float(10**digits))
    product, cut = a * scale, a * 134217729.0
    high = cut - (cut - a)
    lost = (high * scale - product) + (a - high) * scale
    whole = F.floor(product)
    # the last term is less than any difference there can be, and takes a tie up to the even number
    over = (product - whole.cast("double") - 0.5) + lost + (whole % 2).cast("double") * 1e-300
    return F.when(finite(x), whole + (over > 0).cast("int"))


def units(x: Column, digits: int) -> Column:
    """x * 10^digits as a whole number: the exact binary value rounded half to even.

    A product of doubles is rounded itself, so what that took away is worked out from x cut into halves
    and decides the ties. For values up to 2^53 units; null and non-finite ones give null.
    """
    return _magnitude(x, digits) * F.when(x < 0, -1).otherwise(1)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals: its exact binary value rounded half to even; a sign stays before zeros."""
    shown = (_magnitude(x, digits).cast("decimal(20,0)") / F.lit(10**digits)).cast(f"decimal(20,{digits})").cast("string")
    return F.concat(F.when(x < 0, "-").otherwise(""), shown)
