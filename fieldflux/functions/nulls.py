"""Missing-data rules.  NULL is the only nodata value: sources turn NaN and infinities
into NULL, and every function here returns NULL where the arithmetic has no answer."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def finite(c: Column) -> Column:
    """The value, or NULL for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def divide(num: Column, den: Column) -> Column:
    """num / den, NULL for a zero denominator."""
    return F.try_divide(num, den)


def power(x: Column, p: float) -> Column:
    """x ** p.  Only a fractional exponent makes negative bases missing."""
    base = finite(x)
    if float(p).is_integer():
        return F.pow(base, F.lit(float(p)))
    return F.when(base >= 0, F.pow(base, F.lit(float(p))))


def log(x: Column) -> Column:
    """Natural logarithm, NULL for x <= 0 and for non-finite x."""
    return F.ln(finite(x))


def clip(x: Column, lo=None, hi=None) -> Column:
    """min(max(x, lo), hi): a missing value or bound gives NULL, and hi wins if lo > hi.

    Constant bounds use a CASE whose ELSE branch carries the NULL, column bounds need the
    explicit test because greatest() and least() skip NULLs."""
    if not isinstance(lo, Column) and not isinstance(hi, Column):
        if hi is not None:
            top = min(hi, lo) if lo is not None and lo > hi else hi
            out = F.when(x > top, F.lit(float(top)))
            if lo is not None:
                out = out.when(x < lo, F.lit(float(min(lo, hi))))
            return out.otherwise(x)
        return F.when(x < lo, F.lit(float(lo))).otherwise(x)
    known, out = x.isNotNull(), x
    if lo is not None:
        known, out = known & as_col(lo).isNotNull(), F.greatest(out, as_col(lo))
    if hi is not None:
        known, out = known & as_col(hi).isNotNull(), F.least(out, as_col(hi))
    return F.when(known, out)
