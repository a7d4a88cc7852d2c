"""Scalar column functions (F1-F14) and the NULL / rounding rules.

Everything here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen. The rules follow pandas semantics where the
results must agree:

* rounding to n places is NumPy's ``rint(x * 10**n) / 10**n`` at every magnitude
  (``F.round`` rounds half-up and differs on ties); sums that are rounded
  afterwards are taken in decimals first (:func:`exact_sum`), so that the order
  of a sum cannot flip a tie;
* ``x != 0`` keeps missing values (pandas compares NaN as unequal);
* division by zero gives NULL instead of raising under ANSI mode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text form of a date inside seeded hashes (ISO 8601 day).
DAY_KEY_FORMAT = "yyyy-MM-dd"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, places: int = 2) -> Column:
    """F1 at any number of places: ``rint(x * 10**places) / 10**places``."""
    scale = F.lit(float(10 ** places))
    return F.rint(_col(c) * scale) / scale


# Decimal types of the terms of exact sums (money, and means of it).
MONEY = "decimal(24,6)"
MEAN_OF_MONEY = "decimal(24,10)"


def exact_sum(c, kind: str = MONEY) -> Column:
    """Sum of decimals, as double: the same value in any order of the rows."""
    return F.sum(_col(c).cast(kind)).cast("double")


def exact_avg(c, kind: str = MONEY) -> Column:
    """Mean of the values that are not NULL, with an exact sum."""
    return safe_div(exact_sum(c, kind), F.count(_col(c)))


def line_weight(df) -> Column:
    """How many equal order lines a row stands for: ``lines`` if there, else 1."""
    return F.col("lines") if "lines" in df.columns else F.lit(1)


def round2(c) -> Column:
    """round to two decimals, half to even."""
    return round_half_even(c, 2)


def is_nonzero(c) -> Column:
    """``c != 0`` with pandas' missing-value rule: NULL counts as non-zero."""
    return ~F.equal_null(_col(c), F.lit(0))


def safe_div(a, b) -> Column:
    """``a / b`` that is NULL when ``b`` is 0 or NULL (no ANSI error)."""
    return F.try_divide(_col(a), _col(b))


def discount_amount(max_price, price) -> Column:
    """amount below the item maximum, rounded to 2."""
    return round2(_col(max_price) - _col(price))


def discount_share(amount, max_price) -> Column:
    """share of the item maximum, rounded to 2."""
    return round2(safe_div(amount, max_price))


def weekday_mon1(d) -> Column:
    """weekday 1..7 with Monday = 1."""
    return F.weekday(_col(d)) + 1


def month_day(d) -> Column:
    """day of month."""
    return F.dayofmonth(_col(d))


def iso_week(d) -> Column:
    """ISO week of year."""
    return F.weekofyear(_col(d))


def _first_weekday(d) -> Column:
    # weekday (Monday = 0) of the first day of the month of d
    return F.weekday(F.trunc(_col(d), "month"))


def week_of_month_calendar(d) -> Column:
    """F8: row of the date in a Monday-first month calendar."""
    return F.floor((F.dayofmonth(_col(d)) + _first_weekday(d) - 1) / 7).cast("int") + 1


def week_of_month_eda(d) -> Column:
    """exploration form, ``(day + weekday(first)) // 7 + 1``."""
    return F.floor((F.dayofmonth(_col(d)) + _first_weekday(d)) / 7).cast("int") + 1


def days_from_start(d, start) -> Column:
    """1-based day number counted from ``start``."""
    return F.datediff(_col(d), _col(start)) + 1


def promotion_dates(c) -> Column:
    """comma-separated promotion dates -> array<date>; NULL stays NULL."""
    parts = F.split(_col(c), ",")
    return F.filter(F.transform(parts, lambda x: F.to_date(F.trim(x))),
                    lambda x: x.isNotNull())


def _hex_fraction(h: Column, start: int) -> Column:
    # 13 hex digits (52 bits) from position ``start`` as a fraction in [0, 1)
    return (F.conv(F.substring(h, start, 13), 16, 10).cast("double")
            / F.lit(float(16 ** 13)))


def md5_hex(*parts) -> Column:
    """md5 of the ``|``-joined text of ``parts``."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def md5_uniform(*parts) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of the md5 of ``parts``:
    the same key gives the same number on any partitioning and in any engine
    with md5."""
    return _hex_fraction(md5_hex(*parts), 1)


def _hex32(h: Column, k: int) -> Column:
    # k-th group of 8 hex digits (32 bits) as a fraction in [0, 1)
    return (F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("double")
            / F.lit(float(2 ** 32)))


def gaussian_pair(*parts) -> tuple[Column, Column]:
    """T5: two independent standard normals from one md5 of ``parts``: its four
    32-bit groups are two pairs of uniforms for Box-Muller (``1 - u`` keeps the
    log argument in (0, 1])."""
    h = md5_hex(*parts)
    u = [_hex32(h, k) for k in range(4)]

    def box_muller(u1, u2):
        return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)
    return box_muller(u[0], u[1]), box_muller(u[2], u[3])
