"""Column-level helpers: rounding and NULL rules, calendar fields, seeded uniforms."""

from tillcast.functions.scalar import (
    DAY_KEY_FORMAT,
    MEAN_OF_MONEY,
    days_from_start,
    discount_amount,
    discount_share,
    exact_avg,
    exact_sum,
    gaussian_pair,
    iso_week,
    is_nonzero,
    line_weight,
    md5_uniform,
    month_day,
    promotion_dates,
    round2,
    round_half_even,
    safe_div,
    week_of_month_calendar,
    week_of_month_eda,
    weekday_mon1,
)

__all__ = [
    "DAY_KEY_FORMAT", "days_from_start", "discount_amount", "discount_share", "exact_avg",
    "exact_sum", "gaussian_pair", "line_weight", "MEAN_OF_MONEY",
    "iso_week", "is_nonzero", "md5_uniform", "month_day", "promotion_dates", "round2",
    "round_half_even", "safe_div", "week_of_month_calendar", "week_of_month_eda",
    "weekday_mon1",
]
