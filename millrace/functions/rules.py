"""Row rules as built-in column expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

ORDER_CANCELLED = "CANCELLED"
ORDER_RETURNED = "RETURNED"
PAYMENT_PAID = "PAID"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def clean_text(value: Column) -> Column:
    """Trim, squeeze inner blanks and turn an empty text into null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def clean_code(value: Column) -> Column:
    return F.upper(clean_text(value))


def clean_label(value: Column) -> Column:
    return F.initcap(clean_text(value))


def typed(value: Column, type_name: str) -> Column:
    """Cast that yields null instead of failing on dirty input."""
    return clean_text(value).try_cast(type_name)


def soft_date_defect(order_date: Column, *later_dates: Column) -> Column:
    """True when a ship or due date lies before the order date; unknown dates are no defect."""
    defect = F.lit(False)
    for later in later_dates:
        defect = defect | F.coalesce(later < order_date, F.lit(False))
    return defect


def soft_amount_defect(amount: Column, quantity: Column, price: Column, tolerance: str = "0.00") -> Column:
    gap = F.abs(money(amount) - money(price) * quantity)
    return F.coalesce(gap > F.lit(tolerance).cast(MONEY), F.lit(False))


def failed_rules(rules: dict[str, Column]) -> Column:
    """Array with the names of the rules whose condition is true."""
    named = F.array(*[F.when(failed, F.lit(name)) for name, failed in rules.items()])
    return F.array_compact(named)


def line_eligible(soft: Sequence[Column], hard_failures: Column) -> Column:
    clean = F.size(hard_failures) == 0
    for defect in soft:
        clean = clean & ~defect
    return clean


def order_eligible(order_id: Column, customer_known: Column, order_date: Column) -> Column:
    return order_id.isNotNull() & F.coalesce(customer_known, F.lit(False)) & order_date.isNotNull()


def ship_eligible(eligible: Column, order_date: Column, delivered: Column, due: Column) -> Column:
    """Eligible order with a delivered and a due date, neither before the order date."""
    return F.coalesce(eligible & (delivered >= order_date) & (due >= order_date), F.lit(False))


def on_time(delivered: Column, due: Column) -> Column:
    return F.coalesce(delivered <= due, F.lit(False))


def delivery_days(delivered: Column, ordered: Column) -> Column:
    """Calendar days, not business days."""
    return F.datediff(delivered, ordered).cast("bigint")


def arrival_delay_seconds(event_ts: Column, arrival_ts: Column) -> Column:
    days = F.datediff(F.to_date(arrival_ts), F.to_date(event_ts)).cast("bigint")
    return days * 86400 + _second_of_day(arrival_ts) - _second_of_day(event_ts)


def _second_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("bigint")


def time_box(ts: Column, minutes: int) -> Column:
    """Number of the box of so many minutes, counted from 1970, that a timestamp without zone falls into."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    minute = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return F.floor(minute / minutes).cast("bigint")


def full_year(day: Column, first_year: int, last_year: int) -> Column:
    return F.year(day).between(first_year, last_year)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null when the denominator is zero or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def version_key(entity: Column, valid_from: Column) -> Column:
    return F.xxhash64(entity, valid_from)


def batch_id(object_name: str, lower_bound: Column) -> Column:
    """The same committed lower bound always gives the same batch, so a retry lands on it again."""
    return F.sha2(F.concat_ws("|", F.lit(object_name), F.coalesce(lower_bound.cast("string"), F.lit(""))), 256)
