"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import vocab


def is_type(event_type: str) -> Column:
    return F.col("event_type") == event_type


def is_priced_purchase() -> Column:
    """Price 0.0 means the price is unknown, so revenue only counts positive prices."""
    return is_type(vocab.PURCHASE) & (F.col("price") > 0)


def top_category(code: str = "category_code") -> Column:
    """First segment of the dotted category path; events without one are 'unknown'."""
    return F.substring_index(F.coalesce(F.col(code), F.lit(vocab.UNKNOWN_CATEGORY)), ".", 1)


def count_type(event_type: str) -> Column:
    return F.count(F.when(is_type(event_type), 1))


def has_type(event_type: str) -> Column:
    """Aggregate: 1 if the group holds an event of this type, else 0."""
    return F.max(F.when(is_type(event_type), 1).otherwise(0))


# Most operators take events or partial aggregates of them (clickloom/operators/partials.py): the following read either.
def is_partial(df: DataFrame) -> bool:
    return "priced_purchases" in df.columns


def stage_column(event_type: str) -> str:
    return f"{event_type}s"


def n_events(df: DataFrame) -> Column:
    """Aggregate: number of events."""
    return F.sum("events") if is_partial(df) else F.count("*")


def n_type(df: DataFrame, event_type: str) -> Column:
    """Aggregate: number of events of a type."""
    return F.sum(stage_column(event_type)) if is_partial(df) else count_type(event_type)


def has(df: DataFrame, event_type: str) -> Column:
    """Aggregate: 1 if the group holds an event of the type, else 0."""
    return F.max(F.when(F.col(stage_column(event_type)) > 0, 1).otherwise(0)) if is_partial(df) else has_type(event_type)


def n_priced(df: DataFrame) -> Column:
    """Aggregate: number of purchases with a price."""
    return F.sum("priced_purchases") if is_partial(df) else F.count(F.when(is_priced_purchase(), 1))


def revenue(df: DataFrame) -> Column:
    """Aggregate: exact sum of the prices of purchases, NULL without any."""
    return F.sum("revenue") if is_partial(df) else F.sum(money(F.when(is_priced_purchase(), F.col("price"))))


def first_time(df: DataFrame) -> Column:
    return F.min("first_time" if is_partial(df) else "event_time")


def last_time(df: DataFrame) -> Column:
    return F.max("last_time" if is_partial(df) else "event_time")


def holds_type(df: DataFrame, event_type: str) -> Column:
    """Filter: rows that are, or stand for, events of the type."""
    return F.col(stage_column(event_type)) > 0 if is_partial(df) else is_type(event_type)


def holds_priced(df: DataFrame) -> Column:
    return F.col("priced_purchases") > 0 if is_partial(df) else is_priced_purchase()


def category(df: DataFrame) -> Column:
    return F.col("top_category") if "top_category" in df.columns else top_category()


def week(df: DataFrame) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", day(df))) if is_partial(df) else week_start()


def ratio(num: Column, den: Column, digits: int | None = None) -> Column:
    """num / den as double, NULL for a zero denominator."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if digits is None else F.round(out, digits)


def pct(num: Column, den: Column, digits: int | None = 2) -> Column:
    """num as a percentage of den, in double arithmetic, NULL for a zero denominator."""
    out = F.try_divide(num * F.lit(100.0), den.cast("double"))
    return out if digits is None else F.round(out, digits)


# Money and percentages are added as decimals: such sums are exact, so no result depends on the order or the
# partitioning of the rows. Amounts up to 1e20 with 8 decimals fit; Spark raises an error for larger ones.
MONEY = "decimal(28,8)"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def total(value: Column, digits: int | None = None) -> Column:
    """Aggregate: the exact sum of amounts, as a double."""
    return amount(F.sum(money(value)), digits)


def amount(exact: Column, digits: int | None = 2) -> Column:
    """An exact sum as a double, rounded first."""
    return (exact if digits is None else F.round(exact, digits)).cast("double")


def exact_mean(value: Column, digits: int = 2) -> Column:
    """Aggregate: mean of amounts, from their exact sum."""
    return ratio(F.sum(money(value)), F.count(value), digits)


def event_date() -> Column:
    return F.to_date("event_time")


def day(df: DataFrame) -> Column:
    """Day of the event; taken from the folder of a day-partitioned table, so that date filters skip folders."""
    return F.col("event_date") if "event_date" in df.columns else event_date()


def week_start() -> Column:
    """Monday of the event's week."""
    return F.to_date(F.date_trunc("week", F.col("event_time")))


def year_month() -> Column:
    return F.date_format("event_time", "yyyy-MM")


def month_number(ts: str | Column = "event_time") -> Column:
    """Months on a running scale, so that differences count calendar month boundaries."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.year(ts) * 12 + F.month(ts) - 1


def month_text(number: Column) -> Column:
    """'yyyy-MM' of a month on the running scale."""
    return F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def time_slice(seconds: int, ts: str = "event_time") -> Column:
    """Number of the fixed-width time slice an event falls into."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def tie_columns(df: DataFrame) -> list[str]:
    """The columns that order events in time: event_id decides equal times; where there is none, the content does."""
    if "event_id" in df.columns:
        return ["event_time", "event_id"]
    return ["event_time", *(c for c in ("event_type", "product_id", "price") if c in df.columns)]


def tie_order(df: DataFrame) -> list[str | Column]:
    """Order of events in time. Event types of equal times come in the order of the funnel: view, cart, purchase."""
    stage = F.array_position(F.array(*map(F.lit, vocab.EVENT_TYPES)), F.col("event_type"))
    return [stage if c == "event_type" else c for c in tie_columns(df)]


def tier_bucket(value: Column, low: float = 0.33, high: float = 0.67) -> Column:
    return F.when(value < low, "Low").when(value > high, "High").otherwise("Mid")


def minutes_seconds(minutes: Column) -> Column:
    """4.38 -> '4m 23s'."""
    seconds = F.round(minutes * 60, 0).cast("long")
    return F.format_string("%dm %02ds", F.floor(seconds / 60), seconds % 60)


def signed_pct_text(fraction: Column, digits: int = 1) -> Column:
    """0.18 -> '+18.0%'."""
    value = F.round(fraction * 100, digits)
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_number(value, digits), F.lit("%"))


def pct_text(fraction: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(F.round(fraction * 100, digits), digits), F.lit("%"))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))
