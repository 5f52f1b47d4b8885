"""Day-level timing signals and the short-interval test of 30-day lates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeglass.functions import dates
from tradeglass.operators.history import KEY

PAYMENT_FIELDS = ["stated_last_payment", "last_payment"]
REPORTING_FIELDS = ["date_reported", "status_updated", "balance_updated", "date_closed"]


def field_days(names: list[str]) -> str:
    return f"array_compact(array({', '.join(f'unix_date({dates.read_day(n)})' for n in names)}))"


def timing_signals(view: DataFrame) -> DataFrame:
    """Distinct (account, kind, day) signals from scalar fields and dated history cells."""
    kinds = ("concat(transform(payment_days, d -> named_struct('kind', 'payment', 'day', d)), "
             "transform(array_distinct(reporting_days), d -> named_struct('kind', 'reporting', 'day', d)))")
    return view.selectExpr(*KEY, f"explode({kinds}) AS s").selectExpr(
        *KEY, "s.kind AS kind", "date_from_unix_date(s.day) AS d")


def signal_intervals(signals: DataFrame) -> DataFrame:
    """Shortest interval per (account, month) from a payment 1 to 45 days earlier.

    The earlier payment must fall in the same or the previous month. Signals are
    one row per account and day before the window, so a window group is bounded by
    the days of the calendar, not by the number of copies.
    """
    days = (
        signals.groupBy(*KEY, "d").agg(F.expr("max(kind = 'payment') AS pays"))
        .withColumn("day", F.expr("cast(unix_date(d) AS bigint)"))
    )
    w = Window.partitionBy(*KEY).orderBy("day").rangeBetween(-45, -1)
    paired = days.withColumn("paid_day", F.max(F.expr("if(pays, day, NULL)")).over(w)).selectExpr(
        *KEY, f"{dates.month_index('d')} AS m", "cast(day - paid_day AS int) AS days",
        f"{dates.month_index('date_from_unix_date(cast(paid_day AS int))')} AS paid_m")
    return paired.where("m - paid_m <= 1").groupBy(*KEY, "m").agg(F.min("days").alias("interval_days"))


def late_intervals() -> str:
    """The same shortest intervals for the months coded 30, as an array per account.

    Lets the account rules run without a second pass; every array is bounded by the
    months or days of the calendar.
    """
    def month(day: str) -> str:
        return dates.month_index(f"date_from_unix_date({day})")

    earlier = f"filter(payment_days, p -> p < d AND d - p <= 45 AND x - {month('p')} <= 1)"
    current = f"filter(signal_days, d -> {month('d')} = x)"
    shortest = f"array_min(transform({current}, d -> d - array_max({earlier})))"
    return (f"filter(transform(coalesce(late30_months, array()), x -> named_struct('m', x, 'days', {shortest})), "
            "y -> y.days IS NOT NULL)")


def thirty_day_intervals(view: DataFrame) -> DataFrame:
    """Every month coded 30 with a measurable interval; 28 and 29 days are conflicts."""
    return view.selectExpr(*KEY, "explode(intervals) AS p").selectExpr(*KEY, "p.m AS m", "p.days AS interval_days")
