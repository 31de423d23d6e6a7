"""Named business metrics: one registry, usable over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WON, LOST = "Closed Won", "Closed Lost"


def won() -> Column:
    return F.col("stage") == WON


def lost() -> Column:
    return F.col("stage") == LOST


def open_deal() -> Column:
    return ~F.col("stage").isin(WON, LOST)


def ratio(top: Column, bottom: Column) -> Column:
    """Four places, NULL when nothing is counted below the line."""
    return F.round(F.try_divide(top.cast("double"), bottom.cast("double")), 4)


def money(x: Column) -> Column:
    return F.round(x, 2)


def metric(name: str) -> Column:
    """A named metric over the opportunities view, as an aggregate column."""
    amount = F.col("amount_usd")
    return {
        "deals": lambda: F.count("*"),
        "won": lambda: F.count_if(won()),
        "lost": lambda: F.count_if(lost()),
        "open_deals": lambda: F.count_if(open_deal()),
        "pipeline_usd": lambda: money(F.sum(F.when(open_deal(), amount))),
        "weighted_pipeline_usd": lambda: money(F.sum(F.when(open_deal(), amount * F.col("probability")))),
        "bookings_usd": lambda: money(F.sum(F.when(won(), amount))),
        "win_rate": lambda: ratio(F.count_if(won()), F.count_if(won() | lost())),
        "avg_deal_usd": lambda: money(F.avg(amount)),
    }[name]()


def deal_metrics(deals: DataFrame, names: list[str], by: list[str | Column]) -> DataFrame:
    """Metrics in one partial-plus-final aggregation."""
    return deals.groupBy(*by).agg(*(metric(n).alias(n) for n in names))


def in_period(deals: DataFrame, metric: str, start: str, end: str) -> DataFrame:
    """Deals of a half-open period: bookings and win rates go by the close
    date, everything else by the creation date."""
    column = "close_date" if metric in ("bookings_usd", "win_rate", "won", "lost") else "created_date"
    return deals.where((F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.lit(end).cast("date")))


def seat_adoption(seats: DataFrame) -> DataFrame:
    return seats.select("account_id", "seats_purchased", "seats_active", ratio(F.col("seats_active"), F.col("seats_purchased")).alias("adoption"))


def net_line_value() -> Column:
    return F.col("quantity") * F.col("unit_price_usd") * (1 - F.col("discount_pct"))
