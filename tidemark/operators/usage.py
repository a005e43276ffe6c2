"""Billable calls, tiered prices, reconciled days and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import seconds

#: Token classes of a call, as the price columns name them.
CLASSES = ["input", "output", "cache_read", "write_5m", "write_1h"]
LONG_CONTEXT = 200_000


def billable(records: DataFrame, keys: list[str], tokens: list[str], firsts: list[str], order: list[str]) -> DataFrame:
    """One row per call: repeated records of a call collapse to the maximum of each token class and the first record's other columns."""
    first = F.min_by(F.struct(*firsts), F.struct(*order)).alias("_f")
    return records.groupBy(*keys).agg(*[F.max(t).alias(t) for t in tokens], first).select(*keys, *tokens, "_f.*")


def price(tokens: dict[str, Column], rates: dict[str, Column], above: dict[str, Column], threshold: Column) -> Column:
    """What one call costs. Its own context (input and cache) decides whether the long-context rates hold, where there are such; a cache write
    without a split is charged at the shorter tier. Sum calls' prices; never price sums."""
    flat = tokens.get("write_flat", F.lit(0))
    w5 = F.when((tokens["write_5m"] == 0) & (tokens["write_1h"] == 0), flat).otherwise(tokens["write_5m"])
    parts = tokens | {"write_5m": w5}
    context = tokens["input"] + tokens["cache_read"] + w5 + tokens["write_1h"]
    over = (threshold > 0) & (context > threshold)
    total = F.lit(0.0)
    for c in CLASSES:
        high = above.get(c, F.lit(None).cast("double"))
        total = total + parts[c] * F.when(over & (F.coalesce(high, F.lit(0.0)) > 0), high).otherwise(F.coalesce(rates[c], F.lit(0.0)))
    return total


def rate_windows(cards: DataFrame, model: str, day: str) -> DataFrame:
    """Dated cards with the days they hold: from their day (the first one from ever) to before the next."""
    order = Window.partitionBy(model).orderBy(day)
    first = F.row_number().over(order) == 1
    return cards.withColumn("valid_from", F.when(first, F.lit("0001-01-01").cast("date")).otherwise(F.col(day))).withColumn("valid_to", F.coalesce(F.lead(day).over(order), F.lit("9999-12-31").cast("date")))


def with_rates(calls: DataFrame, cards: DataFrame, model: str, day: str, card_day: str) -> DataFrame:
    """calls with the card in force on their day. A rate file has some thousand models, so the cards are the small side; unknown models stay, unpriced."""
    w = rate_windows(cards, model, card_day).withColumnRenamed(model, "_model")
    return calls.join(w, (F.col(model) == F.col("_model")) & (F.col(day) >= F.col("valid_from")) & (F.col(day) < F.col("valid_to")), "left").drop("_model", "valid_from", "valid_to")


def reconcile(estimates: DataFrame, settled: DataFrame, day: str, estimate: str, cost: str) -> DataFrame:
    """Days with the settled cost where there is one, else the estimate, and which it is. A total is the sum of these rows."""
    both = estimates.join(settled, day, "left")
    return both.withColumn("cost", F.coalesce(F.col(cost), F.col(estimate))).withColumn("cost_source", F.when(F.col(cost).isNull(), "estimated").otherwise("reconciled"))


def budget(days: DataFrame, day: str, cost: str, now: str, cap: float, warn_pct: float = 80.0, window: int = 7) -> DataFrame:
    """One row: month to date, daily rate over the last `window` days (none before the month's start), projection, severity and when the cap is met."""
    at = F.lit(now).cast("timestamp")
    start, end = F.date_trunc("month", at), F.add_months(F.date_trunc("month", at).cast("date"), 1).cast("timestamp")
    since = F.greatest(at - F.expr(f"INTERVAL {window} DAYS"), start)
    ts = F.col(day).cast("timestamp")
    sums = days.agg(
        F.coalesce(F.sum(F.when((ts >= start) & (ts <= at), F.col(cost))), F.lit(0.0)).alias("spent"),
        F.coalesce(F.sum(F.when((ts >= since) & (ts <= at), F.col(cost))), F.lit(0.0)).alias("recent"),
    )
    burn_days = (seconds(at) - seconds(since)) / 86_400
    left_days = F.greatest((seconds(end) - seconds(at)) / 86_400, F.lit(0.0))
    out = sums.select("spent", F.when(burn_days > 0, F.col("recent") / burn_days).otherwise(0.0).alias("per_day")).withColumn("projected", F.col("spent") + F.col("per_day") * left_days)
    pct = 100 * F.col("projected") / cap
    severity = F.when(F.col("spent") >= cap, "over").when(pct >= warn_pct, "warn").otherwise("ok")
    left = F.when((F.col("spent") < cap) & (F.col("per_day") > 0), (cap - F.col("spent")) / F.col("per_day"))
    met = F.when(left <= left_days, F.date_format(F.timestamp_seconds(seconds(at) + left * 86_400), "yyyy-MM-dd"))
    return out.withColumn("projected_pct", pct).withColumn("severity", severity).withColumn("cap_met", met)
