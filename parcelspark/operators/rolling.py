"""Totals over trailing periods, days without activity included (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_totals(events: DataFrame, entity: str, day: str, first: str, last: str, periods: tuple[int, ...] = (7, 30), value: str | None = None) -> DataFrame:
    """entity, day, t<p> and avg<p> of each trailing period p (the day itself included), for each entity and each day first..last.

    Daily totals come first (partial sums before the shuffle, so a hot entity is one row a day
    at most). They go to their entity's place, are exploded there onto the days that each influences, and
    are grouped by entity and day; the entity's calendar joins in the same grouping, as rows of 0, so
    neither the exploded rows nor the calendar are shuffled or broadcast. An entity holds at most as many
    rows as the calendar has days, whatever the data. Days before `first` count as empty. Rows with a null
    entity or day, or a day outside first..last, do not count; a null value counts as 0. An
    entity comes out if it has at least one row that counts; an empty table gives no row.
    """
    begin, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    amount = F.count(F.lit(1)) if value is None else F.sum(F.coalesce(F.col(value), F.lit(0)))
    known = events.where(F.col(entity).isNotNull() & F.col(day).between(begin, end))
    daily = known.groupBy(F.col(entity).alias("_entity"), F.col(day).alias("_from")).agg(amount.alias("_n"))
    marks = daily.select("_entity").distinct().select("_entity", F.lit(None).cast("date").alias("_from"), F.lit(0).cast(dict(daily.dtypes)["_n"]).alias("_n"))
    placed = daily.unionByName(marks).repartition("_entity")
    reach = F.sequence(F.col("_from"), F.least(F.date_add("_from", max(periods) - 1), end))
    days = placed.select("_entity", "_from", "_n", F.explode(F.when(F.col("_from").isNull(), F.sequence(begin, end)).otherwise(reach)).alias("day"))
    lag = F.datediff("day", F.col("_from"))
    out = days.groupBy("_entity", "day").agg(*[F.sum(F.when(lag < p, F.col("_n"))).alias(f"t{p}") for p in periods])
    cells = [F.coalesce(F.col(f"t{p}"), F.lit(0)).alias(f"t{p}") for p in periods]
    means = [(F.coalesce(F.col(f"t{p}"), F.lit(0)) / F.lit(float(p))).alias(f"avg{p}") for p in periods]
    return out.select(F.col("_entity").alias(entity), "day", *cells, *means)
