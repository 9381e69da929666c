"""From incident records to a region-year panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ihs, is_nonviolent, is_violent, square_miles
from .nearby import cover_polygons, match_cover, polygons


def with_points(incidents: DataFrame) -> DataFrame:
    """Rows whose two coordinates are known (neither null nor NaN)."""
    x, y = F.col("point_x"), F.col("point_y")
    return incidents.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))


def with_kind(incidents: DataFrame, codes: DataFrame, name: str = "kind") -> DataFrame:
    """The kind of each incident by its code; null where the code has none. codes: ucr_general, crimetype; of repeated codes the least kind."""
    known = codes.where(F.col("ucr_general").isNotNull()).groupBy(F.col("ucr_general").alias("_code")).agg(F.min("crimetype").alias(name))
    return incidents.drop(name).join(known, F.col("ucr_general") == F.col("_code"), "left").drop("_code")


def with_times(incidents: DataFrame) -> DataFrame:
    """day (of dispatch_date, yyyy-MM-dd at its start or MM/dd/yyyy), moment, weekday, year and week_time, the time of day on a fixed Sunday; null where a text does not parse."""
    head = F.substring("dispatch_date", 1, 10)
    iso = F.when(head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), head)
    american = F.when(head.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.concat_ws("-", F.substring(head, 7, 4), F.substring(head, 1, 2), F.substring(head, 4, 2)))
    text = F.coalesce(iso, american)
    return incidents.withColumn("day", text.try_cast("date")).withColumns(
        {"moment": F.concat_ws(" ", text, "dispatch_time").try_cast("timestamp"), "weekday_name": F.date_format("day", "EEEE"), "year_of_day": F.year("day"), "week_time": F.concat(F.lit("2016-05-08 "), F.col("dispatch_time")).try_cast("timestamp")}
    )


def with_region(incidents: DataFrame, regions: DataFrame, name: str = "region") -> DataFrame:
    """The region that holds each incident's point; incidents outside of all regions are left out. Where regions overlap the greatest id holds."""
    held = match_cover(incidents, "point_x", "point_y", cover_polygons(regions, "region_id", "ring"), polygons(regions, "region_id", "ring"))
    return held.withColumn(name, F.col("shape_id").cast(dict(regions.dtypes)["region_id"])).drop("shape_id")


def region_years(incidents: DataFrame, regions: DataFrame, region: str, first: int, last: int) -> DataFrame:
    """region_id, year, violent, nonviolent for every region and year, cells without incidents as 0.

    The spine is each region's own list of years. Rows outside of the regions or years do not count.
    """
    spine = regions.select("region_id").distinct().select("region_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    code = F.col("ucr_general")
    counts = incidents.where(F.col("year").between(first, last)).groupBy(F.col(region).alias("region_id"), "year").agg(F.count_if(is_violent(code)).alias("violent"), F.count_if(is_nonviolent(code)).alias("nonviolent"))
    return spine.join(counts, ["region_id", "year"], "left").na.fill(0, ["violent", "nonviolent"])


def crosstab(counts: DataFrame, first: int, last: int, value: str = "violent") -> DataFrame:
    """One row per region, one column y<year> per year."""
    wide = counts.groupBy("region_id").pivot("year", list(range(first, last + 1))).agg(F.sum(value))
    return wide.select("region_id", *[F.coalesce(F.col(f"`{y}`"), F.lit(0)).alias(f"y{y}") for y in range(first, last + 1)])


def melted(wide: DataFrame, first: int, last: int) -> DataFrame:
    """crosstab back to region_id, year, n."""
    years = [f"y{y}" for y in range(first, last + 1)]
    return wide.unpivot("region_id", years, "name", "n").select("region_id", F.substring("name", 2, 4).cast("int").alias("year"), "n")


def densities(counts: DataFrame, regions: DataFrame, value: str = "violent") -> DataFrame:
    """Counts per square mile and their inverse hyperbolic sine, beside geoid and area. Null where the area is unknown or 0."""
    area = regions.select("region_id", "geoid", F.col("aland"), square_miles(F.col("aland")).alias("area_sqmile")).dropDuplicates(["region_id"])
    density = F.col(value) / F.nullif(F.col("area_sqmile"), F.lit(0.0))
    return counts.join(area, "region_id").withColumn("density", density).withColumn("tr_density", ihs(F.col("density")))


def in_order(incidents: DataFrame, moment: str = "moment", key: str = "crime_id") -> DataFrame:
    """Incidents by time, those without one first, of equal times by key; the order is Spark's range partitioning, written files keep it."""
    return incidents.orderBy(F.asc_nulls_first(moment), key)
