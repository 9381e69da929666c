"""One row per entity with counts, totals and recency for each kind of event (problem 2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


@dataclass
class EntityFeatures:
    """long: entity, kind, period, n. wide: one row per entity. unlisted: totals of kinds outside the list."""

    long: DataFrame
    wide: DataFrame
    unlisted: DataFrame
    kinds: list[str]

    def unpivoted(self) -> DataFrame:
        """entity, kind, total, latest: the wide table's totals as rows, and those of unlisted kinds."""
        entity = self.wide.columns[0]
        cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`total|{k}`").alias("total"), F.col(f"`latest|{k}`").alias("latest")) for k in self.kinds])
        rows = self.wide.select(F.col(f"`{entity}`"), F.explode(cells).alias("_c")).select(F.col(f"`{entity}`"), "_c.*").where(F.col("total") > 0)
        return rows.unionByName(self.unlisted)


def entity_features(events: DataFrame, entity: str, kind: str, period: str, kinds: list[str], periods: list[int]) -> EntityFeatures:
    """Aggregate to a compact long table, then pivot with an explicit list.

    First the events are counted by (entity, kind, period), with partial counts before the
    shuffle, so a hot entity or kind is one row per task. Only this table, of at most
    entities × kinds × periods rows, is written once and pivoted. The wide table has, with `|` in the names,
    n|kind|period (0 if none), total|kind (0 if none), latest|kind (null if none), total and
    latest. Rows with a null entity, kind or period, or a period outside the list, do not count.
    A kind outside the list counts in total and latest, and in `unlisted`, but has no column.
    An empty table gives empty results.
    """
    known = events.select(F.col(entity).alias("_entity"), F.col(kind).alias("kind"), F.col(period).alias("period"))
    known = known.where(F.col("_entity").isNotNull() & F.col("kind").isNotNull() & F.col("period").isin(periods))
    long = written(known.groupBy("_entity", "kind", "period").agg(F.count(F.lit(1)).alias("n")), "features")
    listed = F.col("kind").isin(kinds)
    names = [f"n|{k}|{p}" for k in kinds for p in periods] + [f"{a}|{k}" for a in ("total", "latest") for k in kinds] + ["total", "latest"]
    name = lambda *parts: F.concat_ws("|", *parts)
    features = F.array(
        F.struct(F.when(listed, name(F.lit("n"), "kind", F.col("period").cast("string"))).alias("name"), F.col("n").alias("value"), F.lit(0).cast("bigint").alias("latest")),
        F.struct(F.when(listed, name(F.lit("total"), "kind")).alias("name"), F.col("n").alias("value"), F.lit(0).cast("bigint").alias("latest")),
        F.struct(F.when(listed, name(F.lit("latest"), "kind")).alias("name"), F.lit(0).cast("bigint").alias("value"), F.col("period").cast("bigint").alias("latest")),
        F.struct(F.lit("total").alias("name"), F.col("n").alias("value"), F.lit(0).cast("bigint").alias("latest")),
        F.struct(F.lit("latest").alias("name"), F.lit(0).cast("bigint").alias("value"), F.col("period").cast("bigint").alias("latest")),
    )
    cells = long.select("_entity", F.explode(features).alias("f")).select("_entity", "f.*").where(F.col("name").isNotNull())
    cells = cells.groupBy("_entity", "name").agg(F.greatest(F.sum("value"), F.max("latest")).alias("v"))
    wide = cells.groupBy("_entity").pivot("name", names).agg(F.first("v"))
    wide = wide.na.fill(0, [f"`{n}`" for n in names if not n.startswith("latest")])
    unlisted = long.where(~listed).groupBy("_entity", "kind").agg(F.sum("n").alias("total"), F.max("period").cast("bigint").alias("latest"))
    named = lambda df: df.withColumnRenamed("_entity", entity)
    return EntityFeatures(named(long), named(wide), named(unlisted), kinds)
