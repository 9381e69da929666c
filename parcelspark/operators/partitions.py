"""Algebra of partitions given as keys, unit_id, cluster_id; labels carry no meaning of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_sizes(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """Units by cluster."""
    return assignment.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("n"))


def relabelled(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """Labels 1, 2, ... in the order of the clusters' least units."""
    first = F.min("unit_id").over(Window.partitionBy(*keys, "cluster_id"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    return assignment.withColumn("_first", first).withColumn("cluster_id", rank).drop("_first")


def merged_labels(assignment: DataFrame, low: Column, high: Column) -> DataFrame:
    """Cluster high joins cluster low (low < high), and the labels above high move down by one."""
    c = F.col("cluster_id")
    return assignment.withColumn("cluster_id", F.when(c == high, low).when(c > high, c - 1).otherwise(c))


def signatures(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """A text that two partitions of the same units share if and only if they are equal: each unit with the least unit of its cluster."""
    least = F.min("unit_id").over(Window.partitionBy(*keys, "cluster_id"))
    rows = assignment.withColumn("_least", least)
    listed = F.array_sort(F.collect_list(F.struct("unit_id", "_least")))
    text = F.array_join(F.transform(listed, lambda r: r["_least"].cast("string")), ",")
    return rows.groupBy(*keys).agg(text.alias("_text"), F.count(F.lit(1)).alias("units")).select(*keys, F.md5("_text").alias("signature"), "units")


def meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The common refinement, labelled by dense rank of the two labels."""
    both = a.join(b.withColumnRenamed("cluster_id", "_other"), [*keys, "unit_id"])
    return both.withColumn("cluster_id", F.dense_rank().over(Window.partitionBy(*keys).orderBy("cluster_id", "_other"))).drop("_other")


def contingency(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c1, c2, n: units by the clusters of two partitions."""
    both = a.withColumnRenamed("cluster_id", "c1").join(b.withColumnRenamed("cluster_id", "c2"), [*keys, "unit_id"])
    return both.groupBy(*keys, "c1", "c2").agg(F.count(F.lit(1)).alias("n"))


def comembership(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit_a, unit_b: pairs of a cluster, unit_a < unit_b. Rows grow with the squares of the clusters' sizes, as the result is defined so; contingency and cluster_sizes count pairs without listing them."""
    other = assignment.select(*keys, "cluster_id", F.col("unit_id").alias("unit_b"))
    return assignment.withColumnRenamed("unit_id", "unit_a").join(other, [*keys, "cluster_id"]).where(F.col("unit_a") < F.col("unit_b")).select(*keys, "unit_a", "unit_b")


def comparison(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rand, adjusted Rand, Binder's loss (unscaled, and times 2/n²) and variation of information (natural and base 2) from a contingency table.

    All are sums over the cells and margins of each key. Adjusted Rand is null where it is 0/0 (one cluster, or singletons, on both sides).
    """
    pairs = lambda n: n * (n - 1) / 2.0
    xlogx = lambda n: n * F.ln(n)
    one = Window.partitionBy(*keys, "c1")
    two = Window.partitionBy(*keys, "c2")
    n = F.col("n").cast("double")
    m = table.withColumns({"n1": F.sum(n).over(one), "n2": F.sum(n).over(two), "first1": F.row_number().over(one.orderBy("c2")) == 1, "first2": F.row_number().over(two.orderBy("c1")) == 1})
    only = lambda flag, v: F.sum(F.when(F.col(flag), v).otherwise(0.0))
    sums = m.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(pairs(n)).alias("p12"), only("first1", pairs(F.col("n1"))).alias("p1"), only("first2", pairs(F.col("n2"))).alias("p2"), F.sum(xlogx(n)).alias("e12"), only("first1", xlogx(F.col("n1"))).alias("e1"), only("first2", xlogx(F.col("n2"))).alias("e2"))
    p, p1, p2, p12, n = pairs(F.col("n")), F.col("p1"), F.col("p2"), F.col("p12"), F.col("n")
    binder = p1 + p2 - 2 * p12
    expected = p1 * p2 / F.nullif(p, F.lit(0.0))
    vi = F.greatest((F.col("e1") + F.col("e2") - 2 * F.col("e12")) / n, F.lit(0.0))
    return sums.select(*keys, (1 - binder / F.nullif(p, F.lit(0.0))).alias("rand"), ((p12 - expected) / F.nullif((p1 + p2) / 2 - expected, F.lit(0.0))).alias("adjusted_rand"), binder.alias("binder"), (binder * 2 / (n * n)).alias("binder_scaled"), vi.alias("vi"), (vi / F.ln(F.lit(2.0))).alias("vi_log2"))


def within_squares(assignment: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of squares of value around its cluster's mean, by key."""
    on = [c for c in values.columns if c in (*keys, "unit_id")]
    by = assignment.join(values.select(*on, value), on).groupBy(*keys, "cluster_id").agg((F.var_pop(value) * F.count(value)).alias("ss"))
    return by.groupBy(*keys).agg(F.sum("ss").alias("within_ss"))


def mode_labels(draws: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The commonest label of each key; of equals the least."""
    counts = draws.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("mode"), F.max("n").alias("n"))


def elbow(path: DataFrame, keys: list[str], k: str, value: str) -> DataFrame:
    """The k where a falling curve bends most: greatest second difference; of equals the least k. Keys with under three points give none."""
    w = Window.partitionBy(*keys).orderBy(k)
    bent = path.withColumn("bend", F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)).where(F.col("bend").isNotNull())
    return bent.groupBy(*keys).agg(F.max_by(k, F.struct("bend", -F.col(k))).alias("elbow"))
