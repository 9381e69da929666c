"""Readers and writers. Every reader names its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INCIDENT_SCHEMA = T.StructType(
    [
        T.StructField("dc_dist", T.StringType()),
        T.StructField("psa", T.StringType()),
        T.StructField("ucr_general", T.IntegerType()),
        T.StructField("text_general_code", T.StringType()),
        T.StructField("point_x", T.DoubleType()),
        T.StructField("point_y", T.DoubleType()),
        T.StructField("dispatch_date", T.StringType()),
        T.StructField("dispatch_time", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table NAME of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_incident_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of incidents with a header, as text columns cast leniently (a value that does not fit is null)."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in INCIDENT_SCHEMA])
    df = spark.read.schema(raw).option("header", True).csv(path)
    return df.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in INCIDENT_SCHEMA])


def read_matrix_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A CSV matrix whose first column is the row id and whose others are the periods 1..columns, as unit_id, t, value.

    A Spark reader promises no order of lines, so the id has to be written with the row (write_matrix_csv does).
    """
    names = [f"v{i}" for i in range(1, columns + 1)]
    schema = T.StructType([T.StructField("unit_id", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in names])
    wide = spark.read.schema(schema).csv(path)
    return wide.select("unit_id", F.posexplode(F.array(*names)).alias("p", "value")).select("unit_id", (F.col("p") + 1).alias("t"), "value")


def read_plain_matrix_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A CSV matrix without ids, whose rows are the units 1, 2, ... in the order of the file, as unit_id, t, value.

    path is one file. Its splits keep the order of its lines, so a line's place is the number of lines in the splits before, of which one
    number by split goes to the driver, and its place in its split.
    """
    lines = spark.read.text(path).where(F.length("value") > 0).select("value", F.monotonically_increasing_id().alias("_id"))
    lines = lines.select("value", F.shiftright("_id", 33).alias("_split"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    held = {r["_split"]: r["n"] for r in lines.groupBy("_split").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for split in sorted(held):
        before += [F.lit(split), F.lit(total)]
        total += held[split]
    numbers = F.transform(F.split("value", ","), lambda v: F.trim(v).try_cast("double"))
    if not before:
        return lines.select(F.lit(0).alias("unit_id"), F.lit(0).alias("t"), F.lit(0.0).alias("value")).limit(0)
    unit = (F.create_map(*before)[F.col("_split")] + F.col("_at") + 1).cast("int").alias("unit_id")
    return lines.select(unit, F.posexplode(F.slice(numbers, 1, columns)).alias("p", "value")).select("unit_id", (F.col("p") + 1).alias("t"), "value")


def write_matrix_csv(long: DataFrame, path: str, columns: int) -> None:
    """Write unit_id, t, value (t = 1..columns) as one CSV row per unit; see read_matrix_csv."""
    wide = long.groupBy("unit_id").pivot("t", list(range(1, columns + 1))).agg(F.first("value"))
    wide.write.mode("overwrite").csv(path)


def append_comembership(pairs: DataFrame, path: str) -> None:
    """Append pairs of units of one cluster (run_id, particle_id, unit_a, unit_b) to a CSV folder."""
    pairs.write.mode("append").csv(path)


def read_comembership(spark: SparkSession, path: str) -> DataFrame:
    """The pairs that append_comembership wrote."""
    return spark.read.schema("run_id int, particle_id int, unit_a int, unit_b int").csv(path)


def read_batches(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """(rows of all batches with their number as batch, the paths that do not exist): batches of a study, each a Parquet folder; missing ones are skipped and named."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = [hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(p)) for p in paths]
    out = spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    for i, (path, found) in enumerate(zip(paths, there), 1):
        if found:
            out = out.unionByName(spark.read.schema(schema).parquet(path).withColumn("batch", F.lit(i)))
    return out, [p for p, found in zip(paths, there) if not found]
