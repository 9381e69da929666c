"""Session helpers: a local session for tests and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Inputs of at most so many bytes may be moved for the sake of more tasks; larger ones never are.
SPREAD_BYTES = 64 << 20


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("parcelspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset.

    A cluster without the setting is an error, as no folder of the driver's machine is shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parcelspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, whatever folder they start in."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="parcelspark-code-"), "parcelspark.zip")  # the driver serves it from there
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores where it is an input of at most SPREAD_BYTES, which one file may hold; any larger input is read as its files are cut."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def over_cores(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where each row is work for a Python helper; small tables would else be a task or two."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _path_on(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write df once as a table in the shared folder and read it back; rows_a_file: at most so many, for large rows, which are else held together.

    Later reads survive the loss of executors and do not compute df again. The table is removed
    when the application ends, or before that by dropped.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    files, place = _path_on(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written made and that nothing reads any more."""
    for table in tables:
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            files, place = _path_on(table.sparkSession, path)
            files.delete(place, True)
