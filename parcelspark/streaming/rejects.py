"""Incident lines that keep arriving: the same rules as for a table, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.rejects import load_incidents

RAW = T.StructType([T.StructField("raw_id", T.LongType()), T.StructField("batch_file", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def load_stream(lines: DataFrame, codes: DataFrame, loaded: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Write loaded and rejected records of each batch to two folders; the parting keeps no state.

    Batches go to folders by their number, which a repeated batch overwrites, so each line is
    written once however often a batch is tried.
    """

    def put(batch: DataFrame, number: int) -> None:
        lines = batch.persist()  # read once for the two outputs
        good, bad = load_incidents(lines, codes)
        good.write.mode("overwrite").parquet(f"{loaded}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        lines.unpersist()

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
