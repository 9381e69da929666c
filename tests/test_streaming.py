from parcelspark.operators.rejects import load_incidents
from parcelspark.sources.tables import table
from parcelspark.streaming.rejects import arriving, load_stream


def test_stream_equals_table(spark, small, tmp_path):
    raw, codes = table(spark, small, "incident_raw"), table(spark, small, "crime_code")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    query = load_stream(arriving(spark, str(tmp_path / "in"), 1), codes, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    ids = lambda df: sorted(r["raw_id"] for r in df.select("raw_id").collect())
    loaded, rejected = load_incidents(raw, codes)
    assert ids(spark.read.parquet(str(tmp_path / "good"))) == ids(loaded)
    assert ids(spark.read.parquet(str(tmp_path / "bad"))) == ids(rejected)
