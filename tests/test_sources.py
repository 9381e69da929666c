import math

from pyspark.sql import functions as F

from parcelspark.functions import scalars
from parcelspark.operators import incidents
from parcelspark.sources import generators, tables


def test_matrix_round_trip(spark, tmp_path):
    long = spark.createDataFrame([(u, t, u + t / 10) for u in (1, 2, 3) for t in (1, 2)], "unit_id int, t int, value double")
    tables.write_matrix_csv(long, str(tmp_path / "m"), 2)
    back = tables.read_matrix_csv(spark, str(tmp_path / "m"), 2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_incident_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("dc_dist,psa,ucr_general,text_general_code,point_x,point_y,dispatch_date,dispatch_time\n01,2,600,\"a, b\",-41.1,x,2010-01-01,10:00:00\n")
    row = tables.read_incident_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row["ucr_general"], row["text_general_code"], row["point_x"], row["point_y"]) == (600, "a, b", -41.1, None)


def test_scalars(spark):
    df = spark.createDataFrame([(1,), (5,), (0,), (None,)], "n int")
    assert [None if v is None else round(v, 9) for (v,) in df.select(scalars.ln_gamma_int(F.col("n"))).collect()] == [0.0, 3.17805383, None, None]
    back = df.select(scalars.ihs_count(scalars.ihs(F.col("n").cast("double")), F.lit(1.0))).collect()
    assert [v for (v,) in back] == [1.0, 5.0, 0.0, None]


def test_times_and_kinds(spark):
    df = spark.createDataFrame([(1, 600, "2010-01-03 00:00:00", "10:00:00"), (2, 7, "01/03/2010", "25:00:00"), (3, None, None, None), (4, 7, "13/01/2010", "10:00:00"), (5, 7, "5 May", "10:00:00")], "id int, ucr_general int, dispatch_date string, dispatch_time string")
    codes = spark.createDataFrame([(600, "theft"), (600, "zzz"), (None, "x")], "ucr_general int, crimetype string")
    rows = {r["id"]: r for r in incidents.with_times(incidents.with_kind(df, codes)).collect()}
    assert rows[1]["kind"] == "theft" and rows[1]["weekday_name"] == "Sunday" and rows[1]["year_of_day"] == 2010
    assert rows[2]["kind"] is None and str(rows[2]["day"]) == "2010-01-03" and rows[2]["moment"] is None and rows[2]["week_time"] is None and len(rows) == 5
    assert all(rows[i]["day"] is None for i in (3, 4, 5))


def test_counts_without_a_cap(spark):
    truth = spark.createDataFrame([(r, 1, a, 0.0) for r in range(1, 201) for a in ([6.0, 8.0][r % 2],)], "run_id int, unit_id int, alpha double, beta double")
    rows = generators.poisson_panel(truth, 4, seed=5).toPandas()
    for odd, alpha in ((0, 6.0), (1, 8.0)):
        y = rows[rows.run_id % 2 == odd].y
        assert abs(y.mean() / math.exp(alpha) - 1) < 0.02 and 0.7 < y.var() / math.exp(alpha) < 1.3
    again = generators.poisson_panel(truth.repartition(7), 4, seed=5).toPandas()
    key = ["run_id", "unit_id", "t"]
    assert rows.sort_values(key).y.tolist() == again.sort_values(key).y.tolist()


def test_plain_matrix_batches_and_pairs(spark, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"{u}.5, {u + 100}\n" for u in range(1, 400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = tables.read_plain_matrix_csv(spark, str(tmp_path / "x.csv"), 2)
        got = {(r["unit_id"], r["t"]): r["value"] for r in rows.collect()}
        assert rows.rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(u, t): u + 0.5 if t == 1 else u + 100.0 for u in range(1, 400) for t in (1, 2)}
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "a int, v double")
    df.write.parquet(str(tmp_path / "b2"))
    rows, missing = tables.read_batches(spark, [str(tmp_path / n) for n in ("b1", "b2", "b3")], df.schema)
    assert sorted(map(tuple, rows.collect())) == [(1, 1.0, 2), (2, 2.0, 2)] and [m[-2:] for m in missing] == ["b1", "b3"]
    pairs = spark.createDataFrame([(1, 1, 2, 5)], "run_id int, particle_id int, unit_a int, unit_b int")
    for _ in range(2):
        tables.append_comembership(pairs, str(tmp_path / "pairs"))
    assert list(map(tuple, tables.read_comembership(spark, str(tmp_path / "pairs")).collect())) == [(1, 1, 2, 5)] * 2


def test_order(spark):
    df = spark.createDataFrame([(3, "b"), (1, "b"), (2, None), (4, "a")], "crime_id int, moment string")
    assert [r["crime_id"] for r in incidents.in_order(df).collect()] == [2, 4, 1, 3]
