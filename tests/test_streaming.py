from voxelry.streaming import contours


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_contours_split_as_points_arrive(spark, tmp_path):
    schema = "object long, idx long, z int, value double"
    src = str(tmp_path / "points")
    spark.createDataFrame([(1, 1, 0, 0.0), (1, 2, 0, 1.0), (2, 1, 0, 5.0)], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = contours.split_stream(stream, 3.0).writeStream.outputMode("append").format("memory").queryName("split").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(1, 3, 0, 9.0), (2, 2, 1, 5.0)], schema).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.object, r.idx): r.contour for r in spark.sql("select * from split").collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 2, (2, 1): 1, (2, 2): 2}


def test_windows_and_sessions(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:02:00", 2.0), (1, "2024-01-01 00:20:00", 4.0)]
    df = spark.createDataFrame(rows, "object long, t string, value double").selectExpr("object", "cast(t as timestamp) ts", "value")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = run(spark, contours.windowed_counts(stream, "0 minutes"), "windows", "complete")
    assert sorted((r.n, r.total) for r in got) == [(1, 4.0), (2, 3.0)]
    got = run(spark, contours.sessions(stream, "5 minutes", "0 minutes"), "runs", "complete")
    assert sorted(r.n for r in got) == [1, 2]
