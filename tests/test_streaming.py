from boxwright.streaming import counters


def run(spark, folder, rows, schema, make, name):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_running_counters(spark, tmp_path):
    rows = [(f"c{i % 2}", i, 0.05, int(i % 3 == 0)) for i in range(40)]
    got = run(spark, tmp_path, rows, "source string, frame_no bigint, seconds double, n int", counters.running_counters, "counted")
    last = max((r for r in got if r.source == "c0"), key=lambda r: r.frame_no)
    assert len(got) == 40 and last.seen == 20 and last.hit == 7 and abs(last.fps - 20) < 1e-9


def test_rate_limited_capture(spark, tmp_path):
    rows = [("c", i, i * 0.1) for i in range(20)]
    got = run(spark, tmp_path, rows, "source string, frame_no bigint, t double", lambda s: counters.rate_limited(s, 0.15, 5), "captured")
    assert [r.frame_no for r in sorted(got, key=lambda r: r.saved)] == [0, 2, 4, 6, 8]
