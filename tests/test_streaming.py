from sparkloom.streaming import edges as E


def test_degrees_and_windows_over_a_stream(spark, tmp_path):
    rows = [(0, 1, "2024-01-01 00:10:00"), (0, 2, "2024-01-01 00:20:00"), (0, 1, "2024-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "src long, dst long, t string").selectExpr("src", "dst", "cast(t as timestamp) ts")
    df.write.parquet(str(tmp_path / "in"))
    stream = E.read_stream(spark, str(tmp_path / "in"))
    out = {}
    for name, query, mode in (("deg", E.running_degrees(stream), "complete"), ("win", E.windowed_edges(stream), "complete"), ("uniq", E.distinct_edges(stream), "append")):
        q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        out[name] = spark.table(name).collect()
    assert {r["id"]: r["degree"] for r in out["deg"]} == {0: 3, 1: 2, 2: 1}
    assert sorted(r["n"] for r in out["win"]) == [1, 2]
    assert len(out["uniq"]) == 2
