import datetime as dt

from lexmill.streaming import stream


def test_spend_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), "ab"[i % 2], 1.5, '{"k": 2}') for i in range(20)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, event_type string, value double, props string")
    path = str(tmp_path / "events.parquet")
    df.repartition(3).write.parquet(path)
    got = stream.run_available(spark, path, stream.spend_windows, "spend")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stream.spend_windows(df).collect()))


def test_versions_are_minted_once(spark, tmp_path):
    rows = [("d", s, dt.datetime(2024, 1, d)) for d, s in enumerate(["x", "x", "y", "x"], 1)]
    path = str(tmp_path / "manifest")
    spark.createDataFrame(rows, "doc_id string, sha256 string, fetched_at timestamp_ntz").write.parquet(path)
    got = stream.run_available(spark, path, stream.new_versions, "versions", mode="append")
    assert sorted(r["sha256"] for r in got.collect()) == ["x", "y"]
