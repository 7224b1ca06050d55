from lodestone.streaming import events


def test_each_event_once_and_batches_replace_themselves(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    rows.unionByName(rows.limit(50)).write.parquet(str(tmp_path / "in"))
    stream = events.once(events.read(spark, str(tmp_path / "in"), rows.schema))
    for _ in range(2):
        events.append(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == rows.count() == out.select("event_id").distinct().count()
