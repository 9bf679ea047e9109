from docloom.streaming import events


def test_windows_match_the_batch(spark, sf001, tmp_path):
    folder = f"{tmp_path}/in"
    batch = spark.read.parquet(f"{sf001}/events.parquet")
    batch.repartition(3).write.parquet(folder)
    counts = events.windowed_counts(events.read_events(spark, folder), late="60 days")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in events.windowed_counts(batch).collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want
