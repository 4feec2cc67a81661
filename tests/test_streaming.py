from pyspark.sql import functions as F

from lineweave.streaming import events as E


def rows(spark):
    base = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.5).alias("value"))
    return base.withColumn("ts", (F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,event_id * 7)")).cast("timestamp_ntz"))


def streamed(spark, tmp_path, plan, name, mode):
    rows(spark).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows(spark).schema).parquet(str(tmp_path / "in"))
    query = plan(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_tumbling_stream_equals_table(spark, tmp_path):
    got = streamed(spark, tmp_path, E.tumbling, "tumbled", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.tumbling(rows(spark)).collect()))


def test_stream_drops_repeats(spark, tmp_path):
    doubled = lambda s: E.first_seen(s.union(s), ["event_id"])
    assert streamed(spark, tmp_path, doubled, "seen", "append").count() == 200


def test_sessions(spark):
    assert sorted(r.n for r in E.sessions(rows(spark), "5 hours").collect()) == [50] * 4
    assert E.sessions(rows(spark), "10 minutes").count() == 200


def test_sliding_stream_equals_table(spark, tmp_path):
    got = streamed(spark, tmp_path, E.sliding, "slid", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.sliding(rows(spark)).collect()))


def test_append_goes_on_where_it_ended(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in (0, 1):
        rows(spark).filter(f"event_id % 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows(spark).schema).parquet(str(tmp_path / "in"))
        E.append_to(source.select("event_id"), out, state).awaitTermination()
        assert spark.read.parquet(out).count() == 100 * (part + 1)


def test_runs_of_a_stream_equal_those_of_the_table_after_restarts(spark, tmp_path):
    kinds = F.when(F.col("event_id") % 11 < 6, "a").otherwise("b")
    whole = rows(spark).withColumn("event_type", kinds)
    late = spark.createDataFrame([(999, 0, "z", 1.0)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.lit("2030-01-01").cast("timestamp_ntz"))
    later = late.withColumn("event_id", F.lit(1000).cast("long")).withColumn("ts", F.lit("2031-01-01").cast("timestamp_ntz"))
    parts = [whole.filter("event_id < 70"), whole.filter("event_id BETWEEN 70 AND 139"), whole.filter("event_id > 139"), late, later]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in parts:  # a query of its own each time, which goes on from the state of the one before
        part.select(*whole.columns).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
        E.append_to(E.runs(source, "20 hours"), out, state).awaitTermination()
    want = sorted(tuple(r) for r in E.runs(whole, "20 hours").collect())
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect() if r.event_type != "z")
    assert got == want and len(want) > 20
    short = E.runs(whole, "20 minutes")
    assert short.count() == 200


def test_upserts_count_once_and_go_on(spark, tmp_path):
    path, state = str(tmp_path / "table"), str(tmp_path / "state")
    assert E.newest(spark, path) is None
    for n, k in enumerate((0, 1, 2)):
        rows(spark).filter(f"event_id >= {k * 50} AND event_id < {k * 50 + 100}").withColumn("value", F.lit(float(n))).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows(spark).schema).parquet(str(tmp_path / "in"))
        E.upsert_to(source.select("event_id", "value"), path, ["event_id"], state).awaitTermination()
    got = {r.event_id: r.value for r in E.newest(spark, path).collect()}
    assert got == {i: float(min(i // 50, 2)) for i in range(200)}
    found = E.versions(spark, path)
    assert len(found) == 2
    before = E.newest(spark, path, before=found[-1])
    before.write.parquet(f"{path}/version=99")  # a version that was not written to its end
    E.drop(spark, f"{path}/version=99/_SUCCESS")
    assert E.versions(spark, path) == found
