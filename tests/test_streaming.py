import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gradewell.models import training as T
from gradewell.operators import sessions as S
from gradewell.streaming import events as E
from gradewell.streaming.scoring import score_stream


def run(stream, tmp_path, fmt="parquet"):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    E.append_to(stream, out, state, fmt).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.format(fmt).load(out)


def source(spark, fx, tmp_path, table):
    path = str(tmp_path / "in")
    table.repartition(3).write.parquet(path)
    return E.read_events(spark, path, table.schema)


def test_batch_sessions_of_a_user_with_most_events(spark):
    rng = random.Random(3)
    start = datetime(1969, 12, 30)
    rows = [(rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 2, None]), start + timedelta(seconds=rng.choice([0, 600, 1800]) + 900 * rng.randrange(600))) for _ in range(1500)]
    rows += [(3, None), (4, start), (4, start), (4, start + timedelta(seconds=1800)), (4, start + timedelta(seconds=3599, microseconds=999999))]
    expected = []
    for user in {u for u, _ in rows}:
        times = sorted(t for u, t in rows if u == user and t)
        for i, t in enumerate(times):
            if i and t < times[i - 1] + timedelta(seconds=1800):
                expected[-1][2:] = [t + timedelta(seconds=1800), expected[-1][3] + 1]
            else:
                expected.append([user, t, t + timedelta(seconds=1800), 1])
    for kind in ("timestamp", "timestamp_ntz"):
        events = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz").withColumn("ts", F.col("ts").cast(kind))
        got = S.gap_sessions(events, "user_id", "ts", 1800).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
        assert sorted(map(list, got.collect()), key=str) == sorted(expected, key=str)
    assert S.gap_sessions(events.limit(0), "user_id", "ts", 1800).count() == 0


def test_closed_sessions_equal_the_batch(spark, fx, tmp_path):
    events = fx.table("events").select("user_id", "ts", "event_id")
    got = run(E.gap_sessions(source(spark, fx, tmp_path, events), "user_id", "ts"), tmp_path)
    batch = S.gap_sessions(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 1800)
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = batch.filter(F.col("end") <= F.lit(last) - F.expr("interval 1 hour"))
    assert got.count() == closed.count() > 0
    assert got.exceptAll(closed.select(got.columns)).count() == 0


def test_content_is_seen_once(spark, fx, tmp_path):
    table = fx.table("events").limit(50).select("event_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
                                               F.sha2((F.col("event_id") % 7).cast("string"), 256).alias("sha"))
    got = run(E.distinct_content(source(spark, fx, tmp_path, table), "ts", "sha"), tmp_path)
    assert got.count() == table.select("sha").distinct().count()


def test_feedback_windows_equal_the_batch(spark, fx, tmp_path):
    feedback = fx.feedback.select("ts", "rating", "seconds")
    got = run(E.feedback_metrics(source(spark, fx, tmp_path, feedback), "ts"), tmp_path)
    batch = S.feedback_metrics(feedback.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day")
    want = {r["start"]: r["n"] for r in batch.collect()}
    assert got.count() > 0 and all(want[r["start"]] == r["n"] for r in got.collect())


def test_feedback_documents(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{"session_id":"s","image_count":1,"retake_count":0,"time_to_finish_seconds":2.5,"clarity_rating":4}\n{"session_id":"t","clarity_rating":8}\nbroken\n')
    got = run(E.read_feedback(spark, str(tmp_path / "docs")), tmp_path, "json")
    assert [r["session_id"] for r in got.collect()] == ["s"]


def test_task_states_keep_the_newest(spark, tmp_path):
    rows = [("a", 1, "PENDING"), ("a", 3, "SUCCESS"), ("a", 2, "STARTED"), ("b", 1, "PENDING")]
    table = spark.createDataFrame(rows, "task string, at int, state string").withColumn("at", F.timestamp_seconds("at"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = E.latest_states(stream, "task", "at").writeStream.outputMode("update").format("memory").queryName("task_states").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["task"], r["state"]) for r in spark.table("task_states").collect()} == {("a", "SUCCESS"), ("b", "PENDING")}


def test_task_states_expire(spark, tmp_path):
    stream = None
    for n, (task, at) in enumerate([("a", 0), ("b", 100_000), ("c", 200_000), ("d", 300_000)]):
        table = spark.createDataFrame([(task, at, "STARTED")], "task string, at int, state string").withColumn("at", F.timestamp_seconds("at"))
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream or spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        query = E.latest_states(stream, "task", "at", keep_seconds=3600).writeStream.outputMode("update").option(
            "checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, i: df.collect() and None).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] < 4


def test_scored_stream_equals_scored_table(spark, fx, tmp_path):
    table = fx.feats.select("row_id", "label", "qty_sum", "total").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    model = T.fit(table, ["qty_sum", "total"], "naive_bayes")
    ok = F.col("row_id") % 5 != 0
    got = run(score_stream(source(spark, fx, tmp_path, table), model, ok), tmp_path).select("row_id", "result", "positive_probability")
    want = score_stream(table, model, ok).select("row_id", "result", "positive_probability")
    assert got.count() == table.count() and got.exceptAll(want).count() == 0
    assert got.filter("row_id % 5 = 0 and positive_probability is not null").count() == 0
