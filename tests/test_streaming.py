import datetime as dt
import json

from pyspark.sql import functions as F

from parley import schemas
from parley.operators import KEY, analytics, discovery
from parley.plans.views import NOW, Views
from parley.sources.changes import ChangeLog, archive_logs
from parley.streaming import buffers, tables

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def as_stream(spark, df, path, files=1):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, tmp, mode="append"):
    q = (stream.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", str(tmp / f"ckpt-{name}")).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_discovery_batches_gap_threshold_and_last_wins(spark, tmp_path):
    rows = [("chatgpt", "a", 1, at(0)), ("chatgpt", "b", 2, at(200)), ("chatgpt", "a", 3, at(440)), ("chatgpt", "c", 4, at(1000)),
            ("gemini", "x", 5, at(0)), ("gemini", "y", 6, at(10)), ("gemini", "z", 7, at(20)), ("gemini", "late", 8, at(60_000))]
    df = spark.createDataFrame(rows, "platform string, source_id string, seq bigint, at timestamp")
    stream = as_stream(spark, df, str(tmp_path / "in"))
    drain(buffers.discovery_batches(stream, max_ids=3, watermark="0 seconds"), "batches", tmp_path)
    got = {}
    for r in spark.table("batches").orderBy("buffer", "batch", "place").collect():
        got.setdefault((r.buffer, r.batch, r.reason), []).append(json.loads(r.body)["seq"])
    assert got == {("chatgpt", 0, "timer"): [3, 2], ("chatgpt", 1, "timer"): [4], ("gemini", 0, "threshold"): [5, 6, 7]}


def test_log_batches_delay_from_first_and_urgent_pass(spark, tmp_path):
    rows = [("w", "l1", 1, "info", at(0)), ("w", "l2", 2, "debug", at(300)), ("w", "l3", 3, "info", at(450)),
            ("w", "l4", 4, "warn", at(500)), ("w", "l5", 5, "info", at(600)), ("v", "end", 6, "info", at(60_000))]
    df = spark.createDataFrame(rows, "worker_id string, id string, seq bigint, level string, at timestamp")
    drain(buffers.log_batches(as_stream(spark, df, str(tmp_path / "in")), watermark="0 seconds"), "flushed", tmp_path)
    got = [(r.batch, r.reason, r.id) for r in spark.table("flushed").where("buffer = 'w'").orderBy("batch", "place").collect()]
    assert got == [(0, "timer", "l1"), (0, "timer", "l2"), (0, "timer", None), (1, "manual", "l3"), (1, "manual", None),
                   (2, "pass", "l4"), (3, "timer", "l5"), (3, "timer", None)]
    note = json.loads(spark.table("flushed").where("buffer = 'w' AND batch = 0 AND id IS NULL").first().body)
    assert note["details"] == {"batchSize": 2, "reason": "timer"}


def test_stream_ingest_equals_batch_and_survives_retry(spark, tmp_path):
    v = Views(spark, SF)
    batch = v.ingest_v
    # Three files in order of arrival.
    for i in range(3):
        batch.where(F.col("seq") % 3 == i).withColumn("seq", F.col("seq") + i * 10_000).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    logs = archive_logs(spark, str(tmp_path / "archive"))
    seen = []
    q = tables.stream_ingest(stream, logs, NOW, str(tmp_path / "ckpt"), lambda rows, n: seen.append(rows.groupBy("status").count().collect()))
    q.awaitTermination()
    total = {}
    for part in seen:
        for r in part:
            total[r["status"]] = total.get(r["status"], 0) + r["count"]
    whole = batch.groupBy("platform", "source_id", "revision").count().count()
    keys = batch.select("platform", "source_id").distinct().count()
    assert total == {"created": keys, "updated": whole - keys, "duplicate": batch.count() - whole}
    assert logs["revisions"].known().count() == whole and logs["conversations"].known().count() == keys
    # A batch that is tried again sees the table before it and overwrites its own rows.
    third = batch.where(F.col("seq") % 3 == 2).withColumn("seq", F.col("seq") + 20_000)
    before = {n: sorted(map(tuple, log.known().collect()), key=repr) for n, log in logs.items()}
    _, conversations, revisions = tables.ingest_changes(third, logs["conversations"].known(2), logs["revisions"].known(2), NOW)
    logs["conversations"].append(conversations, 2)
    logs["revisions"].append(revisions, 2)
    assert {n: sorted(map(tuple, log.known().collect()), key=repr) for n, log in logs.items()} == before
    # New redeliveries are duplicates, and change nothing.
    done, conversations, revisions = tables.ingest_changes(batch, logs["conversations"].known(), logs["revisions"].known(), NOW)
    assert [r["status"] for r in done.select("status").distinct().collect()] == ["duplicate"]
    assert conversations.isEmpty() and revisions.isEmpty()


def test_a_log_grows_by_its_batches_and_compacts_apart(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "platform string, source_id string, title string", KEY)
    assert log.known().collect() == []

    def rows(*titles):
        return spark.createDataFrame([("p", str(i), t) for i, t in titles], log.schema)

    log.append(rows(*[(i, f"title {i} " * 20) for i in range(2000)]), 0)
    log.append(rows((5, "five")), 1)
    log.append(rows((5, "V"), (2000, "last")), 2)
    sizes = [sum(f.stat().st_size for f in (tmp_path / "log" / "changes" / f"n={n}").glob("*.parquet")) for n in range(3)]
    assert sizes[1] * 5 < sizes[0] and sizes[2] * 5 < sizes[0]
    want = {**{str(i): f"title {i} " * 20 for i in range(2000)}, "5": "V", "2000": "last"}
    assert {r.source_id: r.title for r in log.known().collect()} == want
    assert [r.title for r in log.known(2).where("source_id = '5'").collect()] == ["five"]
    log.compact(1)
    assert {r.source_id: r.title for r in log.known().collect()} == want and log._compacted() == 1
    log.compact(2)
    log.append(rows((7, "seven")), 3)
    assert {r.source_id: r.title for r in log.known().collect()} == {**want, "7": "seven"}


def test_stream_index_equals_batch(spark, tmp_path):
    v = Views(spark, SF)
    log = ChangeLog(spark, str(tmp_path / "t"), schemas.INDEX, KEY)
    log.append(v.index_v, -1)
    queued = []
    q = tables.stream_index(as_stream(spark, v.discovery_v, str(tmp_path / "in")), log, NOW, str(tmp_path / "ckpt"),
                            lambda rows, n: queued.append(rows.count()))
    q.awaitTermination()
    want = discovery.dedupe_then_apply(v.index_v, v.discovery_v, NOW)
    assert sorted(map(tuple, log.known().collect()), key=repr) == sorted(map(tuple, want["index"].collect()), key=repr)
    assert queued == [want["queueable"].count()]


def test_stream_dedupe_windows_and_tail(spark, tmp_path):
    v = Views(spark, SF)
    events = v.discovery_v.withColumn("at", F.lit(at(0)).cast("timestamp") + F.make_dt_interval(secs=F.col("seq") % 5))
    drain(tables.stream_dedupe(as_stream(spark, events, str(tmp_path / "e")), "1 hour"), "unique_events", tmp_path)
    assert spark.table("unique_events").count() == events.select("platform", "source_id", "revision_fingerprint").distinct().count()
    changes = v.queue_v.withColumn("at", F.col("updated_at").try_cast("timestamp"))
    drain(tables.platform_windows(as_stream(spark, changes, str(tmp_path / "q")), "1 day", watermark="2 days"), "win", tmp_path, "complete")
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, tables.platform_windows(changes, "1 day").collect()))
    tail = ChangeLog(spark, str(tmp_path / "logs"), schemas.LOGS, ["id"])
    tables.stream_log_tail(as_stream(spark, v.logs_v, str(tmp_path / "l"), 3), tail, 60, str(tmp_path / "ck")).awaitTermination()
    newest = [r.id for r in v.logs_v.orderBy(F.desc("timestamp"), F.desc("id")).limit(60).collect()]
    assert sorted(r.id for r in analytics.retain_logs(tail.known(), 60).collect()) == sorted(newest)


def test_sessions_and_flush_hook(spark, tmp_path):
    rows = [("p", "a", 1, at(0)), ("p", "a", 2, at(200)), ("p", "a", 3, at(600)), ("p", "b", 4, at(100_000))]
    df = spark.createDataFrame(rows, "platform string, source_id string, seq bigint, at timestamp")
    assert sorted(r.seq for r in buffers.discovery_sessions(df).collect()) == [2, 3, 4]
    got = []
    stream = as_stream(spark, df, str(tmp_path / "s"))
    buffers.on_flush(buffers.discovery_batches(stream, watermark="0 seconds", salts=4), lambda b, n: got.extend(b.collect()),
                     str(tmp_path / "c")).awaitTermination()
    assert sorted((r.reason, json.loads(r.body)["seq"]) for r in got) == [("timer", 2), ("timer", 3)]
