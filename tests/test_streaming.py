import os

import pytest
from pyspark.sql import functions as F

from paths import SF001
from riskline.plans import catalog as C
from riskline.streaming import stream as St


def _frames(spark, folder, counts_per_file, user=1):
    """Write frames of one stream as parquet files in time order (one file per batch)."""
    start = 0
    for i, n in enumerate(counts_per_file):
        rows = [(user, start + j, start + j) for j in range(n)]
        spark.createDataFrame(rows, "user_id long, event_id long, ts long").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(folder, f"part{i:03d}"))
        start += n


def _sampled(spark, tmp_dir, counts, max_files=None):
    src_dir = os.path.join(tmp_dir, "src")
    _frames(spark, src_dir, counts)
    src = (spark.readStream.schema("user_id long, event_id long, ts long")
           .option("maxFilesPerTrigger", max_files or 1000).option("recursiveFileLookup", "true").parquet(src_dir))
    out = os.path.join(tmp_dir, "out")
    St.count_frames(src, "user_id", ["ts", "event_id"], out, os.path.join(tmp_dir, "ck")).awaitTermination()
    return sorted(r.frame_no for r in St.read_frames(spark, out).collect())


@pytest.mark.parametrize("n,expected", [(29, []), (30, [30]), (60, [30, 60]), (61, [30, 60])])
def test_frame_counts(spark, tmp_dir, n, expected):
    assert _sampled(spark, tmp_dir, [n]) == expected


def test_counter_survives_micro_batches(spark, tmp_dir):
    # 25 + 25 + 25 frames in three micro-batches: frames 30 and 60 straddle batches
    assert _sampled(spark, tmp_dir, [25, 25, 25], max_files=1) == [30, 60]


def test_explicit_frame_number_is_stateless(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 62)], "frame_no long")
    assert [r[0] for r in St.sample_frames(df, "frame_no", 30).collect()] == [30, 60]


def test_stream_equals_batch(spark):
    for sname, bname in [("stream_alerts", "alerts"), ("stream_latest_state", "latest_state"),
                         ("stream_frame_sample", "frame_sample")]:
        s = C.QUERIES[sname](spark, SF001)
        b = C.QUERIES[bname](spark, SF001)
        assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0, sname


def test_monitor_dead_letter(spark, tmp_dir):
    src_dir = os.path.join(tmp_dir, "scans")
    rows = [(1, 1, "urgent verify", "ok"), (1, 2, "", "error"), (2, 1, "hello", "ok")]
    spark.createDataFrame(rows, "stream_id long, seq long, text string, status string") \
        .write.parquet(src_dir)
    model = spark.createDataFrame([("urgent", 1.0, 3.0)], "term string, idf double, coef double")
    from riskline.functions import risk as R
    from riskline.operators import features as Fe

    def scorer(b):
        return Fe.score_linear(b, "stream_id", "text", model, keep=("seq",)).withColumn("risk_band", R.band("risk_score"))

    src = St.file_stream(spark, src_dir)
    out = os.path.join(tmp_dir, "mon")
    St.monitor(src, scorer, out, os.path.join(tmp_dir, "ck"), key="stream_id", order="seq",
               trigger="availableNow").awaitTermination()
    assert spark.read.parquet(f"{out}/dead_letter").count() == 1
    alerts = spark.read.parquet(f"{out}/alerts").collect()
    # a non-blank text without any known term scores sigma(0) = 0.5 -> MEDIUM, which alerts
    assert sorted((a.stream_id, a.seq, a.risk_band) for a in alerts) == [(1, 1, "HIGH"), (2, 1, "MEDIUM")]
    state = {r.stream_id: (r.seq, r.risk_band) for r in St.read_state(spark, out, "stream_id", "seq").collect()}
    assert state == {1: (1, "HIGH"), 2: (1, "MEDIUM")}


def test_processing_time_trigger_start_and_stop(spark, tmp_dir):
    """L1/L2: a fixed-interval monitor picks up files as they arrive and stops on request."""
    import time
    from riskline.functions import risk as R
    from riskline.operators import features as Fe
    src_dir = os.path.join(tmp_dir, "scans")
    os.makedirs(src_dir)
    schema = "stream_id long, seq long, text string"
    model = spark.createDataFrame([("urgent", 1.0, 3.0)], "term string, idf double, coef double")

    def scorer(b):
        return Fe.score_linear(b, "stream_id", "text", model, keep=("seq",)).withColumn("risk_band", R.band("risk_score"))

    src = spark.readStream.schema(schema).parquet(src_dir)
    out = os.path.join(tmp_dir, "mon")
    q = St.monitor(src, scorer, out, os.path.join(tmp_dir, "ck"), key="stream_id", order="seq",
                   trigger="1 second")
    try:
        spark.createDataFrame([(1, 1, "urgent now")], schema).write.mode("append").parquet(src_dir)
        q.processAllAvailable()
        spark.createDataFrame([(1, 2, "all calm")], schema).write.mode("append").parquet(src_dir)
        q.processAllAvailable()
        spark.createDataFrame([(2, 1, "urgent")], schema).write.mode("append").parquet(src_dir)
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    assert not q.isActive
    state = {r.stream_id: (r.seq, r.risk_band) for r in St.read_state(spark, out, "stream_id", "seq").collect()}
    assert state == {1: (2, "MEDIUM"), 2: (1, "HIGH")}
    assert spark.read.parquet(f"{out}/scores").count() == 3


def test_late_captures_win_under_every_zone(spark, tmp_dir):
    import datetime as dt
    src_dir = os.path.join(tmp_dir, "caps")
    t0 = dt.datetime(2024, 3, 10, 2, 30, 0)  # an hour that New York skips
    batches = [
        [(1, t0 + dt.timedelta(milliseconds=100)), (2, t0 + dt.timedelta(milliseconds=500)),
         (3, t0 + dt.timedelta(minutes=5))],
        [(4, t0 + dt.timedelta(milliseconds=900)), (5, t0 + dt.timedelta(minutes=5, milliseconds=700))],
        [(6, t0 + dt.timedelta(milliseconds=950)), (7, t0 + dt.timedelta(days=9))],
        [(8, t0 + dt.timedelta(milliseconds=200)), (9, None)],  # days late, and not the last of its second
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(src_dir, f"part{i}"))
    tz = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            src = (spark.readStream.schema("event_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(src_dir))
            out = os.path.join(tmp_dir, zone.replace("/", "-"))
            St.capture_stream(src, "ts", "event_id", out, out + "-ck").awaitTermination()
            got = {r.capture_name: (r.event_id, r.n_writes) for r in St.read_captures(spark, out, "event_id").collect()}
            assert got == {"capture_20240310_023000.png": (6, 5), "capture_20240310_023500.png": (5, 2),
                           "capture_20240319_023000.png": (7, 1), None: (9, 1)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", tz)


def test_monitor_with_trained_pipeline(spark, tmp_dir):
    from riskline.operators import model as Mo
    rows = [(i, "good fine lovely day", 0) for i in range(20)] + [(100 + i, "urgent verify password now", 1) for i in range(20)]
    model = Mo.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), "doc_id", fit_on="all").model
    src_dir = os.path.join(tmp_dir, "scans")
    spark.createDataFrame([(1, 1, "urgent verify your password"), (1, 2, "lovely day"), (2, 1, "   ")],
                          "stream_id long, seq long, text string").write.parquet(src_dir)
    out = os.path.join(tmp_dir, "mon")
    St.monitor(St.file_stream(spark, src_dir), lambda b: Mo.classify(b, model, "text"), out,
               os.path.join(tmp_dir, "ck"), key="stream_id", order="seq", trigger="availableNow").awaitTermination()
    alerts = [(r.stream_id, r.seq) for r in spark.read.parquet(f"{out}/alerts").collect()]
    assert alerts == [(1, 1)]
    state = {r.stream_id: (r.seq, r.risk_band, r.risk_score) for r in St.read_state(spark, out, "stream_id", "seq").collect()}
    assert state[1][:2] == (2, "LOW") and state[2] == (1, "LOW", 0.0)


def _log(spark, path):
    from riskline.streaming.keyed_log import latest_log
    return latest_log(spark, path, "k", "o", [("k", "string"), ("o", "long"), ("v", "string")])


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_keyed_log_writes_what_changed_and_compacts(spark, tmp_dir):
    log = _log(spark, tmp_dir)
    assert log.read().count() == 0
    many = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(0).cast("long").alias("o"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("v"))
    log.append(many, 0)
    few = spark.createDataFrame([("5", 1, "new"), ("x", 1, "new"), ("5", 3, "newest"), (None, 1, "no key")], "k string, o long, v string")
    log.append(few, 1)
    # the second batch merges into a base once; the next small ones only add what they changed
    before = _size(f"{tmp_dir}/base")
    log.append(spark.createDataFrame([("7", 1, "late")], "k string, o long, v string"), 2)
    log.append(spark.createDataFrame([("7", 0, "older"), ("8", -1, "older")], "k string, o long, v string"), 3)
    assert _size(f"{tmp_dir}/base") == before
    assert max(_size(f"{tmp_dir}/changes/batch_id={b}") for b in (2, 3)) < before / 20
    for _ in range(2):  # replaying a batch changes nothing
        got = {r.k: (r.o, r.v) for r in log.read().where("k in ('5', '7', 'x') or k is null").collect()}
        assert got == {"5": (3, "newest"), "7": (1, "late"), "x": (1, "new"), None: (1, "no key")}
        assert log.read().count() == 20_002 and log.read().where("k = '8' and o = 0").count() == 1
        log.append(spark.createDataFrame([("7", 0, "older"), ("8", -1, "older")], "k string, o long, v string"), 3)
    assert log.read(before=1).count() == 20_000


def test_keyed_log_ignores_a_torn_base(spark, tmp_dir):
    log = _log(spark, tmp_dir)
    for b in range(3):
        log.append(spark.createDataFrame([("a", b, "v%d" % b)], "k string, o long, v string"), b)
    log.compact(2)
    os.remove(f"{tmp_dir}/base/v=2/_SUCCESS")
    assert [tuple(r) for r in log.read().collect()] == [("a", 2, "v2")]


def test_count_frames_of_a_hot_stream(spark, tmp_dir):
    """A third of a batch in one stream, null keys, several batches: the numbers go on and equal a plain count."""
    from pyspark.sql import Window
    src = os.path.join(tmp_dir, "src")
    every = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40)
        .cast("long").alias("user_id"), F.col("id").alias("event_id"), F.col("id").alias("ts"))
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    for low in range(0, 9_000, 3_000):
        every.where(F.col("ts").between(low, low + 2_999)).write.mode("append").parquet(src)
        St.count_frames(St.file_stream(spark, src), "user_id", ["ts", "event_id"], out, ck, 30).awaitTermination()
    got = {tuple(r) for r in St.read_frames(spark, out).select("user_id", "event_id", "frame_no").collect()}
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = every.withColumn("frame_no", F.row_number().over(w)).where("frame_no % 30 = 0")
    assert got == {tuple(r) for r in want.select("user_id", "event_id", "frame_no").collect()}


def test_replay_is_idempotent_and_keeps_newer_state(spark, tmp_dir):
    from riskline.functions import risk as R
    from riskline.operators import features as Fe
    src_dir, out = os.path.join(tmp_dir, "scans"), os.path.join(tmp_dir, "mon")
    rows = [(1, 1, "urgent", "", "error", "e1"), (1, 2, "calm", "calm", "ok", None), (2, 1, "urgent", "", "error", "e2"),
            (3, 1, "", "", "unreadable", None), (4, 1, "urgent", "", "error", "e4")]
    spark.createDataFrame(rows, "stream_id long, seq long, raw string, text string, status string, error string") \
        .write.parquet(src_dir)
    model = Fe.TermModel(("urgent",), (1.0,), (3.0,), 1)

    def scorer(b):
        return Fe.score_linear(b, "stream_id", "text", model, keep=("seq",)).withColumn("risk_band", R.band("risk_score"))

    def extract(bad):
        return lambda d: d.withColumn("text", F.when(F.col("stream_id").isin(bad), F.lit("")).otherwise(F.col("raw"))) \
            .withColumn("status", F.when(F.col("stream_id").isin(bad), F.lit("error")).otherwise(F.lit("ok"))) \
            .withColumn("error", F.when(F.col("stream_id").isin(bad), F.lit("again")))

    St.monitor(St.file_stream(spark, src_dir), scorer, out, os.path.join(tmp_dir, "ck"), key="stream_id", order="seq",
               trigger="availableNow").awaitTermination()
    state = lambda: {r.stream_id: (r.seq, r.risk_band) for r in St.read_state(spark, out, "stream_id", "seq").collect()}
    left = lambda: sorted((r.stream_id, r.seq, r.attempt, r.error) for r in
                          St.open_letters(spark, out, "stream_id", "seq").collect())
    assert state() == {1: (2, "MEDIUM"), 3: (1, "LOW")}  # what could not be read scores 0.0
    assert left() == [(1, 1, 1, "e1"), (2, 1, 1, "e2"), (4, 1, 1, "e4")]
    for _ in range(2):  # the same run twice
        St.replay(spark, out, extract([2, 4]), scorer, "stream_id", "seq", 0)
        assert left() == [(2, 1, 2, "again"), (4, 1, 2, "again")]
        assert spark.read.parquet(f"{out}/scores").count() == 3
        assert state() == {1: (2, "MEDIUM"), 3: (1, "LOW")}  # an older row does not replace a newer one
    St.replay(spark, out, extract([4]), scorer, "stream_id", "seq", 1)
    assert left() == [(4, 1, 3, "again")] and state()[2] == (1, "HIGH")
    alerts = sorted((r.stream_id, r.seq) for r in spark.read.parquet(f"{out}/alerts").collect())
    assert alerts == [(1, 1), (1, 2), (2, 1)]


def test_status_of_a_running_scan(spark, tmp_dir):
    import time
    from riskline.functions import risk as R
    src_dir, out, status = (os.path.join(tmp_dir, n) for n in ("scans", "mon", "status"))
    schema = "stream_id long, seq long, text string"
    spark.createDataFrame([(1, 1, "a")], schema).write.parquet(src_dir)
    listener = St.ScanStatus(spark, status)
    spark.streams.addListener(listener)

    def scorer(b):
        return b.withColumn("risk_score", F.lit(0.0)).withColumn("risk_band", R.band("risk_score"))

    def events(n):
        for _ in range(200):
            if os.path.exists(f"{status}/_SUCCESS"):
                got = sorted(spark.read.parquet(status).collect(), key=lambda r: r.at)
                if len(got) >= n:
                    return got
            time.sleep(0.1)
        raise AssertionError("no status")

    try:
        q = St.monitor(spark.readStream.schema(schema).parquet(src_dir), scorer, out, os.path.join(tmp_dir, "ck"),
                       key="stream_id", order="seq", trigger="1 second", name="desk scan")
        q.processAllAvailable()
        events(2)
        spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], schema).write.mode("append").parquet(src_dir)
        q.processAllAvailable()
        events(3)
        q.stop()
        got = events(4)
    finally:
        spark.streams.removeListener(listener)
    assert [(r.event, r.batch_id, r.rows) for r in got] == [("started", None, None), ("batch", 0, 1), ("batch", 1, 2), ("stopped", None, None)]
    assert {r.query for r in got} == {"desk scan"} and got[-1].error is None and len({r.run_id for r in got}) == 1
