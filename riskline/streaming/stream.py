"""Structured Streaming jobs.

* ``file_stream``: records arriving as files (frames, captures, scans).
* ``monitor``: one streaming query; each micro-batch is scored with the same
  batch operators (``foreachBatch``) and written to three outputs:
  ``scores/`` (every record), ``alerts/`` (MEDIUM/HIGH, every time: no
  de-duplication) and ``state/`` (latest record per stream key, a change log).
  Failed extractions go to ``dead_letter/`` and never raise an alert; ``replay``
  tries them again. Each output is partitioned by batch id and overwritten per
  batch, so a replayed batch after a failure rewrites exactly its own files.
* ``sample_frames``: every N-th frame of a stream with explicit frame numbers;
  ``count_frames``: the same where frames must be counted, by exact ranks within
  the batch after the counts of a change log.
* ``capture_stream``: one capture a second, the last write wins however late.

Triggers: ``processingTime`` for the fixed-interval loops (L1 2 s, L2 3 s),
``availableNow`` for "process what is there, then stop" (L8, tests).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from riskline.functions import risk as R
from riskline.functions.text import capture_name
from riskline.operators.ranking import key_rank
from riskline.sources.extract import STATUS_OK, STATUS_UNREADABLE
from riskline.streaming.keyed_log import DONE, KeyedLog, file_system, latest_log, numbered

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for right results).
MONITOR_INTERVAL = "2 seconds"      # fixed-interval re-scan
AUTO_SCAN_INTERVAL = "3 seconds"    # auto scan loop
SAMPLE_EVERY = 30                   # every 30th frame (1-based count)
INITIAL_BAND = R.BAND_LOW
SCAN_COMPLETE = "\u25cf  Scan complete"
SCAN_ERROR = "\u25cf  Error"
# ---------------------------------------------------------------------------


def file_stream(spark: SparkSession, folder: str, name_glob: str | None = None, fmt: str = "parquet",
                schema=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the files of ``folder`` (optionally one name pattern).

    A pattern that names a directory (a table of several files) streams that directory.
    """
    if name_glob:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name_glob}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            folder, name_glob = path.toString(), None
    reader = spark.read.format(fmt)
    static = reader.option("pathGlobFilter", name_glob).load(folder) if name_glob else reader.load(folder)
    r = spark.readStream.format(fmt).schema(schema or static.schema)
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def _trigger(writer, trigger):
    if trigger == "availableNow" or trigger is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Overwrite one batch's folder; a batch without rows leaves an empty file that names the columns."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def latest_per_key(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Per key, the row with the greatest ``order`` (map-side partial max_by)."""
    agg = df.groupBy(key).agg(F.max_by(F.struct(order, *cols), order).alias("_s"))
    return agg.select(key, "_s.*")


def monitor(stream_df: DataFrame, scorer: Callable[[DataFrame], DataFrame], out_dir: str,
            checkpoint: str, key: str, order: str, trigger: str | None = MONITOR_INTERVAL,
            state_cols: list[str] | None = None, unreadable: str = "empty", name: str | None = None) -> StreamingQuery:
    """L1/L2/L4/L5/L6/L7 + B6: score every micro-batch, write scores, alerts and latest state.

    ``scorer(batch) -> DataFrame`` must add ``risk_score`` and ``risk_band``.
    If the stream has a ``status`` column (from ``extract_text``), rows whose extraction
    failed are written to ``dead_letter/`` with their error and attempt number, whole, for
    ``replay``. Input that could only not be read scores as empty text (0.0, LOW) under
    ``unreadable = 'empty'`` and goes the same way as failures under ``'dead_letter'``.
    (``key``, ``order``) names a row.
    """
    if unreadable not in ("empty", "dead_letter"):
        raise ValueError("unreadable must be 'empty' or 'dead_letter'")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if "status" in batch.columns:
            failed = _failed(unreadable)
            letters = batch.where(failed).withColumn("scan_status", F.lit(SCAN_ERROR)).withColumn("attempt", F.lit(1))
            _write_batch(letters, f"{out_dir}/dead_letter", batch_id)
            batch = batch.where(~failed)
        _publish(batch, scorer, out_dir, batch_id, key, order, state_cols, "state")

    w = stream_df.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(w.queryName(name) if name else w, trigger).start()


def _failed(unreadable: str):
    ok = [STATUS_OK, STATUS_UNREADABLE] if unreadable == "empty" else [STATUS_OK]
    return ~F.coalesce(F.col("status").isin(ok), F.lit(False))


def _publish(rows: DataFrame, scorer, out_dir: str, batch_id: int, key: str, order: str, state_cols, state: str) -> None:
    """Scores, alerts and state of one batch. Scored once, used by the three outputs; a lost block is recomputed
    from the batch's own input (scoring is deterministic)."""
    scored = scorer(rows).withColumn("scan_status", F.lit(SCAN_COMPLETE)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _write_batch(scored, f"{out_dir}/scores", batch_id)
        _write_batch(scored.where(R.is_alert("risk_band")), f"{out_dir}/alerts", batch_id)
        log = _state_log(rows.sparkSession, f"{out_dir}/{state}", key, order, scored, state_cols)
        log.append(scored.select(*log_columns(log)), batch_id)
    finally:
        scored.unpersist()


#: Replays are batches of their own, numbered from here on, apart from those of the stream.
REPLAYS = 1 << 40


def open_letters(spark: SparkSession, out_dir: str, key: str, order: str) -> DataFrame:
    """Rows that failed and have not been scored since, each with its last attempt."""
    letters = spark.read.parquet(f"{out_dir}/dead_letter").drop("batch_id")
    rows = [c for c in letters.columns if c not in (key, order)]
    last = letters.groupBy(key, order).agg(F.max_by(F.struct(*rows), "attempt").alias("_last")).select(key, order, "_last.*")
    done = spark.read.parquet(f"{out_dir}/scores").select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    return last.join(done, last[key].eqNullSafe(done["_key"]) & last[order].eqNullSafe(done["_order"]), "left_anti")


def replay(spark: SparkSession, out_dir: str, extract: Callable[[DataFrame], DataFrame],
           scorer: Callable[[DataFrame], DataFrame], key: str, order: str, run: int,
           state_cols: list[str] | None = None, unreadable: str = "empty") -> None:
    """Try the open dead letters once more, as replay number ``run`` (0, 1, ...).

    ``extract`` gets the letters without their text, status and error and gives them anew. What
    succeeds is scored, alerts if it must and enters the latest state (where a newer row of
    its key stays); what fails again is a letter with the next attempt number. The letters
    of a run are written down before they are tried, so a run that broke off and is
    repeated under its number tries the same rows and overwrites its own files.
    """
    batch_id, todo = REPLAYS + run, f"{out_dir}/replays/run={run}"
    p, fs = file_system(spark, f"{todo}/{DONE}")
    if not fs.exists(p):
        open_letters(spark, out_dir, key, order).write.mode("overwrite").parquet(todo)
    letters = spark.read.parquet(todo)
    again = extract(letters.drop("text", "status", "error", "scan_status"))
    # extracted once: what fails and what is scored come from the same attempt
    tried = f"{out_dir}/replays/tried={run}"
    again.write.mode("overwrite").parquet(tried)
    again = spark.read.schema(again.schema).parquet(tried)
    failed = _failed(unreadable)
    out = again.where(failed).withColumn("attempt", F.col("attempt") + 1).withColumn("scan_status", F.lit(SCAN_ERROR))
    _write_batch(out.select(*letters.columns), f"{out_dir}/dead_letter", batch_id)
    _publish(again.where(~failed).drop("attempt"), scorer, out_dir, batch_id, key, order, state_cols, "state_replayed")


def _state_log(spark: SparkSession, path: str, key: str, order: str, rows: DataFrame,
               state_cols: list[str] | None = None) -> KeyedLog:
    cols = state_cols or [c for c in rows.columns if c not in (key, order)]
    fields = [(c, rows.schema[c].dataType.simpleString()) for c in (key, order, *cols)]
    return latest_log(spark, path, key, order, fields)


def log_columns(log: KeyedLog) -> list[str]:
    return [f.name for f in Ty.StructType.fromDDL(log.schema).fields]


def read_state(spark: SparkSession, out_dir: str, key: str, order: str) -> DataFrame:
    """The monitor's latest row of every key, replayed rows included."""
    logs = []
    for path in (f"{out_dir}/state", f"{out_dir}/state_replayed"):
        written = numbered(spark, f"{path}/changes", "batch_id=")
        if written:
            rows = spark.read.parquet(f"{path}/changes/batch_id={written[-1]}")  # for its schema
            logs.append(_state_log(spark, path, key, order, rows))
    if not logs:
        raise FileNotFoundError("no state written yet")
    rows = logs[0].rows()
    for log in logs[1:]:
        rows = rows.unionByName(log.rows())
    return logs[0].merged(rows)


class ScanStatus(StreamingQueryListener):
    """L1/L2: what a running scan does, as rows of a table: one when it starts, one a finished batch that had input,
    one when it stops.

    (query, run_id, at, event, batch_id, rows, rows_per_second, error); the stop's ``error`` is null when it was asked
    for or the input ended. Each row is a small file of its own below ``path``, written by the driver, which is told.
    """

    SCHEMA = ("query string, run_id string, at timestamp, event string, batch_id long, rows long, "
              "rows_per_second double, error string")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names = spark, path, {}

    def _row(self, run_id, event, batch_id=None, rows=None, speed=None, error=None):
        run_id = str(run_id)
        row = (self.names.get(run_id), run_id, datetime.now(timezone.utc), event, batch_id, rows, speed, error)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event):
        self.names[str(event.runId)] = event.name
        self._row(event.runId, "started")

    def onQueryProgress(self, event):
        p = event.progress
        if p.numInputRows:
            self._row(p.runId, "batch", p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._row(event.runId, "stopped", error=event.exception)


def sample_frames(df: DataFrame, frame_col: str, every: int = SAMPLE_EVERY) -> DataFrame:
    """Frames whose 1-based number is a multiple of ``every``, the number being given: a stateless filter that
    reaches the source."""
    return df.where(F.col(frame_col) % every == 0)


def _frame_log(spark: SparkSession, path: str, key: str, kind: str) -> KeyedLog:
    return KeyedLog(spark, path, [key], lambda: [F.sum("seen").alias("seen")], f"`{key}` {kind}, seen long")


def count_frames(stream_df: DataFrame, key: str, order: list[str], out_dir: str, checkpoint: str,
                 every: int = SAMPLE_EVERY, trigger: str | None = "availableNow") -> StreamingQuery:
    """L3/D6 without frame numbers: count the frames of every ``key`` and keep each ``every``-th, with its ``frame_no``.

    A micro-batch ranks its frames exactly within their key (``key_rank``: a key with a
    third of all frames is cut into ranges, none is held in one task) and numbers them
    after those its key had before. The counts are a change log with one row for each
    key of the batch; it is read in full (two narrow columns a key) and written only
    for the keys that changed. Counts are never forgotten, so numbers never restart.
    Files must arrive in ``order``, which must be unique within a key.
    """
    spark = stream_df.sparkSession
    kind = stream_df.schema[key].dataType.simpleString()

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        log = _frame_log(batch.sparkSession, f"{out_dir}/counts", key, kind)
        ranked = key_rank(batch, [key], order, "_rank")
        before = log.read(before=batch_id).withColumnRenamed("seen", "_seen").withColumnRenamed(key, "_key")
        ranked = ranked.join(before, F.col(key).eqNullSafe(F.col("_key")), "left")
        frame_no = (F.coalesce("_seen", F.lit(0)) + F.col("_rank")).alias("frame_no")
        kept = ranked.select(*batch.columns, frame_no).where(F.col("frame_no") % every == 0)
        _write_batch(kept, f"{out_dir}/frames", batch_id)
        log.append(batch.select(key, F.lit(1).cast("long").alias("seen")), batch_id)

    w = stream_df.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def read_frames(spark: SparkSession, out_dir: str) -> DataFrame:
    """Frames kept so far."""
    return spark.read.parquet(f"{out_dir}/frames").drop("batch_id")


def _capture_log(spark: SparkSession, path: str, id_col: str, kinds: tuple[str, str]) -> KeyedLog:
    def merge():
        last = F.max(F.struct("written", id_col))  # equal times: the larger id
        return [last.getField("written").alias("written"), last.getField(id_col).alias(id_col),
                F.sum("n_writes").alias("n_writes")]
    return KeyedLog(spark, path, ["capture_name"], merge,
                    f"capture_name string, written {kinds[0]}, `{id_col}` {kinds[1]}, n_writes long")


def capture_stream(stream_df: DataFrame, ts_col: str, id_col: str, out_dir: str, checkpoint: str,
                   trigger: str | None = "availableNow") -> StreamingQuery:
    """A9 on a stream: one capture for each second (its name), last write wins without a horizon.

    Each micro-batch appends the names it wrote, with the last write and the number of
    writes, to a change log that is merged when it is read: a capture that arrives
    late, however late, is counted and wins if it was written last. A time without a
    zone gives the same name under every session time zone.
    """
    kinds = tuple(stream_df.schema[c].dataType.simpleString() for c in (ts_col, id_col))
    rows = stream_df.select(capture_name(ts_col).alias("capture_name"), F.col(ts_col).alias("written"), id_col,
                            F.lit(1).cast("long").alias("n_writes"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _capture_log(batch.sparkSession, out_dir, id_col, kinds).append(batch, batch_id)

    w = rows.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def read_captures(spark: SparkSession, out_dir: str, id_col: str, id_type: str = "long",
                  ts_type: str = "timestamp_ntz") -> DataFrame:
    """capture_name, the id that was written last, and the number of writes."""
    return _capture_log(spark, out_dir, id_col, (ts_type, id_type)).read().drop("written")


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "availableNow",
                   partition_by: str | None = None) -> StreamingQuery:
    """Append a streaming DataFrame to parquet (file sink: exactly-once via its log)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(partition_by)
    return _trigger(w.outputMode("append"), trigger).start()
