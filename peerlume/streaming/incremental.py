"""Incremental collection: high-water marks, known ids, run log, and the streaming form of the same."""

from __future__ import annotations

import contextlib
import fcntl
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerlume.session import shared_table_path

LOOKBACK_DAYS = 3
RUNS_KEPT = 50


def start_dates(state: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """(source, last_date, start_date): the latest known date less a look-back, for late rows."""
    last = state.groupBy("source").agg(F.max("last_date").alias("last_date"))
    return last.withColumn("start_date", F.date_sub("last_date", days))


def new_rows(feed: DataFrame, starts: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the feed from the start date on (unknown dates included) whose id is not known."""
    f = feed.join(F.broadcast(starts.select("source", "start_date")), "source", "left")  # one row per source
    return f.where(F.coalesce(F.col("date") >= F.col("start_date"), F.lit(True))).drop("start_date").join(known.select(key), key, "left_anti")


def synced_state(state: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, id) known ids and (source, last_date), add-only and never moving back.

    The state is kept as rows, not as one array per source, so that a source with a third of all
    ids is no hot row.
    """
    both = state.select("source", "id", "last_date").unionByName(rows.select("source", "id", F.col("date").alias("last_date")))
    return both.groupBy("source", "id").agg(F.max("last_date").alias("last_date"))


def startup_dates(state: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, last_date, moved_back): the date a start-up sync takes from a source's rows wherever it
    differs from the state's. Unlike :func:`synced_state` it can move back, which ``moved_back`` tells."""
    s = state.groupBy("source").agg(F.max("last_date").alias("known"))
    r = rows.groupBy("source").agg(F.max("date").alias("found"))
    both = s.join(r, "source", "full_outer")
    return both.select("source", F.coalesce("found", "known").alias("last_date"), F.coalesce(F.col("found") < F.col("known"), F.lit(False)).alias("moved_back"))


def dates_after_run(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """(source, last_date): after a run a source's date moves on only if the run brought new ids, and never back."""
    s = state.groupBy("source").agg(F.max("last_date").alias("known"))
    f = fresh.groupBy("source").agg(F.max("date").alias("found"))
    return s.join(f, "source", "left").select("source", F.greatest("known", "found").alias("last_date"))


def state_summary(state: DataFrame) -> DataFrame:
    """(source, n_ids, last_date) in order of source: the deterministic form for a state file."""
    return state.groupBy("source").agg(F.count_distinct("id").alias("n_ids"), F.max("last_date").alias("last_date")).orderBy("source")


def run_history(runs: DataFrame, by: list[str], started: str, kept: int = RUNS_KEPT) -> DataFrame:
    """The last ``kept`` runs, newest first."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(started), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= kept)


def without_concerns(articles: DataFrame, letter: str = "decision_letter_raw") -> DataFrame:
    """Articles to be extracted again: a letter but no concerns."""
    return articles.where((F.coalesce(F.size("concerns"), F.lit(0)) < 1) & (F.length(F.trim(F.coalesce(letter, F.lit("")))) > 0))


def deduplicated_stream(stream: DataFrame, key: list[str], event_time: str, lateness: str = f"{LOOKBACK_DAYS} days") -> DataFrame:
    """First row of each key within the watermark; later copies and rows beyond the lateness are dropped."""
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], width: str, lateness: str = f"{LOOKBACK_DAYS} days") -> DataFrame:
    """Rows per tumbling window and group, closed by the watermark."""
    s = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, lateness)
    return s.groupBy(F.window(event_time, width), *by).agg(F.count(F.lit(1)).alias("n"))


class StateTable:
    """A versioned table of known ids; each batch writes only the ids it adds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        schema = "source string, id string, last_date date, batch bigint"
        if not self._exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Add unknown ids once; a repeated batch overwrites its own folder and changes nothing else."""
        known = self.read().where(F.col("batch") != batch_id)
        first = batch.groupBy("source", "id").agg(F.max("date").alias("last_date"))
        fresh = first.join(known.select("source", "id"), ["source", "id"], "left_anti").withColumn("batch", F.lit(batch_id).cast("bigint"))
        fresh.select("source", "id", "last_date", "batch").write.mode("overwrite").parquet(f"{self.path}/part-of-batch={batch_id}")


def run_into_state(stream: DataFrame, state: StateTable, checkpoint: str, per_batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Drain a stream of (source, id, date) into a state table, micro-batch by micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        state.upsert(batch, batch_id)
        if per_batch:
            per_batch(batch, batch_id)

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into a written table and read that."""
    spark = stream.sparkSession
    path = shared_table_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@contextlib.contextmanager
def single_writer(path: str) -> Iterator[bool]:
    """True for the one process that holds the lock file, False for any other; never waits."""
    fd = os.open(path, os.O_CREAT | os.O_RDWR)
    try:
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            yield False
            return
        yield True
    finally:
        os.close(fd)


def trigger_kind(env: dict[str, str]) -> str:
    """How a run was started: ci, cron or manual."""
    return "ci" if env.get("CI") else "cron" if env.get("CRON_JOB") else "manual"
