"""The job queue as events: batch state, and a streaming form with the same result."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def latest(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last ``value`` of each key; partial maxima before the shuffle. Works on a stream in update or complete mode."""
    pick = F.struct(*order, value)
    return events.groupBy(key).agg(F.max(pick).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def clear_done(states: DataFrame, done: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    return states.where(~F.col("status").isin(*done))


def recover(states: DataFrame) -> DataFrame:
    """What had not completed is pending again."""
    return states.where("status <> 'completed'").withColumn("status", F.lit("pending"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share: in the session's checkpoint folder, or, where it names none and is local, our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    base = re.sub(r"^file:/+", "/", base or tempfile.gettempdir())
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, key: str, mode: str = "update") -> DataFrame:
    """Run a streaming query over what is there now; its result, the last row of each ``key``.

    Each micro-batch writes its rows as files of its own, again if it runs again; nothing comes to the driver.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = F.struct("batch", *[c for c in stream.columns if c != key])
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/rows")
    last = rows.groupBy(key).agg(F.max(rest).alias("m"))
    return last.select(*[F.col(key) if c == key else F.col(f"m.{c}").alias(c) for c in stream.columns])


def progress(events: DataFrame) -> DataFrame:
    """(job, pct) by the last event (job, seq, current, total): 0 for a total of 0, at most 100."""
    last = events.groupBy("job").agg(F.max(F.struct("seq", "current", "total")).alias("m"))
    share = F.when(F.col("m.total") > 0, F.least(F.lit(100.0), F.lit(100.0) * F.col("m.current") / F.col("m.total"))).otherwise(F.lit(0.0))
    return last.select("job", share.alias("pct"))


def move(items: DataFrame, job: str, by: int) -> DataFrame:
    """(queue, job, pos) with ``job`` and its neighbour before (-1) or after (1) it in its queue exchanged."""
    w = Window.partitionBy("queue").orderBy("pos")
    other = items.withColumn("before", F.lag("job").over(w)).withColumn("after", F.lead("job").over(w)).withColumn("up", F.lag("pos").over(w)).withColumn("down", F.lead("pos").over(w))
    partner, mine = ("after", "up") if by < 0 else ("before", "down")
    theirs = "down" if by < 0 else "up"
    return other.select("queue", "job", F.when(F.col("job") == job, F.coalesce(mine, "pos")).when(F.col(partner) == job, F.col(theirs)).otherwise(F.col("pos")).alias("pos"))


def remove(items: DataFrame, gone: DataFrame) -> DataFrame:
    return items.join(gone.select("job"), "job", "left_anti")


def next_pending(items: DataFrame) -> DataFrame:
    """The first pending position of each queue."""
    return items.where("status = 'pending'").groupBy("queue").agg(F.min("pos").alias("pos"))


def worth_storing(pages: DataFrame, least: float = 50) -> DataFrame:
    """Jobs to cache: not those whose pages are all empty without confidence, nor those of a mean under ``least``."""
    text = F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))) > 0
    g = pages.groupBy("job").agg(text.alias("some"), F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)).alias("mean"))
    return g.where((F.col("some") | (F.col("mean") > 0)) & ((F.col("mean") == 0) | (F.col("mean") >= least))).select("job")


def add(events: DataFrame, items: DataFrame) -> DataFrame:
    """The log of events (job, seq, event) with ``items`` (job) added after the last one, in order of job."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("job"))
    fresh = items.select("job", place.alias("k")).join(F.broadcast(last)).select("job", (F.col("last") + F.col("k")).cast("long").alias("seq"), F.lit("added").alias("event"))
    return events.select("job", "seq", "event").unionByName(fresh)


def unresolved(states: DataFrame, done: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """One row: how many jobs (job, status) have not ended."""
    return states.agg(F.count_if(~F.col("status").isin(*done)).alias("n"))


def find(items: DataFrame, needle: str) -> DataFrame:
    """Items whose file's name (path) contains ``needle``, letters of either case; all for an empty one."""
    name = F.lower(F.substring_index("path", "/", -1))
    return items.where(F.contains(name, F.lower(F.lit(needle))))


def save_states(items: DataFrame, folder: str) -> None:
    """Items (job, ...) as JSON, a folder a job, each replaced whole: what a later run finds pending."""
    spark = items.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        items.repartition("job").write.mode("overwrite").partitionBy("job").json(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def subscribe(stream: DataFrame, listeners: list, checkpoint: str):  # noqa: ANN201
    """Start a stream whose micro-batches go to each listener (rows, batch number); one that raises ends it, as its batch is not done."""

    def tell(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for listener in listeners:
                listener(rows, batch)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def autosave(stream: DataFrame, folder: str, checkpoint: str):  # noqa: ANN201
    """Start a stream of pages (doc, page, text, error) that keeps each micro-batch's as files; a batch that runs again replaces its own."""
    return subscribe(stream, [lambda rows, batch: rows.write.mode("overwrite").json(f"{folder}/batch={batch}")], checkpoint)


class Jobs:
    """Functions of a session on threads of their own; each under a tag, by which what it started in Spark can be stopped."""

    def __init__(self, spark: SparkSession, most: int = 4):
        self.spark, self.pool, self.futures = spark, ThreadPoolExecutor(most), {}

    def submit(self, name: str, work, on_complete=None, on_error=None) -> Future:  # noqa: ANN001
        """``work(spark)`` under ``name``; tried once more if it raises."""

        def run():  # noqa: ANN202
            self.spark.addTag(name)
            try:
                try:
                    out = work(self.spark)
                except Exception:  # noqa: BLE001  whatever a job raises, it has a second try
                    out = work(self.spark)
            except Exception as e:
                if on_error:
                    on_error(name, e)
                raise
            finally:
                self.spark.removeTag(name)
            if on_complete:
                on_complete(name, out)
            return out

        self.futures[name] = self.pool.submit(run)
        return self.futures[name]

    def cancel(self, name: str) -> bool:
        """Whether a job that had not started was taken off, or one that runs was told to stop."""
        f = self.futures.get(name)
        if f is None or f.done():
            return False
        if not f.cancel():
            self.spark.interruptTag(name)
        return True

    def active(self) -> int:
        return sum(not f.done() for f in self.futures.values())
