"""Issues that open, change and close themselves as reports arrive: one open issue a source, kept by an idempotent sink.

A report has a key, an order (``at``, ``ord``), a level (ok, attention or broken), the names of what waits, whether it
is a ``weekly`` one, and whether it should ``keep`` a broken issue as it is. The log of what was done is the state:
each row keeps the number of the batch that wrote it, so a batch that runs again replaces its own rows and sees only those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Levels by severity.
LEVELS = {"ok": 0, "attention": 1, "broken": 2}
REPORT = "key long, at long, ord long, level string, waiting array<string>, weekly boolean, keep boolean"
LOG = "key long, at long, ord long, level string, waiting array<string>, action string, comment string, number long"
BATCH = "batch_id"


def _rank(level: Column) -> Column:
    """The severity of a level; one that isn't known counts as attention."""
    out = F
    for name, rank in LEVELS.items():
        out = out.when(level == name, rank)
    return out.otherwise(LEVELS["attention"])


def lifecycle(reports: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """``LOG`` rows of reports, in their order within each key, after ``state`` (key, level, waiting, number: the last of each).

    A report that should keep a broken issue is passed over (``left broken``) while the issue is broken; any other is
    compared with the last that wasn't. Of an open issue an edit is silent unless things got worse, a weekly report is still
    broken, or something new waits.
    """
    rows = reports.select("key", "at", "ord", "level", F.coalesce("waiting", F.array().cast("array<string>")).alias("waiting"), "weekly", "keep", F.lit(None).cast("long").alias("base"))
    if state is not None:
        # The state so far counts as a report before the first one, which no other passes over.
        rows = rows.unionByName(state.select("key", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("ord"), "level", "waiting", F.lit(False).alias("weekly"), F.lit(False).alias("keep"), F.coalesce("number", F.lit(0)).cast("long").alias("base")))
    order = [F.col("base").isNull(), "at", "ord"]
    each = Window.partitionBy("key").orderBy(*order)
    rows = rows.withColumn("_part", F.sum(F.when(F.coalesce("keep", F.lit(False)), 0).otherwise(1)).over(each))
    before = Window.partitionBy("key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce("keep", F.lit(False)) & F.coalesce(F.max(F.col("level") == "broken").over(before), F.lit(False))
    rows = rows.withColumn("_left", left)
    # What each report meets: the last one that wasn't passed over.
    met = F.last(F.when(~F.col("_left"), F.struct("level", "waiting")), ignorenulls=True).over(each.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_met", met)
    was, is_ = F.when(F.col("_met").isNull(), 0).otherwise(_rank(F.col("_met.level"))), _rank(F.col("level"))
    action = F.when(F.col("_left"), "left broken").when((is_ == 0) & (was == 0), "nothing").when(is_ == 0, "closed").when(was == 0, "opened").otherwise("updated")
    new = F.array_except("waiting", F.coalesce("_met.waiting", F.array().cast("array<string>")))
    comment = (
        F.when(F.col("action") == "closed", "all clear")
        .when(F.col("action") != "updated", None)
        .when(is_ > was, "worse")
        .when(F.col("weekly") & (F.col("level") == "broken"), "still broken")
        .when(F.size(new) > 0, F.concat(F.lit("waiting: "), F.array_join(new, ", ")))
    )
    rows = rows.withColumn("action", action).withColumn("comment", comment)
    opened = F.sum(F.when(F.col("base").isNull() & (F.col("action") == "opened"), 1).otherwise(F.coalesce("base", F.lit(0)))).over(each)
    rows = rows.withColumn("number", opened.cast("long")).where(F.col("base").isNull())
    return rows.select(*(c.split()[0] for c in LOG.split(", ")))


class IssueSink:
    """Writes the log of issues batch by batch; ``upsert`` is what ``foreachBatch`` calls."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """All rows so far, with the batch that wrote each."""
        return self.spark.read.schema(f"{LOG}, {BATCH} long").parquet(self.path)

    def state(self, before: int | None = None) -> DataFrame:
        """The issue of each key (key, level, waiting, number), by the batches before one. All of the log is read: it has a row for
        each report, which are few beside what they report on."""
        rows = self.log() if before is None else self.log().where(F.col(BATCH) < before)
        last = rows.where(F.col("action") != "left broken").groupBy("key").agg(F.max_by(F.struct("level", "waiting"), F.struct(BATCH, "at", "ord")).alias("s"), F.max("number").alias("number"))
        return last.select("key", "s.level", "s.waiting", "number")

    def upsert(self, reports: DataFrame, batch_id: int) -> None:
        """Adds a batch, or replaces it: its folder is overwritten as a whole, and what it builds on doesn't change."""
        spark = reports.sparkSession
        sink = IssueSink(spark, self.path)
        keys = reports.select("key").distinct()
        state = sink.state(batch_id).join(keys, "key", "left_semi") if batch_id else None
        lifecycle(reports, state).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")


def tracked(spark: SparkSession, arrivals: str, folder: str, files: int | None = None) -> IssueSink:
    """Runs over what is new in the folder ``arrivals`` (Parquet files of ``REPORT``); ``folder`` keeps the log and the
    checkpoint. A key's reports come in order from batch to batch."""
    sink = IssueSink(spark, f"{folder}/log")
    stream = spark.readStream.schema(REPORT)
    stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(arrivals)
    query = stream.writeStream.foreachBatch(sink.upsert).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink
