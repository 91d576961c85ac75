"""Check states of sources: in batches, and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.changes import DEAD_AFTER, REFUSED


def next_state(ok: Column, status: Column, digest: Column, old_digest: Column, failures: Column) -> Column:
    """struct<outcome, failures, content_hash> after one fetch; a refusal changes nothing, and the
    baseline digest stays until a reading agrees with it or is accepted."""
    count = F.coalesce(failures, F.lit(0))
    refused = F.coalesce(status.isin(*REFUSED), F.lit(False))
    outcome = F.when(refused, "refused").when(~ok, F.when(count + 1 >= DEAD_AFTER, "dead").otherwise("failed")).when(digest.eqNullSafe(old_digest), "unchanged").otherwise("changed")
    return F.struct(outcome.alias("outcome"), F.when(ok, 0).when(refused, count).otherwise(count + 1).alias("failures"), old_digest.alias("content_hash"))


def advanced(state: DataFrame, fetches: DataFrame, key: str) -> DataFrame:
    """The state table (key, failures, content_hash) after a batch of at most one fetch a key
    (key, ok, status, digest); keys without a fetch stay."""
    both = state.join(fetches, key, "full_outer")
    after = next_state(F.col("ok"), F.col("status"), F.col("digest"), F.col("content_hash"), F.col("failures"))
    both = both.withColumn("_s", F.when(F.col("ok").isNotNull(), after))
    return both.select(key, F.coalesce("_s.failures", "failures").alias("failures"), F.coalesce("_s.content_hash", "content_hash").alias("content_hash"), F.col("_s.outcome").alias("outcome"))


def issue_action(was_open: Column, broken: Column, old_level: Column, level: Column, new_reasons: Column) -> Column:
    """nothing, opened, commented, updated or closed for an issue that tracks a report."""
    return F.when(~was_open & ~broken, "nothing").when(~was_open & broken, "opened").when(~broken, "closed").when((level > old_level) | (F.size(new_reasons) > 0), "commented").otherwise("updated")


def event_counts(spark: SparkSession, path: str, schema, window: str = "1 day", late: str = "2 days") -> DataFrame:  # noqa: ANN001
    """A stream: events by type and window, closed once they are later than the watermark."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """All windows that are closed once a stream has read what there is now, as a table in ``folder``: append
    mode writes each window once, when the watermark has passed its end."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
