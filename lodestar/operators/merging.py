"""Findings merged into a catalogue, and a table of buckets of which a merge rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.sources.scratch import written
from lodestar.sources.sinks import Locked

#: How a page was read when nothing on it counts as evidence.
UNREAD = ("read_failed", "suspicious_page")
#: Grounds on which a role is removed though no quotation says so.
GONE = ("page_404", "not_on_board", "not_on_charity_pages", "source_not_volunteering")
BUCKET = "_bucket"


def merged_findings(current: DataFrame, reads: DataFrame, roles: DataFrame, retire: DataFrame, core: list[str], gone: tuple[str, ...] = GONE) -> DataFrame:
    """``current`` roles (org_id, id, status, unsupported, ``core`` fields and others) after a batch of findings, with
    ``action``: unchanged, updated, new, retired, kept_unknown or untouched.

    ``reads`` (org_id, read_status): the organisations that have findings; the rest stays untouched. ``roles`` (org_id, id,
    ``core`` fields): what was found; a field that the table lacks keeps its value. ``retire`` (org_id, id, basis,
    quote): roles that are said to be over, whatever was found of them; with a ground or a quotation they go, else they stay
    with an unknown status that is noted as unsupported. Roles that a page doesn't mention stay, also where it
    couldn't be read. Rows that go are returned as well, for the report.
    """
    found = roles.select("org_id", "id", F.lit(True).alias("_found"), *(F.col(c).alias(f"_new_{c}") for c in core if c in roles.columns))
    over = retire.groupBy("org_id", "id").agg(F.bool_or(F.coalesce(F.col("basis").isin(*gone), F.lit(False)) | (F.coalesce("quote", F.lit("")) != "")).alias("_gone"))
    known = reads.select("org_id", F.lit(True).alias("_read")).distinct()
    new = found.join(current.select("org_id", "id"), ["org_id", "id"], "left_anti").join(known, "org_id", "left_semi")
    both = current.join(known, "org_id", "left").join(found, ["org_id", "id"], "left").join(over, ["org_id", "id"], "left")
    taken = [c for c in core if c in roles.columns]
    differs = F.lit(False)
    for c in taken:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    said, read = F.coalesce("_found", F.lit(False)), F.coalesce("_read", F.lit(False))
    action = F.when(~read, "untouched").when(F.col("_gone"), "retired").when(~F.col("_gone"), "kept_unknown").when(said & differs, "updated").when(said, "unchanged").otherwise("untouched")
    both = both.withColumn("action", action)
    out = {c: F.when(F.col("action") == "updated", F.col(f"_new_{c}")).otherwise(F.col(c)) for c in taken}
    out["status"] = F.when(F.col("action") == "kept_unknown", "unknown").otherwise(out.get("status", F.col("status")))
    out["unsupported"] = F.when(F.col("action") == "kept_unknown", F.array_sort(F.array_union(F.coalesce("unsupported", F.array().cast("array<string>")), F.array(F.lit("status"))))).otherwise(F.col("unsupported"))
    rows = both.select(*(out.get(c, F.col(c)).alias(c) for c in current.columns), "action")
    added = new.select(*((F.col(f"_new_{c}") if c in taken else F.col(c) if c in ("org_id", "id") else F.lit(None).cast(current.schema[c].dataType)).alias(c) for c in current.columns), F.lit("new").alias("action"))
    return rows.unionByName(added)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Buckets:
    """A Parquet table in folders by a hash of its key. A merge reads and rewrites only the folders that hold a changed key; the
    others' files stay as they are, names included. One merge at a time, under a lock; readers that began before it may
    have to start again."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def create(self, rows: DataFrame) -> None:
        self._write(rows, "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.withColumn(BUCKET, bucket_of(F.col(self.key), self.buckets))
        dealt.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self._typed().drop(BUCKET)

    def _typed(self) -> DataFrame:
        # Folders' values are read as integers, whatever the session infers.
        own = self.spark.read.parquet(self.path)
        kind = T.StructType([f for f in own.schema.fields if f.name != BUCKET] + [T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(kind).parquet(self.path)

    def merge(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets of ``keys`` (one column) with what ``change`` makes of their rows; returns these buckets. The
        new rows are written beside the table first, so a failure on the way leaves the table as it was. Rows must
        stay in their buckets: ``change`` may not bring keys of others."""
        with Locked(self.spark, self.path):
            touched = sorted(r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), self.buckets)).distinct().collect())
            if not touched:
                return []
            rows = written(change(self._typed().where(F.col(BUCKET).isin(touched)).drop(BUCKET)))
            own = bucket_of(F.col(self.key), self.buckets)
            stray = rows.where(~own.isin(touched)).limit(1).count()
            if stray:
                raise ValueError("a merge made rows of buckets that it didn't touch")
            left = {r[0] for r in rows.select(own).distinct().collect()}
            self._write(rows, "overwrite")
            self._remove([b for b in touched if b not in left])
            return touched

    def _remove(self, buckets: list[int]) -> None:
        """Folders of buckets that have no rows any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for b in buckets:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            folder.getFileSystem(conf).delete(folder, True)
