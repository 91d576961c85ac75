"""Sinks: documents, bundles, partitioned pages, site lists, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.runs import placed
from lodestar.sources.scratch import written


def documents(orgs: DataFrame, roles: DataFrame, key: str = "org_id") -> DataFrame:
    """One row an organisation with its roles nested in their order; roles of one are few."""
    role = F.struct("ord", *[c for c in roles.columns if c not in (key, "ord")])
    nested = roles.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(role)), lambda r: r.dropFields("ord")).alias("opportunities"))
    return orgs.join(nested, key, "left")


def write_documents(docs: DataFrame, path: str, dry: bool = False) -> None:
    if not dry:
        docs.write.mode("overwrite").json(path)


def bundle(df: DataFrame, columns: list[str], name: str = "line") -> DataFrame:
    """Compact JSON of some columns, null fields left out."""
    return df.select(F.to_json(F.struct(*columns)).alias(name))


def _said(value: Column, kind: T.DataType, unknown: tuple[str, ...]) -> Column:
    """A value without what says nothing: null for null, '' and the ``unknown`` words, empty lists, and structs of such."""
    if isinstance(kind, T.StringType):
        return F.when((F.trim(value) != "") & ~value.isin(*unknown), value)
    if isinstance(kind, T.ArrayType):
        held = F.filter(F.transform(value, lambda x: _said(x, kind.elementType, unknown)), lambda x: x.isNotNull())
        return F.when(F.size(held) > 0, held)
    if isinstance(kind, T.StructType):
        parts = [_said(value.getField(f.name), f.dataType, unknown).alias(f.name) for f in kind.fields]
        return F.when(F.coalesce(*(F.when(p.isNotNull(), True) for p in parts), F.lit(False)), F.struct(*parts))
    return value


def sparse(df: DataFrame, columns: list[str], name: str = "line", unknown: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """Compact JSON of some columns with only what the record states, at any depth of its structs and lists."""
    return df.select(F.to_json(F.struct(*(_said(F.col(c), df.schema[c].dataType, unknown).alias(c) for c in columns))).alias(name))


def assigned(lines: DataFrame, variable: str, order: str) -> DataFrame:
    """One row ``script``: the lines of a bundle in order as a script that assigns them to a variable. What a
    browser loads at once is small."""
    rows = F.array_sort(F.collect_list(F.struct(order, "line")))
    body = F.array_join(F.transform(rows, lambda r: r["line"]), ",")
    return lines.agg(F.concat(F.lit(f"{variable}=["), body, F.lit("];")).alias("script"))


def write_pages(df: DataFrame, path: str, *by: str) -> None:
    """A folder for each value of the columns; rows of a folder come together, but for those of a large one, which several tasks
    write."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


#: The folder beside the pages that keeps each folder's digest, and the column of it.
DIGESTS, DIGEST = "_digests", "_digest"


def folder_digests(df: DataFrame, *by: str) -> DataFrame:
    """by, _digest: a digest of each folder's rows that doesn't depend on their order; a repeated row counts."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns))
    sums = [F.sum(F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(1 << 40))).cast("string") for seed in (1, 2)]
    return df.groupBy(*by).agg(F.concat_ws("-", F.count("*").cast("string"), *sums).alias(DIGEST))


def update_pages(df: DataFrame, path: str, *by: str) -> DataFrame:
    """by, action (written, kept or removed): folders of pages brought up to date. Only folders whose rows changed since the
    last call are written, those without rows are removed, and the files of all others stay as they are.

    Digests are read and written under a lock and after the folders, so that a run that fails half-way is made good by
    the next one. Values of ``by`` mustn't be null.
    """
    spark = df.sparkSession
    with Locked(spark, path):
        now = folder_digests(df, *by)
        held = f"{path}/{DIGESTS}"
        before = spark.read.schema(now.schema).parquet(held) if _exists(spark, held) else now.limit(0)
        both = now.alias("n").join(before.withColumnRenamed(DIGEST, "_was"), list(by), "full_outer")
        action = F.when(F.col(DIGEST).isNull(), "removed").when(F.col(DIGEST).eqNullSafe(F.col("_was")), "kept").otherwise("written")
        plan = written(both.select(*by, action.alias("action"), DIGEST))
        changed = plan.where("action = 'written'").select(*by)
        rows = df.join(changed, list(by), "left_semi")
        rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        _remove(spark, path, plan.where("action = 'removed'").select(*by))
        kept = plan.where(F.col(DIGEST).isNotNull()).select(*by, DIGEST)
        swapped_in(kept, held, lambda found: None)
    return plan.select(*by, "action")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str, folders: DataFrame) -> None:
    """Removes folders by their names; the driver sees one after the other."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in folders.toLocalIterator():
        place = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *(name(c, str(row[c])) for c in folders.columns)]))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def site_list(*paths: DataFrame) -> DataFrame:
    """path, place: the distinct paths of several one-column tables, sorted."""
    out = paths[0]
    for p in paths[1:]:
        out = out.union(p)
    out = out.toDF("path").distinct()
    return placed(out, [F.col("path")])


def report(lines: DataFrame, text: Column, order: list[str], most: int = 60_000) -> DataFrame:
    """One row: lines in order as a text of at most ``most`` characters. A report is small."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return lines.agg(F.substring(F.array_join(F.transform(parts, lambda p: p["_t"]), "\n"), 1, most).alias("report"))


class Locked:
    """An exclusive lock on a path for the driver, as a file beside it that only one can create; raises
    BlockingIOError while another holds it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark._jvm
        self.file = jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
        self.fs = self.file.getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> Locked:
        if not self.fs.createNewFile(self.file):
            raise BlockingIOError(f"{self.file.toString()} is held")
        return self

    def __exit__(self, *_: object) -> None:
        self.fs.delete(self.file, False)


def replaced(df: DataFrame, path: str, valid=lambda df: None) -> None:  # noqa: ANN001
    """``swapped_in`` under the path's lock."""
    with Locked(df.sparkSession, path):
        swapped_in(df, path, valid)


def swapped_in(df: DataFrame, path: str, valid) -> None:  # noqa: ANN001
    """Writes beside the target, checks what was written, then puts it in its place; on a failed
    check the target stays as it was."""
    spark = df.sparkSession
    jvm = spark._jvm
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    valid(spark.read.parquet(new))
    place = jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(place(old), True)
    if fs.exists(place(path)):
        fs.rename(place(path), place(old))
    if not fs.rename(place(new), place(path)):
        fs.rename(place(old), place(path))
        raise OSError(f"{path} couldn't be replaced")
    fs.delete(place(old), True)
