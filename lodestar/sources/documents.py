"""JSON documents: one file an organisation, its roles nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.place import in_city, matched
from lodestar.functions.values import age_days, freshness, status_today, suppressed
from lodestar.operators.runs import placed


def json_documents(spark: SparkSession, path: str, schema: T.StructType, only: list[str] | None = None, key: Column | None = None, single: bool = False) -> DataFrame:
    """All documents of a folder with ``_file``; ``only`` keeps those whose ``key`` is listed. A file is one document, or with
    ``single`` one on each line.

    A file that doesn't parse raises. The schema is given, so nothing is read to guess it.
    """
    df = spark.read.schema(schema).option("multiLine", not single).option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    return df.where(key.isin(*only)) if only else df


def roles_of(docs: DataFrame, organisation: str = "organisation", roles: str = "opportunities") -> DataFrame:
    """One row a role with its organisation's id and ``ord``: file order, then place in the file. Only file
    names are ranked, by ranges of them, not roles."""
    files = placed(docs.select("_file").distinct(), [F.col("_file")], "_rank")
    numbered = docs.join(files, "_file")
    return numbered.select("_rank", F.col(f"{organisation}.id").alias("_org"), F.posexplode(roles).alias("_pos", "role")).select((F.col("_rank").cast("long") * 1_000_000 + F.col("_pos")).alias("ord"), F.col("_org").alias("of_org"), "role.*")


def load(roles: DataFrame, orgs: DataFrame, today: Column, key: str = "org_id") -> tuple[DataFrame, DataFrame]:
    """(roles, organisations) as they are shown: roles in the city only (``in_city``), with their status as of
    today (``start_month``, ``end_month`` name the season), and organisations that have any such role."""
    kept = roles.where(F.coalesce("in_city", F.lit(True))).withColumn("status", status_today(F.col("status"), F.col("start_month"), F.col("end_month"), today))
    return kept, orgs.join(kept.select(key), key, "left_semi")


def catalogue(roles: DataFrame, orgs: DataFrame, gazetteer: DataFrame, today: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """``load`` with what it takes for granted derived: whether a role is in the city, from its kind of place and the places
    that it states (location_type, stated_places) by the gazetteer (name, borough); and of each organisation (org_id,
    last_success, link_status) that has a role shown the age of its last check, its state and whether it is suppressed."""
    places = F.coalesce("stated_places", F.array().cast("array<string>"))
    rows = roles.withColumn("_places", places)
    known = matched(rows, "id", "_places", gazetteer).select("id", "boroughs", "london_only")
    rows = rows.join(known, "id").withColumn("in_city", in_city(F.col("location_type"), F.size("_places"), F.col("boroughs"), F.col("london_only")))
    kept, shown = load(rows.drop("_places", "boroughs", "london_only"), orgs, today)
    state = freshness(F.col("age"))
    shown = shown.withColumn("age", age_days(F.col("last_success"), now)).withColumn("state", state).withColumn("hidden", suppressed(F.col("state"), F.col("link_status")))
    return kept.drop("in_city"), shown


def geo_features(spark: SparkSession, path: str, names: list[str], expected: int | None = None) -> DataFrame:
    """name, geometry (JSON) of the features of a GeoJSON file; the name is the first of ``names`` that a
    feature's properties have. Raises where a feature has no name, or ``expected`` isn't their number."""
    kind = "features array<struct<properties:map<string,string>,geometry:string>>"
    df = spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path)
    each = df.select(F.explode("features").alias("f")).select(F.coalesce(*(F.try_element_at("f.properties", F.lit(n)) for n in names)).alias("name"), "f.geometry")
    n = each.agg(F.count("*").alias("n"), F.count("name").alias("named")).first()
    if n.named != n.n or expected not in (None, n.n):
        raise ValueError(f"{n.n} features of which {n.named} have a name; {expected} were expected")
    return each


def first_findings(findings: DataFrame, org: str = "org_id") -> DataFrame:
    """Of several findings on an organisation, that of the first file, then the first place."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(org).orderBy("_file", "_pos"))).where("_n = 1").drop("_n")


def newest_version(versions: list[DataFrame], stamp: str = "generated_at") -> DataFrame:
    """Of several versions of a report (one row each), the newest; ties to the first listed."""
    out = None
    for i, v in enumerate(versions):
        v = v.withColumn("_version", F.lit(i))
        out = v if out is None else out.unionByName(v, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last(stamp), "_version").limit(1).drop("_version")


def seeded(spark: SparkSession, seed: list[tuple], names: list[str], known: DataFrame, left_out: list[str]) -> DataFrame:
    """Seed rows that aren't known by slug or lower-case name, and aren't left out by name."""
    rows = spark.createDataFrame(seed, names).where(~F.col("name").isin(*left_out)) if left_out else spark.createDataFrame(seed, names)
    rows = rows.join(known.select("slug").distinct(), "slug", "left_anti")
    return rows.withColumn("_low", F.lower("name")).join(known.select(F.lower("name").alias("_low")).distinct(), "_low", "left_anti").drop("_low")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, length of image files by their first bytes; others are left out."""
    from lodestar.functions.web import image_kind

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", image_kind(F.col("content")).alias("kind"), "length").where("kind is not null")
