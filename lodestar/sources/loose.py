"""Payloads of loose JSON as variants: what doesn't have the shape that a reader relies on is refused, with a reason."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of values by how a variant's schema begins.
KINDS = {"object": "OBJECT", "list": "ARRAY", "text": "STRING", "flag": "BOOLEAN", "whole": "BIGINT", "number": ("BIGINT", "DECIMAL", "DOUBLE"), "nothing": "VOID"}
_SQL = {"text": "string", "flag": "boolean", "whole": "bigint", "number": "double"}


def kind_of(value: Column) -> Column:
    """object, list, text, flag, whole, number (with a fraction) or nothing for a JSON null; null where there is no value."""
    name = F.schema_of_variant(value)
    out = F
    for kind in ("object", "list", "text", "flag", "whole", "nothing"):
        out = out.when(name.startswith(KINDS[kind]), kind)
    return out.when(name.isNotNull(), "number")


def at(value: Column, path: str) -> Column:
    """The variant at a path ($.a.b[0]); null where there is none or something on the way has another shape."""
    return F.try_variant_get(value, path, "variant")


def refusal(value: Column, shape: Mapping[str, str]) -> Column:
    """Why a variant doesn't have the shape: path -> kind, a ? after it where the value may be absent or a JSON null. Null where it
    does. The first path that fails is named."""
    out = F.when(value.isNull(), "isn't JSON")
    for path, kind in shape.items():
        found, wanted = kind_of(value if path == "$" else at(value, path)), kind.rstrip("?")
        fits = found.isin("whole", "number") if wanted == "number" else found == wanted
        absent = found.isNull() | (found == "nothing")
        if kind.endswith("?"):
            out = out.when(~absent & ~fits, F.concat(F.lit(f"{path} is of kind "), found, F.lit(f", not {wanted}")))
        else:
            out = out.when(found.isNull(), f"{path} is missing").when(~fits, F.concat(F.lit(f"{path} is of kind "), found, F.lit(f", not {wanted}")))
    return out.otherwise(None)


def shaped(df: DataFrame, payload: str, shape: Mapping[str, str], columns: Mapping[str, str]) -> DataFrame:
    """``df`` with ``refused`` (a reason, or null) and ``columns`` (name -> path of ``shape``) in place of the payload, typed by
    the shape; all of them null in a refused row. A payload is parsed once; duplicate keys aren't JSON here."""
    parsed = df.withColumn("_v", F.try_parse_json(payload)).withColumn("refused", refusal(F.col("_v"), shape))
    value = lambda path: F.try_variant_get("_v", path, _SQL[shape[path].rstrip("?")])
    return parsed.withColumns({name: F.when(F.col("refused").isNull(), value(path)) for name, path in columns.items()}).drop("_v", payload)


def whole_listing(pages: DataFrame, board: str, most: int) -> DataFrame:
    """board, reason: listings that can't be taken as they are, as a part of one must never look like a listing with fewer
    entries. ``pages``: board, page (from 1), refused, more (whether the page says that another follows)."""
    by = pages.groupBy(board).agg(F.count("*").alias("n"), F.max("page").alias("last"), F.min(F.when(F.col("refused").isNotNull(), F.struct("page", "refused"))).alias("bad"), F.max_by("more", "page").alias("more"))
    reason = F.when(F.col("bad").isNotNull(), F.concat(F.lit("page "), F.col("bad.page").cast("string"), F.lit(": "), F.col("bad.refused"))).when(F.col("n") != F.col("last"), "pages are missing").when(F.col("more") & (F.col("last") >= most), f"has more than {most} pages").when(F.col("more"), "ends before its last page")
    return by.select(board, reason.alias("reason")).where("reason is not null")
