"""Helpers that several operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.scratch import scoped as scoped
from lodestar.sources.scratch import written as written

#: A word: a run of characters that are not ASCII white space. Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most so many rows may be broadcast; each use counts the rows first.
BROADCAST_ROWS = 200_000
#: The same for tables of a single 64-bit column (16 MB).
BROADCAST_KEYS = 2_000_000

#: Bytes of text that a Python worker works on at once.
PIECE = 4 << 20
#: Bytes of an Arrow batch.
BATCH = 8 << 20


def _bytes(size: str) -> int:
    """A size as Spark writes it (64m, 1024b) in bytes; a bare number counts bytes."""
    found = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", size.strip().lower())
    return int(found[1]) << 10 * "bkmgt".index(found[2] or "b") if found else -1


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches cut at ``BATCH`` bytes: rows don't bound what a Python worker holds,
    as texts may be long."""
    conf = df.sparkSession.conf
    if not 0 < _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")
    return df


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts in ``column`` have ``most`` bytes together, or one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are at most ``most``, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= most else df


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3: rows with 1 are held out; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def wrapped(df: DataFrame, *need: str) -> DataFrame:
    """``df`` as the struct ``row`` and the columns ``need``: no other column's name can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *need)


def unwrapped(df: DataFrame) -> DataFrame:
    return df.select("row.*")
