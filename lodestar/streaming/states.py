"""The check state of every source as a keyed, resumable stream.

Fetches arrive in any order within a batch and in order from batch to batch. Each source's state outlives the run in
the stream's checkpoint, so a run that starts again goes on where the last one stopped. A timer marks a source stale when no
check has succeeded for a while, also if nothing more arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators.changes import DEAD_AFTER

#: status: blocked, refused, failed or read; reading (of a page that changed): null where nothing could read it, deferred,
#: confirmed, published, held or broken; at: microseconds since 1970; ord: order among equal times.
FETCHES = "source long, at long, ord long, status string, redirected boolean, digest string, reading string"
STATE = "link string, failures int, baseline string, attempt long, success long, extraction long, stale boolean"
OUT = "source long, at long, ord long, outcome string, link string, failures int, baseline string, success long, extraction long"
#: Outcomes of a reading: (name, whether the page was read through, whether it agrees, so that the baseline moves).
READINGS = {
    None: ("ai_unavailable", False, False),
    "deferred": ("ai_deferred", False, False),
    "confirmed": ("confirmed", True, True),
    "published": ("published", True, True),
    "held": ("review_required", True, False),
    "broken": ("extraction_failed", True, False),
}
NEW = {"link": None, "failures": 0, "baseline": None, "attempt": None, "success": None, "extraction": None, "stale": False}


def after(state: dict, fetch: Any) -> tuple[str, dict]:
    """The outcome of a fetch and the state that follows.

    A refusal leaves all but the attempt as it was, a block makes the source a link only; failures count until a page is
    read. The baseline digest moves only when a reading agrees with the page, never when one is held for review.
    """
    new = state | {"attempt": fetch.at}
    if fetch.status == "blocked":
        return "link_only", new | {"link": "link_only"}
    if fetch.status == "refused":
        return "source_refused", new
    if fetch.status == "failed":
        new["failures"] += 1
        return "source_failed", new | ({"link": "dead"} if new["failures"] >= DEAD_AFTER else {})
    new |= {"failures": 0, "link": "redirected" if fetch.redirected else "ok"}
    if fetch.digest == state["baseline"] and fetch.digest is not None:
        return "unchanged", new | {"success": fetch.at, "stale": False}
    outcome, through, agrees = READINGS[fetch.reading]
    if through:
        new["extraction"] = fetch.at
    if agrees:
        new |= {"success": fetch.at, "baseline": fetch.digest, "stale": False}
    return outcome, new


class CheckStates(StatefulProcessor):
    """One row for each fetch, with the state after it, and one when a source goes stale."""

    def __init__(self, stale_after: int) -> None:
        self.stale_after = stale_after * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("check", STATE)

    def _get(self) -> dict:
        return dict(zip(NEW, self.state.get())) if self.state.exists() else dict(NEW)

    def _aged(self, source: int, state: dict, now: int) -> Iterator[tuple]:
        """A row when the last success is ``stale_after`` old by ``now``; once for each success."""
        if state["success"] is not None and not state["stale"] and now >= state["success"] + self.stale_after:
            state["stale"] = True
            yield self._row(source, state["success"] + self.stale_after, None, "stale", state)

    @staticmethod
    def _row(source: int, at: int, ord_: int | None, outcome: str, state: dict) -> tuple:
        return (source, at, ord_, outcome, *(state[c] for c in ("link", "failures", "baseline", "success", "extraction")))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame(rows, columns=names, dtype=object)

    def _keep(self, state: dict) -> None:
        self.state.update(tuple(state.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state["success"] is not None and not state["stale"]:
            self.handle.registerTimer(-(-(state["success"] + self.stale_after) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "ord"], kind="stable")
        batch = batch.astype(object).where(batch.notna(), None)
        state, out = self._get(), []
        for fetch in batch.itertuples():
            out += self._aged(key[0], state, fetch.at)
            outcome, state = after(state, fetch)
            out.append(self._row(key[0], fetch.at, fetch.ord, outcome, state))
        self._keep(state)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._get()
        rows = list(self._aged(key[0], state, expiredTimerInfo.getExpiryTimeInMs() * 1000))
        self._keep(state)
        if rows:
            yield self._frame(rows)

    def close(self) -> None:
        pass


def checked(spark: SparkSession, arrivals: str, folder: str, stale_after: int = 21 * 86_400, late: str = "0 seconds", files: int | None = None) -> DataFrame:
    """All rows of ``OUT`` so far, after a run over what is new in the folder ``arrivals`` (Parquet files of ``FETCHES``).

    ``folder`` holds the rows and the checkpoint; the next run with it goes on from there. ``files`` bounds the
    files, and so the fetches, of one batch; a source's fetches of a batch are sorted in one task. A source is stale
    ``stale_after`` seconds after its last success, once the watermark has passed that time.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(FETCHES)
        stream = (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(arrivals)
        stream = stream.selectExpr("*", "timestamp_micros(at) as time").withWatermark("time", late)
        states = stream.groupBy("source").transformWithStateInPandas(CheckStates(stale_after), OUT, "append", "eventTime")
        query = states.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(OUT).parquet(f"{folder}/rows")
