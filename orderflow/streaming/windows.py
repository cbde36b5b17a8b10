"""Backlog windows of several sizes from one pass, with late rows as a second
output (STR-2, STR-3, STR-3b, STR-7, STR-11, SNK-10).

The stateful step is keyed by (backlog key, salt), so a hot key spreads over
``SALTS`` tasks. Its state is one sum per 5-minute pane: an event touches one
pane, never one row per window. When the watermark passes window ends, each
window is the difference of two running sums over the panes, for every window
type at once; panes that no open window needs are dropped, so the state is
bounded by the longest window.

An event of a window that has closed is not added to it. It leaves as a ``late``
row naming the ends it missed, from the same step and in the same batch, so
windows plus late rows are always the whole input. The partial windows of all
salts close in the same micro-batch, where one aggregate merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.operators import backlog as BL
from orderflow.streaming import sinks as SK

SALTS = 16
PANE = 300_000_000                  # microseconds
HOUR = 3_600_000_000
#: window type -> (size, slide) in microseconds; slides are multiples of a pane
SPECS = {"sliding_1h": (HOUR, PANE), "sliding_24h": (24 * HOUR, HOUR), "tumbling_daily": (24 * HOUR, 24 * HOUR)}
SUMS = ["demand_c", "supply_c", "cnt", "prio"]
KEY = [*BL.KEY, "salt"]

STATE = "closed bigint, pane array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in SUMS)
OUTPUT = ("kind string, bu string, product_family string, horizon string, salt int, window_type string, "
          "window_end bigint, missed_to bigint, order_id string, ts_us bigint, " + ", ".join(f"{c} bigint" for c in SUMS))
COLUMNS = [c.split(" ")[0] for c in OUTPUT.split(", ")]


class WindowFold(StatefulProcessor):
    """Keyed by (bu, family, horizon, salt) under event time."""

    def __init__(self, specs: dict[str, tuple[int, int]]):
        self.specs = specs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getValueState("panes", STATE)

    def _load(self) -> tuple[int, np.ndarray, np.ndarray]:
        stored = self.panes.get()
        if stored is None:
            return 0, np.zeros(0, np.int64), np.zeros((0, len(SUMS)), np.int64)
        return stored[0], np.array(stored[1], np.int64), np.array(stored[2:], np.int64).T.reshape(-1, len(SUMS))

    def _close(self, key, closed: int, now: int, pane: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        """Windows with an end in (closed, now] that hold a pane."""
        out = []
        running = np.vstack([np.zeros((1, len(SUMS)), np.int64), sums.cumsum(axis=0)])
        for name, (size, slide) in self.specs.items() if len(pane) else ():
            lo = max(closed, int(pane[0])) // slide * slide + slide
            hi = min(now, int(pane[-1]) // slide * slide + size)
            ends = np.arange(lo, hi + 1, slide)
            a, b = np.searchsorted(pane, ends - size), np.searchsorted(pane, ends)
            ends, a, b = ends[b > a], a[b > a], b[b > a]
            out.append(pd.DataFrame(running[b] - running[a], columns=SUMS).assign(window_end=ends, window_type=name))
        out = pd.concat(out) if out else pd.DataFrame({"window_end": [], "window_type": []})
        return self._row(key, out.assign(kind="window"))

    def _late(self, key, now: int, rows: pd.DataFrame) -> pd.DataFrame:
        """One row per event and window type with closed windows, and which ends it missed."""
        ts, out = rows["ts_us"].to_numpy(np.int64), []
        for name, (size, slide) in self.specs.items():
            first = (ts - size) // slide * slide + slide + size
            to = np.minimum(ts // slide * slide + size, now // slide * slide)
            late = first <= now
            out.append(rows[late].assign(window_type=name, window_end=first[late], missed_to=to[late]))
        return self._row(key, pd.concat(out).assign(kind="late"))

    @staticmethod
    def _row(key, df: pd.DataFrame) -> pd.DataFrame:
        df = df.assign(**dict(zip(KEY, key)))
        for c in ("missed_to", "order_id", "ts_us", *SUMS):
            if c not in df:
                df[c] = None
        kinds = {c: "Int64" for c in ("window_end", "missed_to", "ts_us", *SUMS)}
        # plain objects: Spark takes no text column in several chunks
        kinds |= {c: object for c in ("kind", *BL.KEY, "window_type", "order_id")}
        return df[COLUMNS].astype(kinds)

    def _last_end(self, pane: np.ndarray) -> np.ndarray:
        return np.max([pane // slide * slide + size for size, slide in self.specs.values()], axis=0)

    def _store(self, closed: int, pane: np.ndarray, sums: np.ndarray) -> None:
        open_ = self._last_end(pane) > closed if len(pane) else np.zeros(0, bool)
        pane, sums = pane[open_], sums[open_]
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if not len(pane):
            self.panes.clear()
            return
        self.panes.update((closed, pane.tolist(), *(c.tolist() for c in sums.T)))
        nexts = [max(closed, int(pane[0])) // slide * slide + slide for _size, slide in self.specs.values()]
        self.handle.registerTimer(min(nexts) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        closed, pane, sums = self._load()
        if now > closed:
            yield self._close(key, closed, now, pane, sums)
        for pdf in rows:
            yield self._late(key, now, pdf)
            ts = pdf["ts_us"].to_numpy(np.int64)
            at = ts // PANE * PANE
            keep = self._last_end(at) > now
            pane, back = np.unique(np.concatenate([pane, at[keep]]), return_inverse=True)
            grown = np.zeros((len(pane), len(SUMS)), np.int64)
            np.add.at(grown, back, np.vstack([sums, pdf.loc[keep, SUMS].to_numpy(np.int64)]))
            sums = grown
        self._store(now, pane, sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        closed, pane, sums = self._load()
        if now > closed:
            yield self._close(key, closed, now, pane, sums)
            self._store(now, pane, sums)


def fold_windows(records: DataFrame, specs: dict[str, tuple[int, int]] = SPECS, salts: int = SALTS,
                 delay: str = S.WATERMARK_DELAY) -> DataFrame:
    """Rows of ``OUTPUT`` for a stream of backlog records (``ts``, ``order_id``, the key and measures)."""
    unfulfilled = F.col("status").isin(*S.UNFULFILLED_STATUSES)
    cents = (F.coalesce("total_value", F.lit(0)) * 100).cast("bigint")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    r = records.withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", delay)
    # ts_us carries no watermark, so Spark drops no late row before the step sees it
    r = r.select(*BL.KEY, F.pmod(F.xxhash64("order_id", "ts"), F.lit(salts)).cast("int").alias("salt"),
                 us.alias("ts_us"), "order_id",
                 F.when(unfulfilled, cents).otherwise(0).alias("demand_c"),
                 F.when(F.col("atp_feasible"), cents).otherwise(0).alias("supply_c"),
                 unfulfilled.cast("bigint").alias("cnt"),
                 F.when(unfulfilled, F.col("priority")).otherwise(0).cast("bigint").alias("prio"))
    r = r.na.fill(0, ["demand_c", "supply_c", "cnt", "prio"])
    return r.groupBy(*KEY).transformWithStateInPandas(WindowFold(specs), OUTPUT, "append", "EventTime")


def finish(sums: DataFrame, specs: dict[str, tuple[int, int]] = SPECS) -> DataFrame:
    """Metric rows (AGG-1) from rows of sums, merged over salts."""
    money = lambda c: (F.col(c) / 100).cast(S.MONEY)
    g = sums.groupBy(*BL.KEY, "window_type", "window_end").agg(*[F.sum(c).alias(c) for c in SUMS])
    size = F.coalesce(*[F.when(F.col("window_type") == n, F.lit(s)) for n, (s, _) in specs.items()])
    g = g.withColumns({"demand": money("demand_c"), "supply": money("supply_c")})
    return g.select(*BL.KEY, "window_type", X.to_ntz(F.timestamp_micros(F.col("window_end") - size)).alias("window_start"),
                    X.to_ntz(F.timestamp_micros("window_end")).alias("window_end"), *BL._finish(g))


def late_sums(late: DataFrame, specs: dict[str, tuple[int, int]] = SPECS) -> DataFrame:
    """The sums that late rows would have added, per window they missed."""
    slide = F.coalesce(*[F.when(F.col("window_type") == n, F.lit(s)) for n, (_, s) in specs.items()])
    return late.withColumn("window_end", F.explode(F.sequence("window_end", "missed_to", slide)))


def window_sink(rows_path: str, metrics_path: str, specs: dict[str, tuple[int, int]] = SPECS):
    """The step's rows are written once, by kind; closed windows, merged over
    salts, go to the metric table, also as JSON (SNK-5) for a topic."""
    def write(batch: DataFrame, batch_id: int) -> None:
        SK.batch_append_sink(rows_path, ("kind",))(batch, batch_id)
        here = SK.batch_path(rows_path, batch_id)
        rows = batch.sparkSession.read.schema(batch.schema).option("basePath", here).parquet(here)
        done = finish(rows.where("kind = 'window'"), specs)
        SK.batch_append_sink(metrics_path)(done.withColumn("json", F.to_json(F.struct(*done.columns))), batch_id)
    return write


def read_late(spark: SparkSession, rows_path: str) -> DataFrame:
    return SK.read_batches(spark, rows_path).where("kind = 'late'")
