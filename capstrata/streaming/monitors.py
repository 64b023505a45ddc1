"""Structured Streaming forms of the ordered checks; each has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from capstrata.policies import SelectionPolicy


def stream_rate_windows(samples: DataFrame, watermark: str, window: str) -> DataFrame:
    """Samples, time range and rate of each stream in tumbling event-time windows.

    ``samples`` has capture_id, stream and a TIMESTAMP ``ts``. Works on a static frame too.
    """
    w = samples.withWatermark("ts", watermark).groupBy("capture_id", "stream", F.window("ts", window)).agg(
        F.count("*").alias("samples"), F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    length = (F.unix_micros("_b") - F.unix_micros("_a")) / 1e6
    return w.select("capture_id", "stream", F.col("window.start").alias("window_start"), "samples", length.alias("span_sec"),
                    F.when(length > 0, (F.col("samples") - 1) / length).alias("rate_hz"))


EVENT = "capture_id bigint, rank bigint, code string, amount double"
LATE = "LATE_ROWS"


class OrderedRows(StatefulProcessor):
    """Releases the rows of one capture in rank order, each once the watermark has passed its event time.

    Rows wait in a list state, so triggers may bring them in any order within the watermark's delay; a row waits for
    waiting rows of smaller rank as well. An event-time timer releases what no new row would. A row that comes behind the
    watermark, or whose place in the order is already passed, is late: it is left out and counted per trigger in a row of
    code LATE_ROWS. With `idle_seconds`, rows that follow a longer pause start anew, and a capture whose last released row
    lies so far behind the watermark leaves no state.
    """

    def __init__(self, columns: list[str], kinds: list[str], scan: Callable, idle_seconds: float | None):
        self.columns, self.kinds, self.scan = columns, kinds, scan
        self.idle = None if idle_seconds is None else int(idle_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{c} {k}" for c, k in zip(self.columns, self.kinds))
        self.handle = handle
        self.last = handle.getValueState("last", fields)
        self.waiting = handle.getListState("waiting", fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p[self.columns] for p in rows if len(p)]
        new = [tuple(r) for r in pd.concat(parts).itertuples(index=False, name=None)] if parts else []
        yield from self.step(key, new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.step(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def step(self, key, new: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        in_time = [r for r in new if r[1] > passed and (last is None or r[0] > last[0])]
        waiting = sorted([*(tuple(r) for r in self.waiting.get()), *in_time]) if self.waiting.exists() else sorted(in_time)
        ready = next((i for i, r in enumerate(waiting) if r[1] > passed), len(waiting))
        events = []
        late = [r for r in new if r[1] <= passed or last is not None and r[0] <= last[0]]
        if late:
            events.append((key[0], min(r[0] for r in late), LATE, float(len(late))))
        start = 0
        for end in range(1, ready + 1):  # a longer pause than `idle` ends what is remembered
            if end == ready or self.idle is not None and waiting[end][1] - waiting[end - 1][1] > self.idle:
                if self.idle is not None and last is not None and waiting[start][1] - last[1] > self.idle:
                    last = None
                found, last = self.scan(last, pd.DataFrame(waiting[start:end], columns=self.columns))
                events += [(key[0], *e) for e in found]
                start = end
        if ready:
            self.last.update(last)
        waiting = waiting[ready:]
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if waiting:
            self.handle.registerTimer(-(-waiting[0][1] // 1000))
        elif last is not None and self.idle is not None:
            if last[1] + self.idle <= passed:
                self.last.clear()
            else:
                self.handle.registerTimer(-(-(last[1] + self.idle) // 1000))
        yield pd.DataFrame(events, columns=["capture_id", "rank", "code", "amount"])


def ordered_stream(rows: DataFrame, watermark: str, columns: list[str], kinds: list[str], scan: Callable, idle_seconds: float | None) -> DataFrame:
    """Events that `scan` finds in each capture's rows, read in rank order; needs the RocksDB state store."""
    seen = rows.withWatermark("ts", watermark).select("capture_id", *[F.unix_micros("ts").alias("us") if c == "us" else F.col(c).cast(k).alias(c) for c, k in zip(columns, kinds)])
    processor = OrderedRows(columns, kinds, scan, idle_seconds)
    return seen.groupBy("capture_id").transformWithStateInPandas(processor, EVENT, "append", "EventTime")


def late_rows(events: DataFrame) -> DataFrame:
    """How many rows of each capture came too late."""
    return events.where(F.col("code") == LATE).groupBy("capture_id").agg(F.sum("amount").cast("bigint").alias("late_rows"))


def stream_gap_events(frames: DataFrame, speed_m_s: float, watermark: str = "10 seconds", idle_seconds: float | None = None) -> DataFrame:
    """Non-rising times, slot gaps and speed events between neighbouring frames, and counts of late frames.

    ``frames`` has capture_id, rank, slot, sec, px, py, pz and a TIMESTAMP ``ts``. The batch twin is
    ``timeseries.gap_events`` over the frames that were not late.
    """
    columns = ["rank", "us", "slot", "sec", "px", "py", "pz"]

    def scan(last: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple]:
        both = pd.concat([pd.DataFrame([last], columns=columns), rows]) if last is not None else rows
        step = both[["sec", "slot"]].diff()
        moved = np.sqrt((both[["px", "py", "pz"]].diff() ** 2).sum(axis=1, skipna=False))
        speed = moved / step["sec"].where(step["sec"] > 0)
        out = []
        for code, hit, amount in (("NONMONOTONIC_TIME", step["sec"] <= 0, step["sec"]), ("SLOT_GAP", step["slot"] > 1, step["slot"] - 1), ("POSE_SPEED", speed > speed_m_s, speed)):
            out += [(int(r), code, float(a)) for r, a in zip(both["rank"][hit.values], amount[hit.values])]
        return out, next(rows.tail(1).itertuples(index=False, name=None))

    return ordered_stream(frames, watermark, columns, ["bigint"] * 3 + ["double"] * 4, scan, idle_seconds)


def stream_anchor_scan(candidates: DataFrame, policy: SelectionPolicy = SelectionPolicy(), watermark: str = "10 seconds",
                       idle_seconds: float | None = None) -> DataFrame:
    """Candidates that moved, turned or changed tracking since the last kept one (code: the reason), and late counts.

    ``kept`` marks rows that other rules keep; they become the anchor as well. The state is the last row with the anchor
    beside it, and the rows that wait for the watermark; it goes when a capture has been idle for ``idle_seconds``.
    """
    rot = [f"w{i}{j}" for i in range(3) for j in range(3)]
    now = ["tracking_normal", "px", "py", "pz", *rot]
    anchored = [f"a_{n}" for n in now]
    columns = ["rank", "us", "kept", *now, *anchored]

    def scan(last: tuple | None, rows: pd.DataFrame) -> tuple[list[tuple], tuple]:
        anchor = None if last is None else np.array(last[3 + len(now):], float)
        out, row = [], None
        for rank, us, kept, *values in rows[columns[:3 + len(now)]].itertuples(index=False, name=None):
            here = np.array(values, float)
            if anchor is not None:
                turn = np.degrees(np.arccos(np.clip((anchor[4:] @ here[4:] - 1) / 2, -1, 1)))
                why = [n for n, hit in (("TRANSLATION", np.linalg.norm(here[1:4] - anchor[1:4]) >= policy.translation_m),
                                        ("ROTATION", turn >= policy.rotation_degrees), ("TRACKING_TRANSITION", here[0] != anchor[0])) if hit]
                out += [(int(rank), reason, 1.0) for reason in why]
                kept = kept or bool(why)
            if anchor is None or kept:
                anchor = here
            row = (int(rank), int(us), bool(kept), *[float(x) for x in here], *[float(x) for x in anchor])
        return out, row

    waiting = candidates.select("*", *[F.lit(None).cast("double").alias(a) for a in anchored])
    kinds = ["bigint", "bigint", "boolean", *["double"] * (2 * len(now))]
    return ordered_stream(waiting, watermark, columns, kinds, scan, idle_seconds)


def stream_interval_join(frames: DataFrame, samples: DataFrame, half_seconds: float, watermark: str) -> DataFrame:
    """Frames joined to the samples within ``half_seconds`` of them, both ends included.

    Both sides have capture_id and a TIMESTAMP ``ts``; watermarks bound the join state.
    """
    f = frames.withWatermark("ts", watermark).alias("f")
    s = samples.withWatermark("ts", watermark).alias("s")
    gap = F.expr(f"INTERVAL {half_seconds} SECONDS")
    near = (F.col("f.capture_id") == F.col("s.capture_id")) & (F.col("s.ts") >= F.col("f.ts") - gap) & (F.col("s.ts") <= F.col("f.ts") + gap)
    return f.join(s, near).select("f.capture_id", "f.rank", F.col("s.source_row").alias("source_row"), F.col("s.ts").alias("sample_ts"))
