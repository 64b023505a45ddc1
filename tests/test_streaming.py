"""Each streaming operator gives the rows of its batch twin, fed one file per trigger."""
import os
from pathlib import Path

from pyspark.sql import functions as F

from capstrata.operators import intervals, selection, timeseries
from capstrata.policies import SelectionPolicy
from capstrata.streaming import monitors

ROT = [f"w{i}{j}" for i in range(3) for j in range(3)]


def frames(spark):
    rows = [(c, i, i + (i > 12) * 3, 10.0 * c + 0.25 * i, 0.03 * i * (1 + (i == 9) * 40), i != 3) for c in (1, 2) for i in range(24)]
    df = spark.createDataFrame(rows, "capture_id long, rank long, slot long, sec double, px double, tracking_normal boolean")
    return df.select("*", F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"), F.timestamp_seconds("sec").alias("ts"),
                     *[F.lit(1.0 if n[1] == n[2] else 0.0).alias(n) for n in ROT])


def stream_of(spark, df, path, parts, ranks=24):
    """Write rank ranges as separate files and read them back one per trigger."""
    for p in range(parts):
        df.where((F.col("rank") >= p * ranks // parts) & (F.col("rank") < (p + 1) * ranks // parts)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def in_files(spark, df, path, groups):
    """One file per group of ranks, in the order given; one file per trigger."""
    for n, ranks in enumerate(groups):
        part = f"{path}/part-{n:03d}"
        df.where(F.col("rank").isin(list(ranks))).coalesce(1).write.parquet(part)
        for f in Path(part).glob("*.parquet"):
            Path(path, "in").mkdir(exist_ok=True)
            at = Path(path, "in", f"{n:03d}.parquet")
            at.write_bytes(f.read_bytes())
            os.utime(at, (1_600_000_000 + n, 1_600_000_000 + n))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def closing(f):
    """The frames and one more per capture, far enough behind them for the watermark to pass all others."""
    end = f.where("rank = 23").withColumn("rank", F.lit(24).cast("long")).withColumn("slot", F.lit(99).cast("long")).withColumn("sec", F.col("sec") + 1000)
    return f.unionByName(end.withColumn("ts", F.timestamp_seconds("sec")))


#: Two triggers out of order within the delay; rank 5 comes back when the watermark is far beyond it.
SHUFFLED = [[0, 2, 1, 7], [4, 3, 6], [12, 8, 9, 10, 11], [*range(13, 24)], [5], [24]]


def test_gap_events_out_of_order_and_late(spark, tmp_path):
    f = frames(spark).where("capture_id = 1")
    f = f.withColumn("sec", F.when(F.col("rank") == 17, F.col("sec") - 0.3).otherwise(F.col("sec"))).withColumn("ts", F.timestamp_seconds("sec"))
    stream = in_files(spark, closing(f), str(tmp_path), SHUFFLED)
    got = run(monitors.stream_gap_events(stream, 3.0, "2 seconds"), "gaps_late", spark).collect()
    on_time = {(r["capture_id"], r["rank"], r["code"], round(r["amount"], 6)) for r in got if r["code"] != monitors.LATE}
    twin = timeseries.gap_events(f.where("rank <> 5"), 3.0)
    assert on_time == {(r["capture_id"], r["rank"], r["code"], round(r["amount"], 6)) for r in twin.collect()}
    assert {c for _, _, c, _ in on_time} == {"SLOT_GAP", "POSE_SPEED", "NONMONOTONIC_TIME"} and (1, 6, "SLOT_GAP", 1.0) in on_time
    assert [tuple(r) for r in monitors.late_rows(spark.table("gaps_late")).collect()] == [(1, 1)]


def test_gap_events_of_more_captures_and_idle_state(spark, tmp_path):
    f = frames(spark)
    got = run(monitors.stream_gap_events(stream_of(spark, closing(f), str(tmp_path / "f"), 3, 25), 3.0, "100 seconds"), "gaps", spark)
    b = f.withColumn("sensor_sec", F.col("sec")).withColumn("relative_sec", F.col("sec"))
    want = {(r["capture_id"], r["after_frame"], "SLOT_GAP") for r in timeseries.slot_gaps(b).collect()}
    want |= {(r["capture_id"], r["second_rank"], "POSE_SPEED") for r in timeseries.pose_speed_events(b, 3.0).collect()}
    assert want == {(r["capture_id"], r["rank"], r["code"]) for r in timeseries.gap_events(f, 3.0).collect()} and len(want) == 6
    # one watermark serves all captures: its delay must cover how far they lie apart
    assert {(r["capture_id"], r["rank"], r["code"]) for r in got.collect() if r["rank"] < 24 and r["code"] != monitors.LATE} == want
    # with a short idle time nothing is remembered across the jump to the closing row
    fresh = in_files(spark, closing(f.where("capture_id = 1")), str(tmp_path), [range(12), range(12, 24), [24]])
    forgot = run(monitors.stream_gap_events(fresh, 3.0, "0 seconds", idle_seconds=5.0), "gaps_idle", spark)
    assert {(r["rank"], r["code"]) for r in forgot.collect()} == {(r, c) for k, r, c in want if k == 1}


def test_anchor_scan_out_of_order(spark, tmp_path):
    p = SelectionPolicy()
    f = frames(spark).where("capture_id = 1").withColumn("relative_sec", F.col("sec")).withColumn("score", F.lit(0.5))
    cov = selection.coverage_views(f, p)
    want = {tuple(r) for r in selection.anchor_scan(f, cov, p).collect()}
    kept = f.join(cov.select("capture_id", "rank").distinct().withColumn("kept", F.lit(True)), ["capture_id", "rank"], "left").fillna(False, ["kept"])
    order = [[0, 2, 1, 7], [4, 3, 6, 5], [12, 8, 9, 10, 11], [*range(13, 24)], [24]]
    got = run(monitors.stream_anchor_scan(in_files(spark, closing(kept), str(tmp_path), order), p, "2 seconds"), "anchors", spark)
    assert {tuple(r)[:3] for r in got.collect() if r["rank"] < 24} == want and want


def test_rate_windows(spark, tmp_path):
    f = frames(spark).withColumn("stream", F.lit("imu"))
    s = stream_of(spark, f, str(tmp_path / "f"), 2)
    got = run(monitors.stream_rate_windows(s, "100 seconds", "2 seconds"), "rates", spark, "update")
    newest = {}
    for r in got.collect():
        k = (r["capture_id"], r["window_start"])
        newest[k] = max(newest.get(k, (0, 0)), (r["samples"], r["rate_hz"] or 0))
    want = {(r["capture_id"], r["window_start"]): (r["samples"], r["rate_hz"] or 0) for r in monitors.stream_rate_windows(f, "100 seconds", "2 seconds").collect()}
    assert newest == want


def test_interval_join(spark, tmp_path):
    f = frames(spark).select("capture_id", "rank", "ts", "sec")
    s = f.select("capture_id", F.col("rank"), F.col("rank").alias("source_row"), "ts", "sec")
    got = run(monitors.stream_interval_join(stream_of(spark, f, str(tmp_path / "f"), 2), stream_of(spark, s, str(tmp_path / "s"), 2), 0.25, "100 seconds"), "joined", spark)
    iv = f.select("capture_id", "rank", (F.col("sec") - 0.25).alias("a"), (F.col("sec") + 0.25).alias("b"))
    want = intervals.interval_join(s.select("capture_id", "source_row", "sec"), iv, ["capture_id"], "sec", "a", "b", 0.5)
    assert {(r[0], r[1], r[2]) for r in got.collect()} == {(r["capture_id"], r["rank"], r["source_row"]) for r in want.collect()}
