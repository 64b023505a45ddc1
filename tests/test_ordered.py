"""Sliced and plain plans must agree on a key that owns most rows."""
import random

import numpy as np
from pyspark.sql import functions as F

from capstrata.operators.intervals import covering_blocks, interval_join, interval_stats
from capstrata.operators.ordered import SLICE, group_diameter, quantiles, runs_of, sequence_over, with_diameter, with_slices
from capstrata.session import SLICES_KEY


def rows(seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.8 else rng.choice("abc"), i, round(rng.uniform(0, 50), 2)) for i in range(160)]


def test_sequence_same_under_slicing(spark):
    data = spark.createDataFrame(rows(), "k string, id long, t double")

    def run():
        out = sequence_over(data, ["k"], ["t", "id"], rank="pos", lag={"before": "t"}, lead={"after": "id"}, running_sum={"s": F.col("id")},
                            running_max_before={"m": F.col("id")}, total_sum={"all": F.col("id")}, total_min={"lo": F.col("t")})
        return sorted(tuple(r) for r in out.collect())

    plain = run()
    spark.conf.set(SLICES_KEY, "7")
    try:
        assert run() == plain
    finally:
        spark.conf.unset(SLICES_KEY)
    hot = [r for r in plain if r[0] == "hot"]
    assert sorted(r[3] for r in hot) == list(range(len(hot)))


def test_quantiles_exact(sliced):
    data = sliced.createDataFrame(rows(), "k string, id long, t double")
    got = {r["k"]: r for r in quantiles(data, ["k"], "t", {"m": 0.5, "p": 0.9, "top": 1.0}, count="n").collect()}
    for k in {r[0] for r in rows()}:
        v = [r[2] for r in rows() if r[0] == k]
        assert got[k]["n"] == len(v)
        assert np.allclose([got[k]["m"], got[k]["p"], got[k]["top"]], np.quantile(v, [0.5, 0.9, 1.0]))


def test_quantiles_with_heavy_ties(sliced):
    data = sliced.createDataFrame([("a", 1.0)] * 90 + [("a", 2.0)] * 10, "k string, t double")
    r = quantiles(data, ["k"], "t", {"m": 0.5, "p": 0.95}).first()
    assert (r["m"], r["p"]) == (1.0, 2.0)


def test_runs_do_not_bridge_gaps(sliced):
    data = sliced.createDataFrame([("a", b) for b in [-3, -2, 0, 1, 2, 5, 9, 10, 11, 12]], "k string, bin long")
    got = {r["bin"]: r["run"] for r in runs_of(data, ["k"], "bin").collect()}
    assert got == {-3: -3, -2: -3, 0: 0, 1: 0, 2: 0, 5: 5, 9: 9, 10: 9, 11: 9, 12: 9}


def test_diameter_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(int(g), *map(float, rng.normal(size=3))) for g in rng.integers(0, 4, 200)] + [(9, 1.0, 1.0, 1.0)]
    got = {r["g"]: r["d"] for r in group_diameter(spark.createDataFrame(pts, "g long, x double, y double, z double"), ["g"], ["x", "y", "z"], "d").collect()}
    for g in got:
        p = np.array([r[1:] for r in pts if r[0] == g])
        assert np.isclose(got[g], np.linalg.norm(p[:, None] - p[None], axis=2).max())


def test_interval_join_closed_and_unique(spark):
    pts = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "c long, id long, t double")
    iv = spark.createDataFrame([(1, 0, 2.0, 7.0), (1, 1, 7.0, 7.0), (1, 2, 30.0, 31.0)], "c long, k long, a double, b double")
    got = sorted((r["k"], r["id"]) for r in interval_join(pts, iv, ["c"], "t", "a", "b", 2.0).collect())
    assert got == [(0, i) for i in range(2, 8)] + [(1, 7)]


def test_interval_gaps_keep_their_position(sliced):
    s = sliced.createDataFrame([(1, i, float(i), 3.0, 4.0) for i in range(12)], "c long, source_row long, t double, x double, y double")
    iv = sliced.createDataFrame([(1, 0, 2.0, 4.0), (1, 1, 4.25, 4.5), (1, 2, -2.0, 1.0)], "c long, rank long, start double, end double")
    got = {r["rank"]: r for r in interval_stats(s, iv, ["c"], ["rank"], F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).collect()}
    assert (got[0]["sample_count"], got[0]["range_start"], got[0]["range_end"], got[0]["rms_magnitude"]) == (3, 2, 5, 5.0)
    assert (got[1]["sample_count"], got[1]["range_start"], got[1]["range_end"], got[1]["rms_magnitude"]) == (0, 5, 5, None)
    assert got[2]["boundary_covered"] is False and got[0]["boundary_covered"] is True


def test_interval_statistics_of_any_length(spark):
    """Intervals from empty to the whole key against numpy; the widest is made of a few blocks."""
    rng = np.random.default_rng(5)
    n = 9000
    t = np.sort(np.round(rng.uniform(0, 3000, n), 1))
    x = rng.normal(size=n)
    samples = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))] + [(2, 0, 5.0, 1.0)], "c long, source_row long, t double, x double")
    spans = [(1, 0, -10.0, 4000.0), (1, 1, 7.5, 7.4), (1, 2, None, 3.0), (1, 3, float(t[10]), float(t[4200])), (3, 0, 0.0, 9.0)]
    spans += [(1, 10 + i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(rng.uniform(0, 3000, 40).round(1), rng.exponential(300, 40).round(1)))]
    iv = spark.createDataFrame(spans, "c long, id long, start double, end double")
    got = {(r["c"], r["id"]): r for r in interval_stats(samples, iv, ["c"], ["id"], F.abs(F.col("x"))).collect()}
    assert len(got) == len(spans)
    for c, i, a, b in spans:
        r, hit = got[c, i], (t >= a) & (t <= b) if a is not None and c == 1 else np.zeros(n, bool)
        assert (r["sample_count"], r["range_end"] - r["range_start"]) == (hit.sum(), hit.sum())
        if hit.any():
            assert r["range_start"] == (t < a).sum() and r["first_sample_sec"] == t[hit].min() and r["last_sample_sec"] == t[hit].max()
            assert np.isclose(r["rms_magnitude"], np.sqrt((x[hit] ** 2).mean())) and r["maximum_magnitude"] == np.abs(x[hit]).max()
        else:
            assert r["rms_magnitude"] is None and r["maximum_magnitude"] is None
    assert covering_blocks(iv.limit(1).select(F.lit(1).alias("_lo"), F.lit(10_000_000).alias("_hi"))).count() < 256 * 4 + 10_000_000 / 65536


def test_one_key_and_an_outlier_leave_no_large_slice(spark):
    """99 % of the rows in one key, and one value far away: slices stay even, for numbers and for text."""
    n = 8000
    data = spark.range(n).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("k"), F.when(F.col("id") == 7, F.lit(1e15)).otherwise(F.col("id") * 0.5).alias("t"), F.format_string("name-%05d", "id").alias("s"), F.lit(0).alias("same"))
    spark.conf.set(SLICES_KEY, "8")
    try:
        for order in (["t"], ["s"], ["same", "s"]):
            sizes = [r["count"] for r in with_slices(data, ["k"], order).groupBy("k", SLICE).count().collect()]
            assert max(sizes) <= 2 * n / 8
            ranks = sequence_over(data, ["k"], order, rank="pos").where("k = 'hot'").select("pos").collect()
            assert sorted(r["pos"] for r in ranks) == list(range(len(ranks)))
    finally:
        spark.conf.unset(SLICES_KEY)


def test_capture_findings(spark):
    from capstrata.operators.timeseries import capture_findings

    frames = spark.createDataFrame([(1, i, 0.01 * i) for i in range(8)] + [(2, 0, 9.0), (3, 0, None)], "capture_id long, rank long, exposure_sec double")
    settings = spark.createDataFrame([(1, 0.045), (2, None)], "capture_id long, requested_cap double")
    objects = spark.createDataFrame([(2, 5), (2, 6), (9, 1)], "capture_id long, object_id long")
    got = sorted((r["capture_id"], r["code"], r["frames"], r["first_rank"], r["objects"]) for r in capture_findings(frames, settings, objects).collect())
    assert got == [(1, "EXPOSURE_EXCEEDS_REQUESTED_CAP", 3, 5, None), (1, "PHYSICAL_CALIBRATION_UNVERIFIED", None, None, None), (2, "PHYSICAL_CALIBRATION_UNVERIFIED", None, None, None),
                   (2, "SCALE_PRIOR_NOT_LOCALIZED", None, None, 2), (3, "PHYSICAL_CALIBRATION_UNVERIFIED", None, None, None)]


def test_slices_and_tasks_hold_bounded_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from capstrata.operators import ordered

    monkeypatch.setattr(ordered, "SLICE_ROWS", 500)
    data = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(7).alias("k"), F.col("id").alias("v"))
    sizes = [r["count"] for r in ordered.with_slices(data, ["k"], ["v"]).groupBy(ordered.SLICE).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 2_000
    out = ordered.sequence_over(data, ["k"], ["v"], rank="pos", lag={"before": "v"}, lead={"after": "v"},
                                running_sum={"s": F.col("v")}, total_sum={"n": F.lit(1).cast("bigint")})
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 20_000 and max(np.bincount([r.task for r in got])) < 5_000  # 18,000 rows have one key
    rows, want = {(r.k, r.v): r for r in got}, {}
    for v in range(20_000):
        want.setdefault(v % 3 if v % 10 == 0 else 7, []).append(v)
    for k, vs in want.items():
        total = 0
        for i, v in enumerate(vs):
            total += v
            r = rows[k, v]
            assert (r.pos, r.s, r.n) == (i, total, len(vs))
            assert r.before == (vs[i - 1] if i else None) and r.after == (vs[i + 1] if i + 1 < len(vs) else None)


def test_points_meet_limits_of_their_capture_without_a_sort(spark, monkeypatch):
    from pyspark.sql import functions as F

    from capstrata.operators import room, surfaces

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    points = spark.range(3000).select((F.col("id") % 2).alias("capture_id"), (F.col("id") % 50 / 10).alias("x"),
                                      (F.col("id") % 7 / 10).alias("y"), (F.col("id") % 31 / 10).alias("z"))
    seen = {}
    real = room.quantiles
    monkeypatch.setattr(room, "quantiles", lambda df, keys, value, *a, **kw: seen.update({value: plan(df)}) or real(df, keys, value, *a, **kw))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # the points are larger, the limits of two captures smaller
    try:
        trimmed = surfaces.trim_quantiles(points, ["x", "z"], 0.02)
        assert "SortMergeJoin" not in plan(trimmed) and 2700 < trimmed.count() <= 3000
        assert room.sparse_room(points).count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(seen) >= {"p0", "p1"} and not any("SortMergeJoin" in p for p in seen.values())


def test_diameter_of_gathered_points(spark):
    rng = np.random.default_rng(5)
    groups = {0: [[1.0, 2.0, 3.0]], 1: rng.normal(size=(5, 3)).tolist(), 2: rng.normal(size=(300, 3)).tolist(), 3: rng.uniform(size=(17, 3)).tolist(), 4: [[0.5, 0.5, 0.5]] * 40, 5: []}
    df = spark.createDataFrame([(g, p) for g, p in groups.items()], "g long, p array<struct<x:double,y:double,z:double>>")
    for few in (0, 16, 1000):
        got = {r["g"]: r["d"] for r in with_diameter(df, "p", ["x", "y", "z"], "d", few).collect()}
        for g, p in groups.items():
            want = max((float(np.linalg.norm(np.subtract(a, b))) for a in p for b in p), default=0.0)
            assert abs(got[g] - want) < 1e-12
    assert with_diameter(df, "p", ["x", "y", "z"], "d").columns == ["g", "p", "d"]
