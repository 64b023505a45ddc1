"""Analytic cases on tiny frames."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.functions.numeric import bottom_offset_interval, exact_integer, exact_number
from capstrata.operators import boundaries as bd
from capstrata.operators import graph, integrity, matching, room, selection, surfaces, timeseries, tracks
from capstrata.policies import BoundaryPolicy, PlanPolicy, PolicyError, SelectionPolicy, SurfacePolicy, TrackPolicy

EYE = {f"w{i}{j}": 1.0 if i == j else 0.0 for i in range(3) for j in range(3)}


def test_policy_bounds():
    with pytest.raises(PolicyError):
        SelectionPolicy(candidate_fps=11.0)
    with pytest.raises(PolicyError):
        SurfacePolicy(distance_m=1.0)


def test_exact_parsing(spark):
    df = spark.createDataFrame([("1000000000.016667",), ("NaN",), ("2.5",), ("7",), ("x",)], "s string")
    got = [tuple(r) for r in df.select(exact_number(F.col("s")).cast("double"), exact_integer(F.col("s"))).collect()]
    assert got == [(1000000000.016667, None), (None, None), (2.5, None), (7.0, 7), (None, None)]


def test_pose_export_pair(spark):
    f = spark.createDataFrame([(1, 0, 0, "1000000000.000000", 0.0), (1, 1, 2, "1000000000.016667", 0.01)],
                              "capture_id long, rank long, slot long, s string, px double").select(
        "capture_id", "rank", "slot", F.col("s").cast("decimal(20,6)").alias("sensor_sec"), F.col("s").cast("decimal(20,6)").alias("relative_sec"),
        "px", F.lit(0.0).alias("py"), F.lit(0.0).alias("pz"))
    gap = timeseries.slot_gaps(f).first()
    assert gap["skipped_slots"] == 1 and str(gap["interval_sec"]) == "0.016667"
    assert timeseries.pose_speed_events(f, 3.0).count() == 0
    assert timeseries.pose_speed_events(f, 0.5).count() == 1


def test_bucket_downsample(sliced):
    f = sliced.createDataFrame([(1, i, i / 4) for i in range(17)], "capture_id long, rank long, relative_sec double")
    got = [r["rank"] for r in selection.bucket_downsample(f, SelectionPolicy(candidate_fps=2.0)).orderBy("rank").collect()]
    assert got == list(range(0, 17, 2))


def walk(spark):
    data = [(1, i, i / 4, i != 0, 0.5, 0.03 * i, 0.0, 0.0, *EYE.values()) for i in range(17)]
    cols = "capture_id long, rank long, relative_sec double, tracking_normal boolean, score double, px double, py double, pz double, " + ", ".join(f"{k} double" for k in EYE)
    return spark.createDataFrame(data, cols)


def expected_anchor(rows, covered, policy):
    anchor, out = rows[0], []
    for c in rows[1:]:
        why = [n for n, hit in (("TRANSLATION", abs(c["px"] - anchor["px"]) >= policy.translation_m),
                                ("TRACKING_TRANSITION", c["tracking_normal"] != anchor["tracking_normal"])) if hit]
        out += [(c["rank"], w) for w in why]
        if why or c["rank"] in covered:
            anchor = c
    return sorted(out)


@pytest.mark.parametrize("gap", [0.75, 4.0])
def test_anchor_scan_matches_sequential_walk(sliced, gap):
    p = SelectionPolicy(max_gap_seconds=gap)
    c = walk(sliced)
    cov = selection.coverage_views(c, p)
    ranks = {r["rank"] for r in cov.collect()}
    assert {0, 16} <= ranks
    got = sorted((r["rank"], r["reason"]) for r in selection.anchor_scan(c, cov, p).collect())
    assert got == expected_anchor(c.orderBy("rank").collect(), ranks, p)
    assert (1, "TRACKING_TRANSITION") in got


def test_revisit_pairs(spark):
    def views(n):
        return spark.createDataFrame([(1, i, float(i), 0.0 if i in (0, 29) else 3.0, 0.0, 0.0, *EYE.values()) for i in range(n)],
                                     "capture_id long, rank long, relative_sec double, px double, py double, pz double, " + ", ".join(f"{k} double" for k in EYE))
    got = {(r[1], r[2]) for r in tracks.revisit_pairs(views(30)).collect()}
    assert (0, 1) in got and (0, 29) in got and (0, 20) not in got
    assert tracks.revisit_pairs(views(24)).count() == 276


def test_two_core_drops_the_tail(spark):
    obs = spark.createDataFrame([(1, 1, r) for r in (0, 15, 30)] + [(1, 2, 30), (1, 2, 1755)], "capture_id long, point_id long, rank long")
    assert {r["rank"] for r in tracks.two_core_views(obs).collect()} == {0, 15, 30}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(1, i, i + 1) for i in range(40) if i != 20], "k long, a long, b long")
    v = spark.createDataFrame([(1, i) for i in range(43)], "k long, v long")
    got = {r["v"]: r["component"] for r in graph.connected_components(v, e, ["k"], "v", "a", "b").collect()}
    assert {v for v, c in got.items() if c == 0} == set(range(21)) and got[40] == 21 and got[42] == 42


def test_components_of_a_graph_without_keys(spark):
    v = spark.createDataFrame([(i,) for i in range(8)], "v long")
    e = spark.createDataFrame([(5, 3), (3, 4), (4, 1), (6, 7), (2, 2), (None, 2), (7, None), (6, 7)], "a long, b long")
    got = {r["v"]: r["component"] for r in graph.connected_components(v, e, [], "v", "a", "b").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    none = graph.connected_components(v, e.limit(0), [], "v", "a", "b").collect()
    assert {r["v"]: r["component"] for r in none} == {i: i for i in range(8)}


def test_track_reasons(spark):
    def case(pid, z, centres, ranks=None, move=0.0):
        ranks = ranks or range(len(centres))
        return [(1, pid, r, 100 * (0 - x) / z + 50 + (move if i == 0 else 0), 50.0) for i, (r, x) in enumerate(zip(ranks, centres))]
    apart = [0.0, 0.2, 0.4]
    obs = case(1, 4.0, apart) + case(2, 4.0, apart, move=20.0) + case(3, -4.0, apart) + case(4, 4.0, [0.0, 0.2, 0.2], [0, 1, 1]) + case(5, 4.0, [0.0, 0.0, 0.0], [10, 11, 12])
    o = spark.createDataFrame(obs, "capture_id long, point_id long, rank long, px double, py double")
    pts = spark.createDataFrame([(1, i, 0.0, 0.0, -4.0 if i == 3 else 4.0) for i in range(1, 6)], "capture_id long, point_id long, x double, y double, z double")
    cams = [(1, r, x) for r, x in list(enumerate(apart)) + [(10, 0.0), (11, 0.0), (12, 0.0)]]
    c = spark.createDataFrame(cams, "capture_id long, rank long, ox double").select(
        "*", F.lit(100.0).alias("fx"), F.lit(100.0).alias("fy"), F.lit(50.0).alias("cx"), F.lit(50.0).alias("cy"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("oz"),
        (-F.col("ox")).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"), *[F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    got = {r["point_id"]: r["reasons"] for r in tracks.track_metrics(tracks.observation_geometry(pts, o, c)).collect()}
    assert got[1] == [] and got[2] == ["REPROJECTION"] and got[3] == ["NONPOSITIVE_DEPTH"]
    assert got[4] == ["DUPLICATE_IMAGE_IN_TRACK"] and got[5] == ["LOW_PARALLAX"]


def test_ratio_matches_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 8)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 6)), rng.normal(size=(25, 6))
    data = [(1, 0, i, [float(x) for x in v]) for i, v in enumerate(a)] + [(1, 1, 100 + i, [float(x) for x in v]) for i, v in enumerate(b)]
    d = spark.createDataFrame(data, "capture_id long, image long, feature_id long, embedding array<float>")
    got = {(r["query_id"], r["target_id"]) for r in matching.ratio_matches(d, matching.adjacent_images(d), 0.9).collect()}
    dist = np.linalg.norm(a.astype("f4").astype(float)[:, None] - b.astype("f4").astype(float)[None], axis=2)
    best = {}
    for q in range(30):
        t1, t2 = np.argsort(dist[q])[:2]
        if dist[q, t1] < 0.9 * dist[q, t2] and dist[q, t1] < best.get(t1, (9e9,))[0]:
            best[t1] = (dist[q, t1], q)
    assert got == {(q, 100 + t) for t, (_, q) in best.items()}


def test_voxel_average(spark):
    p = spark.createDataFrame([(1, x, 0.0, 0.0, c, c, c) for x, c in ((0.001, 0), (0.003, 100), (0.2, 255))], "capture_id long, x double, y double, z double, r long, g long, b long")
    got = sorted((round(r["x"], 9), r["r"]) for r in surfaces.voxel_average(p, 0.01).collect())
    assert got == [(0.002, 50), (0.2, 255)]


def test_noisy_planes(spark):
    rng = np.random.default_rng(7)
    floor = np.c_[rng.uniform(-2, 2, 1600), rng.normal(-1, 0.005, 1600), rng.uniform(-2, 2, 1600)]
    wall = np.c_[rng.normal(2, 0.005, 1600), rng.uniform(-1, 2, 1600), rng.uniform(-2, 2, 1600)]
    noise = rng.uniform(-6, 6, (200, 3)) + [0, 10, 0]
    pts = [(1, i, *map(float, p)) for i, p in enumerate(np.vstack([floor, wall, noise]))]
    df = spark.createDataFrame(pts, "capture_id long, id long, x double, y double, z double")
    policy = SurfacePolicy(max_planes=4, iterations=96)
    one, two = (surfaces.plane_extraction(d, policy).orderBy("plane_index").collect() for d in (df, df.repartition(7)))
    assert one == two and len(one) == 2
    lab = surfaces.plane_labels(df, spark.createDataFrame(one), policy.distance_m)
    n = {r[0]: r[1] for r in lab.groupBy(F.when(F.col("id") < 3200, "plane").otherwise("noise"), ).agg(F.avg((F.col("plane_index") >= 0).cast("int"))).collect()}
    assert n["plane"] > 0.99 and n["noise"] < 0.1


def test_no_planes_means_no_label(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "capture_id long, x double, y double, z double")
    empty = spark.createDataFrame([], "capture_id long, plane_index long, a double, b double, c double, d double")
    r = surfaces.plane_labels(p, empty, 0.035).first()
    assert r["plane_index"] == -1 and math.isinf(r["residual"])


def test_even_sample_positions(sliced):
    f = sliced.createDataFrame([(1, i) for i in range(23)], "capture_id long, rank long")
    got = sorted(r["rank"] for r in surfaces.even_sample(f, ["rank"], 8).collect())
    assert got == [(i * 22) // 7 for i in range(8)]


def test_wall_gap_is_not_bridged(spark):
    zs = [i / 40 for i in range(41)] + [2 + i / 40 for i in range(41)]
    pts = [(1, 1, r, 2.0, h, z, h) for r in range(3) for z in zs for h in (0.7, 1.2, 2.0)]
    p = spark.createDataFrame(pts, "capture_id long, plane_index long, rank long, x double, y double, z double, h double")
    st = spark.createDataFrame([(1, r, 0.3 * r, 0.0, 0.0) for r in range(3)], "capture_id long, rank long, ox double, oy double, oz double")
    planes = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, -2.0)], "capture_id long, plane_index long, a double, b double, c double, d double")
    floor = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 0.0)], "capture_id long, a double, b double, c double, d double")
    frame = bd.floor_frames(floor, spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "capture_id long, x double, y double, z double"))
    s = bd.wall_spans(p, planes, st, frame, BoundaryPolicy(min_points_per_view=3)).collect()
    assert len(s) == 2 and all(r["end_m"] - r["start_m"] < 1.2 and r["views"] == 3 for r in s)
    parallel = spark.createDataFrame([(1, 2, 0.0, 1.0, 0.0, -2.0)], "capture_id long, plane_index long, a double, b double, c double, d double")
    assert bd.wall_lines(parallel, frame).first()["dx"] is None


def test_repeated_cameras_are_weak(spark):
    p = spark.createDataFrame([(1, r) for r in range(3) for _ in range(9)], "capture_id long, rank long")
    st = spark.createDataFrame([(1, r, 0.0, 0.0, 0.0) for r in range(3)], "capture_id long, rank long, ox double, oy double, oz double")
    r = bd.supported_views(p, st, ["capture_id"], 3).first()
    assert r["views"] == 3 and r["baseline_m"] == 0.0 and r["supported"] is False


def test_region_precedence_in_any_order(spark):
    s = spark.createDataFrame([(1, 0, 0, i, x, 5) for i, x in enumerate((2, 12, 30, 40))], "capture_id long, rank long, plane_index long, sample_id long, x long, y long")
    box = lambda a, b: [(float(a), 0.0), (float(b), 0.0), (float(b), 10.0), (float(a), 10.0)]
    kinds = [("FLOOR", box(0, 20)), ("FURNITURE", box(10, 20))]
    for order in (kinds, kinds[::-1]):
        r = spark.createDataFrame([(1, 0, 0, i, role, poly) for i, (role, poly) in enumerate(order)],
                                  "capture_id long, rank long, plane_index long, region_index long, role string, polygon array<struct<x:double,y:double>>")
        got = {x["sample_id"]: x["role"] for x in bd.region_roles(s, r).collect()}
        assert got == {0: "FLOOR", 1: "FURNITURE", 2: "UNREVIEWED", 3: "UNREVIEWED"}


def test_persistent_cells_keep_the_tall_wall(spark):
    wall = [(1, 0.05 + 0.1 * i, 0.05, 0.65 + 0.05 * k) for i in range(10) for k in range(33)] + [(1, 0.05 + 0.1 * i, 0.15, 0.65 + 0.05 * k) for i in range(10) for k in range(33)]
    bed = [(1, 3.05 + 0.1 * i, 0.05, 0.65 + 0.01 * k) for i in range(10) for k in range(20)] + [(1, 3.05, 0.05, 2.2)]
    p = spark.createDataFrame(wall + bed, "capture_id long, u double, v double, h double")
    cells = room.persistent_cells(p, PlanPolicy()).collect()
    assert len(cells) == 20 and max(c["cx"] for c in cells) == 9


def test_ceiling_and_missing_support(spark):
    rng = np.random.default_rng(7)
    n = 6000
    pts = [(1, *map(float, p)) for p in np.c_[rng.uniform(0, 3, n), rng.uniform(0, 3, n), rng.normal(2.7, 0.008, n)]] + [(1, 1.0, 1.0, 3.9), (2, 1.0, 1.0, 2.5), (2, 1.1, 1.0, 2.5)]
    p = spark.createDataFrame(pts, "capture_id long, u double, v double, h double")
    rooms = spark.createDataFrame([(c, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 3.0, 3.0) for c in (1, 2)],
                                  "capture_id long, ax double, ay double, bx double, by double, lo0 double, lo1 double, hi0 double, hi1 double")
    got = {r["capture_id"]: r for r in room.ceiling_height(p, rooms).collect()}
    assert abs(got[1]["height_m"] - 2.7) < 0.03
    assert got[2]["status"] == "INSUFFICIENT_UPPER_COVERAGE" and got[2]["height_m"] is None


def test_zbuffer(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 0.0, 0.0, 2.0), (1, 2, 0.0, 0.0, -1.0)], "capture_id long, point_id long, x double, y double, z double")
    cam = spark.createDataFrame([(1, 5, 100.0, 100.0, 50.0, 50.0, 100, 100)], "capture_id long, rank long, fx double, fy double, cx double, cy double, width long, height long").select(
        "*", *[F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.lit(0.0).alias(f"t{a}") for a in "xyz"])
    assert [r["point_id"] for r in room.zbuffer_visible(p, cam).collect()] == [0]


def test_interval_reversal(spark):
    lit = F.lit
    r = spark.range(1).select(bottom_offset_interval(lit(0.02), lit(1.0), lit(0.0), lit(0.01), lit(True), lit(False)).alias("i")).first()["i"]
    assert (round(r["lower_m"], 9), round(r["upper_m"], 9), r["lower_inclusive"], r["upper_inclusive"]) == (0.01, 0.02, False, True)


def test_smallest_axis(spark):
    pts = np.array([[0, 0, 0], [1, 0, 0.1], [1.2, 1, 0], [0, 1, 0.05]])
    m = np.cov(pts.T)
    df = spark.createDataFrame([tuple(float(x) for x in m.ravel())], ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))
    r = G.with_smallest_axis(df, [[f"m{i}{j}" for j in range(3)] for i in range(3)], ["a", "b", "c"]).first()
    v = np.linalg.eigh(m)[1][:, 0]
    assert np.isclose(abs(np.dot(v, [r["a"], r["b"], r["c"]])), 1.0)


def test_tampered_value_and_lineage(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5)], "k long, n long, x double")
    b = spark.createDataFrame([(1, 2, 0.5 + 1e-12), (2, 4, 0.5)], "k long, n long, x double")
    assert [tuple(r) for r in integrity.audit_diff(a, b, ["k"], ["n"], ["x"]).collect()] == [(2, "CHANGED:n")]
    chain = spark.createDataFrame([("c", "ingest", "h1", None, None), ("c", "prepare", "h2", "ingest", "h1"), ("c", "sparse", "h3", "prepare", "old")],
                                  "capture_id string, stage string, manifest_hash string, parent_stage string, parent_hash string")
    assert [r["stage"] for r in integrity.lineage_breaks(chain).collect()] == ["sparse"]


def test_enforce_raises_with_code(spark):
    with pytest.raises(integrity.ContractViolation) as e:
        integrity.enforce(spark.createDataFrame([("p", "UNSAFE_BUNDLE_PATH")], "path string, code string"))
    assert e.value.code == "UNSAFE_BUNDLE_PATH"


def test_tree_audit_equals_the_full_comparison(spark):
    from capstrata.operators import integrity
    from capstrata.session import stage

    base = spark.range(5000).select((F.col("id") % 5).alias("capture_id"), F.col("id").alias("k"), (F.col("id") % 7).alias("n"), (F.col("id") / 3).alias("x"))
    derived = base.unionByName(base.where("k = 1"))  # a repeated row
    stored = derived.where("k not in (17, 4001)").withColumn("n", F.when(F.col("k") == 33, 99).otherwise(F.col("n"))).withColumn(
        "x", F.when(F.col("k") == 54, F.col("x") + 1e-3).when(F.col("k") == 59, F.col("x") * (1 + 1e-14)).when(F.col("k") == 60, None).otherwise(F.col("x")))
    stored = stored.unionByName(spark.createDataFrame([(9, 9000, 1, 1.0)], "capture_id long, k long, n long, x double"))
    args = ("capture_id", ["capture_id", "k"], ["n"], ["x"])
    got = sorted(tuple(r) for r in integrity.tree_audit(stage(stored), stage(derived), *args, buckets=64).collect())
    assert got == sorted(tuple(r) for r in integrity.audit_diff(stored.dropDuplicates(), derived.dropDuplicates(), *args[1:]).collect())
    assert {d for _, _, d in got} == {"DERIVED_ONLY", "STORED_ONLY", "CHANGED:n", "CHANGED:x"} and (4, 59, "CHANGED:x") not in got
    assert integrity.tree_audit(stage(derived), stage(derived.repartition(3)), *args).collect() == []
