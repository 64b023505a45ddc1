"""Steps that must not grow faster than their input."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from capstrata.operators import boundaries, graph, grounding, integrity, matching, room, surfaces, timeseries, tracks
from capstrata.operators.ordered import sequence_over
from capstrata.policies import GroundingPolicy, TrackPolicy


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exploded(spark, folder):
    """One row per capture in a file far below the broadcast limit; what it explodes to looks as small to Spark."""
    spark.range(50).withColumnRenamed("id", "capture_id").write.parquet(folder)
    one = spark.read.parquet(folder)
    return one.select("capture_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("rank"))


def square():
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 1), (50, 1), (50, 50), (1, 50))])


def test_views_and_planes_are_not_broadcast(spark, tmp_path):
    views = exploded(spark, str(tmp_path / "views")).select(
        "capture_id", "rank", F.lit("v").alias("image"), F.lit(100).alias("width"), F.lit(90).alias("height"), F.lit("h").alias("sha256"),
        F.lit(1).alias("frame_id"), F.lit(1.0).alias("relative_sec"))
    planes = exploded(spark, str(tmp_path / "planes")).select("capture_id", F.col("rank").alias("plane_index"), F.lit("vertical").alias("orientation"))
    regions = views.select("*", F.lit(3).cast("bigint").alias("plane_index"), F.col("rank").alias("region_index"), F.lit("WALL").alias("role"), square().alias("polygon"))
    found = boundaries.region_violations(regions, views, planes)
    assert "Broadcast" not in plan_of(found) and found.count() == 0
    marked = views.select("*", F.lit(1).alias("object_id"), F.col("rank").alias("position"), square().alias("polygon"))
    found = grounding.corner_violations(marked, views)
    assert "Broadcast" not in plan_of(found) and found.count() == 0


def test_sequences_do_not_broadcast_their_keys(spark):
    df = spark.range(300).select((F.col("id") % 60).alias("k"), F.col("id").alias("v"))
    seq = sequence_over(df, ["k"], ["v"], rank="pos", lag={"before": "v"})
    assert "Broadcast" not in plan_of(seq)
    assert {(r["k"], r["pos"], r["before"]) for r in seq.collect()} == {(k, p, k + 60 * (p - 1) if p else None) for k in range(60) for p in range(5)}


def test_codes_travel_once_per_block_not_once_per_flip(spark, monkeypatch):
    rows = [(1, image, 1000 * image + i, [i * 2654435761 % 2**32, i * 2246822519 % 2**32]) for image in (1, 2) for i in range(300)]
    d = spark.createDataFrame(rows, "capture_id long, image long, feature_id long, code array<bigint>")
    found = matching.hamming_pairs(d, matching.adjacent_images(d), 2, 7)
    assert "explode" not in plan_of(found).lower()
    whole = sorted(map(tuple, found.collect()))
    assert {(1, 1, 2, 1000 + i, 2000 + i, 1, 0) for i in range(300)} <= set(whole)
    monkeypatch.setattr(matching, "CODES", 16)  # many blocks meet
    assert sorted(map(tuple, matching.hamming_pairs(d, matching.adjacent_images(d), 2, 7).collect())) == whole


def test_votes_leave_a_task_as_counts(spark):
    rows = [(i % 2, float(i % 7), 1.0 if i % 3 else float(i % 5), float(i % 11)) for i in range(400)] + [(None, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "capture_id long, x double, y double, z double").repartition(3)
    trials = spark.createDataFrame([(0, [(0, 0.0, 1.0, 0.0, -1.0), (1, 1.0, 0.0, 0.0, -50.0)]), (1, [(0, 0.0, 1.0, 0.0, -1.0)])],
                                   "capture_id long, _hyps array<struct<_t:long,a:double,b:double,c:double,d:double>>")
    votes = surfaces._votes(points, trials, 0.5)
    got = {(r["capture_id"], r["_t"]): r["n"] for r in votes.groupBy("capture_id", "_h._t").agg(F.sum("_n").alias("n")).collect()}
    want = lambda k: sum(c == k and x is not None and abs(y - 1) <= 0.5 for c, x, y, _ in rows)
    assert got == {(0, 0): want(0), (1, 0): want(1)} and votes.count() <= 3 * 4


def test_rays_of_a_corner_are_shuffled_once(spark):
    rows = [(1, 1, r, 0, 0.0, 0.0, float(r), 0.0, 0.0, x / (x * x + 1) ** 0.5, 0.0, 1 / (x * x + 1) ** 0.5) for r in range(5) for x in [(1 - r) / 3]] * 2
    rays = spark.createDataFrame(rows, "capture_id long, object_id long, rank long, corner long, px double, py double, ox double, oy double, oz double, rx double, ry double, rz double")
    solved = grounding.triangulate(rays)
    assert "Join" not in plan_of(solved) and plan_of(solved).count("Exchange") == 1
    row = solved.first()
    assert row["views"] == 5 and abs(row["max_ray_angle_degrees"] - 63.4349488) < 1e-6 and abs(row["x"] - 1) < 1e-9 and abs(row["z"] - 3) < 1e-9


def test_held_out_views_stage_nothing_and_never_pair_rays(spark, monkeypatch):
    monkeypatch.setattr(grounding, "stage", lambda df: 1 / 0)
    corners = spark.range(4).crossJoin(spark.range(4).withColumnRenamed("id", "rank")).select(
        F.lit(1).alias("capture_id"), F.lit(1).alias("object_id"), "rank", F.col("id").alias("corner"), (F.col("id") * 10.0 + F.col("rank") * 60).alias("px"), (F.col("id") * 7.0).alias("py"))
    cams = spark.range(4).select(
        F.lit(1).alias("capture_id"), F.col("id").alias("rank"), F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"),
        *[F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)], (F.col("id") * -0.3).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"),
        (F.col("id") * 0.3).alias("ox"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("oz"))
    held = grounding.leave_one_out(corners, cams)
    assert held.count() == 4


def test_roles_are_met_without_a_join(spark):
    rows = lambda *r: spark.createDataFrame([(x,) for x in r], "role string")
    met = integrity.admitted_roles(rows("a", "a", "b", None), rows("a", None, "c", "c"))
    assert "Join" not in plan_of(met) and sorted(r["role"] or "" for r in met.collect()) == ["", "a"]


def test_captures_met_in_one_chunk_are_finished_without_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(c, a, b) for c in range(40) for a, b in ((5, 4), (4, 9), (2, 9), (20, 21), (21, 20), (7, 7))] + [(None, 1, 2), (1, None, 2)],
                                  "capture_id long, a long, b long").repartition(5)
    views = spark.createDataFrame([(c, v) for c in range(40) for v in (2, 4, 5, 7, 9, 20, 21, 30)], "capture_id long, rank long")
    want = {(c, v, w) for c in range(40) for v, w in ((2, 2), (4, 2), (5, 2), (9, 2), (7, 7), (20, 20), (21, 20), (30, 30))}
    rounds, real = [], graph._star_rounds
    monkeypatch.setattr(graph, "_star_rounds", lambda e, keys: rounds.append(e.count()) or real(e, keys))
    find = lambda: {tuple(r) for r in graph.connected_components(views, edges, ["capture_id"], "rank", "a", "b").collect()}
    assert find() == want and rounds == [0]


def test_captures_cut_by_chunks_go_on_to_the_rounds(spark):
    chain = spark.range(5000).select((F.col("id") % 2).alias("capture_id"), F.col("id").alias("a"), (F.col("id") + 2).alias("b"))
    views = chain.select("capture_id", F.col("a").alias("rank"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    real = graph.contracted.__globals__["CHUNK"]
    try:
        graph.CHUNK = 300
        found = graph.connected_components(views, chain, ["capture_id"], "rank", "a", "b").where("component = capture_id").count()
    finally:
        graph.CHUNK = real
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == 5000


def test_core_of_long_tracks_needs_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(tracks, "covisible_pairs", lambda obs: 1 / 0)
    seen = {1: (1, 2, 3, 3), 2: (3, 4), 3: (4, 5), 4: (5, 1), 5: (6, 7), 6: (2, 8), 7: (9,), 8: (10, 11), 9: (11, 12), 10: (12, 10)}
    obs = spark.createDataFrame([(1, p, r) for p, views in seen.items() for r in views] + [(2, p, r) for p, r in ((1, 1), (1, 2), (2, 2), (2, 3))] + [(None, 1, 1), (1, 1, None)],
                                "capture_id long, point_id long, rank long")
    core = {tuple(r) for r in tracks.two_core_views(obs).collect()}
    assert core == {(1, r) for r in (1, 2, 3, 4, 5, 10, 11, 12)}


def test_poses_travel_without_their_histogram(spark):
    from capstrata.plans import q_timeseries
    from capstrata.plans.views import Views
    v = Views(spark, "/none")
    v.poses = spark.createDataFrame([(1, r, Decimal(r), Decimal(r), "normal", r, r, float(r), 0.0, 0.0, [0.5] * 4) for r in range(3)],
                                    "capture_id long, rank long, relative_sec decimal(20,6), sensor_sec decimal(20,6), tracking_state string, k long, event_id long, "
                                    "px double, py double, pz double, histogram array<double>")
    c = q_timeseries.candidates(v)
    assert not {"histogram", "px"} & set(c.columns) and "px" in q_timeseries.candidates(v, "px").columns and c.count() == 2
    seen = []
    real = timeseries.sequence_over
    try:
        timeseries.sequence_over = lambda df, *a, **k: seen.extend(df.columns) or real(df, *a, **k)
        assert timeseries.pose_speed_events(v.poses, 0.5).count() == 2
    finally:
        timeseries.sequence_over = real
    assert "histogram" not in seen


def test_revisits_meet_in_few_copies(spark):
    policy = TrackPolicy(exhaustive_views=4, temporal_window=2, revisit_distance_m=0.5, revisit_degrees=60.0, revisit_seconds=3.0, revisit_neighbors=3)
    rng = np.random.default_rng(4)
    eye = np.eye(3).ravel().tolist()
    rows = [(c, r, Decimal(r), *rng.uniform(-2, 2, 3).tolist(), *eye) for c, n in ((1, 60), (2, 4), (3, 5)) for r in range(n)]
    rows += [(4, r, Decimal(r), r * 0.5 * (r in (0, 9)) / 9 * 0.999 - 1.0, 50.0 * (r not in (0, 9)) * r, 0.5, *eye) for r in range(10)]
    df = spark.createDataFrame(rows, "capture_id long, rank long, relative_sec decimal(20,6), px double, py double, pz double, " + ", ".join(f"w{i}{j} double" for i in range(3) for j in range(3)))
    want = set()
    for c in (1, 2, 3, 4):
        mine = [r for r in rows if r[0] == c]
        reach = 4 if len(mine) <= 4 else 2
        want |= {(c, a[1], b[1]) for a in mine for b in mine if 0 < b[1] - a[1] <= reach}
        if len(mine) > 4:
            for a in mine:
                near = sorted((float(np.linalg.norm(np.subtract(a[3:6], b[3:6]))), b[1]) for b in mine if b[1] > a[1] + 2 and b[1] - a[1] >= 3)
                want |= {(c, a[1], b) for d, b in [x for x in near if x[0] < 0.5][:3]}
    found = tracks.revisit_pairs(df, policy)
    assert {tuple(r) for r in found.collect()} == want and (4, 0, 9) in want and "_y" not in plan_of(found)


def test_audit_derives_each_table_once(spark, monkeypatch):
    from capstrata.plans import q_clouds
    calls = []
    cells = spark.createDataFrame([(0, i, 1, 1, 2, 0.5) for i in range(40)], "capture_id long, vx long, vy long, vz long, n long, x double")
    monkeypatch.setattr(q_clouds, "RECOMPUTED", [("voxel", ["vx", "vy", "vz"], "vz", 31, "n", "x", lambda v: calls.append(v) or cells)])
    assert q_clouds.recompute_audit(None).where("difference = 'DERIVED_ONLY'").count() > 0 and len(calls) == 1


CAMERA = "capture_id long, rank long, fx double, fy double, cx double, cy double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double, ox double, oy double, oz double"


def marked_objects(spark):
    """Objects with repeated, missing and lone marks; a camera comes twice, and one lacks its position."""
    eye = [1.0 if i == j else 0.0 for i in range(3) for j in range(3)]
    cams = [(c, r, 500.0, 500.0, 320.0, 240.0, *eye, -0.3 * r, -0.1 * (r % 2), 0.0, 0.3 * r, 0.1 * (r % 2), 0.0) for c in (1, 2) for r in range(5)]
    cams += [(1, 1, 510.0, 500.0, 321.0, 240.0, *eye, -0.31, -0.1, 0.0, 0.31, 0.1, 0.0), (1, 6, 500.0, 500.0, 320.0, 240.0, *eye, -0.1, 0.0, 0.0, None, 0.0, 0.0), (None, 0, *cams[0][2:])]
    at = ((0.0, 0.0), (0.3, 0.0), (0.3, 0.2), (0.0, 0.2))
    mark = lambda c, o, r, i, off=0.0: (c, o, r, i, 500 * (at[i][0] - 0.3 * r) / 3 + 320 + off * (r * 3 + i) % 2, 500 * (at[i][1] - 0.1 * (r % 2)) / 3 + 240)
    rows = [mark(c, o, r, i, 0.25 * o) for c, o, n in ((1, 1, 5), (1, 2, 3), (2, 3, 2), (2, 4, 5), (2, 5, 5)) for r in range(n) for i in range(4)]
    rows += [mark(1, 2, 2, 1, 0.5), (2, 4, 3, 0, None, 1.0), (2, 5, 1, None, 300.0, 250.0), (1, 1, 6, 2, 330.0, 250.0), (1, 7, 9, 0, 1.0, 1.0)]
    rows += [mark(2, None, r, i) for r in range(4) for i in range(4)] + [mark(None, 8, 0, 0)]
    return spark.createDataFrame(rows, "capture_id long, object_id long, rank long, corner long, px double, py double"), spark.createDataFrame(cams, CAMERA)


def shuffled_by(df):
    return [line for line in plan_of(df).splitlines() if "Exchange " in line]


def rounded(df, *columns):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*columns).na.fill(-1.0).na.fill(-1).collect())


def test_trials_never_reach_a_shuffle(spark):
    corners, cams = marked_objects(spark)
    policy = GroundingPolicy(sensitivity_trials=8, max_reprojection_pixels=30.0)
    sizes = corners.select("capture_id", "object_id").distinct().select("*", F.lit(0.3).alias("width_m"), F.lit(0.2).alias("height_m"))
    found = grounding.sensitivity_range(corners, cams, sizes, policy)
    assert shuffled_by(found) and not [x for x in shuffled_by(found) if "trial" in x]
    # the same trials as rows of their own
    t = corners.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(8))))
    noise = lambda a: (F.pmod(F.xxhash64(F.lit(policy.seed), F.lit(a), "trial", "capture_id", "object_id", "rank", "corner"), F.lit(2_000_001)).cast("double") / 1_000_000 - 1) * policy.sensitivity_pixels
    rays = grounding.corner_rays(t.withColumns({"px": F.col("px") + noise("x"), "py": F.col("py") + noise("y")}), cams, ["trial"])
    solved = grounding.triangulate(rays, ["trial"], policy)
    states = grounding.object_state(solved, grounding.corner_errors(rays, solved, cams, ["trial"]), ["trial"], policy).where("state = 'TRIANGULATED'")
    rect = grounding.object_rectangles(solved, sizes, ["trial"]).join(states.select("capture_id", "object_id", "trial"), ["capture_id", "object_id", "trial"], "left_semi")
    w, h = (F.col("width_edge_0_m") + F.col("width_edge_1_m")) / 2, (F.col("height_edge_0_m") + F.col("height_edge_1_m")) / 2
    want = rect.groupBy("capture_id", "object_id").agg(F.count("*").alias("usable_trials"), F.min(w).alias("width_min_m"), F.max(w).alias("width_max_m"), F.min(h).alias("height_min_m"), F.max(h).alias("height_max_m"))
    columns = ["capture_id", "object_id", "usable_trials", "width_min_m", "width_max_m", "height_min_m", "height_max_m"]
    assert rounded(found.where("usable_trials > 0"), *columns) == rounded(want, *columns) and want.count() >= 2
    assert found.count() == corners.select("capture_id", "object_id").distinct().count()


def test_shifted_cameras_never_reach_a_shuffle(spark):
    corners, cams = marked_objects(spark)
    policy = GroundingPolicy(max_reprojection_pixels=2.5)
    found = grounding.pixel_shift_check(corners, cams, policy)
    assert shuffled_by(found) and not [x for x in shuffled_by(found) if "shift" in x]
    columns = ["object_id", "views", "min_corner_angle_degrees", "condition", "reprojection_max_px", "min_depth", "state"]
    for shift in (-0.5, 0.5):
        c = cams.withColumns({"cx": F.col("cx") + shift, "cy": F.col("cy") + shift})
        rays = grounding.corner_rays(corners, c)
        solved = grounding.triangulate(rays, policy=policy)
        want = rounded(grounding.object_state(solved, grounding.corner_errors(rays, solved, c), policy=policy), "capture_id", *columns)
        assert rounded(found.where(F.col("shift") == shift), "capture_id", *columns) == want and len({r[-1] for r in want}) >= 3


def test_tracks_are_gathered_in_one_shuffle(spark):
    rng = np.random.default_rng(6)
    rows = [(c, p, r, float(rng.uniform(1, 4)), float(rng.uniform(0, 5)), *rng.normal(size=3).tolist()) for c, p, n in ((1, 1, 2), (1, 2, 4), (2, 1, 40), (2, 3, 1)) for r in range(n)]
    rows += [(1, 2, 3, 2.0, None, 0.0, 0.0, 1.0), (None, 1, 1, 1.0, 1.0, 0.0, 0.0, 1.0), (1, None, 1, 1.0, 1.0, 0.0, 0.0, 1.0)]
    geometry = spark.createDataFrame(rows, "capture_id long, point_id long, rank long, depth double, residual double, dx double, dy double, dz double")
    metrics = tracks.track_metrics(geometry)
    assert len(shuffled_by(metrics)) == 1 and "Join" not in plan_of(metrics)
    assert len(shuffled_by(tracks.track_metrics(geometry.repartition("capture_id", "point_id")))) == 1
    got = {(r["capture_id"], r["point_id"]): r for r in metrics.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 3)}
    for key, m in got.items():
        mine = [r for r in rows if r[:2] == key]
        chord = max(float(np.linalg.norm(np.subtract(a[5:], b[5:]))) for a in mine for b in mine)
        assert m["observations"] == len(mine) and abs(m["max_angle_degrees"] - np.degrees(2 * np.arcsin(min(chord / 2, 1.0)))) < 1e-9
        assert ("DUPLICATE_IMAGE_IN_TRACK" in m["reasons"]) == (len({r[2] for r in mine}) < len(mine))
        assert ("REPROJECTION" in m["reasons"]) == any(r[4] is None or r[4] > 4 for r in mine) and ("SHORT_TRACK" in m["reasons"]) == (len(mine) < 3)


def exchanged(df, column):
    """Rows written by the shuffles that deal by a column, after the query ran."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        mine = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" and f"{column}#" in node.outputPartitioning().toString() else 0
        return mine + sum(walk(x) for x in below)

    return walk(df._jdf.queryExecution().executedPlan())


def test_hidden_points_stay_with_their_tile(spark):
    rng = np.random.default_rng(8)
    cams = [(c, r, 50.0, 50.0, 20.0, 15.0, 40, 30, *[float(i == j) for i in range(3) for j in range(3)], -0.1 * r, 0.0, 0.0) for c in (1, 2) for r in (0, 1)] + [(1, None, *[1.0] * 4, 4, 3, *[0.0] * 12)]
    cameras = spark.createDataFrame(cams, "capture_id long, rank long, fx double, fy double, cx double, cy double, width long, height long, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double")
    wall = [(1, i, float(x), float(y), 1.0 + 0.05 * float(z)) for i, (x, y, z) in enumerate(rng.uniform((-0.5, -0.4, 0), (0.6, 0.4, 1), (1500, 3)))]
    behind = [(1, 2000 + i, *map(float, p)) for i, p in enumerate(rng.uniform((-0.4, -0.4, 3.0), (0.4, 0.4, 3.4), (6000, 3)))]
    open_ = [(2, 9000 + i, *map(float, p)) for i, p in enumerate(rng.uniform((-0.4, -0.4, 1.0), (0.4, 0.4, 3.0), (300, 3)))]
    pts = wall + behind + open_ + open_[:3] + [(2, 1, None, 0.0, 1.0), (None, 2, 0.0, 0.0, 1.0), (2, 3, float("nan"), 0.0, 1.0)]
    points = spark.createDataFrame(pts, "capture_id long, point_id long, x double, y double, z double")
    for pixel_bin, tile_m in ((3, 0.25), (1, 2.0)):
        want, framed = [], 0
        for c, r, *_ in cams[:4]:
            bins = {}
            for cap, pid, x, y, z in pts[:-3]:
                u, v = 50 * (x - 0.1 * r) / z + 20, 50 * y / z + 15
                if cap == c and 0 <= u < 40 and 0 <= v < 30:
                    framed += 1
                    bins.setdefault((u // pixel_bin, v // pixel_bin), []).append((z, pid))
            want += [(c, pid, r) for near in bins.values() for d, pid in near if d <= min(near)[0] + 0.12]
        found = room.zbuffer_visible(points, cameras, pixel_bin, 0.12, tile_m)
        got = sorted((x["capture_id"], x["point_id"], x["rank"]) for x in found.collect())
        assert got == sorted(want) and found.columns == [*points.columns, "rank", "px", "py", "depth"]
        if tile_m < 1:
            assert len(want) < framed / 2 and exchanged(found, "_bx") < 0.6 * framed
