"""Reference objects: corner triangulation, diagnostics and surface comparison.

``corners`` has (capture_id, object_id, rank, corner, px, py) with at most 12 views per
object by contract; ``cameras`` is keyed by (capture_id, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.functions.numeric import bottom_offset_interval, within_interval
from capstrata.operators.ordered import group_diameter, quantiles
from capstrata.operators.reviews import order_violations
from capstrata.policies import GroundingPolicy
from capstrata.session import stage

MAX_MARKED_VIEWS = 12
RAY = ["rx", "ry", "rz"]
CAMERA = ["fx", "fy", "cx", "cy", *[f"r{i}{j}" for i in range(3) for j in range(3)], *[f"{c}{a}" for c in "to" for a in "xyz"]]


def corner_rays(corners: DataFrame, cameras: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Unit world ray of every marked corner with its camera centre."""
    extra = extra or []
    j = corners.join(cameras, ["capture_id", "rank"])
    d = G.pixel_ray(F.col("px"), F.col("py"))
    return j.select("capture_id", "object_id", *extra, "rank", "corner", "px", "py", "ox", "oy", "oz",
                    *[c.alias(n) for c, n in zip(d, ("rx", "ry", "rz"))])


def _ray_terms(ray: Column | None = None) -> dict[str, Column]:
    """What one ray, of columns or of a struct, adds to the nine sums of its corner's 3x3 system."""
    d, o = ([F.col(c) if ray is None else ray[c] for c in names] for names in (RAY, ["ox", "oy", "oz"]))
    terms = {}
    for i in range(3):
        for j in range(i, 3):
            terms[f"m{i}{j}"] = (1.0 if i == j else 0.0) - d[i] * d[j]
        terms[f"b{i}"] = o[i] - d[i] * G.dot(d, o)
    return terms


def _solved_corners(sums: DataFrame, keys: list[str], cosine: Column, policy: GroundingPolicy) -> DataFrame:
    """Point, condition, angle and status of each corner from its sums and the cosine of its widest rays."""
    angle = F.coalesce(F.degrees(F.acos(G.clamp(cosine, -1.0, 1.0))), F.lit(0.0))
    m = [[f"m{min(i, c)}{max(i, c)}" for c in range(3)] for i in range(3)]
    point = G.solve3([[F.col(c) for c in row] for row in m], G.vec("b0", "b1", "b2"))
    j = G.with_extremes(sums.withColumn("max_ray_angle_degrees", angle), m, "_low", "_high")
    low, high = F.col("_low"), F.col("_high")
    out = j.select(*keys, "views", "max_ray_angle_degrees", F.when(low > 0, high / low).alias("condition"), *[c.alias(n) for c, n in zip(point, "xyz")])
    bad = (F.col("max_ray_angle_degrees") < policy.min_angle_degrees) | F.col("condition").isNull() | (F.col("condition") > policy.max_condition)
    status = F.when(F.col("views") < policy.min_views, "INSUFFICIENT_OBSERVATIONS").when(bad, "INSUFFICIENT_PARALLAX").otherwise("SOLVED")
    return out.withColumn("corner_status", status)


def _widest_of(rays: str) -> Column:
    """The smallest cosine between two rays of different views, from the rays of one corner as an array."""
    def against(a):
        others = F.filter(rays, lambda b: a["rank"] < b["rank"])
        return F.array_min(F.transform(others, lambda b: F.struct(F.abs(G.dot([a[c] for c in RAY], [b[c] for c in RAY])).alias("cosine"))))

    return F.array_min(F.transform(rays, against))["cosine"]


def triangulate(rays: DataFrame, extra: list[str] | None = None, policy: GroundingPolicy = GroundingPolicy()) -> DataFrame:
    """Closest point to the rays of each corner, from nine sums and a closed 3x3 solve.

    One row per corner with its ray angle, system condition and status. The rays of a corner, at most 12 by contract,
    are gathered in the shuffle of the sums, and their pairs are compared in place.
    """
    k = ["capture_id", "object_id", *(extra or []), "corner"]
    sums = rays.groupBy(*k).agg(F.collect_list(F.struct("rank", *RAY)).alias("_rays"), *[F.sum(c).alias(n) for n, c in _ray_terms().items()])
    sums = sums.withColumns({"views": F.size(F.array_distinct(F.transform("_rays", lambda r: r["rank"]))).cast("bigint"), "_cosine": _widest_of("_rays")}).drop("_rays")
    return _solved_corners(sums, k, F.col("_cosine"), policy)


def gathered_views(corners: DataFrame, cameras: DataFrame) -> DataFrame:
    """The marked views of each corner with their cameras, at most 12 by contract, in one row, ``_views``.

    The rows are dealt by object, so that variants of an object (trials, moved cameras) are exploded and summed up in
    place: a shuffle gets every mark once, however many variants there are.
    """
    j = corners.select("capture_id", "object_id", "rank", "corner", "px", "py").join(cameras.select("capture_id", "rank", *CAMERA), ["capture_id", "rank"])
    return j.repartition("capture_id", "object_id").groupBy("capture_id", "object_id", "corner").agg(F.collect_list(F.struct("rank", "px", "py", *CAMERA)).alias("_views"))


def solved_in_place(gathered: DataFrame, extra: list[str], policy: GroundingPolicy) -> DataFrame:
    """``triangulate`` and ``corner_errors`` for gathered views: the corner with its worst error and least depth, if it is solved."""
    k = ["capture_id", "object_id", *extra, "corner"]
    ray = F.transform("_views", lambda w: F.struct(w["rank"].alias("rank"), *[w[f"o{a}"].alias(f"o{a}") for a in "xyz"],
                                                   *[c.alias(n) for c, n in zip(G.pixel_direction(w["px"], w["py"], of=w), RAY)]))
    ray = F.transform(ray, lambda r: F.struct(*[r[c].alias(c) for c in ("rank", "ox", "oy", "oz")], *[c.alias(n) for c, n in zip(G.unit([r[c] for c in RAY]), RAY)]))
    none = F.struct(*[F.lit(None).cast("double").alias(n) for n in _ray_terms()])
    add = lambda s, r: F.struct(*[F.coalesce(s[n] + c, s[n], c).alias(n) for n, c in _ray_terms(r).items()])  # noqa: E731  (as F.sum: without nulls)
    at = gathered.withColumn("_rays", ray).withColumns({
        "_sums": F.aggregate("_rays", none, add), "_cosine": _widest_of("_rays"),
        "views": F.size(F.array_distinct(F.transform("_rays", lambda r: r["rank"]))).cast("bigint")}).drop("_rays")
    at = at.withColumns({n: F.col(f"_sums.{n}") for n in _ray_terms()})
    out = _solved_corners(at, [*k, "_views"], F.col("_cosine"), policy)

    def fit(w):
        u, v, depth = G.project_pixel(G.vec("x", "y", "z"), of=w)
        return F.struct(F.sqrt((u - w["px"]) ** 2 + (v - w["py"]) ** 2).alias("error_px"), depth.alias("depth"))

    known = (F.col("corner_status") == "SOLVED") & F.col("object_id").isNotNull() & F.col("corner").isNotNull()
    out = out.withColumn("_fits", F.when(known, F.transform("_views", fit))).drop("_views")
    return out.withColumns({"error_px": F.array_max("_fits.error_px"), "depth": F.array_min("_fits.depth")}).drop("_fits")


def corner_errors(rays: DataFrame, solved: DataFrame, cameras: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Reprojection error and depth of each solved corner in each of its views."""
    k = ["capture_id", "object_id", *(extra or []), "corner"]
    j = rays.select(*k, "rank", F.col("px").alias("seen_x"), F.col("py").alias("seen_y")).join(
        solved.where("corner_status = 'SOLVED'").select(*k, "x", "y", "z"), k).join(cameras, ["capture_id", "rank"])
    u, v, depth = G.project_pixel(G.vec("x", "y", "z"))
    return j.select(*k, "rank", F.sqrt((u - F.col("seen_x")) ** 2 + (v - F.col("seen_y")) ** 2).alias("error_px"), depth.alias("depth"))


def _state_sums() -> list[Column]:
    """What the state of an object needs of its corners."""
    return [F.min("views").alias("views"), F.max(F.col("corner_status") == "INSUFFICIENT_OBSERVATIONS").alias("_few"),
            F.max(F.col("corner_status") == "INSUFFICIENT_PARALLAX").alias("_flat"), F.max("condition").alias("condition"),
            F.min("max_ray_angle_degrees").alias("min_corner_angle_degrees"), F.count("*").alias("_corners")]


def _error_sums() -> list[Column]:
    return [F.max("error_px").alias("reprojection_max_px"), F.min("depth").alias("min_depth")]


def _state(policy: GroundingPolicy) -> Column:
    good = (F.col("min_depth") > 0) & (F.col("reprojection_max_px") <= policy.max_reprojection_pixels)
    return (F.when(F.col("_few") | (F.col("_corners") < 4), "INSUFFICIENT_OBSERVATIONS").when(F.col("_flat"), "INSUFFICIENT_PARALLAX")
            .when(good, "TRIANGULATED").otherwise("DISAGREEMENT_REVIEW_REQUIRED"))


def object_state(solved: DataFrame, errors: DataFrame, extra: list[str] | None = None,
                 policy: GroundingPolicy = GroundingPolicy()) -> DataFrame:
    """State of each object from its four corners and their reprojection."""
    k = ["capture_id", "object_id", *(extra or [])]
    j = solved.groupBy(*k).agg(*_state_sums()).join(errors.groupBy(*k).agg(*_error_sums()), k, "left")
    return j.select(*k, "views", "min_corner_angle_degrees", "condition", "reprojection_max_px", "min_depth", _state(policy).alias("state"))


def _corner_points() -> list[Column]:
    """How many corners of an object are solved, and their points."""
    solved = F.col("corner_status") == "SOLVED"
    return [F.count_if(solved).alias("_n"), *[F.max(F.when(solved & (F.col("corner") == i), F.col(c))).alias(f"c{i}{c}") for i in range(4) for c in "xyz"]]


def object_rectangles(solved: DataFrame, references: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Edge lengths, errors and plane of each object whose four corners are solved."""
    k = ["capture_id", "object_id", *(extra or [])]
    return _rectangles(solved.where("corner_status = 'SOLVED'").groupBy(*k).agg(*_corner_points()), references, k)


def _rectangles(points: DataFrame, references: DataFrame, k: list[str]) -> DataFrame:
    j = points.where("_n = 4").join(references.select("capture_id", "object_id", "width_m", "height_m"), ["capture_id", "object_id"])
    pts = [[F.col(f"c{i}{c}") for c in "xyz"] for i in range(4)]
    m = G.rectangle_metrics(pts, F.col("width_m"), F.col("height_m"))
    centre = [(pts[0][a] + pts[1][a] + pts[2][a] + pts[3][a]) / 4 for a in range(3)]
    rel = [G.minus(p, centre) for p in pts]
    scatter = [[sum(r[a] * r[b] for r in rel) for b in range(3)] for a in range(3)]
    j = j.select("*", *[scatter[a][b].alias(f"_s{a}{b}") for a in range(3) for b in range(a, 3)])
    j = G.with_smallest_axis(j, [[f"_s{min(a, b)}{max(a, b)}" for b in range(3)] for a in range(3)], ["_nx", "_ny", "_nz"])
    n = G.vec("_nx", "_ny", "_nz")
    sign = F.when(n[1] < 0, -1.0).otherwise(1.0)
    n = [c * sign for c in n]
    off = -G.dot(n, centre)
    flat = F.greatest(*[F.abs(G.dot(p, n) + off) for p in pts])
    return j.select(*k, *[c.alias(name) for name, c in m.items()], *[c.alias(f"center_{a}") for c, a in zip(centre, "xyz")],
                    *[c.alias(f"normal_{a}") for c, a in zip(n, "xyz")], off.alias("plane_d"), flat.alias("coplanarity_max_m"))


def reference_state(states: DataFrame, rectangles: DataFrame, pose_views: DataFrame, policy: GroundingPolicy = GroundingPolicy()) -> DataFrame:
    """Consistency of each triangulated object with its declared size and per-view poses.

    ``pose_views`` has one row per marked view: usable, ambiguous, centre cx, cy, cz and
    normal nx, ny, nz of the best pose.
    """
    k = ["capture_id", "object_id"]
    errors = ["width_error_0", "width_error_1", "height_error_0", "height_error_1"]
    r = rectangles.select(*k, F.greatest(*[F.abs(F.col(c)) for c in errors]).alias("size_error"))
    usable = pose_views.where("usable")
    centre = group_diameter(usable, k, ["cx", "cy", "cz"], "center_spread_m")
    n2 = usable.select(*k, F.col("rank").alias("_r"), F.col("nx").alias("_x"), F.col("ny").alias("_y"), F.col("nz").alias("_z"))
    cosine = F.abs(F.col("nx") * F.col("_x") + F.col("ny") * F.col("_y") + F.col("nz") * F.col("_z"))
    turn = usable.join(n2, k).where("rank < _r").groupBy(*k).agg(
        F.degrees(F.acos(G.clamp(F.min(cosine), 0.0, 1.0))).alias("normal_spread_degrees"))
    v = pose_views.groupBy(*k).agg(F.count("*").alias("marked"), F.count_if("usable").alias("usable_views"), F.count_if("ambiguous").alias("ambiguous_views"))
    j = states.join(r, k, "left").join(v, k, "left").join(centre, k, "left").join(turn, k, "left").fillna(
        0, ["marked", "usable_views", "ambiguous_views", "center_spread_m", "normal_spread_degrees"])
    apart = ((F.col("size_error") > policy.size_relative_tolerance) | (F.col("usable_views") != F.col("marked"))
             | (F.col("center_spread_m") > policy.max_pose_center_spread_m)
             | (F.col("normal_spread_degrees") > policy.max_pose_normal_spread_degrees))
    state = (F.when(F.col("state") != "TRIANGULATED", F.col("state")).when(apart, "DISAGREEMENT_REVIEW_REQUIRED")
             .when(F.col("ambiguous_views") > 0, "AMBIGUOUS_OBJECT_POSE").otherwise("CONSISTENT_LOCAL_REFERENCE"))
    return j.select(*k, "size_error", "usable_views", "ambiguous_views", "center_spread_m", "normal_spread_degrees", state.alias("state"))


def _ends_of(rays: Column) -> Column:
    """The two views of a corner whose rays differ most in direction: cosine, rank, other."""
    def against(a):
        others = F.filter(rays, lambda b: a["rank"] < b["rank"])
        return F.array_min(F.transform(others, lambda b: F.struct(
            F.abs(G.dot([a[c] for c in RAY], [b[c] for c in RAY])).alias("cosine"), a["rank"].alias("rank"), b["rank"].alias("other"))))

    return F.array_min(F.transform(rays, against))


def leave_one_out(corners: DataFrame, cameras: DataFrame, policy: GroundingPolicy = GroundingPolicy()) -> DataFrame:
    """Largest error in each held-out view when the other views triangulate the object.

    The sums of the other views are all sums minus the held view's own terms. Their widest rays
    are those of all views unless the held view is one of the two; only for these two views are
    the remaining rays compared again. The rays of a corner, at most 12 by contract, are gathered
    once per object, and each view is held out in place; solved corners travel once more, to their camera.
    """
    k = ["capture_id", "object_id"]
    kc = [*k, "corner"]
    held = F.col("held_out_rank")
    views = corners.select(*k, "rank").distinct()
    enough = views.groupBy(*k).agg(F.count("*").alias("_n"), F.collect_set("rank").alias("_ranks"), F.max(F.col("rank").isNull()).alias("_none")).where(
        F.col("_n") > policy.min_views).select(*k, F.when(F.col("_none"), F.concat("_ranks", F.array(F.lit(None)))).otherwise(F.col("_ranks")).alias("_held"))
    rays = corner_rays(corners, cameras).join(enough, k)
    ray = F.struct("rank", "px", "py", *RAY, "ox", "oy", "oz")
    at = rays.groupBy(*kc).agg(F.collect_list(ray).alias("_rays"), F.any_value("_held").alias("_held"), *[F.sum(c).alias(n) for n, c in _ray_terms().items()])
    at = at.withColumn("_views", F.size(F.array_distinct(F.transform("_rays", lambda r: r["rank"])))).withColumn("_wide", _ends_of(F.col("_rays")))
    j = at.withColumn("held_out_rank", F.explode("_held")).withColumn("_own", F.filter("_rays", lambda r: r["rank"] == held))
    rest = F.filter("_rays", lambda r: r["rank"] != held)
    one_of_two = held.isin(F.col("_wide.rank"), F.col("_wide.other"))
    j = j.withColumn("_cosine", F.when(one_of_two, _ends_of(rest)["cosine"]).otherwise(F.col("_wide.cosine")))
    j = j.withColumn("views", (F.col("_views") - F.when(F.size("_own") > 0, 1).otherwise(0)).cast("bigint")).where("views > 0")
    none = F.struct(*[F.lit(0.0).alias(n) for n in _ray_terms()])
    add = lambda s, r: F.struct(*[(s[n] + c).alias(n) for n, c in _ray_terms(r).items()])
    left = j.withColumn("_less", F.aggregate("_own", none, add)).withColumns({n: F.col(n) - F.col(f"_less.{n}") for n in _ray_terms()})
    solved = _solved_corners(left, [*kc, "held_out_rank", "_own"], F.col("_cosine"), policy)
    solved = solved.select(*k, "held_out_rank", (F.col("corner_status") == "SOLVED").alias("_ok"), "x", "y", "z", F.transform("_own", lambda r: F.struct(r["px"].alias("px"), r["py"].alias("py"))).alias("_own"))
    seen = solved.join(cameras.withColumnRenamed("rank", "held_out_rank").withColumn("_in", F.lit(True)), ["capture_id", "held_out_rank"], "left").withColumn("_own", F.explode_outer("_own"))
    u, v, depth = G.project_pixel(G.vec("x", "y", "z"))
    error = F.sqrt((u - F.col("_own.px")) ** 2 + (v - F.col("_own.py")) ** 2)
    met = F.col("_ok") & F.col("_in") & F.col("_own").isNotNull()
    e = seen.groupBy(*k, "held_out_rank").agg(F.min("_ok").alias("_ok"), F.max(F.when(met, error)).alias("held_out_max_px"), F.min(F.when(met, depth)).alias("_d"), F.count_if(met).alias("_c"))
    full = F.col("_ok") & (F.col("_c") == 4)
    return e.select(
        *k, "held_out_rank", F.when(full, "TRIANGULATED").otherwise("INSUFFICIENT").alias("training_state"),
        F.when(full, F.col("held_out_max_px")).alias("held_out_max_px"), F.when(full, F.col("_d") > 0).alias("held_out_positive_depth"))


def pixel_shift_check(corners: DataFrame, cameras: DataFrame, policy: GroundingPolicy = GroundingPolicy()) -> DataFrame:
    """The object state under principal points moved by half a pixel either way."""
    k = ["capture_id", "object_id", "shift"]
    c = gathered_views(corners, cameras).withColumn("shift", F.explode(F.array(F.lit(-0.5), F.lit(0.5))))
    c = c.withColumn("_views", F.transform("_views", lambda w: F.struct(
        *[(w[n] + F.col("shift") if n in ("cx", "cy") else w[n]).alias(n) for n in ("rank", "px", "py", *CAMERA)])))
    states = solved_in_place(c, ["shift"], policy).groupBy(*k).agg(*_state_sums(), *_error_sums())
    return states.select(*k, "views", "min_corner_angle_degrees", "condition", "reprojection_max_px", "min_depth", _state(policy).alias("state"))


def residual_breakdown(errors: DataFrame) -> DataFrame:
    """Worst view and corner of each object, and the RMS of each corner."""
    k = ["capture_id", "object_id"]
    worst = errors.groupBy(*k).agg(
        F.max(F.struct("error_px", (-F.col("rank")).alias("_r"), (-F.col("corner")).alias("_c"))).alias("_w"),
        *[F.sqrt(F.avg(F.when(F.col("corner") == i, F.col("error_px") * F.col("error_px")))).alias(f"rms_corner_{i}") for i in range(4)])
    return worst.select(*k, (-F.col("_w._r")).alias("worst_rank"), (-F.col("_w._c")).alias("worst_corner"),
                        F.col("_w.error_px").alias("worst_px"), *[f"rms_corner_{i}" for i in range(4)])


def sensitivity_range(corners: DataFrame, cameras: DataFrame, references: DataFrame, policy: GroundingPolicy = GroundingPolicy()) -> DataFrame:
    """Range of measured sizes over seeded corner perturbations of the marked pixels.

    The noise comes from a hash of seed, trial and corner, so it does not depend on the
    partitioning. The number of trials is a small fixed policy value; they are made from the
    gathered views of an object and summed up where they are made.
    """
    k = ["capture_id", "object_id"]
    t = gathered_views(corners, cameras).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(policy.sensitivity_trials))))

    def moved(w, axis):
        h = F.xxhash64(F.lit(policy.seed), F.lit(axis), "trial", "capture_id", "object_id", w["rank"], "corner")
        return w[f"p{axis}"] + (F.pmod(h, F.lit(2_000_001)).cast("double") / 1_000_000 - 1) * policy.sensitivity_pixels

    t = t.withColumn("_views", F.transform("_views", lambda w: F.struct(
        w["rank"].alias("rank"), moved(w, "x").alias("px"), moved(w, "y").alias("py"), *[w[c].alias(c) for c in CAMERA])))
    trials = solved_in_place(t, ["trial"], policy).groupBy(*k, "trial").agg(*_state_sums(), *_error_sums(), *_corner_points())
    r = _rectangles(trials.where(_state(policy) == "TRIANGULATED"), references, [*k, "trial"])
    w = (F.col("width_edge_0_m") + F.col("width_edge_1_m")) / 2
    h = (F.col("height_edge_0_m") + F.col("height_edge_1_m")) / 2
    out = r.groupBy(*k).agg(F.count("*").alias("usable_trials"), F.min(w).alias("width_min_m"), F.max(w).alias("width_max_m"),
                            F.min(h).alias("height_min_m"), F.max(h).alias("height_max_m"))
    return corners.select(*k).distinct().join(out, k, "left").fillna(0, ["usable_trials"])


def plane_comparison(rectangles: DataFrame, planes: DataFrame, thickness: DataFrame) -> DataFrame:
    """Angle and signed offset of each object against the horizontal planes of its capture.

    ``thickness`` holds the reviewed interval per object.
    """
    j = rectangles.join(planes.where("orientation = 'horizontal'").select("capture_id", "plane_index", "a", "b", "c", "d"), "capture_id")
    j = j.join(thickness, ["capture_id", "object_id"], "left")
    n = G.vec("a", "b", "c")
    cosine = F.abs(G.dot(G.vec("normal_x", "normal_y", "normal_z"), n))
    offset = G.dot(G.vec("center_x", "center_y", "center_z"), n) + F.col("d")
    j = j.withColumn("_off", offset)
    interval = bottom_offset_interval(F.col("_off"), F.col("b"), F.col("lower_m"), F.col("upper_m"), F.col("lower_inclusive"), F.col("upper_inclusive"))
    return j.select("capture_id", "object_id", "plane_index", F.degrees(F.acos(G.clamp(cosine, 0.0, 1.0))).alias("normal_angle_degrees"),
                    F.col("_off").alias("signed_distance_m"), F.when(F.col("lower_m").isNotNull(), interval).alias("bottom"))


def thickness_violations(bounds: DataFrame) -> DataFrame:
    """Reviewed thickness intervals that are empty, too wide, or miss the exact value."""
    ok = (F.col("lower_m") >= 0) & (F.col("lower_m") < F.col("upper_m")) & (F.col("upper_m") <= 0.2)
    fits = F.col("exact_m").isNull() | within_interval(F.col("exact_m"), F.col("lower_m"), F.col("upper_m"), F.col("lower_inclusive"), F.col("upper_inclusive"))
    return bounds.where(~F.coalesce(ok & fits, F.lit(False))).select("capture_id", "object_id", F.lit("GROUNDING_REVIEW_INVALID").alias("code"))


def corner_violations(corners: DataFrame, views: DataFrame) -> DataFrame:
    """Marked views that are unknown, changed, malformed, too many or out of order.

    ``corners`` here has one row per marked view with polygon and the identity columns
    frame_id, relative_sec, sha256, width and height, and ``position``, its place as written.
    """
    ident = ["frame_id", "relative_sec", "sha256", "width", "height"]
    v = views.select("capture_id", "rank", *[F.col(c).alias(f"_v_{c}") for c in ident])
    # views grow with the captures, and Spark guesses exploded tables too small: never broadcast them
    j = corners.join(v.hint("merge"), ["capture_id", "rank"], "left")
    changed = F.lit(False)
    for c in ident:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_v_{c}"))
    known = F.col("_v_frame_id").isNotNull()
    codes = F.array_compact(F.array(
        F.when(~known, F.lit("GROUNDING_SELECTION_INVALID")), F.when(known & changed, F.lit("GROUNDING_ANNOTATION_SOURCE_CHANGED")),
        F.when(~G.valid_polygon(F.col("polygon"), F.col("width"), F.col("height"), corners=True), F.lit("GROUNDING_CORNERS_INVALID"))))
    rows = j.select("capture_id", "object_id", "rank", F.explode(codes).alias("code"))
    order = order_violations(corners, ["capture_id", "object_id"], "position", "rank", at_most=MAX_MARKED_VIEWS)
    return rows.unionByName(order.select("capture_id", "object_id", F.lit(None).cast("bigint").alias("rank"), F.lit("GROUNDING_SELECTION_INVALID").alias("code")))


def polygon_spans(polygons: DataFrame, tile_px: int = 64) -> DataFrame:
    """Scan-line pieces of convex polygons: image row ``y``, ``tile`` of ``tile_px`` columns, ``x_from`` to ``x_to``.

    A span reaches at least over all pixel centres of its row inside the polygon and at most two
    pixels beyond. Polygons lie within their image (``corner_violations`` reports others), which
    bounds the rows.
    """
    poly = F.col("polygon")
    nxt = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
    ys = F.transform(poly, lambda p: p["y"])
    df = polygons.withColumns({"_top": F.array_min(ys), "_end": F.array_max(ys)})
    df = df.withColumn("y", F.explode(F.sequence(F.floor(F.col("_top") - 0.5), F.ceil(F.col("_end") - 0.5))))
    at = G.clamp_between(F.col("y") + 0.5, F.col("_top"), F.col("_end"))

    def cut(a, b, pick):
        x = a["x"] + (at - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] != a["y"], b["y"] - a["y"])
        crosses = (at >= F.least(a["y"], b["y"])) & (at <= F.greatest(a["y"], b["y"]))
        return F.when(crosses, F.when(b["y"] != a["y"], x).otherwise(pick(a["x"], b["x"])))

    df = df.withColumns({"x_from": F.floor(F.array_min(F.zip_with(poly, nxt, lambda a, b: cut(a, b, F.least))) - 1.5),
                         "x_to": F.ceil(F.array_max(F.zip_with(poly, nxt, lambda a, b: cut(a, b, F.greatest))) + 0.5)})
    return df.withColumn("tile", F.explode(F.sequence(F.floor(F.col("x_from") / tile_px), F.floor(F.col("x_to") / tile_px)))).drop("_top", "_end")


def polygon_pixels(corner_polygons: DataFrame, support: DataFrame, margin_px: float = 3.0, tile_px: int = 64) -> DataFrame:
    """Accepted pixels inside each marked polygon, kept ``margin_px`` away from its edges.

    Pixels meet scan-line spans by image row and column tile, so a pixel is compared with the
    polygons of its row nearby, not with all polygons of its image.
    """
    nxt = lambda p: F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    spans = polygon_spans(corner_polygons, tile_px)
    pixels = support.where("accepted").withColumn("tile", F.floor(F.col("x") / tile_px))
    j = pixels.join(spans, ["capture_id", "image", "y", "tile"]).where(F.col("x").between(F.col("x_from"), F.col("x_to"))).drop("tile", "x_from", "x_to")
    px, py, poly = F.col("x") + 0.5, F.col("y") + 0.5, F.col("polygon")
    clear = F.forall(F.zip_with(poly, nxt(poly), lambda a, b: F.abs(
        (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])) / F.sqrt(
        (b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)), lambda d: d >= margin_px)
    return j.where(G.in_convex_polygon(px, py, poly) & clear)


def polygon_plane_distance(inside: DataFrame, cameras: DataFrame, planes: DataFrame, views: DataFrame) -> DataFrame:
    """Signed median and absolute 90th percentile distance of inside pixels to the object plane."""
    k = ["capture_id", "object_id", "image"]
    j = inside.join(cameras, ["capture_id", "image"])
    w = G.backproject_pixel(F.col("x"), F.col("y"), F.col("z"))
    j = j.select(*k, *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))]).join(planes, ["capture_id", "object_id"])
    d = F.col("normal_x") * F.col("wx") + F.col("normal_y") * F.col("wy") + F.col("normal_z") * F.col("wz") + F.col("plane_d")
    e = j.select(*k, d.alias("signed"), F.abs(d).alias("absolute"))
    q = quantiles(e, k, "signed", {"signed_median_m": 0.5}, count="accepted_object_pixels").join(
        quantiles(e, k, "absolute", {"absolute_p90_m": 0.9}), k)
    return views.select(*k).join(q, k, "left").fillna(0, ["accepted_object_pixels"]).withColumn(
        "status", F.when(F.col("accepted_object_pixels") > 0, "SUPPORTED_PIXELS_ONLY").otherwise("MISSING_STEREO_SUPPORT"))
