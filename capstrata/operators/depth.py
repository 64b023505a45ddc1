"""Depth rasters as pixel tables: consistency, reports, resampling, image metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.ordered import quantiles
from capstrata.policies import DensePolicy
from capstrata.session import stage

CAMERA = ["fx", "fy", "cx", "cy", "width", "height", *[f"r{i}{j}" for i in range(3) for j in range(3)],
          "tx", "ty", "tz", "ox", "oy", "oz"]


def valid_pixels(pixels: DataFrame, policy: DensePolicy = DensePolicy()) -> DataFrame:
    """Finite depths inside the policy range."""
    return pixels.where(~F.isnan("z") & (F.abs("z") < float("inf")) & F.col("z").between(policy.min_depth, policy.max_depth))


def _cameras(cameras: DataFrame, image: str, prefix: str) -> DataFrame:
    return cameras.select("capture_id", F.col("image").alias(image), *[F.col(c).alias(f"{prefix}{c}") for c in CAMERA])


def depth_support(pixels: DataFrame, cameras: DataFrame, schedule: DataFrame, policy: DensePolicy = DensePolicy()) -> DataFrame:
    """Number of scheduled neighbours that confirm each valid pixel.

    A pixel is projected into a neighbour and bound-checked before its coordinates become
    integers, so the join on (capture, image, y, x) only carries pixels that can meet. The
    neighbour's own depth must agree, its back-projection must return to the pixel, and the
    rays must part by the minimum angle. Pixel keys are unique, so no join key is hot.
    """
    valid = valid_pixels(pixels, policy)
    k = ["capture_id", "image", "y", "x"]
    # staged steps keep each filter on plain columns; inlined camera algebra would outgrow the JIT
    world = G.backproject_pixel(F.col("x"), F.col("y"), F.col("z"), "a_")
    own = valid.select(*k, "z").join(_cameras(cameras, "image", "a_"), ["capture_id", "image"])
    own = stage(own.select(*k, "z", *[c.alias(f"w{n}") for c, n in zip(world, "xyz")]))
    own = own.drop("z").join(schedule, ["capture_id", "image"]).join(_cameras(cameras, "partner", "b_"), ["capture_id", "partner"])
    u, v, depth = G.project_pixel(G.vec("wx", "wy", "wz"), "b_")
    own = own.select("*", u.alias("bu"), v.alias("bv"), depth.alias("bz")).where(
        (F.col("bz") > 0) & (F.col("bu") >= 0) & (F.col("bu") < F.col("b_width")) & (F.col("bv") >= 0) & (F.col("bv") < F.col("b_height")))
    # only the pixel and its target travel; the cameras are looked up again on the other side
    own = own.select(*k, "partner", "wx", "wy", "wz", "bz", F.floor("bv").alias("ty_"), F.floor("bu").alias("tx_"))
    target = valid.select("capture_id", F.col("image").alias("partner"), F.col("y").alias("ty_"), F.col("x").alias("tx_"), F.col("z").alias("seen"))
    m = own.join(target, ["capture_id", "partner", "ty_", "tx_"]).where(
        F.abs(F.col("seen") - F.col("bz")) <= policy.relative_depth_error * F.col("bz"))
    m = m.join(_cameras(cameras, "image", "a_"), ["capture_id", "image"]).join(_cameras(cameras, "partner", "b_"), ["capture_id", "partner"])
    back = G.backproject_pixel(F.col("tx_"), F.col("ty_"), F.col("seen"), "b_")
    m = m.select("*", *[c.alias(f"q{n}") for c, n in zip(back, "xyz")])
    ru, rv, rz = G.project_pixel(G.vec("qx", "qy", "qz"), "a_")
    off = F.sqrt((ru - (F.col("x") + 0.5)) ** 2 + (rv - (F.col("y") + 0.5)) ** 2)
    p = G.vec("wx", "wy", "wz")
    ra, rb = G.minus(p, G.vec("a_ox", "a_oy", "a_oz")), G.minus(p, G.vec("b_ox", "b_oy", "b_oz"))
    cosine = G.dot(ra, rb) / F.greatest(G.norm(ra) * G.norm(rb), F.lit(1e-15))
    angle = F.degrees(F.acos(G.clamp(cosine, -1.0, 1.0)))
    m = stage(m.select(*k, rz.alias("_rz"), off.alias("_off"), angle.alias("_angle")))
    good = m.where((F.col("_rz") > 0) & (F.col("_off") <= policy.roundtrip_pixels) & (F.col("_angle") >= policy.min_angle_degrees))
    n = good.groupBy(*k).agg(F.count("*").alias("support"))
    out = valid.select(*k, "z").join(n, k, "left").fillna(0, ["support"])
    return out.withColumn("accepted", F.col("support") >= policy.min_support)


def depth_view_report(support: DataFrame, cameras: DataFrame, policy: DensePolicy = DensePolicy()) -> DataFrame:
    """Valid, accepted and rejected pixels and the support histogram, per view and per capture."""
    bars = [F.count_if(F.col("support") == n).alias(f"support_{n}") for n in range(policy.neighbors + 1)]
    # the rolled-up row of a capture has image NULL
    agg = support.rollup("capture_id", "image").agg(
        F.count("*").alias("valid_pixels"), F.count_if("accepted").alias("accepted_pixels"),
        F.count_if(~F.col("accepted")).alias("rejected_valid_pixels"), *bars).where("capture_id IS NOT NULL")
    size = cameras.rollup("capture_id", "image").agg(F.sum(F.col("width") * F.col("height")).alias("pixels")).where("capture_id IS NOT NULL")
    a, b = agg.alias("a"), size.alias("b")
    j = b.join(a, (F.col("a.capture_id") == F.col("b.capture_id")) & F.col("a.image").eqNullSafe(F.col("b.image")), "left")
    cols = ["valid_pixels", "accepted_pixels", "rejected_valid_pixels", *[f"support_{n}" for n in range(policy.neighbors + 1)]]
    filled = [F.coalesce(f"a.{c}", F.lit(0)).alias(c) for c in cols]
    return j.select("b.capture_id", "b.image", "b.pixels", *filled).withColumn(
        "accepted_fraction", F.col("accepted_pixels") / F.col("pixels"))


def sparse_depth_agreement(observed: DataFrame, support: DataFrame, cameras: DataFrame) -> DataFrame:
    """Relative difference of track points to the accepted depth under them, per view.

    ``observed`` has one row per (capture, image, point) with world x, y, z named wx, wy, wz.
    """
    p = observed.join(cameras, ["capture_id", "image"])
    u, v, depth = G.project_pixel(G.vec("wx", "wy", "wz"))
    p = p.select("capture_id", "image", depth.alias("depth"), F.floor(v).alias("y"), F.floor(u).alias("x")).where("depth > 0")
    hit = p.join(support.where("accepted").select("capture_id", "image", "y", "x", "z"), ["capture_id", "image", "y", "x"])
    e = hit.select("capture_id", "image", (F.abs(F.col("z") - F.col("depth")) / F.col("depth")).alias("error"))
    q = quantiles(e, ["capture_id", "image"], "error", {"error_median": 0.5, "error_p90": 0.9}, count="sparse_samples")
    return cameras.select("capture_id", "image").join(q, ["capture_id", "image"], "left").fillna(0, ["sparse_samples"])


def accepted_points(support: DataFrame, cameras: DataFrame, stride: int) -> DataFrame:
    """World points of accepted pixels on the sampling grid."""
    s = support.where(F.col("accepted") & (F.col("y") % stride == 0) & (F.col("x") % stride == 0)).join(cameras, ["capture_id", "image"])
    w = G.backproject_pixel(F.col("x"), F.col("y"), F.col("z"))
    return s.select("capture_id", "image", F.col("y").alias("py"), F.col("x").alias("px"), *[c.alias(n) for c, n in zip(w, "xyz")])


def resample_depth(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """Nearest source depth on another pixel grid of the same pose; never filled or scaled.

    ``grids`` has the source intrinsics fx.., the target intrinsics tfx.. and the target
    size per image. Each target pixel computes its source pixel and meets it by equality.
    """
    g = grids.select("*", F.explode(F.sequence(F.lit(0), (F.col("theight") - 1).cast("int"))).alias("ty"))
    g = g.select("*", F.explode(F.sequence(F.lit(0), (F.col("twidth") - 1).cast("int"))).alias("tx"))
    u = (F.col("tx") + 0.5 - F.col("tcx")) / F.col("tfx") * F.col("fx") + F.col("cx") - 0.5
    v = (F.col("ty") + 0.5 - F.col("tcy")) / F.col("tfy") * F.col("fy") + F.col("cy") - 0.5
    g = g.select("capture_id", "image", F.col("ty").cast("bigint").alias("ty"), F.col("tx").cast("bigint").alias("tx"),
                 F.floor(v + 0.5).alias("y"), F.floor(u + 0.5).alias("x"))
    return g.join(pixels, ["capture_id", "image", "y", "x"], "left").select(
        "capture_id", "image", "ty", "tx", F.coalesce("z", F.lit(0.0)).alias("z"))


def raster_stats(pixels: DataFrame) -> DataFrame:
    """Zero count and range of non-zero values of each capture's sampled rasters."""
    v = F.when(F.col("value") != 0, F.col("value"))
    return pixels.groupBy("capture_id").agg(
        F.count_distinct("frame").alias("sampled_frames"), F.count_if(F.col("value") == 0).alias("invalid_values"),
        F.min(v).alias("valid_min"), F.max(v).alias("valid_max"))


def level_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("capture_id", "value").agg(F.count("*").alias("pixels"))


def grid_violations(rasters: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """Depth must be 16 bit on one grid per capture; confidence 8 bit on the same grid."""
    k = "capture_id"
    depth = rasters.groupBy(k).agg(F.count_distinct("width", "height").alias("_g"), F.max(F.col("bit_depth") != 16).alias("_b"),
                                   F.min(F.struct("width", "height")).alias("_grid"))
    out = depth.where("_b").select(k, F.lit("DEPTH_ENCODING_MISMATCH").alias("code")).union(
        depth.where("_g > 1").select(k, F.lit("DEPTH_GRID_MISMATCH")))
    if confidence is not None:
        c = confidence.join(depth.select(k, "_grid"), k, "left")
        out = out.union(c.where("bit_depth <> 8").select(k, F.lit("CONFIDENCE_ENCODING_MISMATCH"))).union(
            c.where(F.struct("width", "height") != F.col("_grid")).select(k, F.lit("CONFIDENCE_GRID_MISMATCH")))
    return out.distinct()


def image_metrics(pixels: DataFrame) -> DataFrame:
    """Exposure fractions, mean, 32-bin histogram and Laplacian variance of grey images.

    ``pixels`` has capture_id, image, y, x, value, with borders mirrored without repeating
    the edge. Each pixel hands its value to its four neighbours, so the Laplacian is one
    aggregate over the pixel keys.
    """
    k = ["capture_id", "image"]
    size = pixels.groupBy(*k).agg(F.max("x").alias("_mx"), F.max("y").alias("_my"))
    p = pixels.join(size, k)
    x, y, val = F.col("x"), F.col("y"), F.col("value").cast("double")

    def give(dx, dy):
        # the border has one neighbour on this axis, which counts for the mirrored side too
        to_x, to_y = x + dx, y + dy
        inside = to_x.between(0, F.col("_mx")) & to_y.between(0, F.col("_my"))
        if dx:
            edge = to_x == (F.col("_mx") if dx > 0 else F.lit(0))
        else:
            edge = to_y == (F.col("_my") if dy > 0 else F.lit(0))
        return F.when(inside, F.struct(to_x.alias("x"), to_y.alias("y"), (F.when(edge, 2.0).otherwise(1.0) * val).alias("v")))

    parts = F.array_compact(F.array(F.struct(x.alias("x"), y.alias("y"), (-4.0 * val).alias("v")),
                                    give(1, 0), give(-1, 0), give(0, 1), give(0, -1)))
    lap = p.select(*k, F.explode(parts).alias("_p")).groupBy(*k, "_p.x", "_p.y").agg(F.sum("_p.v").alias("l"))
    lap = lap.groupBy(*k).agg(F.var_pop("l").alias("laplacian_variance"))
    v = F.col("value")
    n = F.count("*")
    bins = [(F.count_if(F.floor(v / 8) == i) / n).alias(f"h{i:02d}") for i in range(32)]
    base = pixels.groupBy(*k).agg(
        (F.count_if(v < 8) / n).alias("dark_fraction"), (F.count_if(v > 247) / n).alias("bright_fraction"), F.avg(v).alias("mean_luminance"), *bins)
    hist = [f"h{i:02d}" for i in range(32)]
    return base.select(*k, "dark_fraction", "bright_fraction", "mean_luminance", F.array(*hist).alias("luminance_histogram")).join(lap, k)


def image_pair_error(rendered: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean squared error, PSNR and covered share of rendered against reference rasters."""
    k = ["capture_id", "rank", "phase"]
    j = rendered.join(reference, ["capture_id", "rank", "y", "x"])
    mse = F.avg((F.col("value") - F.col("truth")) ** 2)
    return j.groupBy(*k).agg(mse.alias("mse"), (F.count_if(F.col("alpha") > 0.5) / F.count("*")).alias("coverage")).withColumn(
        "psnr_db", -10 * F.log10(F.greatest("mse", F.lit(1e-12))))


def gain_gate(errors: DataFrame, minimum_db: float = 1.0) -> DataFrame:
    """Held-out improvement from the initial to the final phase must exceed the minimum."""
    mean = lambda ph: F.avg(F.when(F.col("phase") == ph, F.col("psnr_db")))
    g = errors.groupBy("capture_id").agg(mean("initial").alias("initial_db"), mean("final").alias("final_db"))
    ok = F.col("final_db") > F.col("initial_db") + minimum_db
    return g.withColumn("status", F.when(F.coalesce(ok, F.lit(False)), "PASSED").otherwise("GAUSSIAN_QUALITY"))
