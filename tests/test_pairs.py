"""Pairs that meet through an index, against all pairs."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstrata.operators import grounding, matching, room

CAMERA = ("capture_id long, rank long, fx double, fy double, cx double, cy double, width long, height long, "
          + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + ", tx double, ty double, tz double, ox double, oy double, oz double")


def camera(rng, capture, rank, centre=None):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    r = q * np.sign(np.linalg.det(q))
    o = rng.uniform(-3, 3, 3) if centre is None else np.asarray(centre, float)
    return (capture, rank, 50.0, 60.0, 20.0, 14.0, 40, 30, *map(float, r.ravel()), *map(float, -r @ o), *map(float, o))


def test_zbuffer_meets_only_cameras_in_reach(spark):
    rng = np.random.default_rng(5)
    cams = [camera(rng, 1, i) for i in range(40)] + [camera(rng, 2, 0)]
    pts = [(1 + int(i % 10 == 0), i, *map(float, rng.uniform(-4, 4, 3))) for i in range(3000)]
    pts += [(1, 3000, float("nan"), 0.0, 0.0), (1, 3001, None, 0.0, 0.0)]
    points = spark.createDataFrame(pts, "capture_id long, point_id long, x double, y double, z double")
    cameras = spark.createDataFrame(cams, CAMERA)
    want, framed, product = set(), 0, 0
    for c in cams:
        r, t = np.array(c[8:17]).reshape(3, 3), np.array(c[17:20])
        bins = {}
        for cap, pid, *xyz in pts[:3000]:
            if cap != c[0]:
                continue
            product += 1
            o = r @ np.array(xyz) + t
            if o[2] <= 0.05:
                continue
            u, v = c[2] * o[0] / o[2] + c[4], c[3] * o[1] / o[2] + c[5]
            if 0 <= u < c[6] and 0 <= v < c[7]:
                framed += 1
                bins.setdefault((int(u // 3), int(v // 3)), []).append((o[2], pid))
        for near in bins.values():
            want |= {(c[0], pid, c[1]) for d, pid in near if d <= min(near)[0] + 0.12}
    got = [(r["capture_id"], r["point_id"], r["rank"]) for r in room.zbuffer_visible(points, cameras).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    cell = {t: F.floor(F.col(c) / 0.25) for t, c in zip(("_i", "_j", "_k"), "xyz")}
    tiled = points.withColumns(cell)
    met = tiled.join(room.tiles_in_view(tiled.select("capture_id", *cell).distinct(), cameras, 0.25, 0.05), ["capture_id", *cell]).count()
    assert framed <= met < 1.6 * framed < product / 3


def test_zbuffer_empty(spark):
    points = spark.createDataFrame([], "capture_id long, point_id long, x double, y double, z double")
    assert room.zbuffer_visible(points, spark.createDataFrame([], CAMERA)).count() == 0


@pytest.mark.parametrize("margin,tile", [(0.0, 16), (3.0, 64), (1.0, 5)])
def test_polygon_pixels(spark, margin, tile):
    rng = random.Random(3)
    shapes = [(1, 1, 0, [(10, 10), (50, 10), (50, 40), (10, 40)]), (1, 2, 1, [(5.5, 20.5), (30, 2), (61.5, 20.5), (30, 39)]), (1, 1, 2, [(7, 7), (8, 7), (8, 8), (7, 8)])]
    for i in range(3, 9):
        x, y, a, b = rng.uniform(5, 40), rng.uniform(5, 25), rng.uniform(4, 20), rng.uniform(4, 15)
        shape = [(x, y), (x + a, y + 1), (x + a + 2, y + b), (x - 2, y + b + 2)]
        shapes.append((1, 1 + i % 2, i, shape if i % 2 else shape[::-1]))
    polygons = spark.createDataFrame([(c, im, o, [{"x": float(x), "y": float(y)} for x, y in p]) for c, im, o, p in shapes],
                                     "capture_id long, image long, object_id long, polygon array<struct<x double, y double>>")
    pixels = spark.range(2 * 64 * 44).select(F.lit(1).cast("bigint").alias("capture_id"), (1 + F.floor(F.col("id") / (64 * 44))).alias("image"),
                                             F.floor(F.col("id") % (64 * 44) / 64).alias("y"), (F.col("id") % 64).alias("x"), F.lit(1.0).alias("z"), (F.col("id") % 7 != 0).alias("accepted"))
    got = sorted((r["object_id"], r["image"], r["y"], r["x"]) for r in grounding.polygon_pixels(polygons, pixels, margin, tile).collect())
    want = []
    for _, image, o, p in shapes:
        for y in range(44):
            for x in range(64):
                if ((image - 1) * 64 * 44 + y * 64 + x) % 7 == 0:
                    continue
                turn = [((b[0] - a[0]) * (y + .5 - a[1]) - (b[1] - a[1]) * (x + .5 - a[0]), np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(p, p[1:] + p[:1])]
                inside = all(t >= -1e-9 for t, _ in turn) or all(t <= 1e-9 for t, _ in turn)
                if inside and all(abs(t) / n >= margin for t, n in turn):
                    want.append((o, image, y, x))
    assert got == sorted(want) and want


@pytest.mark.parametrize("words,bound", [(1, 0), (1, 5), (2, 7), (2, 15), (8, 30)])
def test_hamming_against_all_pairs(spark, words, bound):
    rng = random.Random(bound)
    base = [[rng.getrandbits(32) for _ in range(words)] for _ in range(12)]
    rows = []
    for image in (1, 2, 3):
        for i in range(40):
            code = list(rng.choice(base))
            for _ in range(rng.randrange(bound + 3) if i % 5 else 0):
                code[rng.randrange(words)] ^= 1 << rng.randrange(32)
            rows.append((1, image, 100 * image + i, code))
    rows += [(1, 1, 190, [0] * words), (1, 2, 290, [0xFFFFFFFF] * words), (1, 2, 291, [0] * words)]
    d = spark.createDataFrame(rows, "capture_id long, image long, feature_id long, code array<bigint>")
    pairs = matching.adjacent_images(d)
    fold = {}
    for _, image, f, code in rows:
        fold.setdefault((image, tuple(code)), []).append(f)
    near = {}
    for (ia, ca), fa in fold.items():
        for (ib, cb), fb in fold.items():
            n = sum(bin(x ^ y).count("1") for x, y in zip(ca, cb))
            if ib == ia + 1 and n <= bound:
                near.setdefault((ia, min(fa)), []).append((n, min(fb), len(fb)))
    want = sorted((ia, q, t, c, n) for (ia, q), found in near.items() for n, t, c in found)
    got = sorted((r["first_image"], r["query_id"], r["target_id"], r["copies"], r["distance"]) for r in matching.hamming_pairs(d, pairs, words, bound).collect())
    assert got == want and want
    best = {}
    for (ia, q), found in near.items():
        found.sort()
        n, t, c = found[0]
        second = min([bound + 1] + [m for m, *_ in found[1:2]] + [n] * (c > 1))
        if n < 0.75 * second:
            best[ia, t] = min(best.get((ia, t), (n, q)), (n, q))
    matched = matching.hamming_matches(d, pairs, words, bound).collect()
    assert sorted((r["first_image"], r["target_id"], r["distance"], r["query_id"]) for r in matched) == sorted((i, t, n, q) for (i, t), (n, q) in best.items())


def test_hamming_bound(spark):
    with pytest.raises(ValueError):
        matching.hamming_pairs(None, None, 1, 8)


def test_leave_one_out_equals_triangulating_the_rest(spark):
    rng = np.random.default_rng(2)
    corners, cams = [], []
    for obj, n in ((1, 3), (2, 4), (3, 9), (4, 6)):
        spread = 0.01 if obj == 4 else 1.0
        for rank in range(n):
            o = rng.uniform(-1, 1, 3) * (spread, spread, 0.1)
            cams.append((obj, rank, 500.0, 500.0, 320.0, 240.0, 640, 480, *np.eye(3).ravel().tolist(), *map(float, -o), *map(float, o)))
            for c, q in enumerate(((0, 0, 3), (.3, 0, 3), (.3, .2, 3), (0, .2, 3))):
                if (obj, rank, c) in ((3, 2, 1), (3, 4, 1)):
                    continue
                u = [500 * (q[i] - o[i]) / (q[2] - o[2]) + (320, 240)[i] + rng.normal() * .3 for i in (0, 1)]
                corners.append((obj, obj, rank, c, *map(float, u)))
    corners.append((3, 3, 1, 0, 400.0, 200.0))  # marked twice
    cd = spark.createDataFrame(corners, "capture_id long, object_id long, rank long, corner long, px double, py double")
    cam = spark.createDataFrame(cams, CAMERA)
    got = {(r["object_id"], r["held_out_rank"]): r for r in grounding.leave_one_out(cd, cam).collect()}
    assert {o for o, _ in got} == {2, 3, 4} and len(got) == 19
    states = set()
    for (obj, held), row in got.items():
        if (obj, held) not in {(2, 0), (3, 1), (3, 2), (3, 8), (4, 3)}:
            continue
        rest = cd.where((F.col("object_id") == obj) & (F.col("rank") != held))
        solved = grounding.triangulate(grounding.corner_rays(rest, cam))
        seen = grounding.corner_rays(cd.where((F.col("object_id") == obj) & (F.col("rank") == held)), cam)
        e = grounding.corner_errors(seen, solved, cam).collect()
        ok = all(r["corner_status"] == "SOLVED" for r in solved.collect()) and len(e) == 4
        states.add(row["training_state"])
        assert row["training_state"] == ("TRIANGULATED" if ok else "INSUFFICIENT"), (obj, held)
        if ok:
            assert row["held_out_max_px"] == pytest.approx(max(r["error_px"] for r in e), abs=1e-6)
    assert states == {"TRIANGULATED", "INSUFFICIENT"}
