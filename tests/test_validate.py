"""Contract violations of single rows."""
from capstrata.operators import reviews, validate


def test_camera_rows(spark):
    cols = "capture_id long, rank long, width long, height long, fx double, fy double, cx double, cy double, exposure_sec double, tracking_state string"
    rows = spark.createDataFrame([(1, 0, 100, 60, 100.0, 100.0, 49.5, 29.5, 0.005, "normal"), (1, 1, 90, 60, 100.0, 100.0, 120.0, 29.5, 0.0, ""),
                                  (1, 2, 100, 60, 100.0, 100.0, 49.5, 29.5, None, "limited")], cols)
    media = spark.createDataFrame([(1, 100, 60)], "capture_id long, width long, height long")
    got = {(r["rank"], r["code"]) for r in validate.camera_row_violations(rows, media).collect()}
    assert got == {(1, c) for c in ("CALIBRATION_GRID_MISMATCH", "INVALID_INTRINSICS", "INVALID_EXPOSURE", "MISSING_TRACKING_STATE")}
    m = spark.createDataFrame([(1, 100.0, 100.0, 49.5, 29.5), (2, 1.0, 1.0, 1.0, 1.0)], "capture_id long, fx double, fy double, cx double, cy double")
    assert [r["capture_id"] for r in validate.matrix_violations(m, rows).collect()] == [2]


def test_association_counts(spark):
    f = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "capture_id long, frame_id string")
    c = f.selectExpr("capture_id", "frame_id", "1.0 as fx")
    p = c.where("not (capture_id = 1 and frame_id = 'b')").selectExpr("capture_id", "frame_id", "0.0 as tx")
    joined, bad = validate.associated_frames(f, c, p)
    assert joined.count() == 2 and [r["capture_id"] for r in bad.collect()] == [1]


def test_annotations(spark):
    a = spark.createDataFrame([(1, 1, "v", 0.2, 0.3, 0.0, 5.0), (1, 2, "x", 0.2, 0.3, 0.0, 5.0), (1, 3, "v", 0.0, 0.3, 0.0, 5.0), (1, 4, "v", 0.2, 0.3, 5.0, 1.0), (1, 5, "v", 0.2, 0.3, 50.0, 60.0)],
                              "capture_id long, object_id long, source_video_sha256 string, width_m double, height_m double, start_sec double, end_sec double")
    frames = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "capture_id long, rank long, relative_sec double")
    got = {(r["object_id"], r["code"]) for r in validate.annotation_violations(a, frames, spark.createDataFrame([(1, "v")], "capture_id long, sha256 string")).collect()}
    assert got == {(2, "ANNOTATION_SOURCE_MISMATCH"), (3, "INVALID_ANNOTATION"), (4, "INVALID_ANNOTATION"), (5, "INVALID_ANNOTATION")}


def test_order_violations(sliced):
    rows = [(1, p, r) for p, r in enumerate([0, 3, 7])] + [(2, p, r) for p, r in enumerate([0, 7, 3])] + [(3, p, r) for p, r in enumerate([1, 1, 2])]
    rows += [(4, 0, 5)] + [(5, p, p) for p in range(40)] + [(6, 0, None), (6, 1, 4), (6, 2, 9)] + [(7, p, p if p < 29 else 28) for p in range(30)]
    df = sliced.createDataFrame(rows, "capture_id long, position long, rank long")
    got = lambda *limits: sorted(r[0] for r in reviews.order_violations(df, ["capture_id"], "position", "rank", *limits).collect())
    assert got() == [2, 3, 6, 7]
    assert got(3, 30) == [2, 3, 4, 5, 6, 7]
    prepared = sliced.createDataFrame([(1, r) for r in (0, 3)] + [(5, r) for r in range(40)], "capture_id long, rank long")
    chosen = df.where("capture_id IN (1, 5)")
    found = reviews.selection_order_violations(chosen, prepared, 100).collect()
    assert [(r["capture_id"], r["code"]) for r in found] == [(1, "RECONSTRUCTION_SELECTION_INVALID")]
    assert reviews.order_violations(df.where("false"), ["capture_id"], "position", "rank", 3).count() == 0


def test_confirmations(spark):
    c = spark.createDataFrame([(1, 1, "a", "yes", 0.0, 0.1, True, False), (2, 1, "b", "yes", 0.0, 0.1, True, False), (3, 1, "c", None, 0.1, 0.1, True, True),
                               (4, 1, "d", "yes", 0.0, 0.05, True, False), (5, 1, "e", "yes", 0.0, 0.05, True, True)],
                              "capture_id long, object_id long, corners_sha256 string, statement string, lower_m double, upper_m double, lower_inclusive boolean, upper_inclusive boolean")
    a = spark.createDataFrame([(1, 1, "a", None), (2, 1, "x", None), (3, 1, "c", None), (4, 1, "d", 0.05), (5, 1, "e", 0.05)],
                              "capture_id long, object_id long, corners_sha256 string, cover_m double")
    marked = spark.createDataFrame([(i, 1, p, p) for i in range(1, 6) for p in range(3)], "capture_id long, object_id long, position long, rank long")
    reviewed = marked.where("NOT (capture_id = 4 AND position = 2)")
    got = {(r["capture_id"], r["code"]) for r in reviews.confirmation_violations(c, a, reviewed, marked).collect()}
    changed, invalid = "GROUNDING_REVIEW_SOURCE_CHANGED", "GROUNDING_REVIEW_INVALID"
    assert got == {(2, changed), (3, invalid), (4, changed), (4, invalid)}
    # a confirmation without any marked view binds nothing
    assert {r["code"] for r in reviews.confirmation_violations(c.where("capture_id = 1"), a, reviewed.where("false"), marked.where("false")).collect()} == {changed}
