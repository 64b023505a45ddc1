"""Small written captures: scans, hashes, rasters and publication."""
import hashlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from capstrata.operators import integrity
from capstrata.operators.integrity import ContractViolation
from capstrata.sources import files, publish

HEAD = ",".join(files.STREAM_HEADERS["accelerometer"])


def test_commented_csv_keeps_line_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(("﻿# device\n\n" + HEAD + "\n1.000001,0,1,2,3\n# note\n1.000002,0,1,2,nan\n1.5,0,1\n").encode())
    (tmp_path / "b.csv").write_text("sensor_sec,x\n1,2\n")
    (tmp_path / "c.csv").write_text("# only\n")
    rows, notes, bad = files.scan_commented_csv(spark, str(tmp_path), files.STREAM_HEADERS["accelerometer"])
    assert [(r["source_line"], r["sensor_sec"]) for r in rows.orderBy("source_line").collect()] == [(4, "1.000001"), (6, "1.000002")]
    assert sorted(r["source_line"] for r in notes.collect()) == [1, 1, 5]
    got = sorted((r["file"][-5:], r["source_line"], r["code"]) for r in bad.collect() if r["source_line"])
    assert got == [("a.csv", 6, "INVALID_NUMBER"), ("a.csv", 7, "MALFORMED_ROW")]
    assert {(r["file"][-5:], r["code"]) for r in bad.where("source_line is null").collect()} == {("b.csv", "UNSUPPORTED_HEADER"), ("c.csv", "EMPTY_STREAM")}


def test_lines_are_numbered_across_byte_ranges(spark, tmp_path):
    """Ranges of a few bytes: many tasks a file, and the numbers of one pass over it."""
    bodies = {"a": "".join(f"line {i} {'x' * (i % 40)}\n" for i in range(400)), "b": "".join(f"{i}\r\n" for i in range(300)) + "end", "c": "", "d": "\ufeffone\n\ntwo"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.csv").write_bytes(body.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines, every = files._lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        got = {}
        for r in lines.collect():
            got.setdefault(r["file"][-5], []).append((r["source_line"], r["line"]))
        assert sorted(r["file"][-5] for r in every.collect()) == list("abd")  # Spark lists no empty files
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, body in bodies.items():
        want = body.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert sorted(got.get(name, [])) == [(i + 1, w) for i, w in enumerate(want)]


def test_native_csv_maps_to_the_canonical_header(spark, tmp_path):
    (tmp_path / "odometry.csv").write_text(", ".join(files.ODOMETRY_HEADER) + "\n1000.0, 0, 0,0,0, 0,0,0,1, 100,100,50,30,,\n")
    rows, bad = files.scan_native_csv(spark, str(tmp_path / "odometry.csv"), files.ODOMETRY_HEADER)
    assert bad.count() == 0
    r = files.map_native_columns(rows, 100, 60).first()
    assert (r["sensor_sec"], r["tracking_state"], r["exposure_sec"], r["width_px"], r["source_line"]) == ("1000.0", "unreported", "", "100", 2)


def test_metadata_codes(spark, tmp_path):
    (tmp_path / "meta.json").write_text('{"app": {"name": "other"}, "format_version": 1}')
    _, bad = files.scan_capture_metadata(spark, str(tmp_path / "meta.json"))
    codes = {r["code"] for r in bad.collect()}
    assert {"UNSUPPORTED_EXPORT_VERSION", "UNFINISHED_OR_WRONG_MODE", "MISSING_REQUIRED_STREAM"} <= codes


def test_inventory_roles_and_hashes(spark, tmp_path):
    (tmp_path / "depth").mkdir()
    (tmp_path / "wide.mp4").write_bytes(b"video")
    (tmp_path / "depth" / "000001.png").write_bytes(b"d")
    (tmp_path / "x.txt").write_bytes(b"x")
    for large in (1 << 30, 1):  # 1 sends every file through the chunked path
        got = {r["path"]: (r["role"], r["sha256"]) for r in files.inventory_assets(spark, str(tmp_path), large_bytes=large).collect()}
        assert got["wide.mp4"] == ("rgb", hashlib.sha256(b"video").hexdigest())
        assert got["depth/000001.png"][0] == "measured_depth_excluded" and got["x.txt"][0] == "auxiliary_excluded"


def test_frame_images(spark, tmp_path):
    for name in ("000001.png", "000012.png", "cover.png"):
        (tmp_path / name).write_bytes(b"any")
    frames, bad = files.scan_frame_images(spark, str(tmp_path))
    assert sorted(r["frame"] for r in frames.collect()) == [1, 12] and bad.count() == 1


def test_depth_arrays(spark, tmp_path):
    g = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "v.bin").write_bytes(b"4&3&1&" + g.tobytes())
    rows = files.scan_depth_arrays(spark, str(tmp_path)).collect()
    assert all(r["z"] == g[r["y"], r["x"]] for r in rows) and len(rows) == 12


def test_publish_once(spark, tmp_path):
    root, t = str(tmp_path / "out"), spark.createDataFrame([("c1", 1, 1.5)], "capture_id string, rank long, x double")
    bad = spark.createDataFrame([("p", "UNSAFE_BUNDLE_PATH")], "path string, code string")
    with pytest.raises(ContractViolation):
        publish.publish_once(spark, {"frames": t}, root, "c1", checks={"paths": bad})
    assert publish.read_manifests(spark, root).count() == 0
    publish.publish_once(spark, {"frames": t}, root, "c1", checks={"paths": bad.where("false")})
    publish.publish_once(spark, {"frames": t.withColumn("capture_id", F.lit("c2")).withColumn("extra", F.lit(1))}, root, "c2", schema="canonical-capture-2")
    with pytest.raises(ContractViolation) as e:
        publish.publish_once(spark, {"frames": t}, root, "c1")
    assert e.value.code == "OUTPUT_EXISTS"
    assert {(r["capture_id"], r["extra"]) for r in publish.open_capture(spark, root, "frames").collect()} == {("c1", None), ("c2", 1)}
    with pytest.raises(ContractViolation):
        publish.publish_once(spark, {"frames": t}, root, "c3", sources=[str(tmp_path)])


def test_photo_rooms_and_connections(spark, tmp_path):
    root = tmp_path / "house"
    for name in ("Kitchen/a.jpg", "Kitchen/b.PNG", "Kitchen 2/c.jpeg", "x/Kitchen/d.jpg", "Hall/e.heic", "notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    photos, bad = files.discover_photos(spark, str(root))
    assert {r["path"] for r in photos.collect()} == {"Kitchen/a.jpg", "Kitchen/b.PNG", "Kitchen 2/c.jpeg", "x/Kitchen/d.jpg"}
    assert [(r["path"], r["code"]) for r in bad.collect()] == [("Hall/e.heic", "UNSUPPORTED_IMAGE_FORMAT")]
    rooms = integrity.room_slugs(photos.select(F.lit("house").alias("capture_id"), "path"))
    assert {(r["folder"], r["room_id"]) for r in rooms.collect()} == {("Kitchen", "kitchen"), ("Kitchen 2", "kitchen-2"), ("x/Kitchen", "kitchen-3")}
    declared = spark.createDataFrame([("house", "Kitchen", 0, "x/Kitchen"), ("house", "Kitchen", 1, "Hall"), ("house", "Attic", 2, "Kitchen"), ("other", "Kitchen", 0, "Kitchen 2")],
                                     "capture_id string, folder string, position long, target string")
    links, left = integrity.room_connections(rooms, declared)
    assert [tuple(r) for r in links.collect()] == [("house", "kitchen", 0, "kitchen-3")]
    assert {(r["capture_id"], r["position"], r["missing"]) for r in left.collect()} == {("house", 1, "TARGET"), ("house", 2, "SOURCE"), ("other", 0, "SOURCE")}
    loose = spark.createDataFrame([("house", "kitchen"), ("house", "cellar")], "capture_id string, connected_room_id string")
    assert [tuple(r) for r in integrity.dangling_room_links(rooms, loose).collect()] == [("house", "cellar", "DANGLING_ROOM_LINK")]


def test_two_writers_one_publishes(spark, tmp_path):
    root, t = str(tmp_path / "out"), spark.createDataFrame([("c1", 1)], "capture_id string, rank long")

    def write(n):
        try:
            return publish.publish_once(spark, {"frames": t.withColumn("writer", F.lit(n))}, root, "c1")
        except ContractViolation as refused:
            return refused.code

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(write, range(4)))
    won = [i for i, g in enumerate(got) if g not in ("OUTPUT_CLAIMED", "OUTPUT_EXISTS")]
    assert len(won) == 1
    assert [r["writer"] for r in publish.open_capture(spark, root, "frames").collect()] == won
    assert publish.read_manifests(spark, root).count() == 1 and not [p for p in (tmp_path / "out" / "_claims").iterdir() if not p.name.startswith(".")]


def test_stale_claims(spark, tmp_path):
    root, t = str(tmp_path / "out"), spark.createDataFrame([("c1", 1)], "capture_id string, rank long")
    publish.claim(spark, root, "c1", "dead")
    with pytest.raises(ContractViolation) as e:
        publish.publish_once(spark, {"frames": t}, root, "c1", stale_after_sec=3600)
    assert e.value.code == "OUTPUT_CLAIMED"
    publish.publish_once(spark, {"frames": t}, root, "c1", stale_after_sec=0)
    assert publish.open_capture(spark, root, "frames").count() == 1
    with pytest.raises(ContractViolation) as e:
        publish.open_capture(spark, root, "poses")
    assert e.value.code == "CAPTURE_NOT_READY"


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(2, "b", 0.5), (1, "a", 1.5)], "k long, s string, x double").coalesce(1)
    publish.sink_csv_crlf(t, str(tmp_path / "csv"), ["k"])
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert data.count(b"\r\n") >= 3
    publish.sink_jsonl(t, str(tmp_path / "j"))
    assert files.scan_jsonl(spark, str(tmp_path / "j"), t.schema).count() == 2
    with pytest.raises(ContractViolation):
        publish.sink_jsonl(t.withColumn("x", F.lit(float("nan"))), str(tmp_path / "n"))


def test_manifest_roundtrip_detects_change(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1")
    before = integrity.build_manifest(files.inventory_assets(spark, str(tmp_path))).collect()
    m = spark.createDataFrame(before)
    (tmp_path / "a.bin").write_bytes(b"2")
    assert [r["code"] for r in integrity.artifact_check(m, files.inventory_assets(spark, str(tmp_path))).collect()] == ["ARTIFACT_CHANGED"]
