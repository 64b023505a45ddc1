"""Content identity, deduplication, references, record contracts, audits and lineage."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capstrata.functions import text as X
from capstrata.functions.numeric import equivalent
from capstrata.session import stage


class ContractViolation(ValueError):
    """Raised by ``enforce`` with the stable code of the first broken rule."""

    def __init__(self, code: str, message: str):
        self.code = code
        super().__init__(f"{code}: {message}")


def enforce(violations: DataFrame) -> None:
    """Stop publication when a validator found anything; reads one row."""
    row = violations.limit(1).collect()
    if row:
        raise ContractViolation(row[0]["code"], str(row[0].asDict()))


# --- content ------------------------------------------------------------------

def asset_identity(assets: DataFrame, prefix: str = "capture-") -> DataFrame:
    """One hash per capture over its sorted asset list.

    Large captures are hashed as a tree: assets fall into 65536 buckets by a hash of their
    path, each bucket hashes its own sorted lines, and the capture hashes its bucket hashes.
    No task gathers a whole capture, and equal contents still spread by path.
    """
    lines = assets.select("capture_id", F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 4).alias("_b"),
                          F.concat_ws("\t", "path", "sha256", F.col("bytes").cast("string")).alias("line"))
    buckets = lines.groupBy("capture_id", "_b").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("_h"), F.count("*").alias("_n"))
    return buckets.groupBy("capture_id").agg(
        F.sum("_n").alias("assets"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda s: s["_h"]), "\n").cast("binary"), 256).alias("identity")
    ).select("capture_id", "assets", "identity", F.concat(F.lit(prefix), F.substring("identity", 1, 16)).alias("content_id"))


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """One row per content hash: its first path, number of copies and distinct rooms."""
    return assets.groupBy("sha256").agg(
        F.min("path").alias("first_path"), F.count("*").alias("copies"), F.count_distinct("room_id").alias("rooms"),
        F.min_by("bytes", "path").alias("bytes"), F.min_by("asset_id", "path").alias("source_asset")).select(
        F.concat(F.lit("asset-"), F.substring("sha256", 1, 16)).alias("asset_id"), "sha256", "bytes", "first_path", "copies", "rooms", "source_asset")


def duplicate_findings(assets: DataFrame) -> DataFrame:
    """One finding row per path of a content that occurs more than once."""
    copies = assets.groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    return assets.join(copies, "sha256").select(
        F.concat(F.lit("asset-"), F.substring("sha256", 1, 16)).alias("asset_id"), "path", "copies", F.lit("DUPLICATE_IMAGE_CONTENT").alias("code"))


def observation_assets(assets: DataFrame) -> DataFrame:
    """One observation per path bound to the asset of its content."""
    return assets.select(
        F.concat(F.lit("obs-"), F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 16)).alias("observation_id"),
        F.concat(F.lit("asset-"), F.substring("sha256", 1, 16)).alias("asset_id"), "room_id", "path", X.file_name(F.col("path")).alias("native_frame_id"))


def room_counts(assets: DataFrame) -> DataFrame:
    """Images and distinct contents per room, with the photo tier of the capture set."""
    n = assets.groupBy("capture_id", "room_id").agg(F.count("*").alias("images"))
    d = assets.groupBy("capture_id").agg(F.count_distinct("sha256").alias("distinct_images"))
    return n.join(d, "capture_id").withColumn(
        "tier", F.when(F.col("distinct_images").between(2, 8), "PHOTO_PROFILE").otherwise("OUTSIDE_PHOTO_PROFILE"))


def room_slugs(paths: DataFrame) -> DataFrame:
    """A unique slug per photo folder of a capture.

    In folder order, a folder whose slug is taken gets the first free of slug-2, slug-3, ... Slugs can only meet
    others that differ by numeric suffixes, so these families are independent. A family with a single slug is
    numbered in slices, whatever its size; only in families with slugs such as "kitchen" and "kitchen-2" does the
    number depend on what earlier folders took, and only those are walked one by one.
    """
    from capstrata.operators.ordered import sequence_over

    folders = paths.select("capture_id", X.parent_path(F.col("path")).alias("folder")).distinct()
    base = X.slugify(F.when(F.col("folder") == "", F.col("capture_id")).otherwise(X.file_name(F.col("folder"))))
    named = stage(folders.withColumn("slug", base).withColumn("family", F.regexp_replace(base, "(-[0-9]+)+$", "")))
    mixed = named.groupBy("capture_id", "family").agg((F.min("slug") < F.max("slug")).alias("mixed"))
    marked = named.join(mixed, ["capture_id", "family"])
    seq = sequence_over(marked.where(~F.col("mixed")), ["capture_id", "slug"], ["folder"], rank="_i")
    numbered = seq.select("capture_id", "folder", F.when(F.col("_i") == 0, F.col("slug")).otherwise(
        F.concat("slug", F.lit("-"), (F.col("_i") + 1).cast("string"))).alias("room_id"))

    def walk(family):
        taken, following, ids = set(), {}, []
        family = family.sort_values("folder")
        for slug in family["slug"]:
            name, i = slug, following.get(slug, 2)
            while name in taken:
                name, i = f"{slug}-{i}", i + 1
            following[slug] = i
            taken.add(name)
            ids.append(name)
        return family.assign(room_id=ids)[["capture_id", "folder", "room_id"]]

    kind = named.schema["capture_id"].dataType.simpleString()
    walked = marked.where("mixed").groupBy("capture_id", "family").applyInPandas(walk, f"capture_id {kind}, folder string, room_id string")
    return numbered.unionByName(walked)


def room_connections(rooms: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared connections of folders as connections of rooms, and the declarations left out.

    ``rooms`` is a ``room_slugs`` result; ``declared`` has (capture_id, folder, position, target),
    both folders as declared. A declaration counts if both folders hold photos. The others come
    back with ``missing``: SOURCE or TARGET.
    """
    at = lambda folder, room: rooms.select("capture_id", F.col("folder").alias(folder), F.col("room_id").alias(room))
    j = declared.join(at("folder", "room_id"), ["capture_id", "folder"], "left").join(at("target", "connected_room_id"), ["capture_id", "target"], "left")
    missing = F.when(F.col("room_id").isNull(), "SOURCE").when(F.col("connected_room_id").isNull(), "TARGET")
    j = j.withColumn("missing", missing)
    return (j.where("missing IS NULL").select("capture_id", "room_id", "position", "connected_room_id"),
            j.where("missing IS NOT NULL").select("capture_id", "folder", "position", "target", "missing"))


def dangling_room_links(rooms: DataFrame, links: DataFrame) -> DataFrame:
    """Connections that name no room of their capture."""
    known = rooms.select("capture_id", F.col("room_id").alias("connected_room_id")).distinct()
    return links.join(known, ["capture_id", "connected_room_id"], "left_anti").select(
        "capture_id", "connected_room_id", F.lit("DANGLING_ROOM_LINK").alias("code")).distinct()


def photo_findings(photos: DataFrame) -> DataFrame:
    """Missing EXIF or time, a name that disagrees with the EXIF time, unapplied orientation.

    ``photos`` has path, has_exif, exif_time (ISO or NULL) and orientation.
    """
    named = X.filename_timestamp(X.file_stem(F.col("path")))
    codes = F.array_compact(F.array(
        F.when(~F.col("has_exif"), F.lit("MISSING_EXIF")),
        F.when(F.col("exif_time").isNull(), F.lit("MISSING_CAPTURE_TIMESTAMP")),
        F.when(F.col("exif_time").isNotNull() & (named != F.substring("exif_time", 1, 19)), F.lit("FILENAME_EXIF_TIME_DISCREPANCY")),
        F.when(F.coalesce("orientation", F.lit(1)) != 1, F.lit("EXIF_ORIENTATION_NOT_APPLIED"))))
    return photos.select("path", F.explode(codes).alias("code"))


def capability_flags(photos: DataFrame, keys: list[str]) -> DataFrame:
    flag = lambda c: F.when(F.bool_or(c), "PRESENT_UNVERIFIED").otherwise("ABSENT")
    return photos.groupBy(*keys).agg(flag(F.col("has_exif")).alias("exif"), flag(F.col("exif_time").isNotNull()).alias("timestamps"))


def lidar_findings(captures: DataFrame) -> DataFrame:
    """Standing convention flags, absent confidence, and a decoded count other than records - 1."""
    codes = F.array_compact(F.array(
        F.lit("DEPTH_UNITS_UNVERIFIED"), F.lit("CONVENTIONS_UNVERIFIED"), F.lit("IMU_UNITS_UNRESOLVED"),
        F.when(F.col("confidence_maps") == 0, F.lit("CONFIDENCE_ABSENT")),
        F.when((F.col("decoded_frames") != 0) & (F.col("decoded_frames") != F.col("camera_records") - 1), F.lit("RGB_FRAME_COUNT_DISCREPANCY"))))
    return captures.select("capture_id", F.explode(codes).alias("code"))


def union_findings(*findings: DataFrame) -> DataFrame:
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- references and records -----------------------------------------------------

def id_set_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Ids found on one side only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("LEFT_ONLY")).unionByName(
        b.join(a, keys, "left_anti").withColumn("side", F.lit("RIGHT_ONLY")))


def duplicate_ids(rows: DataFrame, key: str, code: str = "DUPLICATE_ID") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("uses")).where("uses > 1").select(F.col(key).cast("string").alias("id"), F.lit(code).alias("code"))


def dangling(rows: DataFrame, column: str, targets: DataFrame, target: str, code: str) -> DataFrame:
    """Distinct references that name no target row."""
    refs = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(target)).distinct()
    return refs.join(targets.select(target).distinct(), target, "left_anti").select(F.col(target).cast("string").alias("id"), F.lit(code).alias("code"))


def reference_resolution(references: DataFrame, observations: DataFrame) -> DataFrame:
    """Asset of each reference: exact path or name first, then a path ending in it, else a code.

    A suffix can only match at a slash, so each observation lists its own slash suffixes and
    the lookup is an equi-join. Earlier observations, by path, win within a priority.
    """
    ref = references.withColumn("_key", F.translate("reference", "\\", "/"))
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = observations.select("asset_id", "path", F.posexplode(tails).alias("_pos", "_key")).select(
        "asset_id", "path", "_key", F.when((F.col("_pos") == 0) | ~F.contains(F.col("_key"), F.lit("/")), 0).otherwise(1).alias("_rank"))
    best = ref.join(keys, "_key", "left").groupBy("reference").agg(F.min(F.struct("_rank", "path", "asset_id")).alias("_b"))
    found = F.col("_b._rank").isNotNull()
    return best.select("reference", F.when(found, F.col("_b.asset_id")).alias("asset_id"),
                       F.when(found, "RESOLVED").otherwise("UNKNOWN_REFERENCE_ASSET").alias("status"))


def unsafe_paths(rows: DataFrame, column: str = "path") -> DataFrame:
    return rows.where(~X.is_safe_relative_path(F.col(column))).select(F.col(column).alias("path"), F.lit("UNSAFE_BUNDLE_PATH").alias("code"))


def unsafe_names(rows: DataFrame, column: str = "path") -> DataFrame:
    return rows.where(~X.is_safe_upload_name(F.col(column))).select(F.col(column).alias("path"), F.lit("UNSAFE_FILENAME").alias("code"))


def path_case_collisions(members: DataFrame) -> DataFrame:
    """Path prefixes of one capture that differ only in case, and repeated members."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    p = members.select("capture_id", F.explode(prefixes).alias("prefix")).distinct()
    clash = p.groupBy("capture_id", F.lower("prefix").alias("folded")).agg(F.count("*").alias("spellings")).where("spellings > 1")
    same = members.groupBy("capture_id", F.lower("path").alias("folded")).agg(F.count("*").alias("spellings")).where("spellings > 1")
    return clash.withColumn("code", F.lit("CASE_COLLISION")).unionByName(same.withColumn("code", F.lit("DUPLICATE_MEMBER")))


def expanded_size_violations(members: DataFrame, limit: int, member_limit: int) -> DataFrame:
    t = members.groupBy("capture_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("members"))
    return t.where((F.col("bytes") > limit) | (F.col("members") > member_limit)).withColumn(
        "code", F.when(F.col("members") > member_limit, "TOO_MANY_FILES").otherwise("CAPTURE_TOO_LARGE"))


#: Which Spark types carry a declared type.
CARRIERS = {
    "integer": (T.IntegerType, T.LongType, T.ShortType), "number": (T.NumericType,), "string": (T.StringType,), "boolean": (T.BooleanType,),
    "array": (T.ArrayType,), "object": (T.StructType, T.MapType),
}
#: Keywords that judge a present value alone: rule code and predicate of the value and the keyword's argument.
VALUE_RULES: dict[str, tuple[str, Callable[[Column, Any], Column]]] = {
    "const": ("OTHER_VALUE", lambda v, a: v != F.lit(a)),
    "enum": ("UNLISTED_VALUE", lambda v, a: ~v.isin(*a)),
    "minimum": ("TOO_SMALL", lambda v, a: v < a),
    "maximum": ("TOO_LARGE", lambda v, a: v > a),
    "pattern": ("WRONG_FORM", lambda v, a: ~v.rlike(a if a.startswith("^") else f"^(?:{a})")),
    "minLength": ("TOO_SHORT", lambda v, a: F.length(v) < a),
    "minItems": ("TOO_FEW", lambda v, a: F.size(v) < a),
    "maxItems": ("TOO_MANY", lambda v, a: F.size(v) > a),
}
#: A rule of a contract: where it holds, its code, and what breaks it, given the column it is applied to.
Rule = tuple[str, str, Callable[[Column], Column]]


def contract_rules(kind: T.DataType, contract: dict, path: str, optional: bool = False, own: frozenset[str] = frozenset()) -> list[Rule]:
    """All rules that a contract sets for a value of this Spark type, those of its parts included.

    The parts of objects are reached by name; items of arrays and values of maps are judged one by one, whatever
    they are, and a rule is broken when any of them breaks it. ``own`` names fields the contract need not declare.
    """
    declared = contract.get("type", [])
    names = [declared] if isinstance(declared, str) else list(declared)
    if any(n != "null" for n in names) and not any(isinstance(kind, CARRIERS[n]) for n in names if n != "null"):
        return [(path, "WRONG_TYPE", lambda v: v.isNotNull())]
    out: list[Rule] = []
    if names and "null" not in names and not optional:
        out.append((path, "WRONG_TYPE", lambda v: v.isNull()))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        out.append((path, "NOT_FINITE", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    for word, (code, breaks) in VALUE_RULES.items():
        if word in contract:
            out.append((path, code, lambda v, breaks=breaks, a=contract[word]: v.isNotNull() & breaks(v, a)))
    part = lambda name: f"{path}.{name}" if path else name
    extra = contract.get("additionalProperties", True)
    if isinstance(kind, T.ArrayType) and "items" in contract:
        for where, code, breaks in contract_rules(kind.elementType, contract["items"], f"{path}[]"):
            out.append((where, code, lambda v, breaks=breaks: F.exists(v, lambda x: breaks(x))))
    elif isinstance(kind, T.MapType) and isinstance(extra, dict):
        for where, code, breaks in contract_rules(kind.valueType, extra, part("*")):
            out.append((where, code, lambda v, breaks=breaks: F.exists(F.map_values(v), lambda x: breaks(x))))
    elif isinstance(kind, T.StructType):
        known, needed = contract.get("properties", {}), contract.get("required", [])
        there = {f.name: f.dataType for f in kind.fields}
        out += [(part(n), "REQUIRED", lambda v: v.isNotNull()) for n in needed if n not in there]
        for name, inner in there.items():
            if name in known:
                rules = contract_rules(inner, known[name], part(name), name not in needed)
            elif isinstance(extra, dict):
                rules = contract_rules(inner, extra, part(name), True)
            else:
                rules = [(part(name), "NOT_DECLARED", lambda v: v.isNotNull())] if extra is False and name not in own else []
            out += [(where, code, lambda v, name=name, breaks=breaks: v.isNotNull() & breaks(v[name])) for where, code, breaks in rules]
    return out


def validate_record(rows: DataFrame, schema: dict, key: str) -> DataFrame:
    """Broken rules of a document contract, one row each ("place: RULE"), from predicates made of the schema.

    Understands type (lists of types included), enum, const, minimum, maximum, pattern, minLength, minItems, maxItems,
    items, properties, required and additionalProperties (yes, no, or a schema), at any depth.
    """
    record = F.struct(*[F.col(c) for c in rows.columns])
    rules = contract_rules(rows.schema, schema, "", own=frozenset([key]))
    found = [F.when(F.coalesce(breaks(F.col("_record")), F.lit(False)), F.lit(f"{place}: {code}")) for place, code, breaks in rules]
    return rows.select(F.col(key).cast("string").alias("id"), record.alias("_record")).select(
        "id", F.explode(F.array_compact(F.array(*found))).alias("violation"), F.lit("INVALID_DOCUMENT").alias("code"))


# Roles each consumer profile may read.
ROLE_ALLOWLIST = {
    "ios_preprocessing": ["rgb", "pose_calibration", "accelerometer", "gyroscope", "device_motion"],
    "video_rgb": ["rgb"],
    "ios_assisted_rgb": ["rgb", "metadata", "pose_calibration", "accelerometer", "gyroscope", "device_motion", "magnetometer",
                         "user_scale_prior", "imu_native"],
    "evaluation": ["rgb", "metadata", "pose_calibration", "accelerometer", "gyroscope", "device_motion", "magnetometer",
                   "user_scale_prior", "measured_depth_excluded", "evaluation_reference", "imu_native"],
}
# Frame columns the RGB-only profile may see.
VIDEO_RGB_COLUMNS = ["frame_id", "camera_id", "video_asset_id", "decoded_rank", "media_pts_ticks", "media_timebase", "decoded_status"]


def project_for_profile(assets: DataFrame, profile: str, allowlist: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Assets a profile may read, and the access log with every denial."""
    allowed = (allowlist or ROLE_ALLOWLIST).get(profile)
    if allowed is None:
        raise ContractViolation("UNKNOWN_PROFILE", profile)
    ok = F.col("role").isin(allowed)
    log = assets.groupBy("role").agg(F.count("*").alias("assets")).select(
        F.lit(profile).alias("profile"), "role", "assets", F.when(ok, "CONSUMED").otherwise("INPUT_ROLE_DENIED").alias("outcome"))
    return assets.where(ok), log


def profile_frames(frames: DataFrame, profile: str) -> DataFrame:
    if profile not in ROLE_ALLOWLIST:
        raise ContractViolation("UNKNOWN_PROFILE", profile)
    return frames.select(*[c for c in frames.columns if c in VIDEO_RGB_COLUMNS]) if profile == "video_rgb" else frames


def admitted_roles(requested: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requested roles that are allowed, each once; an aggregate, since a join by role would gather its rows in one task."""
    side = lambda df, asked: df.select("role", F.lit(asked).alias("_asked"), F.lit(not asked).alias("_allowed"))
    both = side(requested, True).union(side(allowed, False)).groupBy("role").agg(F.max("_asked").alias("_asked"), F.max("_allowed").alias("_allowed"))
    return both.where("_asked AND _allowed").select("role")


# --- audits -------------------------------------------------------------------

def audit_diff(stored: DataFrame, derived: DataFrame, keys: list[str], exact: list[str], floats: list[str]) -> DataFrame:
    """Long table of differences: rows on one side only and values that disagree."""
    s = stored.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in [*exact, *floats]], F.lit(True).alias("_s"))
    d = derived.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in [*exact, *floats]], F.lit(True).alias("_d"))
    j = s.join(d, keys, "full_outer")
    both = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    rules = [F.when(F.col("_d").isNull(), F.lit("STORED_ONLY")), F.when(F.col("_s").isNull(), F.lit("DERIVED_ONLY"))]
    for c in [*exact, *floats]:
        same = equivalent(F.col(f"_s_{c}"), F.col(f"_d_{c}"), c in floats)
        rules.append(F.when(both & ~same, F.lit(f"CHANGED:{c}")))
    return j.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("difference"))


def hash_leaves(rows: DataFrame, group: str, keys: list[str], values: list[str], buckets: int) -> DataFrame:
    """(group, bucket, n, sum, xor): digests of the rows of each bucket, whatever their order.

    Two independent 64-bit hashes of every row's bits are summed and xor-ed by partial aggregates, so rows do not move.
    """
    cols = [*keys, *values]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    return rows.select(group, bucket, F.xxhash64(*cols).cast("decimal(38,0)").alias("_h1"), F.xxhash64(F.lit("second"), *cols).alias("_h2")).groupBy(group, "_bucket").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("_h1").alias("s"), F.bit_xor("_h2").alias("x")).alias("_digest"))


def tree_audit(stored: DataFrame, derived: DataFrame, group: str, keys: list[str], exact: list[str], floats: list[str], buckets: int = 1024) -> DataFrame:
    """`audit_diff` of large tables by a hash tree over (group, bucket, rows).

    Both sides are first reduced to one digest per group and bucket of keys. Groups whose digests agree are done, then
    buckets of the others; only rows of buckets that disagree are joined and compared value by value, with the usual
    tolerance for floats. Equal bits are equal values, so agreement never hides a difference (but for a collision of two
    64-bit digests and a count). `keys` include `group`; repeated rows of a key meet their counterparts row by row.
    """
    values = [*exact, *floats]
    same = lambda df: df.select(*[F.col(c).cast(stored.schema[c].dataType) for c in [*keys, *values]])
    sides = [same(stored), same(derived)]
    leaves = [stage(hash_leaves(df, group, keys, values, buckets)) for df in sides]
    tops = [df.groupBy(group).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("_bucket", "_digest").cast("decimal(38,0)")).alias("s")).alias(name)) for df, name in zip(leaves, ("_a", "_b"))]
    open_groups = tops[0].join(tops[1], group, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(group)
    a, b = (df.join(open_groups, group, "left_semi").withColumnRenamed("_digest", name) for df, name in zip(leaves, ("_a", "_b")))
    differing = stage(a.join(b, [group, "_bucket"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(group, "_bucket"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    some = [df.withColumn("_bucket", bucket).join(differing, [group, "_bucket"], "left_semi").drop("_bucket") for df in sides]
    return audit_diff(some[0], some[1], keys, exact, floats)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose content differs between two inventories of a source."""
    b = before.select("path", F.col("sha256").alias("before"))
    a = after.select("path", F.col("sha256").alias("after"))
    return b.join(a, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("path", F.lit("SOURCE_CHANGED").alias("code"))


def artifact_check(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Declared artifacts that are missing, changed, undeclared, or outside the bundle."""
    m = manifest.select("path", F.col("sha256").alias("declared"), F.lit(True).alias("_m"))
    f = found.select("path", F.col("sha256").alias("actual"))
    j = m.join(f, "path", "full_outer")
    code = (F.when(~X.is_safe_relative_path(F.col("path")), "SOURCE_PATH_ESCAPE").when(F.col("_m").isNull(), "UNDECLARED_ARTIFACT")
            .when(F.col("actual").isNull(), "MISSING_ARTIFACT").when(F.col("actual") != F.col("declared"), "ARTIFACT_CHANGED"))
    return j.select("path", code.alias("code")).where("code IS NOT NULL")


def build_manifest(artifacts: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Relative path to content hash for every artifact but the excluded runtime files."""
    return artifacts.where(~F.col("path").isin(excluded or ["runtime.json"])).select("path", "sha256")


def lineage_breaks(lineage: DataFrame) -> DataFrame:
    """Stage manifests whose parent hash is no published manifest of the parent stage.

    Every link of a chain is a row, so one equi-join checks the chain transitively.
    """
    parents = lineage.select("capture_id", F.col("stage").alias("parent_stage"), F.col("manifest_hash").alias("parent_hash")).distinct()
    return lineage.where(F.col("parent_stage").isNotNull()).join(parents, ["capture_id", "parent_stage", "parent_hash"], "left_anti").select(
        "capture_id", "stage", "parent_stage", F.lit("SOURCE_CHANGED").alias("code"))


# --- jobs and catalog -----------------------------------------------------------

TERMINAL_STATES = ["SUCCEEDED", "FAILED"]


def newest_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_sec"), F.desc("job_id")).limit(n)


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("owner_id").agg(F.count("*").alias("jobs"), F.count_if(~F.col("state").isin(TERMINAL_STATES)).alias("pending"))


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("modality", "state").agg(F.count("*").alias("jobs"), F.max("created_sec").cast("double").alias("latest_sec"))


def catalog_listing(manifests: DataFrame, artifacts: DataFrame, required: list[str]) -> DataFrame:
    """Published results whose required assets all exist, newest first within the listing."""
    have = artifacts.where(F.col("name").isin(required)).groupBy("result_id").agg(F.count_distinct("name").alias("_n")).where(F.col("_n") == len(required))
    ok = manifests.where(F.col("result_id").rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$"))
    return ok.join(have.select("result_id"), "result_id", "left_semi").orderBy(F.desc("published_sec"), F.desc("result_id"))
