"""Queries over assets, documents, records, audits, jobs and catalogs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from capstrata.functions import text as X
from capstrata.functions.numeric import exact_integer, exact_number
from capstrata.operators import integrity as ig
from capstrata.plans.q_timeseries import r6c
from capstrata.plans.registry import query, r6
from capstrata.session import run_folder
from capstrata.sources import files
from capstrata.session import stage


@query("asset_identity", "assets", sql="""
    WITH b AS (SELECT capture_id, substr(sha256(path), 1, 4) AS b, count(*) AS n, sha256(string_agg(path || chr(9) || sha256 || chr(9) || bytes, chr(10) ORDER BY path || chr(9) || sha256 || chr(9) || bytes)) AS h FROM assets GROUP BY ALL),
      i AS (SELECT capture_id, CAST(sum(n) AS BIGINT) AS assets, sha256(string_agg(h, chr(10) ORDER BY b)) AS identity FROM b GROUP BY ALL)
    SELECT *, 'capture-' || substr(identity, 1, 16) AS content_id FROM i""")
def asset_identity(v):
    return ig.asset_identity(v.assets)


@query("dedupe_assets", "assets", sql="""
    SELECT 'asset-' || substr(sha256, 1, 16) AS asset_id, sha256, arg_min(bytes, path) AS bytes, min(path) AS first_path, count(*) AS copies, count(DISTINCT room_id) AS rooms,
      arg_min(asset_id, path) AS source_asset FROM assets a GROUP BY sha256""")
def dedupe_assets(v):
    return ig.dedupe_assets(v.assets)


@query("duplicate_findings", "assets", sql="""
    SELECT 'asset-' || substr(sha256, 1, 16) AS asset_id, path, n AS copies, 'DUPLICATE_IMAGE_CONTENT' AS code FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n FROM assets) WHERE n > 1""")
def duplicate_findings(v):
    return ig.duplicate_findings(v.assets)


@query("observation_assets", "assets", sql="""
    SELECT 'obs-' || substr(sha256(path), 1, 16) AS observation_id, 'asset-' || substr(sha256, 1, 16) AS asset_id, room_id, path, regexp_extract(path, '[^/]*$') AS native_frame_id FROM assets""")
def observation_assets(v):
    return ig.observation_assets(v.assets)


@query("room_counts", "assets", sql="""
    SELECT n.*, d AS distinct_images, CASE WHEN d BETWEEN 2 AND 8 THEN 'PHOTO_PROFILE' ELSE 'OUTSIDE_PHOTO_PROFILE' END AS tier FROM
      (SELECT capture_id, room_id, count(*) AS images FROM assets GROUP BY ALL) n JOIN (SELECT capture_id, count(DISTINCT sha256) AS d FROM assets GROUP BY ALL) USING (capture_id)""")
def room_counts(v):
    return ig.room_counts(v.assets)


SLUG_NAMES = ["Kitchen", "Kitchen 2", "kitchen", "Hall", "hall-2", "Hall 2 2", "kitchen-3"]
SLUG_FOLDERS = f"""SELECT DISTINCT 'c' || (doc_id % 5) AS capture_id, 'f' || (doc_id // 40) || '/' || CASE WHEN doc_id % 8 = 7 THEN source ELSE [{', '.join(f"'{n}'" for n in SLUG_NAMES)}][1 + doc_id % 8] END AS folder FROM documents"""


ROOMS = f"""
    WITH RECURSIVE s AS (SELECT capture_id, folder, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_extract(folder, '[^/]*$')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'room') AS slug FROM ({SLUG_FOLDERS})),
      o AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY folder) AS n FROM s),
      w AS (SELECT capture_id, folder, n, slug AS room_id, [slug] AS taken FROM o WHERE n = 1
        UNION ALL SELECT capture_id, folder, n, room_id, list_append(taken, room_id) FROM (
          SELECT o.capture_id, o.folder, o.n, w.taken, CASE WHEN list_contains(w.taken, o.slug) THEN o.slug || '-' || list_filter(range(2, 3 + len(w.taken)), lambda i: NOT list_contains(w.taken, o.slug || '-' || i))[1] ELSE o.slug END AS room_id
          FROM w JOIN o ON o.capture_id = w.capture_id AND o.n = w.n + 1))
    SELECT capture_id, folder, room_id FROM w"""


def _folder(d):
    name = F.coalesce(F.get(F.array(*map(F.lit, SLUG_NAMES)), (d % 8).cast("int")), F.col("source"))
    return F.concat(F.lit("f"), F.floor(d / 40).cast("string"), F.lit("/"), name)


def slug_rooms(v):
    d = F.col("doc_id")
    p = v.table("documents").select(F.concat(F.lit("c"), (d % 5).cast("string")).alias("capture_id"), F.concat(_folder(d), F.lit("/x.jpg")).alias("path"))
    return ig.room_slugs(p)


@query("room_slugs", sql=ROOMS)
def room_slugs(v):
    return slug_rooms(v)


def _folder_sql(d):
    return f"""'f' || ({d} // 40) || '/' || CASE WHEN {d} % 8 = 7 THEN source ELSE [{', '.join(f"'{n}'" for n in SLUG_NAMES)}][1 + {d} % 8] END"""


# Every document declares that its folder leads to that of the fifth document after it; some of these hold no photos.
DECLARED = f"""SELECT 'c' || (doc_id % 5) AS capture_id, doc_id AS position, {_folder_sql('doc_id')} || CASE WHEN doc_id % 17 = 0 THEN ' old' ELSE '' END AS folder, {_folder_sql('(doc_id + 5)')} AS target FROM documents"""
LINKS = f"""SELECT d.*, r.room_id, t.room_id AS connected_room_id FROM ({DECLARED}) d LEFT JOIN ({ROOMS}) r ON r.capture_id = d.capture_id AND r.folder = d.folder
    LEFT JOIN ({ROOMS}) t ON t.capture_id = d.capture_id AND t.folder = d.target"""


def connections(v):
    d = F.col("doc_id")
    declared = v.table("documents").select(
        F.concat(F.lit("c"), (d % 5).cast("string")).alias("capture_id"), d.alias("position"),
        F.concat(_folder(d), F.when(d % 17 == 0, " old").otherwise("")).alias("folder"), _folder(d + 5).alias("target"))
    return ig.room_connections(stage(slug_rooms(v)), declared)


@query("room_connections", sql=f"SELECT capture_id, room_id, position, connected_room_id FROM ({LINKS}) WHERE room_id IS NOT NULL AND connected_room_id IS NOT NULL")
def room_connections(v):
    return connections(v)[0]


@query("unresolved_connections", sql=f"""SELECT capture_id, folder, position, target, CASE WHEN room_id IS NULL THEN 'SOURCE' ELSE 'TARGET' END AS missing
    FROM ({LINKS}) WHERE room_id IS NULL OR connected_room_id IS NULL""")
def unresolved_connections(v):
    return connections(v)[1]


_STEM = "printf('%04d%02d%02d_%02d%02d%02d', 2000 + doc_id % 30, 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24, doc_id % 60, n_chars % 60)"
PHOTOS = f"""SELECT 'room/' || CASE WHEN doc_id % 5 = 0 THEN 'IMG_' || doc_id ELSE {_STEM} END || '.jpg' AS path, lang, doc_id % 7 <> 0 AS has_exif,
    CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN printf('%04d-%02d-%02dT%02d:%02d:%02d', 2000 + doc_id % 30, 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24, doc_id % 60, (n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 60) END AS exif_time,
    doc_id % 4 + 1 AS orientation FROM documents"""


def photos(v):
    d = F.col("doc_id")
    i = lambda c: c.cast("int")
    date = [i(2000 + d % 30), i(1 + d % 12), i(1 + d % 28), i(d % 24), i(d % 60)]
    stem = F.format_string("%04d%02d%02d_%02d%02d%02d", *date, i(F.col("n_chars") % 60))
    iso = F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", *date, i((F.col("n_chars") + F.when(d % 3 == 0, 1).otherwise(0)) % 60))
    return v.table("documents").select(
        F.concat(F.lit("room/"), F.when(d % 5 == 0, F.concat(F.lit("IMG_"), d.cast("string"))).otherwise(stem), F.lit(".jpg")).alias("path"), "lang",
        (d % 7 != 0).alias("has_exif"), F.when((d % 7 != 0) & (d % 11 != 0), iso).alias("exif_time"), (d % 4 + 1).alias("orientation"))


_NAME_TIME = "CASE WHEN regexp_matches(path, '^room/\\d{8}_\\d{6}\\.jpg$') THEN regexp_replace(regexp_extract(path, '(\\d{8}_\\d{6})', 1), '(\\d{4})(\\d{2})(\\d{2})_(\\d{2})(\\d{2})(\\d{2})', '\\1-\\2-\\3T\\4:\\5:\\6') END"


@query("filename_times", sql=f"SELECT path, {_NAME_TIME} AS filename_time FROM ({PHOTOS})")
def filename_times(v):
    return photos(v).select("path", X.filename_timestamp(X.file_stem(F.col("path"))).alias("filename_time"))


@query("photo_findings", sql=f"""
    WITH p AS ({PHOTOS}) SELECT path, 'MISSING_EXIF' AS code FROM p WHERE NOT has_exif UNION ALL SELECT path, 'MISSING_CAPTURE_TIMESTAMP' FROM p WHERE exif_time IS NULL
    UNION ALL SELECT path, 'FILENAME_EXIF_TIME_DISCREPANCY' FROM p WHERE exif_time IS NOT NULL AND {_NAME_TIME} <> exif_time UNION ALL SELECT path, 'EXIF_ORIENTATION_NOT_APPLIED' FROM p WHERE orientation <> 1""")
def photo_findings(v):
    return ig.photo_findings(photos(v))


@query("capability_flags", sql=f"""SELECT lang, CASE WHEN bool_or(has_exif) THEN 'PRESENT_UNVERIFIED' ELSE 'ABSENT' END AS exif,
    CASE WHEN bool_or(exif_time IS NOT NULL) THEN 'PRESENT_UNVERIFIED' ELSE 'ABSENT' END AS timestamps FROM ({PHOTOS}) GROUP BY lang""")
def capability_flags(v):
    return ig.capability_flags(photos(v), ["lang"])


_EXIF = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE printf(CASE WHEN doc_id % 2 = 0 THEN '%04d:%02d:%02d %02d:%02d:%02d' ELSE '%04d-%02d-%02d %02d:%02d:%02d' END,
    2000 + doc_id % 30, 1 + doc_id % 14, 1 + doc_id % 28, doc_id % 24, doc_id % 60, n_chars % 60) END AS original, CASE WHEN doc_id % 8 <> 0 THEN '2024:05:06 07:08:09' END AS modified,
    CASE doc_id % 3 WHEN 0 THEN '+05:30' WHEN 1 THEN '5:30' END AS off FROM documents"""


@query("capture_times", sql=f"""
    WITH e AS (SELECT *, coalesce(original, modified) AS raw FROM ({_EXIF})), d AS (SELECT *, replace(substr(raw, 1, 10), ':', '-') || substr(raw, 11) AS dashed FROM e),
      l AS (SELECT *, CASE WHEN try_cast(dashed AS TIMESTAMP) IS NOT NULL THEN substr(dashed, 1, 10) || 'T' || substr(dashed, 12) END AS local, coalesce(off = '+05:30', false) AS zoned FROM d)
    SELECT doc_id, CASE WHEN zoned THEN local || off ELSE local END AS value, CASE WHEN local IS NOT NULL AND zoned THEN off END AS timezone,
      CASE WHEN original IS NOT NULL THEN 'EXIF_DateTimeOriginal' ELSE 'EXIF_DateTime' END AS source,
      CASE WHEN local IS NULL THEN 'unknown' WHEN zoned THEN 'local_clock' ELSE 'local_clock_unknown_offset' END AS domain FROM l""")
def capture_times(v):
    d = F.col("doc_id")
    i = lambda c: c.cast("int")
    parts = [i(2000 + d % 30), i(1 + d % 14), i(1 + d % 28), i(d % 24), i(d % 60), i(F.col("n_chars") % 60)]
    original = F.when(d % 4 != 0, F.when(d % 2 == 0, F.format_string("%04d:%02d:%02d %02d:%02d:%02d", *parts)).otherwise(F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *parts)))
    modified = F.when(d % 8 != 0, F.lit("2024:05:06 07:08:09"))
    off = F.when(d % 3 == 0, F.lit("+05:30")).when(d % 3 == 1, F.lit("5:30"))
    return v.table("documents").select("doc_id", X.capture_timestamp(original, modified, off).alias("t")).select("doc_id", "t.*")


@query("union_findings", "assets", sql=f"""
    SELECT asset_id, path, code FROM (SELECT 'asset-' || substr(sha256, 1, 16) AS asset_id, path, count(*) OVER (PARTITION BY sha256) AS n, 'DUPLICATE_IMAGE_CONTENT' AS code FROM assets) WHERE n > 1
    UNION ALL SELECT NULL, path, 'MISSING_EXIF' FROM ({PHOTOS}) WHERE NOT has_exif""")
def union_findings(v):
    return ig.union_findings(ig.duplicate_findings(v.assets).drop("copies"), ig.photo_findings(photos(v)).where("code = 'MISSING_EXIF'"))


@query("id_set_mismatch", sql="""
    SELECT doc_id, 'LEFT_ONLY' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'RIGHT_ONLY' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def id_set_mismatch(v):
    return ig.id_set_mismatch(v.table("documents"), v.table("labels"), ["doc_id"])


@query("referential_violations", sql="""
    SELECT CAST(l_orderkey AS VARCHAR) AS id, 'DUPLICATE_ID' AS code FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'DANGLING_ASSET_LINK' FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def referential_violations(v):
    lines = v.table("lineitem")
    return ig.duplicate_ids(lines, "l_orderkey").unionByName(ig.dangling(v.table("orders"), "o_orderkey", lines.withColumnRenamed("l_orderkey", "key"), "key", "DANGLING_ASSET_LINK"))


@query("reference_resolution", "assets", sql="""
    WITH r AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'IMG_' || conv_id || '.jpg' WHEN 1 THEN 'en/IMG_' || conv_id || '.jpg' ELSE 'none/' || conv_id END AS reference FROM (SELECT DISTINCT conv_id FROM conversations)),
      o AS (SELECT asset_id, path, regexp_extract(path, '[^/]*$') AS name FROM assets),
      c AS (SELECT reference, path, asset_id, 0 AS p FROM r JOIN o ON o.name = r.reference UNION ALL SELECT reference, path, asset_id, 0 FROM r JOIN o ON o.path = r.reference
            UNION ALL SELECT reference, path, asset_id, 1 FROM r JOIN o ON ends_with(o.path, '/' || r.reference)),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY p, path, asset_id) AS pos FROM c) WHERE pos = 1)
    SELECT r.reference, asset_id, CASE WHEN asset_id IS NULL THEN 'UNKNOWN_REFERENCE_ASSET' ELSE 'RESOLVED' END AS status FROM r LEFT JOIN b USING (reference)""")
def reference_resolution(v):
    c = F.col("conv_id").cast("string")
    k = F.col("conv_id") % 3
    r = v.table("conversations").select("conv_id").distinct().select(
        F.when(k == 0, F.concat(F.lit("IMG_"), c, F.lit(".jpg"))).when(k == 1, F.concat(F.lit("en/IMG_"), c, F.lit(".jpg"))).otherwise(F.concat(F.lit("none/"), c)).alias("reference"))
    return ig.reference_resolution(r, v.assets.select("asset_id", "path"))


@query("unsafe_paths", sql="""SELECT url AS path, 'UNSAFE_BUNDLE_PATH' AS code FROM pages WHERE contains(url, '\\') OR starts_with(url, '/') OR url = ''
    OR list_has_any(string_split(url, '/'), ['', '.', '..'])""")
def unsafe_paths(v):
    return ig.unsafe_paths(v.table("pages").withColumnRenamed("url", "path"))


@query("unsafe_names", sql="""SELECT url AS path, 'UNSAFE_FILENAME' AS code FROM pages WHERE starts_with(url, '/') OR len(list_filter(string_split(regexp_replace(url, '/+$', ''), '/'),
    lambda p: p IN ('', '.', '..') OR regexp_matches(p, '[. ]$') OR regexp_matches(p, '[\\x00-\\x1f:<>"|?*]'))) > 0""")
def unsafe_names(v):
    return ig.unsafe_names(v.table("pages").withColumnRenamed("url", "path"))


MEMBERS = """SELECT source AS capture_id, CASE WHEN doc_id % 9 = 0 THEN upper(lang) ELSE lang END || '/IMG_' || doc_id % 40 || '.jpg' AS path, n_chars AS bytes FROM documents"""


def members(v):
    d = F.col("doc_id")
    return v.table("documents").select(F.col("source").alias("capture_id"), F.concat(
        F.when(d % 9 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("/IMG_"), (d % 40).cast("string"), F.lit(".jpg")).alias("path"), F.col("n_chars").alias("bytes"))


@query("path_case_collisions", sql=f"""
    WITH m AS ({MEMBERS}), p AS (SELECT DISTINCT capture_id, unnest([split_part(path, '/', 1), path]) AS prefix FROM m)
    SELECT capture_id, lower(prefix) AS folded, count(*) AS spellings, 'CASE_COLLISION' AS code FROM p GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT capture_id, lower(path), count(*), 'DUPLICATE_MEMBER' FROM m GROUP BY ALL HAVING count(*) > 1""")
def path_case_collisions(v):
    return ig.path_case_collisions(members(v))


@query("expanded_size", sql=f"""SELECT capture_id, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS members, CASE WHEN count(*) > 100 THEN 'TOO_MANY_FILES' ELSE 'CAPTURE_TOO_LARGE' END AS code
    FROM ({MEMBERS}) GROUP BY ALL HAVING sum(bytes) > 40000 OR count(*) > 100""")
def expanded_size(v):
    return ig.expanded_size_violations(members(v), 40000, 100)


ORDER_CONTRACT = {
    "required": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], "additionalProperties": False,
    "properties": {"o_orderkey": {"type": "integer", "minimum": 0}, "o_orderstatus": {"type": "string", "enum": ["O", "F"]},
                   "o_totalprice": {"type": "number", "minimum": 1000, "maximum": 400000}, "o_orderpriority": {"type": "string", "pattern": "^[1-4]-"},
                   "o_custkey": {"type": "integer"}, "o_orderdate": {}},
}


@query("record_violations", sql="""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'o_orderstatus: UNLISTED_VALUE' AS violation, 'INVALID_DOCUMENT' AS code FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_totalprice: TOO_SMALL', 'INVALID_DOCUMENT' FROM orders WHERE o_totalprice < 1000
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_totalprice: TOO_LARGE', 'INVALID_DOCUMENT' FROM orders WHERE o_totalprice > 400000
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderpriority: WRONG_FORM', 'INVALID_DOCUMENT' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')""")
def record_violations(v):
    return ig.validate_record(v.table("orders"), ORDER_CONTRACT, "o_orderkey")


ACCOUNT_CONTRACT = {
    "properties": {
        "account": {"type": "object", "properties": {"name": {"type": "string", "pattern": "Customer#0*[1-9]\\d?0$"}}, "required": ["name", "iban"], "additionalProperties": False},
        "marks": {"type": "array", "minItems": 2, "items": {"type": "object", "properties": {"segment": {"enum": ["BUILDING", "MACHINERY"]}, "nation": {"maximum": 20}}}},
        "limits": {"type": "object", "additionalProperties": {"type": "number", "minimum": 0}},
    },
    "additionalProperties": False,
}


@query("nested_record_violations", sql="""
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, * FROM customer), v AS (
      SELECT id, 'account.iban: REQUIRED' AS violation FROM c UNION ALL SELECT id, 'account.balance: NOT_DECLARED' FROM c
      UNION ALL SELECT id, 'account.name: WRONG_FORM' FROM c WHERE NOT regexp_matches(c_name, '^Customer#0*[1-9]\\d?0$')
      UNION ALL SELECT id, 'marks: TOO_FEW' FROM c WHERE c_nationkey % 3 = 0
      UNION ALL SELECT id, 'marks[].segment: UNLISTED_VALUE' FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
      UNION ALL SELECT id, 'marks[].nation: TOO_LARGE' FROM c WHERE c_nationkey > 20
      UNION ALL SELECT id, 'limits.*: TOO_SMALL' FROM c WHERE c_acctbal < 0)
    SELECT id, violation, 'INVALID_DOCUMENT' AS code FROM v""")
def nested_record_violations(v):
    mark = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    c = v.table("customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("account"),
                                   F.when(F.col("c_nationkey") % 3 == 0, F.array(mark)).otherwise(F.array(mark, mark)).alias("marks"), F.create_map(F.lit("credit"), F.col("c_acctbal")).alias("limits"))
    return ig.validate_record(c, ACCOUNT_CONTRACT, "c_custkey")


@query("exact_numbers", sql=r"""
    WITH s AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN n_chars || '.500000' WHEN 2 THEN 'NaN' WHEN 3 THEN ' ' || n_chars || '.000 ' WHEN 4 THEN lang
      WHEN 5 THEN n_chars || '.0000005' WHEN 6 THEN '1e-7' WHEN 7 THEN '17000000000000' || lpad(CAST(n_chars % 100000 AS VARCHAR), 5, '0') WHEN 8 THEN (n_chars % 9 + 1) || '23456789012345.5' WHEN 9 THEN '-1.0000001' ELSE '12e2' END AS raw FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(trim(raw), '^-?\d+(\.\d+)?(e-?\d+)?$') THEN CAST(trim(raw) AS DOUBLE) END AS number,
      CASE WHEN regexp_matches(trim(raw), '^\d+(\.0+)?$') THEN CAST(regexp_replace(trim(raw), '\.0+$', '') AS BIGINT) WHEN raw = '12e2' THEN 1200 END AS whole FROM s""")
def exact_numbers(v):
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 11
    raw = (F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".500000"))).when(k == 2, "NaN").when(k == 3, F.concat(F.lit(" "), n, F.lit(".000 "))).when(k == 4, F.col("lang"))
           .when(k == 5, F.concat(n, F.lit(".0000005"))).when(k == 6, "1e-7").when(k == 7, F.concat(F.lit("17000000000000"), F.lpad((F.col("n_chars") % 100000).cast("string"), 5, "0")))
           .when(k == 8, F.concat((F.col("n_chars") % 9 + 1).cast("string"), F.lit("23456789012345.5"))).when(k == 9, "-1.0000001").otherwise("12e2"))
    return v.table("documents").select("doc_id", exact_number(raw).cast("double").alias("number"), exact_integer(raw).alias("whole"))


ROLES = {"orders": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}


@query("profile_projection", sql="""SELECT 'orders' AS profile, o_orderpriority AS role, count(*) AS assets,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'CONSUMED' ELSE 'INPUT_ROLE_DENIED' END AS outcome FROM orders GROUP BY ALL""")
def profile_projection(v):
    return ig.project_for_profile(v.table("orders").withColumnRenamed("o_orderpriority", "role"), "orders", ROLES)[1]


@query("admitted_roles", sql="SELECT c_mktsegment AS role FROM customer INTERSECT SELECT upper(p_type) FROM part UNION SELECT o_orderpriority FROM orders INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def admitted_roles(v):
    a = ig.admitted_roles(v.table("customer").select(F.col("c_mktsegment").alias("role")), v.table("part").select(F.upper("p_type").alias("role")))
    o = v.table("orders")
    return a.union(ig.admitted_roles(o.select(F.col("o_orderpriority").alias("role")), o.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("role")))).distinct()


# stored totals per order against totals derived from the lines
@query("audit_diff", sql="""
    WITH s AS (SELECT o_orderkey AS k, o_custkey % 5 AS n, CAST(o_totalprice AS DOUBLE) AS t FROM orders),
      d AS (SELECT l_orderkey AS k, count(*) AS n, max(l_extendedprice) AS t FROM lineitem GROUP BY ALL), j AS (SELECT coalesce(s.k, d.k) AS order_id, s.k AS sk, d.k AS dk, s.n AS sn, d.n AS dn, s.t AS st, d.t AS dt FROM s FULL JOIN d ON s.k = d.k)
    SELECT order_id, 'STORED_ONLY' AS difference FROM j WHERE dk IS NULL UNION ALL SELECT order_id, 'DERIVED_ONLY' FROM j WHERE sk IS NULL
    UNION ALL SELECT order_id, 'CHANGED:lines' FROM j WHERE sk IS NOT NULL AND dk IS NOT NULL AND sn <> dn
    UNION ALL SELECT order_id, 'CHANGED:total' FROM j WHERE sk IS NOT NULL AND dk IS NOT NULL AND abs(st - dt) > greatest(1e-12 * greatest(abs(st), abs(dt)), 1e-10)""")
def audit_diff(v):
    s = v.table("orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 5).alias("lines"), F.col("o_totalprice").alias("total"))
    d = v.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("lines"), F.max("l_extendedprice").alias("total"))
    return ig.audit_diff(s, d, ["order_id"], ["lines"], ["total"])


AFTER = "SELECT path, CASE WHEN bytes % 5 = 0 THEN upper(sha256) ELSE sha256 END AS sha256 FROM assets WHERE bytes % 7 <> 0"


def after(v):
    return v.assets.where("bytes % 7 <> 0").select("path", F.when(F.col("bytes") % 5 == 0, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"))


@query("snapshot_diff", "assets", sql=f"SELECT a.path, 'SOURCE_CHANGED' AS code FROM assets a LEFT JOIN ({AFTER}) b ON a.path = b.path WHERE a.sha256 IS DISTINCT FROM b.sha256")
def snapshot_diff(v):
    return ig.snapshot_diff(v.assets, after(v))


@query("artifact_check", "assets", sql=f"""
    WITH j AS (SELECT a.path, a.sha256 AS declared, b.sha256 AS actual FROM assets a LEFT JOIN ({AFTER}) b ON a.path = b.path)
    SELECT path, CASE WHEN list_has_any(string_split(path, '/'), ['', '.', '..']) OR starts_with(path, '/') THEN 'SOURCE_PATH_ESCAPE' WHEN actual IS NULL THEN 'MISSING_ARTIFACT' ELSE 'ARTIFACT_CHANGED' END AS code
    FROM j WHERE list_has_any(string_split(path, '/'), ['', '.', '..']) OR starts_with(path, '/') OR actual IS NULL OR actual <> declared""")
def artifact_check(v):
    return ig.artifact_check(v.assets, after(v))


@query("lineage_breaks", sql="""
    WITH l AS (SELECT o_custkey AS capture_id, o_orderpriority AS stage, CAST(o_orderkey % 3 AS VARCHAR) AS h, CASE WHEN o_orderpriority > '1-URGENT' THEN (SELECT max(p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) WHERE p < o_orderpriority) END AS ps,
        CAST(o_orderkey % 4 AS VARCHAR) AS ph FROM orders)
    SELECT capture_id, stage, ps AS parent_stage, 'SOURCE_CHANGED' AS code FROM l WHERE ps IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l p WHERE p.capture_id = l.capture_id AND p.stage = l.ps AND p.h = l.ph)""")
def lineage_breaks(v):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    parent = F.when(F.lit(False), F.lit(""))
    for a, b in zip(names, names[1:]):
        parent = parent.when(F.col("o_orderpriority") == b, F.lit(a))
    l = v.table("orders").select(F.col("o_custkey").alias("capture_id"), F.col("o_orderpriority").alias("stage"), (F.col("o_orderkey") % 3).cast("string").alias("manifest_hash"),
                                 parent.alias("parent_stage"), (F.col("o_orderkey") % 4).cast("string").alias("parent_hash"))
    return ig.lineage_breaks(l)


@query("newest_jobs", "jobs", sql=f"SELECT job_id, state, {r6('CAST(created_sec AS DOUBLE)')} AS created_sec FROM jobs ORDER BY jobs.created_sec DESC, job_id DESC LIMIT 50")
def newest_jobs(v):
    return ig.newest_jobs(v.jobs).select("job_id", "state", *r6c("created_sec"))


@query("pending_jobs", "jobs", sql="SELECT owner_id, count(*) AS jobs, count(*) FILTER (state NOT IN ('SUCCEEDED', 'FAILED')) AS pending FROM jobs GROUP BY ALL")
def pending_jobs(v):
    return ig.pending_jobs(v.jobs)


@query("job_summary", "jobs", sql="SELECT modality, state, count(*) AS jobs, CAST(max(created_sec) AS DOUBLE) AS latest_sec FROM jobs GROUP BY ALL")
def job_summary(v):
    return ig.job_summary(v.jobs)


@query("catalog_listing", sql="""
    SELECT CAST(o_orderkey AS VARCHAR) AS result_id, CAST(epoch_us(o_orderdate) / 1000000 AS DOUBLE) AS published_sec FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL HAVING count(DISTINCT l_returnflag) = 2)""")
def catalog_listing(v):
    m = v.table("orders").select(F.col("o_orderkey").cast("string").alias("result_id"), F.expr("unix_micros(cast(o_orderdate as timestamp)) / 1000000").alias("published_sec"))
    a = v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("result_id"), F.col("l_returnflag").alias("name"))
    return ig.catalog_listing(m, a, ["A", "R"])


_SCANNED = files.STREAM_HEADERS["accelerometer"]
#: Body lines of sixteen export files: notes, blank lines, ragged rows and words for numbers among the samples.
_BODY = """SELECT user_id % 16 AS f, event_id AS e, CASE WHEN event_id % 13 = 0 THEN concat('# note ', event_id) WHEN event_id % 17 = 0 THEN ' ' WHEN event_id % 19 = 0 THEN '1,2,3'
      WHEN event_id % 23 = 0 THEN concat(event_id, ',0,one,2,3') ELSE concat(event_id, '.5,0, ', user_id, ',2,3') END AS line FROM events"""


@query("strict_scan", sql=f"""
    WITH b AS (SELECT f, e, line, row_number() OVER (PARTITION BY f ORDER BY e) + 3 AS source_line FROM ({_BODY}))
    SELECT CAST(f AS INT) AS file_no, 1::BIGINT AS source_line, 'NOTE' AS kind, '# export ' || f AS text FROM (SELECT DISTINCT f FROM b)
    UNION ALL SELECT CAST(f AS INT), source_line, 'NOTE', line FROM b WHERE e % 13 = 0
    UNION ALL SELECT CAST(f AS INT), source_line, 'MALFORMED_ROW', NULL FROM b WHERE e % 13 <> 0 AND e % 17 <> 0 AND e % 19 = 0
    UNION ALL SELECT CAST(f AS INT), source_line, 'INVALID_NUMBER', NULL FROM b WHERE e % 13 <> 0 AND e % 17 <> 0 AND e % 19 <> 0 AND e % 23 = 0
    UNION ALL SELECT CAST(f AS INT), source_line, 'ROW', trim(string_split(line, ',')[3]) FROM b WHERE e % 13 <> 0 AND e % 17 <> 0 AND e % 19 <> 0""")
def strict_scan(v):
    """Writes the events as export files of a few large texts and scans them with their line numbers."""
    v.table("events").createOrReplaceTempView("events")
    body = v.spark.sql(_BODY).select(F.col("f").cast("int").alias("f"), "e", "line")
    head = lambda e, line: F.struct(F.lit(e).cast("long").alias("e"), line.alias("line"))
    first = F.array(head(-3, F.concat(F.lit("# export "), F.col("f").cast("string"))), head(-2, F.lit("")), head(-1, F.lit(",".join(_SCANNED))))
    heads = body.select("f").distinct().select("f", F.explode(first).alias("h")).select("f", "h.*")
    folder = f"{run_folder(v.spark)}/export-{uuid.uuid4().hex}"
    body.unionByName(heads).repartition("f").sortWithinPartitions("f", "e").select("f", "line").write.partitionBy("f").text(folder)
    rows, notes, bad = files.scan_commented_csv(v.spark, f"{folder}/*/*.txt", _SCANNED)
    out = notes.select("file", "source_line", F.lit("NOTE").alias("kind"), "text").unionByName(bad.select("file", "source_line", F.col("code").alias("kind"), F.lit(None).cast("string").alias("text")))
    out = out.unionByName(rows.select("file", "source_line", F.lit("ROW").alias("kind"), F.col(_SCANNED[2]).alias("text")))
    return out.select(F.regexp_extract("file", "/f=([0-9]+)/", 1).cast("int").alias("file_no"), "source_line", "kind", "text")
