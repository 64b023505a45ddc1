"""Path, name and timestamp rules as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that no portable path may use.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL",
                  *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
# Image suffixes read, and those refused with a message.
KNOWN_IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png"]
OTHER_IMAGE_SUFFIXES = [".heic", ".heif", ".webp", ".tif", ".tiff", ".bmp", ".gif", ".avif"]


def slugify(value: Column, fallback: str = "room") -> Column:
    slug = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))


def filename_timestamp(stem: Column) -> Column:
    """``YYYYMMDD_HHMMSS`` to an ISO string, NULL for any other stem."""
    pattern = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})$"
    part = lambda i: F.regexp_extract(stem, pattern, i)
    return F.when(stem.rlike(pattern), F.concat(
        part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"),
        part(4), F.lit(":"), part(5), F.lit(":"), part(6)))


def capture_timestamp(original: Column, modified: Column, offset: Column) -> Column:
    """EXIF time as struct(value, timezone, source, domain).

    The original time wins over the modification time; colon and dash dates are both read;
    an offset counts only in the form +HH:MM or -HH:MM.
    """
    raw = F.coalesce(F.nullif(original, F.lit("")), modified)
    source = F.when(F.coalesce(original, F.lit("")) != "", F.lit("EXIF_DateTimeOriginal")).otherwise(
        F.lit("EXIF_DateTime"))
    dashed = F.when(raw.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"),
                    F.concat(F.translate(F.substring(raw, 1, 10), ":", "-"), F.substring(raw, 11, 9))
                    ).when(raw.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), raw)
    # try_cast refuses impossible dates such as month 13
    ok = dashed.try_cast("timestamp_ntz").isNotNull()
    local = F.when(ok, F.concat(F.substring(dashed, 1, 10), F.lit("T"), F.substring(dashed, 12, 8)))
    zoned = F.coalesce(offset.rlike(r"^[+-]\d{2}:\d{2}$"), F.lit(False))
    return F.struct(
        F.when(zoned, F.concat(local, offset)).otherwise(local).alias("value"),
        F.when(local.isNotNull() & zoned, offset).alias("timezone"),
        source.alias("source"),
        F.when(local.isNull(), "unknown").when(zoned, "local_clock")
        .otherwise("local_clock_unknown_offset").alias("domain"))


def is_safe_relative_path(path: Column) -> Column:
    """Portable bundle path: relative, forward slashes, no empty, '.' or '..' part."""
    parts = F.split(path, "/")
    return (~F.contains(path, F.lit("\\")) & ~path.startswith("/") & (path != "")
            & ~F.exists(parts, lambda p: p.isin("", ".", "..")))


def is_safe_upload_name(path: Column) -> Column:
    """The stricter rule for archive members: no reserved, padded or control-character parts."""
    norm = F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")
    bad = lambda p: (p.isin("", ".", "..") | p.rlike(r"[. ]$") | p.rlike(r'[\x00-\x1f:<>"|?*]')
                     | F.upper(F.element_at(F.split(p, r"\."), 1)).isin(RESERVED_NAMES))
    return ~F.translate(path, "\\", "/").startswith("/") & ~F.exists(F.split(norm, "/"), bad)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_path(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))
