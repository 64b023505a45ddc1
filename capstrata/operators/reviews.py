"""Contracts of reviews, annotations and selections: order as written, limits, provenance, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.operators.ordered import sequence_over

# Who may have written a review.
ASSISTANT, USER = "ASSISTANT_VISUAL_REVIEW", "USER_VISUAL_REVIEW"
MAX_REGIONS = 200


def _broken(*rules: Column) -> Column:
    """True where a rule does not hold; a rule over a missing value does not hold."""
    out = F.lit(False)
    for rule in rules:
        out = out | ~F.coalesce(rule, F.lit(False))
    return out


def _text(c: str, most: int, least: int = 1) -> Column:
    return F.char_length(c).between(least, most)


def _optional(c: str, most: float) -> Column:
    return F.col(c).isNull() | (F.col(c) >= 0) & (F.col(c) <= most) & ~F.isnan(c)


def order_violations(rows: DataFrame, keys: list[str], position: str, value: str, at_least: int = 0, at_most: int | None = None) -> DataFrame:
    """Keys whose values, read by position, do not ascend strictly, or which hold too few or too many."""
    seq = sequence_over(rows.select(*keys, position, value), keys, [position, value], lag={"_before": value})
    still = F.col(value).isNull() | F.coalesce(F.col(value) <= F.col("_before"), F.lit(False))
    n = seq.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(still).alias("_still"))
    size = F.col("_n") < at_least
    if at_most is not None:
        size = size | (F.col("_n") > at_most)
    return n.where(F.col("_still") | size).select(*keys)


def selection_order_violations(selected: DataFrame, prepared: DataFrame, at_most: int, code: str = "RECONSTRUCTION_SELECTION_INVALID") -> DataFrame:
    """Requested view lists (capture_id, position, rank) must hold 3 to ``at_most`` ascending prepared ranks."""
    wrong = order_violations(selected, ["capture_id"], "position", "rank", 3, at_most)
    unknown = selected.join(prepared.select("capture_id", "rank").distinct(), ["capture_id", "rank"], "left_anti").select("capture_id")
    return wrong.union(unknown).distinct().withColumn("code", F.lit(code))


def review_violations(reviews: DataFrame, regions: DataFrame, planes: DataFrame) -> DataFrame:
    """Reviews with a broken provenance, region list, region text or floor reference.

    ``reviews`` has capture_id, reviewer, authority, human_confirmed and floor_plane (NULL without
    one); ``regions`` has position, region_id, reason, role and plane_index. Region identities and
    polygons are checked by ``boundaries.region_violations``.
    """
    source = F.col("authority").isin(ASSISTANT, USER) & (~F.col("human_confirmed") | (F.col("authority") == USER))
    invalid = lambda df: df.select("capture_id", F.lit("BOUNDARY_REVIEW_INVALID").alias("code"))
    out = invalid(reviews.where(_broken(_text("reviewer", 200), source)))
    out = out.union(invalid(order_violations(regions, ["capture_id"], "position", "region_id", at_most=MAX_REGIONS)))
    out = out.union(invalid(regions.where(_broken(_text("region_id", 80), _text("reason", 2000)))))
    floors = regions.where("role = 'FLOOR'").join(planes.select("capture_id", "plane_index"), ["capture_id", "plane_index"], "left_semi")
    named = reviews.where("floor_plane IS NOT NULL").select("capture_id", F.col("floor_plane").alias("plane_index"))
    missing = named.join(floors, ["capture_id", "plane_index"], "left_anti").select("capture_id", F.lit("BOUNDARY_FLOOR_INVALID").alias("code"))
    return out.union(missing).distinct()


def annotation_limit_violations(annotations: DataFrame) -> DataFrame:
    """Annotator, notes, corner uncertainty and cover thickness of each annotated object."""
    bad = _broken(_text("annotator", 200), F.col("human_reviewed").isNotNull(), _text("notes", 5000, 0), _optional("uncertainty_px", 30), _optional("cover_m", 0.2))
    return annotations.where(bad).select("capture_id", "object_id", F.lit("GROUNDING_ANNOTATION_INVALID").alias("code"))


def confirmation_violations(confirmations: DataFrame, annotations: DataFrame, reviewed: DataFrame, marked: DataFrame) -> DataFrame:
    """Confirmations that do not bind the exact corners and views, or state an impossible thickness.

    ``confirmations`` has the reviewed hash, statement and thickness interval per object,
    ``annotations`` the hash of its corners and its exact cover thickness; ``reviewed`` and
    ``marked`` have (capture_id, object_id, position, rank), the views as listed and as marked.
    """
    k = ["capture_id", "object_id"]
    r = reviewed.select(*k, "position", F.col("rank").alias("_r"))
    lists = r.join(marked.select(*k, "position", F.col("rank").alias("_m")), [*k, "position"], "full_outer")
    differ = lists.groupBy(*k).agg(F.max(~F.col("_r").eqNullSafe(F.col("_m"))).alias("_differ"))
    j = confirmations.join(annotations.select(*k, F.col("corners_sha256").alias("_sha"), "cover_m"), k, "left").join(differ, k, "left")
    unbound = _broken(F.col("corners_sha256") == F.col("_sha"), ~F.col("_differ"))
    low, high, exact = F.col("lower_m"), F.col("upper_m"), F.col("cover_m")
    inside = ((exact > low) | F.col("lower_inclusive") & (exact == low)) & ((exact < high) | F.col("upper_inclusive") & (exact == high))
    invalid = _broken(_text("statement", 5000), low >= 0, low < high, high <= 0.2, F.col("lower_inclusive").isNotNull(), F.col("upper_inclusive").isNotNull(),
                      exact.isNull() | inside)
    codes = F.array_compact(F.array(F.when(unbound, F.lit("GROUNDING_REVIEW_SOURCE_CHANGED")), F.when(invalid, F.lit("GROUNDING_REVIEW_INVALID"))))
    return j.select(*k, F.explode(codes).alias("code"))
