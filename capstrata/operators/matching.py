"""Descriptor matching between images, and the epipolar check of supplied poses."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capstrata.functions import geometry as G
from capstrata.operators.ordered import quantiles, sequence_over
from capstrata.session import stage

BLOCK = 1024
# Binary codes of a block, and lookups of chunks made at once.
CODES = 16384
CANDIDATES = 1 << 24
PAIR_COLUMNS = ["capture_id", "first_image", "second_image", "query_id", "target_id", "copies", "distance"]


def adjacent_images(descriptors: DataFrame) -> DataFrame:
    """Each image with the next one of its capture."""
    images = descriptors.select("capture_id", "image").distinct()
    seq = sequence_over(images, ["capture_id"], ["image"], lead={"other": "image"})
    return seq.where("other IS NOT NULL").select("capture_id", F.col("image").alias("first_image"), F.col("other").alias("second_image"))


def _two_nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The two nearest targets of each query within one pair of blocks."""
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            a = np.stack(row.a_vec).astype(np.float64)
            b = np.stack(row.b_vec).astype(np.float64)
            rough = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
            take = np.argsort(rough, axis=1, kind="stable")[:, :2]
            exact = np.sqrt(((a[:, None, :] - b[take]) ** 2).sum(-1))
            width = take.shape[1]
            yield pd.DataFrame({
                "capture_id": row.capture_id, "first_image": row.first_image, "second_image": row.second_image,
                "query_id": np.repeat(np.asarray(row.a_id), width), "target_id": np.asarray(row.b_id)[take].ravel(),
                "distance": exact.ravel()})


def ratio_matches(descriptors: DataFrame, pairs: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Nearest-neighbour matches that pass the distance-ratio test, one query per target.

    Features are packed into blocks of a fixed size and blocks meet pairwise, so a task
    holds two blocks whatever the image. Only two rows per query leave a block pair.
    """
    ranked = sequence_over(descriptors, ["capture_id", "image"], ["feature_id"], rank="_i")
    blocks = ranked.groupBy("capture_id", "image", F.floor(F.col("_i") / BLOCK).alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct("feature_id", "embedding"))).alias("f")).select(
        "capture_id", "image", F.col("f.feature_id").alias("id"), F.col("f.embedding").alias("vec"))
    a = blocks.select("capture_id", F.col("image").alias("first_image"), F.col("id").alias("a_id"), F.col("vec").alias("a_vec"))
    b = blocks.select("capture_id", F.col("image").alias("second_image"), F.col("id").alias("b_id"), F.col("vec").alias("b_vec"))
    met = pairs.join(a, ["capture_id", "first_image"]).join(b, ["capture_id", "second_image"])
    near = met.select("capture_id", "first_image", "second_image", "a_id", "a_vec", "b_id", "b_vec").mapInPandas(
        _two_nearest, "capture_id bigint, first_image bigint, second_image bigint, query_id bigint, target_id bigint, distance double")
    key = ["capture_id", "first_image", "second_image"]
    place = F.row_number().over(Window.partitionBy(*key, "query_id").orderBy("distance", "target_id"))
    top = near.withColumn("_p", place).where("_p <= 2").groupBy(*key, "query_id").agg(
        F.min(F.struct("distance", "target_id")).alias("_best"), F.max("distance").alias("_second"), F.count("*").alias("_n"))
    good = top.where((F.col("_n") == 2) & (F.col("_best.distance") < ratio * F.col("_second")))
    best = good.groupBy(*key, F.col("_best.target_id").alias("target_id")).agg(
        F.min(F.struct(F.col("_best.distance").alias("distance"), "query_id")).alias("_q"))
    return best.select(*key, F.col("_q.query_id").alias("query_id"), "target_id", F.col("_q.distance").alias("distance"))


def _near_codes(words: int, bound: int, radius: int):
    """Pairs of codes within the bound from one pair of blocks, found by equal chunks after at most ``radius`` flips."""
    flips = np.array([sum(1 << i for i in at) for n in range(radius + 1) for at in combinations(range(16), n)], np.int64)

    def chunks(codes):
        return [(codes[:, i] >> shift) & 65535 for i in range(words) for shift in (0, 16)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key = [batch.column(i)[row].as_py() for i in range(3)]
                a_id, a, b_id, copies, b = (np.asarray(batch.column(i)[row].values) for i in range(3, 8))
                a, b = a.reshape(-1, words), b.reshape(-1, words)
                for place, (ca, cb) in enumerate(zip(chunks(a), chunks(b))):
                    order = np.argsort(cb, kind="stable")
                    cb = cb[order]
                    step = max(1, CANDIDATES // max(1, len(b) * len(flips)))
                    for at in range(0, len(a), step):
                        want = (ca[at:at + step, None] ^ flips).ravel()
                        low, high = np.searchsorted(cb, want, "left"), np.searchsorted(cb, want, "right")
                        n = high - low
                        i = np.repeat(np.repeat(np.arange(at, min(at + step, len(a))), len(flips)), n)
                        j = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                        unlike = a[i] ^ b[j]
                        distance = np.bitwise_count(unlike).sum(1)
                        keep = np.nonzero(distance <= bound)[0]
                        earlier = [np.bitwise_count(c) <= radius for c in chunks(unlike[keep])[:place]]
                        if earlier:
                            keep = keep[~np.logical_or.reduce(earlier)]  # a pair counts at its first chunk only
                        if len(keep):
                            yield pa.RecordBatch.from_arrays(
                                [*(pa.array(np.full(len(keep), k, np.int64)) for k in key), pa.array(a_id[i[keep]]), pa.array(b_id[j[keep]]), pa.array(copies[j[keep]]),
                                 pa.array(distance[keep].astype(np.int32))], names=PAIR_COLUMNS)

    return near


def hamming_pairs(descriptors: DataFrame, pairs: DataFrame, words: int, bound: int) -> DataFrame:
    """All distinct descriptors of image pairs that differ in at most ``bound`` bits, each pair once.

    ``descriptors`` has (capture_id, image, feature_id, code): ``words`` integers of 32 bits. The codes of an image
    are dealt by hash into blocks of about ``CODES`` and blocks meet pairwise, so a code travels once per block of the
    other image. Within a pair of blocks, codes are cut into chunks of 16 bits. Two codes within the bound agree in some
    chunk up to ``bound // chunks`` bits, so the first block looks up every chunk with up to that many bits
    flipped, and a pair counts at its first such chunk only. Equal codes of an image are one row
    with the smallest feature_id and their number ``copies``.
    """
    radius = bound // (2 * words)
    if not 0 <= radius <= 3:
        raise ValueError("a chunk of 16 bits takes at most 3 flips: bound <= 8 * words - 1")
    w = [f"w{i}" for i in range(words)]
    key = ["capture_id", "image"]
    codes = descriptors.select(*key, "feature_id", *[F.col("code")[i].alias(c) for i, c in enumerate(w)]).where(
        " AND ".join(f"{c} IS NOT NULL" for c in [*key, *w]))
    codes = stage(codes.groupBy(*key, *w).agg(F.min("feature_id").alias("id"), F.count("*").alias("copies")))
    size = codes.groupBy(*key).agg(F.ceil(F.count("*") / CODES).alias("_blocks"))
    dealt = codes.join(size, key).groupBy(*key, F.pmod(F.xxhash64(*w), F.col("_blocks")).alias("_b")).agg(
        F.collect_list(F.struct("id", "copies", F.array(*w).alias("code"))).alias("f"))
    blocks = dealt.select(*key, F.col("f.id").alias("id"), F.col("f.copies").alias("copies"), F.flatten("f.code").alias("codes"))
    a = blocks.select("capture_id", F.col("image").alias("first_image"), F.col("id").alias("a_id"), F.col("codes").alias("a_codes"))
    b = blocks.select("capture_id", F.col("image").alias("second_image"), F.col("id").alias("b_id"), "copies", F.col("codes").alias("b_codes"))
    met = pairs.join(a, ["capture_id", "first_image"]).join(b, ["capture_id", "second_image"])
    return met.select("capture_id", "first_image", "second_image", "a_id", "a_codes", "b_id", "copies", "b_codes").mapInArrow(
        _near_codes(words, bound, radius), ", ".join(f"{c} {'int' if c == 'distance' else 'bigint'}" for c in PAIR_COLUMNS))


def hamming_matches(descriptors: DataFrame, pairs: DataFrame, words: int, bound: int, ratio: float = 0.75) -> DataFrame:
    """Nearest matches of binary descriptors within ``bound`` bits that pass the ratio test, one query per target.

    A second neighbour beyond the bound counts with the least distance it can have, ``bound + 1``.
    """
    key = ["capture_id", "first_image", "second_image"]
    near = hamming_pairs(descriptors, pairs, words, bound)
    place = F.row_number().over(Window.partitionBy(*key, "query_id").orderBy("distance", "target_id"))
    top = near.withColumn("_p", place).where("_p <= 2").groupBy(*key, "query_id").agg(
        F.min(F.struct("distance", "target_id", "copies")).alias("_best"), F.max(F.when(F.col("_p") == 2, F.col("distance"))).alias("_second"))
    second = F.least(F.lit(bound + 1), "_second", F.when(F.col("_best.copies") > 1, F.col("_best.distance")))
    best = top.where(F.col("_best.distance") < ratio * second).groupBy(*key, F.col("_best.target_id").alias("target_id")).agg(
        F.min(F.struct(F.col("_best.distance").alias("distance"), "query_id")).alias("_q"))
    return best.select(*key, F.col("_q.query_id").alias("query_id"), "target_id", F.col("_q.distance").alias("distance"))


def sampson_medians(matches: DataFrame, features: DataFrame, cameras: DataFrame, min_matches: int = 8) -> DataFrame:
    """Median epipolar error per image pair; skipped without baseline or enough matches.

    ``features`` has (capture_id, image, feature_id, fx_px, fy_px); ``cameras`` has the
    world-from-camera rotation w00..w22, centre ox, oy, oz and fx, fy, cx, cy per image.
    """
    cam = ["fx", "fy", "cx", "cy", "ox", "oy", "oz", *[f"w{i}{j}" for i in range(3) for j in range(3)]]

    def side(p, image, feature):
        f = features.select("capture_id", F.col("image").alias(image), F.col("feature_id").alias(feature),
                            F.col("u").alias(f"{p}u"), F.col("v").alias(f"{p}v"))
        c = cameras.select("capture_id", F.col("image").alias(image), *[F.col(n).alias(f"{p}{n}") for n in cam])
        return f, c

    j = matches
    for p, image, feature in (("a_", "first_image", "query_id"), ("b_", "second_image", "target_id")):
        f, c = side(p, image, feature)
        j = j.join(f, ["capture_id", image, feature]).join(c, ["capture_id", image])
    ra = [[F.col(f"a_w{i}{k}") for k in range(3)] for i in range(3)]
    rb = [[F.col(f"b_w{i}{k}") for k in range(3)] for i in range(3)]
    oa, ob = G.vec("a_ox", "a_oy", "a_oz"), G.vec("b_ox", "b_oy", "b_oz")
    gap = G.minus(oa, ob)
    rel_t = [sum(rb[k][i] * gap[k] for k in range(3)) for i in range(3)]
    rel_r = [[sum(rb[k][i] * ra[k][m] for k in range(3)) for m in range(3)] for i in range(3)]
    error = G.sampson_residual(F.col("a_u"), F.col("a_v"), F.col("b_u"), F.col("b_v"), rel_r, rel_t,
                               G.vec("a_fx", "a_fy", "a_cx", "a_cy"), G.vec("b_fx", "b_fy", "b_cx", "b_cy"))
    key = ["capture_id", "first_image", "second_image"]
    e = j.withColumn("_base", G.norm(gap)).where("_base > 1e-5").select(*key, error.alias("error"))
    return quantiles(e, key, "error", {"median_sampson_px": 0.5}, count="matches").where(F.col("matches") >= min_matches)
