"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import number_within, unit_hash


def shard_cost(key: Column, shard: Column, weight: Column) -> Column:
    """Exponential race: the shard with the smallest cost owns the key, with odds in proportion to its weight."""
    return -F.log(unit_hash(key, shard)) / weight


def stable_key(df: DataFrame, keys: Sequence[str], fallback: Sequence[str]) -> Column:
    """The key as text, so that an int and a long of the same value agree.

    A row whose key columns are all null takes a hash of its fallback columns instead; a third of the
    rows may lack a key without meeting in one shard.
    """
    as_text = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    content = F.concat(F.lit("content:"), F.xxhash64(*[F.col(c) for c in fallback]).cast("string")) if fallback else F.lit("none")
    return F.when(F.coalesce(*[F.col(k).isNotNull() for k in keys], F.lit(False)) if len(keys) == 1 else F.greatest(*[F.col(k).isNotNull() for k in keys]), as_text).otherwise(content)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0 to len(weights) - 1 of a key. A shard of weight 0 gets nothing; ties go to the lower shard."""
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights: at least one positive weight and no negative one")
    owners = [i for i, w in enumerate(weights) if w > 0]
    candidates = F.array(*[F.struct(F.lit(float(weights[i])).alias("w"), F.lit(i).alias("i")) for i in owners])
    best = F.array_min(F.transform(candidates, lambda s: F.struct(shard_cost(key, s["i"], s["w"]).alias("cost"), s["i"].alias("i"))))
    return best["i"]


def assign_shards(df: DataFrame, keys: Sequence[str], weights: Sequence[float], fallback: Sequence[str] = (), grown_by: Sequence[float] = (), out: str = "shard", grown_out: str = "grown_shard") -> DataFrame:
    """Add the shard of every row, and its shard once shards of the weights `grown_by` are appended.

    The shard depends on the key columns and the weights only. Appending shards moves a row only if one of
    the new shards wins it; removing a shard moves only its own rows. No shuffle: the choice is a column
    expression. Existing columns named like the results are replaced. Rows with equal keys share a shard.
    """
    key = stable_key(df, keys, fallback)
    made = {out: rendezvous_shard(key, weights)}
    if grown_by:
        made[grown_out] = rendezvous_shard(key, [*weights, *grown_by])
    return df.withColumns(made)


def number_slots(df: DataFrame, shard: str, order: Sequence[str], out: str = "slot", buckets: int = 256) -> DataFrame:
    """Gapless slots from 0 within each shard; pass a staged table (see number_within)."""
    return number_within(df, [shard], order, out, buckets)
