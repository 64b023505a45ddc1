"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capstrata.llm.common import columns_of, fresh
from capstrata.session import stage

#: A mean is inverted in parts of at most LARGEST_MEAN; the sum of independent Poisson counts is Poisson.
LARGEST_MEAN = 16
#: No count of such a part exceeds this: the probability is below 1e-27.
LARGEST_COUNT = 80


def md5_bits(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 as a long; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def unit_from_md5(text: Column) -> Column:
    return (md5_bits(text, 13).cast("double") + 0.5) / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. LARGEST_COUNT, of a mean of at most LARGEST_MEAN."""
    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        total = acc["total"] + p
        return F.struct(p.alias("p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("total"), F.array(first).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LARGEST_COUNT)), start, step, lambda acc: acc["cdf"])


def source_rates(df: DataFrame, source: Column, mass: Column, weights: Mapping[str, float], default_weight: float) -> DataFrame:
    """One row per source: its mass, its target repetition rate and the inverse table of its Poisson parts.

    rate = (weight / sum of weights) * (total mass) / (mass of the source), so that the expected mass of the
    mix equals the mass of the input and is shared out by the weights. A null source is a source of its own.
    """
    if any(w < 0 for w in [*weights.values(), default_weight]):
        raise ValueError("weights must not be negative")
    per = stage(df.groupBy(source.alias("mix_source")).agg(F.sum(mass).alias("mix_mass")))
    listed = F.lit(float(default_weight))
    for name, w in weights.items():
        listed = F.when(F.col("mix_source") == name, float(w)).otherwise(listed)
    per = per.withColumn("mix_weight", listed)
    whole = per.agg(F.sum("mix_mass").alias("mass"), F.sum("mix_weight").alias("weight")).first()
    total = float(whole["mass"] or 0)
    weight = float(whole["weight"] or 0) or 1.0
    rate = F.col("mix_weight") / weight * total / F.col("mix_mass")
    rated = per.withColumn("mix_rate", rate).withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / LARGEST_MEAN)).cast("int"))
    return stage(rated.withColumn("mix_cdf", poisson_cdf(F.col("mix_rate") / F.col("mix_parts"))))


def poisson_count(seed: int, key: Column, parts: Column, cdf: Column) -> Column:
    """Inverse of the Poisson distribution at hash-seeded uniforms, one for each part of the mean."""
    def part(i: Column) -> Column:
        u = unit_from_md5(F.concat(F.lit(f"{seed}|"), i.cast("string"), F.lit("|"), key))
        return F.size(F.filter(cdf, lambda p: p <= u))

    return F.aggregate(F.transform(F.sequence(F.lit(0), parts - 1), part), F.lit(0), lambda a, b: a + b)


def mix_sources(df: DataFrame, source: str, key: Sequence[str], text: str, weights: Mapping[str, float], default_weight: float = 1.0, seed: int = 0, copy_out: str = "mix_copy", order_out: str = "mix_order") -> DataFrame:
    """Repeat every row a Poisson number of times so that sources reach their target weights, in global random order.

    The mass of a row is its text's length in characters plus one; null text has length 0. A row of key k in a
    source of rate r appears Poisson(r) times, read off the inverse distribution at a hash of seed and k: the
    mix is the same for any partitioning and after a lost task. Rates have no cap. Rows with equal keys get the
    same count. Adds the number of the copy (from 0) and the place in the shuffle; rows come hash-partitioned and
    sorted by that place, which is a uniform random order. Existing columns of these names are replaced.

    Sources meet their rates through a staged table of one row per source, so the join needs no shuffle of the
    rows while that table is below the session's broadcast threshold, and AQE splits a hot source otherwise.
    """
    name, n, copy, order = fresh(df.columns, "mix_source_key", "mix_count", "mix_copy_", "mix_order_")
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    mass = (F.coalesce(F.length(F.col(text)), F.lit(0)) + 1).cast("long")
    labelled = {f"={k}": v for k, v in weights.items()}
    rates = source_rates(df, src, mass, labelled, default_weight)
    ids = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    rates = rates.select(F.col("mix_source").alias(name), F.struct("mix_rate", "mix_parts", "mix_cdf").alias(n))
    counted = df.withColumn(name, src).join(rates, name)
    counted = counted.withColumn(n, poisson_count(seed, ids, F.col(f"{n}.mix_parts"), F.col(f"{n}.mix_cdf"))).where(F.col(n) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    place = md5_bits(F.concat(F.lit(f"{seed}|order|"), F.col(copy).cast("string"), F.lit("|"), ids), 15)
    placed = copies.withColumn(order, place)
    kept = columns_of(c for c in df.columns if c.lower() not in (copy_out.lower(), order_out.lower()))
    mixed = placed.select(*kept, F.col(copy).cast("int").alias(copy_out), F.col(order).alias(order_out))
    return mixed.repartition(order_out).sortWithinPartitions(order_out, copy_out)
