"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names for working columns that clash with no name in `taken` (case is ignored, as Spark does)."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def columns_of(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, which may hold dots."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: functions over batches take no names with dots or quotes."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def unit_hash(*cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the columns only (52 bits of their 64-bit hash)."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") + 0.5) / float(1 << 52)


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, buckets: int = 256) -> DataFrame:
    """Gapless numbers from 0 within each group, for groups of any size.

    A group is cut into `buckets` parts by a hash of the order columns; rows are numbered per part and
    shifted by the size of the parts before it, so that one group never meets in one task. The numbers
    depend on values only, not on partitions; rows that tie on all order columns are interchangeable.
    The input is read twice: pass a staged table. Group columns must not be null.
    """
    part, n, before = fresh(df.columns, "part", "n_part", "before")
    cut = df.withColumn(part, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    keys = [*group, part]
    starts = (
        cut.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
        .withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop(n)
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return cut.join(starts, keys).withColumn(out, (within - 1 + F.col(before)).cast("long")).select(*columns_of(df.columns), out)
