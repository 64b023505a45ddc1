from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from capstrata.llm import sharding
from capstrata.session import stage


def test_weights_growth_and_slots(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(9).alias("slot"), F.lit("p").alias("part"))
    w = [1.0, 2.0, 0.0, 3.0]
    got = sharding.number_slots(stage(sharding.assign_shards(df, ["doc_id"], w, grown_by=[2.0])).drop("slot"), "shard", ["doc_id"], buckets=5).collect()
    n = Counter(r.shard for r in got)
    assert n[2] == 0 and all(abs(n[i] - 1000 * w[i]) < 150 for i in (0, 1, 3))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert all(r.grown_shard == 4 for r in moved) and abs(len(moved) - 1500) < 200
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_key_decides_alone(spark, frame):
    a = frame([(1, "x", "s"), (2, "y", "s")], "doc_id long, text string, shard string")
    b = frame([(2, "other"), (1, None)], "doc_id int, text string")
    one = {r.doc_id: r.shard for r in sharding.assign_shards(a, ["doc_id"], [1.0] * 7).collect()}
    two = {r.doc_id: r.shard for r in sharding.assign_shards(b, ["doc_id"], [1.0] * 7).collect()}
    assert one == two


def test_null_keys_spread_by_content(spark, frame):
    df = frame([(None, f"t{i}") for i in range(500)] + [(None, None)] * 3, "doc_id long, text string")
    n = Counter(r.shard for r in sharding.assign_shards(df, ["doc_id"], [1.0] * 5, fallback=["text"]).collect())
    assert len(n) == 5 and max(n.values()) < 150
    two = sharding.assign_shards(df, ["doc_id", "text"], [1.0] * 5, fallback=["text"]).collect()
    assert len({r.shard for r in two}) == 5


def test_empty_and_bad_weights(spark, frame):
    none = frame([], "doc_id long, text string")
    assert sharding.number_slots(stage(sharding.assign_shards(none, ["doc_id"], [1.0])), "shard", ["doc_id"]).collect() == []
    with pytest.raises(ValueError):
        sharding.assign_shards(none, ["doc_id"], [0.0])
