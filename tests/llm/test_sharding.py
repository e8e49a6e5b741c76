from collections import Counter

import pytest
from pyspark.sql import functions as F

from tipoff.llm.sharding import fill_table, place, write_shards

SHARDS = [f"s{k}" for k in range(12)]


def test_table_is_balanced_and_changes_little():
    table = fill_table(SHARDS, 1009)
    counts = Counter(table)
    assert set(counts) == set(SHARDS) and max(counts.values()) - min(counts.values()) <= 1
    assert fill_table(SHARDS[::-1], 1009) == table
    fewer = fill_table(SHARDS[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != SHARDS[-1])
    assert moved < 0.15 * 1009
    heavy = Counter(fill_table(SHARDS, 1009, {"s0": 3}))
    assert heavy["s0"] > 2.5 * heavy["s1"]
    for bad in ((SHARDS, 1000), ([], 7), (SHARDS, 11)):
        with pytest.raises(ValueError):
            fill_table(*bad)


def test_placement_equals_the_table(spark, tmp_path):
    rows = [(k, "x", 1, "old") for k in range(3000)] + [(5, "x", 1, "old")] * 2000 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string")
    out = place(df, ["doc_id"], SHARDS, 1009)
    table = fill_table(SHARDS, 1009)
    got = out.withColumn("want", F.pmod(F.xxhash64("doc_id"), F.lit(1009))).collect()
    assert len(got) == len(rows) and all(r.slot == r.want and r.shard == table[r.slot] for r in got)
    loads = Counter(r.shard for r in got if r.doc_id != 5)
    assert max(loads.values()) < 1.5 * min(loads.values())
    write_shards(out, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert place(df.where("false"), ["doc_id"], SHARDS, 1009).count() == 0
