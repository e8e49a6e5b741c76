"""The upserted schedule: replays, late links, parts that a batch does not touch."""

from pyspark.sql import functions as F

from tipoff.session import new_path
from tipoff.streaming.records import Parts, start_schedule_upserts

SCHEMA = "game_id bigint, game_url string"


def _rows(df):
    return sorted((-1 if r.game_id is None else r.game_id, r.game_url) for r in df.collect())


def _parts(spark):
    return Parts(spark, new_path(spark, "schedule"), SCHEMA, F.floor(F.col("game_id") / 10))


def test_batches_replays_and_untouched_parts(spark):
    parts = _parts(spark)
    assert _rows(parts.table()) == []

    def batch(rows, number):
        parts.upsert_changes(spark.createDataFrame(rows, SCHEMA), number)

    batch([(1, ""), (2, "x"), (11, ""), (None, "n")], 0)
    batch([(1, "a"), (2, ""), (3, "")], 1)
    expected = [(-1, "n"), (1, "a"), (2, "x"), (3, ""), (11, "")]
    assert _rows(parts.table()) == expected
    batch([(1, "a"), (2, ""), (3, "")], 1)  # sent again
    assert _rows(parts.table()) == expected
    batch([], 2)
    assert _rows(parts.table()) == expected
    batch([(25, "")], 3)
    touched = spark.read.parquet(f"{parts.root}/batch=3")
    assert touched.count() == 1 and _rows(parts.table()) == [*expected, (25, "")]


def test_last_arrival_counts(spark):
    folder, root, parts = new_path(spark, "arriving"), new_path(spark, "stream"), _parts(spark)
    df = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "", 1), (2, "b", 1)], "game_id bigint, game_url string, at int")
    df.write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    start_schedule_upserts(stream, parts, root, "at", availableNow=True).awaitTermination()
    assert _rows(parts.table()) == [(1, "a"), (2, "b")]
