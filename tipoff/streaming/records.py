"""Win-loss records and schedule changes as streams over micro-batches.

Games that were seen are kept, one file set for each micro-batch, which a replay overwrites. A micro-batch's new games are put among the
kept results of their seasons, with the same skew-safe running sums as the batch operator: a game sent again counts once, and a
game that arrives late gets the record of its own date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.functions.scalar import composite_key
from tipoff.operators.ordered import TEAM_SEASON, running
from tipoff.operators.views import team_rows
from tipoff.sources.tables import changed_rows, upserted


class Parts:
    """A table of rows by ``game_id`` in parts that the key implies, with a version of a part for each micro-batch that changed it.

    A batch reads the newest earlier version of the parts it touches and writes its own, so its cost does not grow with the rest of the table. Nothing that an
    earlier batch wrote is changed: a batch that is replayed, also after half of its writing, overwrites its own versions only.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, part: Column):
        self.spark, self.root, self.schema, self.part = spark, root, schema, part
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/batch=-1/part=none")  # so that there is a table to read

    def _versions(self, before: int | None = None, parts: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, batch bigint, part string").parquet(self.root)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("part").agg(F.max("batch").alias("batch")), ["part", "batch"], "left_semi").drop("part", "batch")

    def table(self) -> DataFrame:
        return self._newest(self._versions())

    def upsert_changes(self, incoming: DataFrame, batch: int) -> None:
        """New games and newly linked box scores of ``incoming`` (one row a game)."""
        placed = incoming.select("*", F.coalesce(self.part.cast("string"), F.lit("none")).alias("part"))
        parts = [r.part for r in placed.select("part").distinct().collect()]  # names of the parts of one batch
        stored = self._newest(self._versions(batch, parts))
        after = upserted(stored, changed_rows(incoming, stored), ["game_id"])
        after.select("*", F.coalesce(self.part.cast("string"), F.lit("none")).alias("part")).write.mode("overwrite").partitionBy("part").parquet(
            f"{self.root}/batch={batch}")


def records_batch(batch: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of the games that are new, what is new to keep) of a micro-batch; ``seen`` is what was kept before.

    A game that comes unplayed first has its record written then; its result counts from the batch that brings it.
    """
    columns = [c for c in seen.columns if c != "game_id"]
    known = F.col("is_home_win").isNotNull()
    latest = F.max_by(F.struct(*columns), known.cast("int")).alias("__g")
    games = batch.groupBy("game_id").agg(latest).select("game_id", "__g.*")
    new = games.join(seen.select("game_id").distinct(), "game_id", "left_anti")
    played = games.where(known).join(seen.where(known).select("game_id").distinct(), "game_id", "left_anti")
    kept = new.where(~known).unionByName(played)

    history = seen.where(known).join(new.select("season_id").distinct(), "season_id", "left_semi")
    fresh = F.lit(True).alias("__new")
    told = played.join(new.select("game_id"), "game_id", "left_anti").join(new.select("season_id").distinct(), "season_id", "left_semi")
    among = new.select("*", fresh).unionByName(history.unionByName(told.select(*history.columns)).select("*", F.lit(False).alias("__new")))
    won, lost = F.col("win").cast("bigint"), (~F.col("win")).cast("bigint")
    line = running(team_rows(among, ["game_id", "date", "season_id", "__new"]), TEAM_SEASON, sums={"wins_before": won, "losses_before": lost})
    return line.where("__new").select(composite_key("game_id", "team").alias("id"), "game_id", "season_id", "team", "wins_before", "losses_before"), kept


SEEN = ["game_id", "date", "season_id", "home_team", "guest_team", "is_home_win"]


def start_records(games: DataFrame, spark: SparkSession, root: str, **trigger):
    """Write the record rows of every arriving game under ``root/records``; replays overwrite their own batch."""
    schema = T.StructType([games.schema[c] for c in SEEN])

    def each(batch: DataFrame, number: int) -> None:
        if number:
            with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
            seen = spark.read.schema(with_batch).parquet(f"{root}/seen").where(F.col("batch") < number).drop("batch")
        else:
            seen = spark.createDataFrame([], schema)
        rows, kept = records_batch(batch.select(*SEEN), seen)
        rows.write.mode("overwrite").parquet(f"{root}/records/batch={number}")
        kept.select(*SEEN).write.mode("overwrite").parquet(f"{root}/seen/batch={number}")

    return games.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()


def start_schedule_upserts(landed: DataFrame, parts: Parts, root: str, arrival: str, **trigger):
    """Keep a schedule table up to date: only new games and newly linked box scores are upserted.

    Of several rows of a game in one micro-batch the last by ``arrival`` counts, of several at once the one with a link.
    """
    def each(batch: DataFrame, number: int) -> None:
        columns = [c for c in parts.spark.createDataFrame([], parts.schema).columns if c != "game_id"]
        last = F.max_by(F.struct(*columns), F.struct(F.col(arrival), "game_url")).alias("__last")
        parts.upsert_changes(batch.groupBy("game_id").agg(last).select("game_id", "__last.*"), number)

    return landed.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()
