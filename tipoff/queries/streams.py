"""ST01-ST03: the incremental jobs as streams. Seasons of games, delivered one after the other, play the arriving data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff import fixtures as fx
from tipoff.fixtures import with_sql
from tipoff.queries.base import query, rounded
from tipoff.queries.rating import _CARRIED, _SHOWN, league_games
from tipoff.queries.sources import _URL, _schedule
from tipoff.queries.windows import earlier
from tipoff.session import new_path, written
from tipoff.streaming import ratings, records

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deliver(spark, df, name: str, period: str, start) -> object:
    """Let ``df`` arrive period by period in one folder; after each, ``start(stream)`` runs over what is new.

    Every period is one micro-batch, however many files it has. Returns the last run.
    """
    path, run = new_path(spark, name), None
    for row in df.select(period).distinct().orderBy(period).collect():  # one value per period
        df.where(F.col(period) == row[0]).write.mode("append").parquet(path)
        run = start(spark.readStream.schema(df.schema).parquet(path))
        run.awaitTermination()
    return run


@query("st01_elo_stream", _CARRIED + f"select {_SHOWN} from rated")
def st01(spark, sf_dir):
    """Seasons arrive one after the other; one game in seven comes with the next season, one in eleven twice, and each delivery is shuffled."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    games = league_games(spark, sf_dir).where(F.col("pts_home").isNotNull())
    root = new_path(spark, "elo-stream")
    on_time, late = F.col("season_id"), F.col("season_id") + 1
    waves = F.when(F.col("game_id") % 7 == 0, F.array(late)).when(F.col("game_id") % 11 == 0, F.array(on_time, late)).otherwise(F.array(on_time))
    arriving = games.select("*", F.explode(waves).alias("arrives")).orderBy(F.xxhash64("game_id"))
    last = games.agg(F.max("season_id").alias("season_id")).select(  # a game to come, by which all before it are released
        F.lit(None).cast("bigint").alias("league"), F.lit(-1).cast("bigint").alias("game_id"), F.expr("make_date(season_id + 20, 1, 1)").alias("date"),
        "season_id", *[F.lit(None).cast(games.schema[c].dataType).alias(c) for c in ("home_team", "guest_team", "pts_home", "pts_guest")],
        (F.col("season_id") + 2).alias("arrives"))

    def start(stream):
        sink = ratings.elo_stream(stream.drop("arrives"), delay="800 days").writeStream.format("parquet").outputMode("append")
        return sink.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/rated")

    deliver(spark, written(arriving.unionByName(last), "games"), "arriving-games", "arrives", start)
    return rounded(spark.read.parquet(f"{root}/rated"))


def _seen_before(outcome: str) -> str:
    """Results known when a game's record is written: all for a late game, those of the first wave for others."""
    count = f"coalesce(sum(case when {outcome}{{0}} then 1 else 0 end) {earlier()}, 0)"
    return f"cast(case when game_id % 7 = 0 then {count.format('')} else {count.format(' and game_id % 7 > 1')} end as bigint)"


@query("st02_record_stream", with_sql("team_games", f"""select concat(game_id, '_', team) as id, game_id, season_id, team,
    {_seen_before('win')} as wins_before, {_seen_before('not win')} as losses_before from team_games"""))
def st02(spark, sf_dir):
    """Every season comes in two waves. In the first, some games are missing and some have no result yet; the second has all games again."""
    games = fx.games(spark, sf_dir).select("game_id", "date", "season_id", "home_team", "guest_team", "is_home_win")
    root = new_path(spark, "record-stream")
    wave, place = 2 * F.col("season_id"), F.col("game_id") % 7
    first = games.where(place > 0).withColumn("is_home_win", F.when(place > 1, F.col("is_home_win")))
    both = first.withColumn("wave", wave).unionByName(games.withColumn("wave", wave + 1))
    deliver(spark, written(both, "games"), "arriving-results", "wave",
            lambda stream: records.start_records(stream, spark, root, availableNow=True))
    return spark.read.parquet(f"{root}/records").drop("batch")


#: Game ids in a part of the schedule.
PART_KEYS = 100_000


@query("st03_schedule_upserts", with_sql("sched", f"select game_id, date, {_URL} as game_url from sched"))
def st03(spark, sf_dir):
    """The schedule arrives twice: first without links, then with the links known by then."""
    rows = _schedule(spark, sf_dir).select("game_id", "date", "game_url")
    both = rows.withColumn("game_url", F.lit("")).withColumn("wave", F.lit(0)).unionByName(rows.withColumn("wave", F.lit(1)))
    root = new_path(spark, "schedule-stream")
    parts = records.Parts(spark, f"{root}/schedule", "game_id bigint, date date, game_url string", F.floor(F.col("game_id") / PART_KEYS))
    deliver(spark, written(both, "schedule"), "arriving-schedule", "wave",
            lambda stream: records.start_schedule_upserts(stream, parts, root, "wave", availableNow=True))
    return parts.table()
