"""Reading, slicing and maintaining the landed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.session import written

def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None,
               order_by: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Projection and filter of a Parquet table; both reach the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    return df.orderBy(order_by) if order_by else df


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int,
              properties: dict[str, str]) -> DataFrame:
    """Partitioned scan of a database table: ``parts`` parallel range reads on a numeric key instead of pages."""
    return spark.read.jdbc(url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts,
                           properties=properties)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_by_season(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Season-partitioned Parquet. Rebalancing gathers small seasons into few files and splits large ones."""
    df.hint("rebalance", "season_id").write.mode(mode).partitionBy("season_id").parquet(path)


def distinct_keys(df: DataFrame, key: str, season: int | None = None) -> DataFrame:
    rows = df if season is None else df.where(F.col("season_id") == season)
    return rows.select(key).distinct()


def distinct_where_in(df: DataFrame, column: str, match: str, keys: DataFrame) -> DataFrame:
    """Distinct non-NULL values of ``column`` in rows whose ``match`` occurs in ``keys``: a semi-join."""
    wanted = keys.select(F.col(keys.columns[0]).alias(match))
    return df.where(F.col(column).isNotNull()).join(wanted, match, "left_semi").select(column).distinct()


def month_slice(df: DataFrame, day, date_column: str = "date") -> DataFrame:
    """Rows of the calendar month of ``day``: from its first day up to, not including, the next month's."""
    first = day.replace(day=1)
    following = first.replace(year=first.year + first.month // 12, month=first.month % 12 + 1)
    return df.where((F.col(date_column) >= F.lit(first)) & (F.col(date_column) < F.lit(following)))


def latest_slice(first: DataFrame, second: DataFrame, by: str, key: str, value=None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``first`` at the largest (or the given) ``by``, and the rows of ``second`` that share ``key``."""
    if value is None:
        top = F.broadcast(first.agg(F.max(by).alias(by)))  # one row
        chosen = first.join(top, by, "left_semi")
    else:
        chosen = first.where(F.col(by) == value)
    return chosen, second.join(chosen.select(key), key, "left_semi")


def latest_season(schedule: DataFrame) -> DataFrame:
    return schedule.agg(F.max("season_id").alias("season_id"))


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return incoming.join(stored.select(*keys), keys, "left_anti")


def append_new(incoming: DataFrame, stored_path: str, keys: list[str]) -> None:
    """Append rows that are missing; running it twice changes nothing."""
    spark = incoming.sparkSession
    stored = spark.read.parquet(stored_path)
    new_rows(incoming, stored, keys).write.mode("append").parquet(stored_path)


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: incoming rows win. Latest-wins is a partial aggregation, not a sort."""
    columns = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, *columns, F.lit(0).alias("__version")).unionByName(
        incoming.select(*keys, *columns, F.lit(1).alias("__version")))
    winner = F.max_by(F.struct(*columns), "__version").alias("__row")
    return both.groupBy(*keys).agg(winner).select(*keys, "__row.*").select(*stored.columns)


def upsert_partitions(incoming: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Upsert into a table partitioned by a column that its keys imply: only the partitions that ``incoming`` has are read and replaced."""
    spark = incoming.sparkSession
    stored = spark.read.parquet(path)
    touched = stored.join(incoming.select(partition).distinct(), partition, "left_semi")
    merged = written(upserted(touched, incoming, keys), "upsert")  # read before it is overwritten
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def changed_rows(landed: DataFrame, stored: DataFrame) -> DataFrame:
    """Landed games that are new, or whose box-score link has appeared since."""
    old = stored.select("game_id", F.col("game_url").alias("__old"))
    appeared = (F.col("game_url") != "") & (F.col("__old") == "")
    return landed.join(old, "game_id", "left").where(F.col("__old").isNull() | appeared).drop("__old")


def missing_work(schedule: DataFrame, team_box: DataFrame, player_box: DataFrame) -> DataFrame:
    """Linked games that lack their team or their player box scores, with what is missing."""
    def present(df: DataFrame, flag: str) -> DataFrame:
        return df.select("game_id").distinct().select("game_id", F.lit(True).alias(flag))

    linked = schedule.where(F.col("game_url") != "")
    joined = linked.join(present(team_box, "__t"), "game_id", "left").join(present(player_box, "__p"), "game_id", "left")
    flags = joined.select(
        *schedule.columns, F.col("__t").isNull().alias("needs_team"), F.col("__p").isNull().alias("needs_player"))
    return flags.where("needs_team or needs_player")


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
