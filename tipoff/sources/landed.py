"""Pages and text tables as they were landed: links, stat tables, typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.functions.scalar import game_key, long_date, minutes, number

HREF = r'href="([^"]*)"'


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link of a page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(html, F.lit(HREF), 1)).alias("href"))


def team_abbrev(href: Column) -> Column:
    """Path segment after ``/teams/``, empty when the link is not a team link."""
    return F.regexp_extract(href, r"/teams/([^/]*)", 1)


def player_id(href: Column) -> Column:
    """Last path segment up to ``.html``."""
    last = F.element_at(F.split(href, "/"), -1)
    return F.element_at(F.split(last, r"\.html"), 1)


def table_rows(pages: DataFrame, table_id: str, html: str = "html") -> DataFrame:
    """Rows of one stat table as (page_id, section, row, row_id, row_name, names, texts).

    The stat names come from the second header row (``data-stat`` of all but its first cell); ``section`` is
    ``tbody`` for players or ``tfoot`` for the team totals. Header rows repeated in the body have no texts.
    """
    def inside(text: Column, tag: str) -> Column:
        return F.regexp_extract(text, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)

    whole = F.regexp_extract(html, rf'(?s)<table[^>]*id="{table_id}"[^>]*>(.*?)</table>', 1)
    # ``once`` keeps Spark from writing an expression again into every filter and column that reads it
    once = lambda value: F.explode(F.array(value))
    table = pages.select("page_id", once(whole).alias("t")).where("t <> ''")
    row = F.lit(r"(?s)<tr[^>]*>(.*?)</tr>")
    head = F.element_at(F.regexp_extract_all(inside(F.col("t"), "thead"), row, 1), 2)
    names = F.regexp_extract_all(head, F.lit(r'<th[^>]*data-stat="([^"]*)"'), 1)
    sections = F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.regexp_extract_all(inside(F.col("t"), s), row, 1).alias("rows"))
        for s in ("tbody", "tfoot")]))
    rows = table.select("page_id", once(names).alias("names"), "t").select(
        "page_id", F.slice("names", 2, F.size("names")).alias("names"), sections.alias("s")).select(
        "page_id", "names", "s.section", F.posexplode("s.rows").alias("row", "cells"))
    plain = lambda text: F.trim(F.regexp_replace(text, "<[^>]*>", ""))
    return rows.select(
        "page_id", "section", "row",
        F.regexp_extract("cells", r'<th[^>]*data-append-csv="([^"]*)"', 1).alias("row_id"),
        plain(F.regexp_extract("cells", r"(?s)<th[^>]*>(.*?)</th>", 1)).alias("row_name"), "names",
        once(F.transform(F.regexp_extract_all("cells", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), plain)).alias("texts"))


def stat_table(pages: DataFrame, table_id: str, html: str = "html") -> DataFrame:
    """Cells of one stat table as (page_id, section, row, row_id, row_name, stat, text)."""
    cells = table_rows(pages, table_id, html).select("page_id", "section", "row", "row_id", "row_name", "names", F.posexplode("texts").alias("col", "text"))
    return cells.where(F.col("col") < F.size("names")).select(
        "page_id", "section", "row", "row_id", "row_name", F.element_at("names", F.col("col") + 1).alias("stat"), "text")


def wide_stats(rows: DataFrame, section: str, stats: list[str]) -> DataFrame:
    """The table rows of a section with the named stats as text columns, NULL where the row has no such cell. Each row is
    read by itself, so nothing is shuffled; of several columns with one name the first counts."""
    place = lambda stat: F.array_position("names", F.lit(stat)).cast("int")
    cell = lambda stat: F.when(place(stat) > 0, F.get("texts", place(stat) - 1)).alias(stat)
    return rows.where((F.col("section") == section) & (F.size("texts") > 0)).select("page_id", "row", "row_id", "row_name", *map(cell, stats))


def typed_players(rows: DataFrame, stats: list[str]) -> DataFrame:
    """Minutes from ``MM:SS`` and all other stats as doubles; notes become NULL."""
    return rows.select(
        "page_id", F.col("row_id").alias("player_id"), F.col("row_name").alias("player_name"),
        minutes("mp").alias("mp"), *[number(s).alias(s) for s in stats if s != "mp"])


def player_boxscores(basic: DataFrame, advanced: DataFrame) -> DataFrame:
    """Basic joined with advanced stats on (page, player name, minutes); players without minutes vanish."""
    return basic.join(advanced.drop("player_id"), ["page_id", "player_name", "mp"])


def typed_schedule(rows: DataFrame) -> DataFrame:
    """Landed schedule text as typed rows with the game key."""
    dated = rows.select("*", long_date("Date").alias("__date"))
    return dated.select(
        game_key("__date", "home_abbrev").alias("game_id"), F.col("__date").alias("date"),
        F.col("Home").alias("home_team"), F.col("Visitor").alias("guest_team"), "home_abbrev", "guest_abbrev",
        "arena", F.col("Box_Score_URL").alias("game_url"))


def current_roster(squad_links: DataFrame, injuries: DataFrame) -> DataFrame:
    """Squad with its injury notes, NULL for healthy players."""
    return squad_links.join(injuries.select("player_id", "injury"), "player_id", "left")
