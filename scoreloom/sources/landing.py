"""Landed files to tables: JSON, parameterised SQL, ordered ingest, reports, a cache with an age. Pulls are in :mod:`scoreloom.sources.pull`."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.text import leading_int
from scoreloom.operators.merge import insert_absent, upsert
from scoreloom.sources.archive import read_or_empty, to_codes


def landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed payloads, one document a file, typed by ``schema``; a malformed file fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def sql_read(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A query over frames named in braces, with values bound to ``:name`` markers and never spliced in."""
    return spark.sql(sql, args=args or {}, **frames)


def ingest_weeks(events: DataFrame, first: list[Callable[[], None]], week: Callable[[int], None]) -> list[int]:
    """Run the loads of dimensions in order, then the load of every week that is finished or current.

    ``events`` has id, finished and is_current, a row a week of one season. A
    week is written before the next one starts, so a failure loses only its
    own week, and running again is safe where the loads are upserts.
    """
    for load in first:
        load()
    weeks = [r["id"] for r in events.where(F.col("finished") | F.col("is_current")).select("id").orderBy("id").collect()]
    for w in weeks:
        week(w)
    return weeks


def land_players(old: DataFrame, payload: DataFrame, season: str, seq: Column) -> DataFrame:
    """The player table after a pull: names of the payload's elements by their stable code."""
    new = payload.select(F.explode("elements").alias("e")).select(F.col("e.code").cast("long").alias("player_code"), F.col("e.web_name").alias("web_name"), F.lit(season).alias("season"), seq.alias("seq"))
    return upsert(old, new.select(*old.columns), ["player_code"], "seq")


def land_week(old: DataFrame, live: DataFrame, ids: DataFrame, season: str, week: int, seq: Column) -> DataFrame:
    """The stats table after a week's pull; elements that lead to no player are skipped."""
    rows = live.select(F.explode("elements").alias("e")).select(F.lit(season).alias("season"), F.col("e.id").cast("int").alias("element"), F.col("e.stats.*"))
    known = to_codes(rows, ids, "element").where("code is not null")
    new = known.withColumns({"player_code": F.col("code").cast("long"), "event_id": F.lit(week), "seq": seq})
    return upsert(old, new.select(*old.columns), ["season", "player_code", "event_id"], "seq")


def report(df: DataFrame, path: str, order: list[str]) -> None:
    """A sorted CSV with a header, in one file; for reports of a size that people read."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def directory(spark: SparkSession, root: str, seasons: list[str]) -> DataFrame:
    """Names over all seasons: code, full_name, web_name, team and season, a row a player and season.

    Seasons without a player file have no rows; those without a team file have no team.
    """
    out = None
    for season in sorted(seasons):
        people = read_or_empty(spark, f"{root}/{season}/players_raw.csv", "code long, first_name string, second_name string, web_name string, team int")
        clubs = read_or_empty(spark, f"{root}/{season}/teams.csv", "id int, name string").select(F.col("id").alias("team"), F.col("name").alias("club"))
        rows = people.join(clubs, "team", "left").select("code", F.concat_ws(" ", "first_name", "second_name").alias("full_name"), "web_name", F.col("club").alias("team"), F.lit(season).alias("season"))
        out = rows if out is None else out.unionByName(rows)
    return out


def apply_matches(records: DataFrame, matches: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Injury records with the codes of their names, typed, and the names that have none, sorted.

    ``records`` has player_name, league, injury, injury_from, injury_until,
    days and games as text. Records without a code are dropped, not guessed.
    """
    codes = matches.where("code is not null").select(F.col("raw_name").alias("player_name"), F.col("code").alias("player_code"))
    rows = records.join(codes, "player_name").select(
        "player_code", F.lit(source).alias("source"), "league", F.col("injury").alias("injury_type"), F.col("injury_from").try_cast("date").alias("injury_from"), F.col("injury_until").try_cast("date").alias("injury_until"),
        leading_int("days").alias("days_out"), F.col("games").try_cast("int").alias("games_missed"), F.col("player_name").alias("raw_player_name"),
    )
    return rows, matches.where("code is null").select("raw_name").distinct().orderBy("raw_name")


def add_injuries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Injuries that aren't known yet, added; the natural key has no updates."""
    return insert_absent(old, new, ["player_code", "source", "injury_from", "injury_type"], ["raw_player_name"])


class Aged:
    """Frames kept in memory for so many seconds; an older one is dropped and built again."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key, build: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            return self.held[key][1]
        self.drop(key)
        self.held[key] = now, build().persist()
        return self.held[key][1]

    def drop(self, key) -> None:
        if key in self.held:
            self.held.pop(key)[1].unpersist()
