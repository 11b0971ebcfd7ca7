"""Season archives and landed JSON as keyed tables; documents as strict JSON."""

from __future__ import annotations

import csv
import json
import math
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column families that older seasons lack.
XG_COLUMNS = ["starts", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded"]
DC_COLUMNS = ["clearances_blocks_interceptions", "defensive_contribution", "recoveries", "tackles"]
STATS = [
    "minutes", "goals_scored", "assists", "bps", "bonus", "total_points", "clean_sheets", "goals_conceded", "own_goals", "saves",
    "yellow_cards", "red_cards", "influence", "creativity", "threat", "ict_index",
]
ARCHIVE_SCHEMA = (
    "element int, GW int, fixture int, name string, position string, team string, opponent_team int, was_home boolean, kickoff_time timestamp, "
    "team_h_score int, team_a_score int, value int, selected long, " + ", ".join(f"{c} double" for c in STATS + XG_COLUMNS + DC_COLUMNS)
)


def read_or_empty(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A CSV by header, pruned and typed by ``schema``; an absent file is an empty frame of that schema."""
    wanted = spark.createDataFrame([], schema).schema
    try:
        raw = spark.read.options(header=True, **options).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], wanted)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, None where there is no file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(at), "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def seasons(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """All seasons' player rows in one scan, typed, with availability flags for the column families that came later.

    Columns are found by each season's own header line, in any order; those
    that a season lacks are null. A season without a file has no rows. The
    season comes from the file's path, so a filter on it skips files.
    """
    wanted = spark.createDataFrame([], ARCHIVE_SCHEMA).schema
    paths = {n: str(PurePosixPath(root) / n / "merged_gw.csv") for n in names}
    lines = {n: first_line(spark, p) for n, p in sorted(paths.items())}
    # The text reader drops a byte order mark; so does this.
    found = {n: x.removeprefix("\ufeff") for n, x in lines.items() if x}
    headers = {n: next(csv.reader([x])) for n, x in found.items()}
    flags = {"xg_data_available": "expected_goals", "dc_data_available": "defensive_contribution"}
    if not found:
        return spark.createDataFrame([], f"{ARCHIVE_SCHEMA}, season string, " + ", ".join(f"{f} int" for f in flags))

    def by_season(value):
        """A value for each season's header, as a lookup by season."""
        return F.create_map(*[F.lit(x) for n, h in headers.items() for x in (n, value(n, h))])[F.col("season")]

    text = spark.read.text([paths[n] for n in found]).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("season"))
    body = text.where((F.trim("value") != "") & (F.col("value") != by_season(lambda n, h: found[n])))
    width = max(map(len, headers.values()))
    cells = body.select("season", F.from_csv("value", ", ".join(f"c{i} string" for i in range(width))).alias("c"))
    row = F.array(*[F.col(f"c.c{i}") for i in range(width)])

    def cell(name: str) -> Column:
        places = {n: h.index(name) for n, h in headers.items() if name in h}
        if len(places) == len(headers) and len(set(places.values())) == 1:
            return F.col(f"c.c{next(iter(places.values()))}")
        return F.get(row, by_season(lambda n, h: places.get(n, -1))) if places else F.lit(None)

    rows = cells.select(*[cell(f.name).try_cast(f.dataType).alias(f.name) for f in wanted], "season", *[by_season(lambda n, h, c=c: int(c in h)).alias(f) for f, c in flags.items()])
    return rows.where("position <> 'AM'").withColumn("position", F.when(F.col("position") == "GK", "GKP").otherwise(F.col("position")))


# Other names of positions, and the numbers that stand for them.
POSITION_NAMES = {"GK": "GKP", "1": "GKP", "2": "DEF", "3": "MID", "4": "FWD"}


def relabelled(df: DataFrame, names: dict[str, str] | None = None, values: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Columns under other names, then values of columns (as text) under other labels; values without one stay."""
    out = df.withColumnsRenamed(names or {})
    told = {c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col(c).cast("string")), F.col(c).cast("string")) for c, labels in (values or {}).items()}
    return out.withColumns(told)


def flatten(landed: DataFrame, array: str, fields: dict[str, str], nested: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of an array in landed JSON, typed; numbers that came as text are cast, bad ones are null."""
    item = landed.select(*keep, F.explode(array).alias("e"))
    at = "e" if nested is None else f"e.{nested}"
    return item.select(*keep, *[F.col(f"{at}.{name}").try_cast(kind).alias(name) for name, kind in fields.items()])


def raw_snapshot(payloads: DataFrame, endpoint: str, season: str) -> DataFrame:
    """The landing log: a row a pull, with the whole payload as a variant."""
    return payloads.select(F.lit(endpoint).alias("endpoint"), F.lit(season).alias("season"), F.try_parse_json("payload").alias("payload"))


def to_codes(df: DataFrame, ids: DataFrame, id_column: str, keys: tuple[str, ...] = ("season",)) -> DataFrame:
    """Season-local ids to stable codes: adds code, null where an id is unknown."""
    return df.join(ids.select(*keys, F.col("id").alias(id_column), "code"), [*keys, id_column], "left")


def known_only(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose references all lead somewhere; the others are skipped, not landed."""
    return df.dropna(subset=list(columns))


def nan_free(c: Column) -> Column:
    return F.nanvl(c, F.lit(None))


def strict_json(value: object) -> str:
    """JSON without NaN or infinities; a number that isn't finite raises ValueError."""
    def plain(o: object) -> object:
        if hasattr(o, "asDict"):
            return plain(o.asDict(recursive=True))
        if hasattr(o, "item") and not isinstance(o, (str, bytes)):
            return o.item()
        if hasattr(o, "isoformat"):
            return o.isoformat()
        if isinstance(o, dict):
            return {str(k): plain(v) for k, v in o.items()}
        if isinstance(o, (list, tuple)):
            return [plain(v) for v in o]
        if isinstance(o, float) and not math.isfinite(o):
            raise ValueError("number isn't finite")
        return o

    return json.dumps(plain(value), allow_nan=False, ensure_ascii=False, separators=(",", ":"), default=str)
