"""Team perspective: results, form, difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.slices import Line
from scoreloom.semantics import latest_by, safe_div


def sides(fixtures: DataFrame, keys: list[str], kept: tuple[str, ...] = ("kickoff",)) -> DataFrame:
    """Each fixture from both sides, played or not, in one scan: team, opponent, is_home, scored, conceded."""
    def side(team: str, other: str, home: bool):
        return F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"), F.lit(home).alias("is_home"), F.col(f"{team}_score").alias("scored"), F.col(f"{other}_score").alias("conceded"))

    both = F.explode(F.array(side("home", "away", True), side("away", "home", False)))
    return fixtures.select(*keys, *kept, both.alias("r")).select(*keys, *kept, "r.*")


def match_results(fixtures: DataFrame, keys: list[str], kept: tuple[str, ...] = ("kickoff",), finished: str | None = None) -> DataFrame:
    """The sides of finished fixtures (by the flag ``finished``, if there is one) whose own score is known."""
    done = fixtures.where(F.col(finished)) if finished else fixtures
    return sides(done, keys, kept).where("scored is not null")


def team_form(results: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """Mean goals for and against over the last n matches with the current one."""
    def means(w: Window) -> dict:
        return {name: F.avg(c).over(w.rowsBetween(1 - n, 0)) for name, c in (("att", "scored"), ("def", "conceded"))}

    return Line(results, keys, order).rows(n - 1, means).done()


def latest_form(form: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The form of each team's newest match, at two places; a match whose time is unknown is newest."""
    known = form.withColumn("__undated", F.col(order[0]).isNull())
    return latest_by(known, keys, ["__undated", *order], ["att", "def"]).select(*keys, F.round("att", 2).alias("att"), F.round("def", 2).alias("def"))


def form_now(results: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """:func:`latest_form` without the form of every match: the means of each team's newest n matches.

    Spark cuts each task's rows to n a team before the shuffle, so teams with
    very many matches are no hot keys.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in order])
    newest = results.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return newest.groupBy(*keys).agg(F.round(F.avg("scored"), 2).alias("att"), F.round(F.avg("conceded"), 2).alias("def"))


def next_fixture(fixtures: DataFrame, keys: list[str], finished: str = "finished") -> DataFrame:
    """Each team's earliest fixture that isn't finished and has a time: opponent, is_home and kickoff."""
    open_ = sides(fixtures.where(~F.col(finished)), keys).where("kickoff is not null")
    first = F.min(F.struct("kickoff", *keys, "opponent", "is_home")).alias("r")
    return open_.groupBy("team").agg(first).select("team", "r.opponent", "r.is_home", "r.kickoff")


def fixture_difficulty(upcoming: DataFrame, latest: DataFrame) -> DataFrame:
    """Difficulty of each coming fixture (team, opponent, is_home, fdr) from form against the league's.

    The league's means and deviations are one row and the form has a row a
    team. A term is 0 where form is missing or the league doesn't vary; the
    rating term isn't guarded.
    """
    norm = F.broadcast(latest.agg(F.avg("att").alias("am"), F.stddev_samp("att").alias("asd"), F.avg("def").alias("dm"), F.stddev_samp("def").alias("dsd")))
    opp = latest.select(F.col("team").alias("opponent"), F.col("att").alias("o_att"), F.col("def").alias("o_def"))
    own = latest.select("team", F.col("att").alias("m_att"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    score = (
        z(safe_div(F.lit(-0.30) * (F.col("o_def") - F.col("dm")), F.col("dsd")))
        + z(safe_div(F.lit(0.30) * (F.col("o_att") - F.col("am")), F.col("asd")))
        + 0.20 * F.when(F.col("is_home"), -0.5).otherwise(0.5)
        - z(safe_div(F.lit(0.10) * (F.col("am") - F.col("m_att")), F.col("asd")))
        + 0.10 * (F.col("fdr") - 3)
    )
    return upcoming.join(norm).join(opp, "opponent", "left").join(own, "team", "left").withColumn("difficulty", F.round(score, 3))


def points_to_rows(df: DataFrame, keys: list[str], columns: list[str], name: str = "role", value: str = "value") -> DataFrame:
    """Columns as rows (role, value), in one scan."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])).alias("r")).select(*keys, "r.*")
