"""Documents of the pages and the decisions shown on them; the last small frames are collected here, and only here.

A squad has 15 rows, a league 20 teams and a season 38 weeks, and each
collect is of one of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.decisions import SQUAD_SHAPE, best_line_up
from scoreloom.plans.payloads import captain_change, lineup_changes, lineup_plan, season_accuracy, season_summary
from scoreloom.plans.reads import last_ingested_week, next_deadline

SQUAD_ROWS = sum(SQUAD_SHAPE.values())
#: Rows of a page; a frame with more is no squad, league or season, and an error.
PAGE_ROWS = 1_000


def shown(df: DataFrame) -> list[dict]:
    """The rows of a page, in the frame's order."""
    rows = df.limit(PAGE_ROWS + 1).collect()
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"a page has at most {PAGE_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def iso(ts: Column) -> Column:
    """A time in UTC as text with a Z, to the second."""
    return F.date_format(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def site_page(stats: DataFrame, rankings: DataFrame, gameweeks: DataFrame, season: str, now: Column, horizon: int = 5) -> DataFrame:
    """One row: when it was made, the last week with stats, the predicted week, the next deadline (null for none)."""
    deadline = next_deadline(gameweeks, season, now).select("event_id", "name", iso(F.col("deadline_time")).alias("time"))
    at = deadline.agg(F.first(F.struct("event_id", "name", "time")).alias("deadline"))
    told = rankings.agg(F.max("predicted_gw").alias("predicted_gw"))
    last = last_ingested_week(stats, season).withColumnRenamed("gw", "last_gw")
    return last.join(told).join(at).select(iso(now).alias("generated_at"), F.lit(season).alias("season"), "last_gw", "predicted_gw", "deadline", F.lit(horizon).alias("horizon"))


def replan(squad: DataFrame, live: list[int], value: str = "predicted_points") -> DataFrame:
    """The line-up of the players actually owned; ValueError where one of them isn't known or comes twice."""
    wanted = squad.sparkSession.createDataFrame([(c,) for c in live], "player_code long")
    rows = wanted.join(squad, "player_code")
    if len(set(live)) != len(live) or rows.count() != len(live):
        raise ValueError("the squad has players that aren't known, or one twice")
    return lineup_plan(rows, value)


def squad_comparison(own: DataFrame, best: DataFrame, objective: float, value: str) -> DataFrame:
    """One row: the own squad's best eleven on the same basis, its gap, how many players match and how many transfers the rest takes."""
    line = best_line_up(own.withColumn("__k", F.lit(1)), ["__k"], "position", value, ["player_code"]).select("total")
    same = own.join(best.select("player_code"), "player_code", "left_semi").agg(F.count("*").alias("overlap"))
    return line.join(same).select(F.col("total").alias("own_total"), (F.lit(objective) - F.col("total")).alias("gap"), "overlap", (F.lit(SQUAD_ROWS) - F.col("overlap")).alias("transfers_needed"))


def fixture_extremes(grid: DataFrame, owned: DataFrame) -> DataFrame:
    """One row: the teams with the easiest and the hardest run (avg), and whether the latter's players are owned."""
    ends = grid.agg(F.min_by("team", F.struct("avg", "team")).alias("best"), F.max_by("team", F.struct("avg", "team")).alias("worst"))
    mine = owned.select(F.col("team").alias("worst")).distinct().withColumn("warn", F.lit(True))
    return ends.join(F.broadcast(mine), "worst", "left").select("best", "worst", F.coalesce("warn", F.lit(False)).alias("warn"))


def solution_index(solutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Solutions (basis, budget, spend, objective, players) as distinct squads and an index from budgets to them."""
    signed = solutions.withColumn("squad", F.md5(F.array_join(F.transform(F.array_sort("players"), lambda p: p.cast("string")), ",")))
    squads = signed.where("players is not null").groupBy("squad").agg(F.first("players").alias("players"), F.min("spend").alias("spend"))
    return squads, signed.select("basis", "budget", "objective", F.when(F.col("players").isNotNull(), F.col("squad")).alias("squad"))


def solution_lookup(squads: DataFrame, index: DataFrame, basis: str, budget: float) -> DataFrame:
    """One row for a budget: found, the squad and what it leaves unspent; a budget that isn't indexed gives found = false."""
    asked = squads.sparkSession.createDataFrame([(basis, float(budget))], "basis string, budget double")
    row = asked.join(index, ["basis", "budget"], "left").join(squads, "squad", "left")
    return row.select("basis", "budget", F.col("players").isNotNull().alias("found"), "objective", "players", F.greatest(F.lit(0.0), F.col("budget") - F.col("spend")).alias("unspent"))


def optimal_squad_page(solutions: DataFrame, players: DataFrame) -> dict[str, DataFrame]:
    """The squads, the index by budget, and the players that any squad refers to."""
    squads, index = solution_index(solutions)
    used = squads.select(F.explode("players").alias("player_code")).distinct()
    return {"squads": squads, "by_budget": index, "players": players.join(used, "player_code", "left_semi")}


def paired(on: list[dict], off: list[dict]) -> list[tuple[int, int]]:
    """(on, off) by code: each that goes off meets one of its position that comes on, if one is left, else the first left."""
    left, out = sorted(on, key=lambda r: r["player_code"]), []
    for gone in sorted(off, key=lambda r: r["player_code"]):
        if left:
            come = next((r for r in left if r["position"] == gone["position"]), left[0])
            left.remove(come)
            out.append((come["player_code"], gone["player_code"]))
    return out


def calls(squad: DataFrame, plan: DataFrame | None = None) -> list[dict]:
    """What is to be done about a squad, numbered: captain, line-up, transfer, each with a done flag."""
    out = []
    cap = captain_change(squad).first()
    if cap["best"] is not None:
        out.append({"kind": "captain", "done": bool(cap["done"]), "from": cap["held"], "to": cap["best"], "gain": cap["gain"]})
    moves = shown(lineup_changes(squad).join(squad.select("player_code", "position"), "player_code"))
    pairs = paired([m for m in moves if m["change"] == "in"], [m for m in moves if m["change"] == "out"])
    out.append({"kind": "lineup", "done": not pairs, "pairs": pairs})
    steps = [] if plan is None else shown(plan.orderBy("step"))
    if steps:
        out.append({"kind": "transfer", "done": False, "sell": steps[0]["sell"], "buy": steps[0]["buy"], "net": round(steps[0]["net"], 1), "hit": steps[0]["hit"], "more": len(steps) - 1})
    return [{"n": i, **c} for i, c in enumerate(out, 1)]


def this_week_page(squad: DataFrame | None, plan: DataFrame | None = None) -> dict:
    """The board, its best form, the calls and the plan; all empty without a squad."""
    if squad is None or squad.isEmpty():
        return {"squad": None, "after": None, "calls": [], "plan": []}
    after = lineup_plan(squad).orderBy("role", "player_code").select("player_code", "role", "bench_order")
    return {"squad": shown(squad.orderBy("squad_position")), "after": shown(after), "calls": calls(squad, plan), "plan": [] if plan is None else shown(plan.orderBy("step"))}


def season_page(weeks: DataFrame) -> dict:
    """Summary, weeks in order and accuracy of a season; without weeks all are empty, without predictions the accuracy is."""
    listed = shown(weeks.orderBy("gw"))
    if not listed:
        return {"summary": None, "gameweeks": [], "accuracy": None}
    accuracy = season_accuracy(weeks).first().asDict()
    return {"summary": season_summary(weeks).first().asDict(), "gameweeks": listed, "accuracy": accuracy if accuracy["weeks"] else None}


def approval_plans(next_week: DataFrame, horizon: DataFrame, free: int) -> DataFrame:
    """One row with both transfer plans, nested; which one holds is chosen at approval."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct("step", "sell", "buy", "net", "hit"))).alias(name))

    return rows(next_week, "next_gw").join(rows(horizon, "five_gw")).withColumn("free_transfers", F.lit(free))


def chosen_plan(approval: DataFrame, variant: Column) -> DataFrame:
    """The plan that an approval names; silence means the next week's."""
    return approval.select(F.when(F.coalesce(variant, F.lit("next_gw")) == "five_gw", F.col("five_gw")).otherwise(F.col("next_gw")).alias("transfers"), "free_transfers")


def lab_page(reference: DataFrame, groups: DataFrame) -> DataFrame:
    """Each left-out group's R2 against the reference run: what leaving it out costs, dearest first."""
    base = F.broadcast(reference.select(F.col("r2").alias("reference_r2")).limit(1))
    return groups.join(base).withColumn("delta", F.col("r2") - F.col("reference_r2")).orderBy("delta", "group")


def teams_of(players: DataFrame) -> DataFrame:
    """The distinct teams of each group of players, as a sorted set."""
    return players.groupBy("group").agg(F.sort_array(F.collect_set("team")).alias("teams"))
