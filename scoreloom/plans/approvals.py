"""What an approval looks up before it acts, and the bundle of recommendations it offers.

Lists of players come from a squad, so they are a few dozen; tables are
filtered by them and never collected whole. The state of an approval is a
key of :class:`scoreloom.sources.claims.Claims`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.decisions import suggestions
from scoreloom.plans.payloads import lineup_plan, recommendation
from scoreloom.plans.reads import POSITIONS
from scoreloom.semantics import latest_by

#: Players of a list at most, and rows of a lookup that reach the driver.
MOST_CODES = 1_000


def _listed(codes: list[int]) -> list[int]:
    if len(codes) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} players in one lookup")
    return list(codes)


def id_map(player_seasons: DataFrame, season: str, codes: list[int]) -> DataFrame:
    """player_code and the season's own id of the listed players; those who aren't in the season are absent."""
    rows = player_seasons.where((F.col("season") == season) & F.col("player_code").isin(_listed(codes)))
    return rows.select("player_code", "fpl_id").distinct()


def latest_prices(snapshots: DataFrame, season: str, codes: list[int]) -> DataFrame:
    """player_code and now_cost of the newest snapshot of each listed player."""
    rows = snapshots.where((F.col("season") == season) & F.col("player_code").isin(_listed(codes)))
    return latest_by(rows, ["player_code"], ["snapshot_date"], ["now_cost"])


def code_by_name(players: DataFrame, web_name: str) -> int:
    """The code of the one player of that name; ValueError where there is none, or more than one."""
    found = [r["player_code"] for r in players.where(F.col("web_name") == web_name).select("player_code").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no player' if not found else 'more than one player'} is called {web_name!r}")
    return found[0]


def live_squad(elements: list[int], player_seasons: DataFrame, players: DataFrame, predictions: DataFrame, season: str) -> DataFrame:
    """element, player_code, web_name, position and predicted_points of the squad's season ids.

    Predictions are those of the season's last predicted week; a missing one
    counts as 0. ValueError names the ids that the season doesn't know.
    """
    mine = player_seasons.where((F.col("season") == season) & F.col("fpl_id").isin(_listed(elements))).select(F.col("fpl_id").alias("element"), "player_code", "element_type")
    unknown = sorted(set(elements) - {r["element"] for r in mine.select("element").distinct().limit(MOST_CODES).collect()})
    if unknown:
        raise ValueError(f"{season} doesn't know the elements {unknown}")
    told = predictions.where(F.col("season") == season)
    last = told.agg(F.max("event_id").alias("event_id"))
    now = told.join(F.broadcast(last), "event_id").select("player_code", "predicted_points")
    position = F.element_at(F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv]), F.col("element_type"))
    rows = mine.join(players.select("player_code", "web_name"), "player_code").join(now, "player_code", "left")
    return rows.select("element", "player_code", "web_name", position.alias("position"), F.coalesce("predicted_points", F.lit(0.0)).alias("predicted_points"))


def bundle(squad: DataFrame, rankings: DataFrame, fixtures: DataFrame, horizon: int, bank: float) -> dict[str, DataFrame]:
    """All that a week's decision looks at: rankings over the horizon, transfers by either, the line-up.

    ``squad`` has player_code; ``rankings`` player_code, position, team,
    price, status and predicted_points; ``fixtures`` player and score. The
    result has ``rankings``, ``squad`` (their rows of it), ``next_week`` and
    ``horizon`` (the best three replacements of each player by next week's
    points and by those of the horizon), and ``line_up`` with formation,
    captain, vice-captain and bench order.
    """
    ranked = recommendation(rankings, fixtures, horizon)
    own = ranked.join(squad.select("player_code").distinct(), "player_code", "left_semi")

    def transfers(value: str) -> DataFrame:
        columns = [F.col("player_code").alias("player"), "position", "team", "price", F.coalesce(value, F.lit(0.0)).alias("value")]
        return suggestions(own.select(*columns), ranked.select(*columns, "status"), bank)

    return {"rankings": ranked, "squad": own, "next_week": transfers("predicted_points"), "horizon": transfers("horizon_points"), "line_up": lineup_plan(own)}


def transfer_plan(found: DataFrame, names: DataFrame, hit: float, free: int, most: int = 5) -> list[dict]:
    """The transfers of an approval in order of their gain: each player sold and bought once, gains less the hits beyond the free ones.

    ``found`` is a result of :func:`scoreloom.operators.decisions.suggestions`
    for one squad, at most three rows a player, and ``names`` has player_code
    and web_name. A transfer whose gain doesn't pay for its hit ends the plan.
    """
    called = names.select(F.col("player_code").alias("__c"), "web_name")
    rows = found.join(called.withColumnsRenamed({"__c": "sell_player", "web_name": "sell"}), "sell_player", "left").join(called.withColumnsRenamed({"__c": "buy_player", "web_name": "buy"}), "buy_player", "left")
    got = rows.orderBy(F.col("gain").desc(), "sell_player", "buy_player").limit(3 * MOST_CODES).collect()
    plan, used = [], set()
    for r in got:
        cost = hit if len(plan) >= free else 0.0
        if len(plan) == most or r["gain"] <= cost:
            break
        if not used & {("s", r["sell_player"]), ("b", r["buy_player"])}:
            used |= {("s", r["sell_player"]), ("b", r["buy_player"])}
            plan.append({"sell": r["sell"], "buy": r["buy"], "sell_code": r["sell_player"], "buy_code": r["buy_player"], "gain": round(r["gain"], 2), "hit": cost, "net": round(r["gain"] - cost, 2)})
    return plan
