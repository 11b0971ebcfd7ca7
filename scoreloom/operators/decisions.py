"""Decisions: points over a horizon, best line-up, transfers, simulations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.bands import difficulty_multiplier
from scoreloom.operators.slices import BEFORE, Line
from scoreloom.semantics import hash_uniform

# The eight formations (defenders, midfielders, forwards), in order of preference.
FORMATIONS = [(3, 4, 3), (3, 5, 2), (4, 3, 3), (4, 4, 2), (4, 5, 1), (5, 2, 3), (5, 3, 2), (5, 4, 1)]
HIT = 4.0
SQUAD_SHAPE = {"GKP": 2, "DEF": 5, "MID": 5, "FWD": 3}
TEAM_LIMIT = 3


def horizon_points(players: DataFrame, fixtures: DataFrame, horizon: int, predicted: str = "predicted", week: str | None = None) -> DataFrame:
    """Predicted points times the sum of fixture multipliers, and the number of fixtures; none gives 0.

    ``players`` has player and the prediction, ``fixtures`` player and score.
    Without any fixture row at all the window is unknown, and the prediction
    counts once for each of its weeks. Where ``week`` names the column of the
    predicted week and no player has one, there is no window: the prediction
    counts once, as one fixture.
    """
    per = fixtures.groupBy("player").agg(F.sum(difficulty_multiplier(F.col("score"))).alias("__m"), F.count("*").alias("__n"))
    known = F.broadcast(fixtures.agg((F.count("*") > 0).alias("__known")))
    anchored = F.broadcast(players.agg((F.count(week) > 0 if week else F.lit(True)).alias("__anchored")))
    return (
        players.join(per, "player", "left")
        .join(known)
        .join(anchored)
        .withColumns(
            {
                "horizon_points": F.when(~F.col("__anchored"), F.col(predicted)).when(F.col("__known"), F.col(predicted) * F.coalesce("__m", F.lit(0.0))).otherwise(F.col(predicted) * horizon),
                "fixtures": F.when(~F.col("__anchored"), F.lit(1)).when(F.col("__known"), F.coalesce("__n", F.lit(0))).otherwise(F.lit(horizon)).cast("long"),
            }
        )
        .drop("__m", "__n", "__known", "__anchored")
    )


def best_line_up(players: DataFrame, keys: list[str], position: str, value: str, tie: list[str], formations=FORMATIONS, labels=("GKP", "DEF", "MID", "FWD")) -> DataFrame:
    """Best total and formation of each key: one keeper and the top of each line, over all formations.

    Players are ranked once; a formation's total is a sum of prefix sums by
    position, so eight formations cost eight rows a key. Of equal totals the
    earlier formation wins; formations that can't be filled don't count.
    """
    w = Window.partitionBy(*keys, position).orderBy(F.col(value).desc(), *tie)
    ranked = players.where(F.col(position).isin(*labels)).withColumn("__n", F.row_number().over(w))
    ranked = ranked.where("__n <= 5").withColumn("__top", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wide = ranked.groupBy(*keys).agg(*[F.max(F.when((F.col(position) == p) & (F.col("__n") == n), F.col("__top"))).alias(f"{p}{n}") for p in labels for n in range(1, 6)])
    g, d, m, f = labels
    options = F.array(
        *[
            F.struct((F.col(f"{g}1") + F.col(f"{d}{a}") + F.col(f"{m}{b}") + F.col(f"{f}{c}")).alias("total"), F.lit(-i).alias("rank"), F.lit(f"{a}-{b}-{c}").alias("formation"))
            for i, (a, b, c) in enumerate(formations)
        ]
    )
    best = F.array_max(F.filter(options, lambda o: o["total"].isNotNull()))
    return wide.select(*keys, best.alias("b")).where("b is not null").select(*keys, "b.formation", "b.total")


def score_weeks(squads: DataFrame, weeks: DataFrame, value: str = "predicted") -> DataFrame:
    """Points of each squad and week: the line-up that ``value`` picks, by what its players then made, the captain's twice.

    ``squads`` has group and player, ``weeks`` gw, player, position, actual
    and the value. Null values and points count as 0. The captain has the
    greatest value in the line-up, the smaller player of equals. Weeks in
    which a squad can't fill any formation have no row; a player without a
    row in a week isn't picked in it.
    """
    told = weeks.select("gw", "player", "position", F.coalesce(value, F.lit(0.0)).alias("__v"), F.coalesce("actual", F.lit(0.0)).alias("actual"))
    # A merge whatever the estimates, which count a table's bytes and not the weeks that its rows become.
    rows = squads.select("group", "player").distinct().join(told.hint("merge"), "player")
    best = best_line_up(rows, ["group", "gw"], "position", "__v", ["player"]).select("group", "gw", "formation")
    counts = F.array(F.lit(1), *[F.split("formation", "-")[i].cast("int") for i in range(3)])
    places = F.array(*map(F.lit, SQUAD_SHAPE))
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("group", "gw", "position").orderBy(F.col("__v").desc(), "player")))
    ranked = ranked.where(F.col("__n") <= max(map(max, FORMATIONS)))
    picked = ranked.join(best, ["group", "gw"]).where(F.col("__n") <= F.get(counts, F.array_position(places, F.col("position")).cast("int") - 1))
    captain = F.max_by(F.struct("player", "actual"), F.struct("__v", (-F.col("player")).alias("o")))
    told = picked.groupBy("group", "gw", "formation").agg(F.sum("actual").alias("sum"), captain.alias("c"))
    return told.select("group", "gw", "formation", F.col("c.player").alias("captain"), (F.col("sum") + F.col("c.actual")).alias("points"))


def best_within(items: DataFrame, probes: DataFrame, keys: list[str], at: str, best: str, top: int) -> DataFrame:
    """``probes`` with the ``top`` greatest ``best`` of the items of their key at or below their place ``at``, as list ``found``.

    Items and probes lie on one line by ``at``. The greatest so far is a
    running maximum. What an item, or the maximum that it pushes aside, leaves
    for the second place has as its running maximum the second greatest, and
    so on: a window a place, and no pair is formed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    asks = probes.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(items.schema[best].dataType).alias("__x0"), row.alias("__row"))
    held = items.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.col(best).alias("__x0"), F.lit(None).cast(asks.schema["__row"].dataType).alias("__row"))
    line = Line(held.unionByName(asks), keys, ["__at", "__kind"])
    for i in range(top):
        line.running(BEFORE, {f"__b{i}": ("max", F.col(f"__x{i}"))})
        over = F.col(f"__b{i}")
        line.df = line.df.withColumn(f"__x{i + 1}", F.when(over.isNotNull() & F.col(f"__x{i}").isNotNull(), F.least(f"__x{i}", over)))
    found = F.filter(F.array(*[F.col(f"__b{i}") for i in range(top)]), lambda b: b.isNotNull())
    return line.done().where("__kind = 1").select("__row.*", found.alias("found"))


def suggestions(owned: DataFrame, pool: DataFrame, bank: float, top: int = 3, hit: float = HIT) -> DataFrame:
    """For each owned player the best replacements: same position, available, affordable, within the team limit, better.

    Columns of both: player (a number), position, team, price, value; the pool
    also has status. Teams that are full open only to those who sell one of
    the same team, so their players have lanes of their own; a seller asks
    the open lane of its position, and its team's where that is full. Rows
    without position, price or value take no part.
    """
    known = F.col("position").isNotNull() & F.col("price").isNotNull() & F.col("value").isNotNull()
    counts = owned.groupBy("team").agg(F.count("*").alias("held"))
    full, lane = F.coalesce("held", F.lit(0)), F.when(F.col("held") == TEAM_LIMIT, F.col("team"))
    free = pool.where((F.col("status") == "a") & known).join(owned.select("player").distinct(), "player", "left_anti").join(counts, "team", "left")
    best = F.struct(F.col("value").alias("value"), (-F.col("player")).alias("order"), "player", "team", "price").alias("best")
    items = free.where(full <= TEAM_LIMIT).select("position", lane.alias("lane"), F.col("price").cast("double").alias("at"), best)
    sell = owned.where(known).join(counts, "team", "left").withColumn("lanes", F.array_distinct(F.array(F.lit(None).cast(owned.schema["team"].dataType), lane)))
    asks = sell.select(
        "position", F.explode("lanes").alias("lane"), (F.col("price") + F.lit(bank)).cast("double").alias("at"), *[F.col(c).alias(f"sell_{c}") for c in ("player", "team", "price", "value")]
    )
    got = best_within(items, asks, ["position", "lane"], "at", "best", top).select("*", F.explode("found").alias("b"))
    pairs = got.select("position", *[c for c in got.columns if c.startswith("sell_")], *[F.col(f"b.{c}").alias(f"buy_{c}") for c in ("player", "team", "price", "value")])
    gain = F.col("buy_value") - F.col("sell_value")
    ok = pairs.where(gain > 0).withColumns({"gain": gain, "gain_after_hit": gain - hit})
    # At most two times ``top`` rows a seller.
    w = Window.partitionBy("sell_player").orderBy(F.col("gain").desc(), "buy_player")
    return ok.withColumn("choice", F.row_number().over(w)).where(F.col("choice") <= top)


#: Largest pool of players that the squad solver and the backtest read, some 10 MB.
POOL_ROWS = 200_000
PLAN_SCHEMA = "group string, step int, sell long, buy long, gain double, hit double, net double, bank double"


def greedy_plans(squads: DataFrame, pool: DataFrame, free: int, most: int = 5, hit: float = HIT) -> DataFrame:
    """Coordinated transfers of many squads at once: a row for each transfer.

    ``squads`` has group, player, position, team, price, value and bank;
    ``pool`` has player (one row each), position, team, price, value and
    status. Each group is a squad of at most some dozen rows with its own
    small state, so the groups are the parallel unit. A group gets the players
    of its positions that some plan may buy: one is passed over while another
    of the same team and position, no dearer, comes before it by value and
    number, so one with more of these than a squad can own and buy is never
    bought.
    """
    import heapq

    import numpy as np
    import pandas as pd

    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("price", "value")]
    players = pool.where((F.col("status") == "a") & known[0] & known[1]).select("player", "position", "team", "price", "value")
    # What a squad owns of a team and position, and what it may buy before.
    held = squads.groupBy("group", "position", "team").count().agg(F.max("count")).first()[0] or 0
    columns, limit = players.columns, held + most

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of a team and position with fewer than ``limit`` such others; cuts of parts, cut again together, leave the same."""
        keep = np.ones(len(rows), bool)
        for at in rows.groupby(["team", "position"], dropna=False, sort=False).indices.values():
            own = rows.iloc[at]
            order = np.lexsort((own["player"], -own["value"].astype(float), own["price"].astype(float)))
            best: list = []
            for i, r in zip(at[order], zip(own["value"].to_numpy()[order], -own["player"].to_numpy()[order])):
                if len(best) < limit:
                    heapq.heappush(best, r)
                elif best[0] > r:
                    keep[i] = False
                else:
                    heapq.heapreplace(best, r)
        return rows[keep]

    def cut_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_rows = None
        for b in batches:
            held_rows = cut(b if held_rows is None else pd.concat([held_rows, b], ignore_index=True)).reset_index(drop=True)
        if held_rows is not None:
            yield held_rows

    players = players.mapInPandas(cut_parts, players.schema).groupBy("team", "position").applyInPandas(lambda rows: cut(rows)[columns], players.schema)
    least = squads.groupBy(F.col("group").alias("__g"), F.col("position").alias("__p")).agg(F.min("value").alias("__least"))
    # Few players of a team and position are left, so a group's share is small; a squad holds some dozen rows.
    offers = players.join(least, F.col("position").eqNullSafe(F.col("__p")) & (F.col("value") > F.col("__least"))).select(F.col("__g").alias("group"), *players.columns)

    def plan(squad: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if squad.empty:
            return pd.DataFrame([], columns=["group", "step", "sell", "buy", "gain", "hit", "net", "bank"])
        squad = squad.sort_values("player")
        bank, counts = float(squad["bank"].iloc[0]), squad["team"].value_counts().to_dict()
        have = squad[["player", "position", "team", "price", "value"]].copy()
        out, bought = [], set()
        for step in range(most):
            pairs = have.merge(rows[~rows["player"].isin(set(have["player"]) | bought)], on="position", suffixes=("_s", "_b"))
            pairs["gain"] = pairs["value_b"] - pairs["value_s"]
            same = pairs["team_s"] == pairs["team_b"]
            held = pairs["team_b"].map(lambda t: counts.get(t, 0)).astype(int)
            ok = (pairs["price_b"] <= pairs["price_s"] + bank + 1e-9) & (held - same.astype(int) + 1 <= TEAM_LIMIT) & (pairs["gain"] > 0)
            pairs = pairs[ok].sort_values(["gain", "player_s", "player_b"], ascending=[False, True, True])
            if pairs.empty:
                break
            p = pairs.iloc[0]
            cost = hit if step >= free else 0.0
            if p["gain"] - cost <= 0:
                break
            bank += p["price_s"] - p["price_b"]
            counts[p["team_s"]] -= 1
            counts[p["team_b"]] = counts.get(p["team_b"], 0) + 1
            bought.add(p["player_b"])
            have = have[have["player"] != p["player_s"]]
            new = rows[rows["player"] == p["player_b"]]
            have = pd.concat([have, new[have.columns]])
            out.append((squad["group"].iloc[0], step + 1, int(p["player_s"]), int(p["player_b"]), float(p["gain"]), cost, float(p["gain"] - cost), round(bank, 6)))
        return pd.DataFrame(out, columns=["group", "step", "sell", "buy", "gain", "hit", "net", "bank"])

    return squads.groupBy("group").cogroup(offers.groupBy("group")).applyInPandas(plan, PLAN_SCHEMA)


def inverse_draw(low, mid, high, u):
    """Points at quantile u: flat below .1, straight lines through (.1, low), (.5, mid), (.9, high), extrapolated above; never below 0."""
    rising = low + (mid - low) * (u - 0.1) / 0.4
    upper = mid + (high - mid) * (u - 0.5) / 0.4
    return F.greatest(F.lit(0.0), F.when(u < 0.1, low).when(u < 0.5, rising).otherwise(upper))


def simulate(squad: DataFrame, keys: list[str], player: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Total points of each key in each draw; quantiles fall back as floor 0, median predicted, ceiling median. Players are whole numbers."""
    low = F.coalesce("floor", F.lit(0.0))
    mid = F.coalesce("median", "predicted", F.lit(0.0))
    high = F.coalesce("ceiling", mid)
    turns = squad.select(*keys, "multiplier", low.alias("lo"), mid.alias("mi"), high.alias("hi"), F.col(player).alias("pl"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = hash_uniform(seed, F.col("pl"), F.col("draw"))
    points = inverse_draw(F.col("lo"), F.col("mi"), F.col("hi"), u) * F.col("multiplier")
    return turns.groupBy(*keys, "draw").agg(F.sum(points).alias("total"))


def _fewer_before(pool: DataFrame, team: str, position: str, price: str, rank: Column, tie: str, value: str, limit: int) -> DataFrame:
    """Players with fewer than ``limit`` of their team and position before them, by price, falling value and tie, whose rank is no less.

    There are so many where the ``limit``-th greatest rank before is no less:
    running maxima, each of what the one before pushed aside (see
    :func:`best_within`), and no pairs. Rows without team, position, price or
    value stay and beat nobody.
    """
    known = F.col(team).isNotNull() & F.col(position).isNotNull() & F.col(price).isNotNull() & F.col(value).isNotNull()
    rows = pool.withColumns({"__known": known, "__x0": F.when(known, rank)})
    line = Line(rows, [team, position], [price, F.col(value).desc(), tie])
    for i in range(limit):
        line.running(BEFORE, {f"__b{i}": ("max", F.col(f"__x{i}"))})
        over, x = F.col(f"__b{i}"), F.col(f"__x{i}")
        line.df = line.df.withColumn(f"__x{i + 1}", F.when(over.isNotNull() & x.isNotNull(), F.least(x, over)))
    least = F.col(f"__b{limit - 1}")
    return line.done().where(~F.col("__known") | least.isNull() | (least < F.col("__x0"))).select(*pool.columns)


def undominated(pool: DataFrame, team: str = "team", position: str = "position", price: str = "price", value: str = "value", tie: str = "player", limit: int = TEAM_LIMIT) -> DataFrame:
    """Players that some best squad may need: fewer than ``limit`` of team and position are no dearer and no worse.

    Exact: a best squad holds at most ``limit`` of a team, so a dominator of
    any other is free to take its place. Players have one row each.
    """
    return _fewer_before(pool, team, position, price, F.col(value), tie, value, limit)
