"""The named reads on the driver's tables, and their SQL twins.

Parts are players, nations teams, months of shipment weeks and line items
what a player did in a week; prices, predictions and picks are derived from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import teams as tm
from scoreloom.operators import windows
from scoreloom.plans import approvals, reads
from scoreloom.semantics import latest_by
from scoreloom.session import table

QUERIES, ORACLES = {}, {}

_STATS = """stats AS (
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS season, l_partkey AS player_code, CAST(month(l_shipdate) AS INTEGER) AS event_id,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) AS BIGINT) AS minutes, CAST(sum(l_linenumber) AS BIGINT) AS total_points,
    count(*) FILTER (WHERE l_returnflag = 'R') AS goals_scored, count(*) FILTER (WHERE l_linestatus = 'F') AS assists, count(*) FILTER (WHERE l_returnflag = 'A') AS clean_sheets,
    CAST(max(l_linenumber) AS BIGINT) AS bonus, CAST(sum(l_suppkey % 50) AS BIGINT) AS bps, count(*) AS defensive_contribution,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS expected_goals, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS expected_assists
  FROM lineitem GROUP BY ALL)"""
_DIMS = """players AS (SELECT p_partkey AS player_code, p_name AS web_name FROM part), teams AS (SELECT n_nationkey AS team_code, n_name AS short_name FROM nation),
player_seasons AS (SELECT CAST(y AS VARCHAR) AS season, p_partkey AS player_code, p_size % 4 + 1 AS element_type, CAST(p_partkey % 25 AS INTEGER) AS team_code FROM part CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y))"""
_PRICES = """prices AS (
  SELECT CAST(year(l_shipdate) AS VARCHAR) AS season, l_partkey AS player_code, CAST(l_shipdate AS DATE) AS snapshot_date, CAST(floor(max(l_extendedprice) / 100) AS INTEGER) AS now_cost,
    max(l_discount) AS selected_by_percent, CASE WHEN max(l_linenumber) > 1 THEN 'a' ELSE 'i' END AS status, CAST(sum(l_orderkey % 100) AS BIGINT) AS transfers_in_event, CAST(sum(l_suppkey % 100) AS BIGINT) AS transfers_out_event
  FROM lineitem GROUP BY ALL),
now_ AS (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY season, player_code ORDER BY snapshot_date DESC) = 1)"""
_PREDICTED = """predictions AS (
  SELECT season, player_code, event_id, minutes / 10.0 AS predicted_points, total_points / 100.0 AS p_return_6plus, total_points / 200.0 AS p_haul_10plus, minutes / 20.0 AS floor_points, minutes / 10.0 AS median_points,
    minutes / 5.0 AS ceiling_points FROM stats WHERE event_id % 2 = 0)"""
_TOTALS = f"""WITH {_STATS}, {_DIMS}, {_PRICES}, sums AS (
  SELECT season, player_code, count(*) FILTER (WHERE minutes > 0) AS games_played, CAST(sum(minutes) AS BIGINT) AS total_minutes, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(goals_scored) AS BIGINT) AS goals,
    CAST(sum(assists) AS BIGINT) AS assists, CAST(sum(clean_sheets) AS BIGINT) AS clean_sheets, CAST(sum(bonus) AS BIGINT) AS bonus, CAST(sum(bps) AS BIGINT) AS bps, CAST(sum(defensive_contribution) AS BIGINT) AS defensive_contribution,
    sum(expected_goals) AS expected_goals, sum(expected_assists) AS expected_assists FROM stats GROUP BY ALL),
totals AS (SELECT s.*, web_name, element_type, team_code, now_cost, selected_by_percent, status,
    round(CAST(total_points AS DOUBLE) / nullif(games_played, 0), 2) AS points_per_game, round(total_points * 90.0 / nullif(total_minutes, 0), 2) AS points_per_90, round(goals * 90.0 / nullif(total_minutes, 0), 2) AS goals_per_90,
    round(s.assists * 90.0 / nullif(total_minutes, 0), 2) AS assists_per_90, round((goals + s.assists) * 90.0 / nullif(total_minutes, 0), 2) AS returns_per_90, round(total_points * 10.0 / nullif(now_cost, 0), 2) AS points_per_million
  FROM sums s JOIN now_ USING (season, player_code) JOIN player_seasons USING (season, player_code) JOIN players USING (player_code))"""
_DIFFICULTY = """difficulty AS (SELECT '1997' AS season, CAST(e AS INTEGER) AS event_id, n_nationkey AS team_code, (n_nationkey * 7 + 3) % 25 AS opponent_code, (n_nationkey + e) % 2 = 0 AS is_home, (n_nationkey * e % 11 - 5) / 10.0 AS fixture_difficulty_score
  FROM nation CROSS JOIN (SELECT unnest(range(1, 13)) AS e))"""
_PICKS = """picks AS (SELECT 7 AS entry_id, '1997' AS season, e AS event_id, p_partkey AS player_code, CAST(p_partkey - e + 1 AS INTEGER) AS squad_position, CASE WHEN p_partkey - e < 11 THEN 1 ELSE 0 END AS multiplier,
    p_partkey = e AS is_captain, p_partkey = e + 1 AS is_vice_captain FROM part CROSS JOIN (SELECT unnest([1, 2, 3]) AS e) WHERE p_partkey >= e AND p_partkey < e + 15)"""
_POSITION = "CASE element_type WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END"
_RANKINGS = f"""{_TOTALS}, {_PREDICTED}, told AS (SELECT * FROM predictions WHERE season = '1997' AND event_id = (SELECT max(event_id) FROM predictions WHERE season = '1997')),
rankings AS (SELECT t.player_code, web_name, element_type, short_name AS team, now_cost, total_points, games_played, points_per_90, points_per_million, selected_by_percent, status, event_id AS predicted_gw,
    predicted_points, p_return_6plus, p_haul_10plus, floor_points, median_points, ceiling_points, {_POSITION} AS position, now_cost / 10.0 AS price, predicted_points / nullif(now_cost / 10.0, 0) AS predicted_value
  FROM totals t JOIN teams USING (team_code) LEFT JOIN told USING (player_code) WHERE t.season = '1997')"""
_SQUAD = f"""WITH {_STATS}, {_DIMS}, {_PRICES}, {_PREDICTED}, {_PICKS}, squad AS (
  SELECT p.player_code, squad_position, multiplier, is_captain, is_vice_captain, web_name, element_type, short_name AS team, now_cost, predicted_points, p_return_6plus, p_haul_10plus, floor_points, median_points, ceiling_points,
    {_POSITION} AS position, now_cost / 10.0 AS price
  FROM picks p JOIN players USING (player_code) JOIN player_seasons ps ON ps.player_code = p.player_code AND ps.season = p.season JOIN teams USING (team_code) JOIN now_ n ON n.player_code = p.player_code AND n.season = p.season
  LEFT JOIN predictions r ON r.player_code = p.player_code AND r.season = p.season AND r.event_id = (SELECT max(event_id) FROM predictions WHERE season = '1997')
  WHERE p.event_id = (SELECT max(event_id) FROM picks))"""
SEASON = "1997"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _year():
    return F.year("l_shipdate").cast("string").alias("season")


def stats(s, d):
    when = lambda c, v: F.count_if(F.col(c) == v)
    cents = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return table(s, d, "lineitem").groupBy(_year(), F.col("l_partkey").alias("player_code"), F.month("l_shipdate").alias("event_id")).agg(
        F.sum(F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_quantity"))).cast("long").alias("minutes"), F.sum("l_linenumber").alias("total_points"), when("l_returnflag", "R").alias("goals_scored"),
        when("l_linestatus", "F").alias("assists"), when("l_returnflag", "A").alias("clean_sheets"), F.max("l_linenumber").cast("long").alias("bonus"), F.sum(F.col("l_suppkey") % 50).alias("bps"),
        F.count("*").alias("defensive_contribution"), cents("l_discount").alias("expected_goals"), cents("l_tax").alias("expected_assists"),
    )


def prices(s, d):
    return table(s, d, "lineitem").groupBy(_year(), F.col("l_partkey").alias("player_code"), F.col("l_shipdate").cast("date").alias("snapshot_date")).agg(
        F.floor(F.max("l_extendedprice") / 100).cast("int").alias("now_cost"), F.max("l_discount").alias("selected_by_percent"), F.when(F.max("l_linenumber") > 1, "a").otherwise("i").alias("status"),
        F.sum(F.col("l_orderkey") % 100).alias("transfers_in_event"), F.sum(F.col("l_suppkey") % 100).alias("transfers_out_event"),
    )


def players(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("player_code"), F.col("p_name").alias("web_name"))


def player_seasons(s, d):
    years = F.explode(F.sequence(F.lit(1995), F.lit(2001)).cast("array<string>")).alias("season")
    return table(s, d, "part").select(years, F.col("p_partkey").alias("player_code"), (F.col("p_size") % 4 + 1).alias("element_type"), (F.col("p_partkey") % 25).cast("int").alias("team_code"))


def clubs(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("team_code"), F.col("n_name").alias("short_name"))


def predictions(s, d):
    m, p = F.col("minutes"), F.col("total_points")
    return stats(s, d).where("event_id % 2 = 0").select(
        "season", "player_code", "event_id", (m / 10).alias("predicted_points"), (p / 100).alias("p_return_6plus"), (p / 200).alias("p_haul_10plus"), (m / 20).alias("floor_points"), (m / 10).alias("median_points"), (m / 5).alias("ceiling_points")
    )


def difficulty(s, d):
    n, e = F.col("n_nationkey"), F.col("event_id")
    rows = table(s, d, "nation").withColumn("event_id", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return rows.select(F.lit(SEASON).alias("season"), "event_id", n.alias("team_code"), ((n * 7 + 3) % 25).alias("opponent_code"), ((n + e) % 2 == 0).alias("is_home"), ((n * e % 11 - 5) / 10).alias("fixture_difficulty_score"))


def picks(s, d):
    p, e = F.col("p_partkey"), F.col("event_id")
    rows = table(s, d, "part").withColumn("event_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where((p >= e) & (p < e + 15))
    return rows.select(
        F.lit(7).alias("entry_id"), F.lit(SEASON).alias("season"), "event_id", p.alias("player_code"), (p - e + 1).cast("int").alias("squad_position"), F.when(p - e < 11, 1).otherwise(0).alias("multiplier"), (p == e).alias("is_captain"), (p == e + 1).alias("is_vice_captain")
    )


def _totals(s, d):
    return reads.player_totals(stats(s, d), players(s, d), player_seasons(s, d), prices(s, d))


def _rankings(s, d):
    return reads.player_rankings(_totals(s, d), clubs(s, d), predictions(s, d), SEASON)


def _squad(s, d):
    return reads.squad(picks(s, d), players(s, d), player_seasons(s, d), clubs(s, d), prices(s, d), predictions(s, d), SEASON, 7)


_SUMS = "round(expected_goals, 4) AS expected_goals, round(expected_assists, 4) AS expected_assists"


@query("player_totals", f"{_TOTALS} SELECT * REPLACE ({_SUMS}) FROM totals")
def player_totals(s, d):
    return _totals(s, d).withColumns({c: F.round(c, 4) for c in ("expected_goals", "expected_assists")})


_AVG = lambda c, w, n: f"round(avg({c}) OVER {w}, {n})"


@query("rolling_view", f"""WITH {_STATS} SELECT season, event_id, player_code, total_points, minutes, {_AVG('total_points', 'w3', 2)} AS points_avg_3gw, {_AVG('total_points', 'w5', 2)} AS points_avg_5gw, {_AVG('minutes', 'w3', 1)} AS minutes_avg_3gw,
  {_AVG('minutes', 'w5', 1)} AS minutes_avg_5gw, {_AVG('goals_scored', 'w3', 2)} AS goals_avg_3gw, {_AVG('assists', 'w3', 2)} AS assists_avg_3gw, {_AVG('bps', 'w3', 1)} AS bps_avg_3gw, {_AVG('expected_goals', 'w3', 3)} AS xg_avg_3gw,
  {_AVG('expected_assists', 'w3', 3)} AS xa_avg_3gw, {_AVG('total_points', 'w', 2)} AS points_avg_season FROM stats
WINDOW w AS (PARTITION BY season, player_code ORDER BY event_id), w3 AS (PARTITION BY season, player_code ORDER BY event_id ROWS 2 PRECEDING), w5 AS (PARTITION BY season, player_code ORDER BY event_id ROWS 4 PRECEDING)""")
def rolling_view(s, d):
    return reads.rolling_view(stats(s, d))


@query("ownership_movers", f"""WITH {_DIMS}, {_PRICES} SELECT season, player_code, snapshot_date, now_cost, selected_by_percent, status, transfers_in_event, transfers_out_event, element_type, team_code, web_name,
  transfers_in_event - transfers_out_event AS net_transfers_event FROM now_ JOIN player_seasons USING (season, player_code) JOIN players USING (player_code)""")
def ownership_movers(s, d):
    return reads.ownership_movers(prices(s, d), players(s, d), player_seasons(s, d))


@query("player_rankings", f"{_RANKINGS} SELECT * REPLACE (round(predicted_value, 6) AS predicted_value) FROM rankings")
def player_rankings(s, d):
    return _rankings(s, d).withColumn("predicted_value", F.round("predicted_value", 6))


@query("plan_rankings", f"{_RANKINGS} SELECT player_code, web_name, element_type, team, now_cost, status, coalesce(predicted_points, 0) AS predicted_points, predicted_gw, position, price FROM rankings")
def plan_rankings(s, d):
    return reads.plan_rankings(_rankings(s, d))


@query("squad_read", f"{_SQUAD} SELECT * FROM squad")
def squad_read(s, d):
    return _squad(s, d)


@query("plan_squad", f"{_SQUAD} SELECT player_code, multiplier, web_name, element_type, team, now_cost, coalesce(predicted_points, 0) AS predicted_points, position, price FROM squad")
def plan_squad(s, d):
    return reads.plan_squad(_squad(s, d))


@query("last_ingested_week", f"WITH {_STATS} SELECT max(event_id) AS gw FROM stats WHERE season = '1997'")
def last_ingested_week(s, d):
    return reads.last_ingested_week(stats(s, d), SEASON)


@query("next_deadline", f"""WITH {_STATS}, gameweeks AS (SELECT DISTINCT season, event_id, 'GW' || event_id AS name, make_timestamp(CAST(season AS BIGINT), CAST(event_id AS BIGINT), 1, 0, 0, 0.0) AS deadline_time, event_id <= 6 AS finished FROM stats)
SELECT event_id, name, deadline_time FROM gameweeks WHERE season = '1997' AND NOT finished AND deadline_time > TIMESTAMP '1997-08-15' ORDER BY deadline_time LIMIT 1""")
def next_deadline(s, d):
    e = F.col("event_id")
    weeks = stats(s, d).select("season", "event_id").distinct().select("season", "event_id", F.concat(F.lit("GW"), e.cast("string")).alias("name"), F.make_date(F.col("season").cast("int"), e, F.lit(1)).cast("timestamp_ntz").alias("deadline_time"), (e <= 6).alias("finished"))
    return reads.next_deadline(weeks, SEASON, F.lit("1997-08-15").cast("timestamp_ntz"))


@query("fixture_window", f"WITH {_DIMS}, {_DIFFICULTY} SELECT player_code, event_id, fixture_difficulty_score FROM difficulty JOIN player_seasons USING (season, team_code) WHERE season = '1997' AND event_id >= 4 AND event_id < 9")
def fixture_window(s, d):
    return reads.fixture_window(difficulty(s, d), player_seasons(s, d), SEASON, 4, 5)


@query("fixture_grid_rows", f"""WITH {_DIMS}, {_DIFFICULTY} SELECT h.short_name AS team, a.short_name AS opponent, is_home, event_id, fixture_difficulty_score FROM difficulty f JOIN teams h ON h.team_code = f.team_code JOIN teams a ON a.team_code = f.opponent_code
WHERE event_id >= 4 AND event_id < 9""")
def fixture_grid_rows(s, d):
    return reads.fixture_grid_rows(difficulty(s, d), clubs(s, d), SEASON, 4, 5)


@query("live_rows", f"""WITH {_STATS}, {_DIMS}, {_PRICES} SELECT s.player_code AS element, s.season, s.event_id AS "GW", minutes, total_points, goals_scored, assists, clean_sheets, bonus, bps, defensive_contribution, expected_goals, expected_assists,
  web_name AS name, element_type, now_cost AS value, s.player_code AS code, {_POSITION} AS position, 1 AS xg_data_available, 1 AS dc_data_available
FROM stats s JOIN players USING (player_code) JOIN player_seasons ps ON ps.player_code = s.player_code AND ps.season = s.season JOIN now_ n ON n.player_code = s.player_code AND n.season = s.season WHERE s.season = '1997'""")
def live_rows(s, d):
    return reads.live_rows(stats(s, d), players(s, d), player_seasons(s, d), prices(s, d), SEASON)


@query("best_value", f"{_TOTALS} SELECT player_code, points_per_million FROM totals WHERE totals.season = '1997' AND total_minutes >= 45 ORDER BY points_per_million DESC, player_code LIMIT 15")
def best_value(s, d):
    rows = _totals(s, d).where(F.col("season") == SEASON)
    return reads.top(rows, F.col("points_per_million"), 15, "player_code", F.col("total_minutes") >= 45).select("player_code", "points_per_million")


@query("top_points", f"{_TOTALS} SELECT player_code, total_points FROM totals WHERE totals.season = '1997' ORDER BY total_points DESC, player_code LIMIT 10")
def top_points(s, d):
    rows = _totals(s, d).where(F.col("season") == SEASON)
    return reads.top(rows, F.col("total_points"), 10, "player_code").select("player_code", "total_points")


@query("top_per_90", f"{_TOTALS} SELECT player_code, points_per_90 FROM totals WHERE totals.season = '1997' AND total_minutes >= 45 AND points_per_90 IS NOT NULL ORDER BY points_per_90 DESC, player_code LIMIT 10")
def top_per_90(s, d):
    rows = _totals(s, d).where(F.col("season") == SEASON)
    return reads.top(rows, F.col("points_per_90"), 10, "player_code", F.col("total_minutes") >= 45).select("player_code", "points_per_90")


@query("net_transfers", f"""WITH {_DIMS}, {_PRICES} SELECT player_code, transfers_in_event - transfers_out_event AS net FROM now_ JOIN player_seasons USING (season, player_code) JOIN players USING (player_code)
WHERE now_.season = '1997' ORDER BY net DESC, player_code LIMIT 10""")
def net_transfers(s, d):
    rows = reads.ownership_movers(prices(s, d), players(s, d), player_seasons(s, d)).where(F.col("season") == SEASON)
    return reads.top(rows, F.col("net_transfers_event"), 10, "player_code").select("player_code", F.col("net_transfers_event").alias("net"))


_FORM = " + ".join(f"coalesce(lag(total_points, {k}) OVER w, 0.0) * {x}" for k, x in enumerate(windows.FORM_WEIGHTS))
_HAD = " + ".join(f"CASE WHEN lag(1, {k}) OVER w = 1 THEN {x} ELSE 0.0 END" for k, x in enumerate(windows.FORM_WEIGHTS))


@query("form_leaders", f"""WITH {_STATS}, weighted AS (
  SELECT season, player_code, ({_FORM}) / ({_HAD}) AS weighted_form FROM stats
  WINDOW w AS (PARTITION BY season, player_code ORDER BY event_id) QUALIFY row_number() OVER (PARTITION BY season, player_code ORDER BY event_id DESC) = 1),
rolling AS (SELECT season, event_id, player_code, {_AVG('total_points', 'w3', 2)} AS points_avg_3gw FROM stats WINDOW w3 AS (PARTITION BY season, player_code ORDER BY event_id ROWS 2 PRECEDING))
SELECT player_code, points_avg_3gw, round(weighted_form, 6) AS weighted_form FROM rolling JOIN weighted USING (season, player_code)
WHERE season = '1997' AND event_id = (SELECT max(event_id) FROM rolling WHERE season = '1997') ORDER BY round(weighted.weighted_form, 6) DESC NULLS LAST, player_code LIMIT 10""")
def form_leaders(s, d):
    season = stats(s, d).where(F.col("season") == SEASON)
    formed = windows.weighted_form(season, list(reads.KEY), ["event_id"], "total_points")
    last = latest_by(formed, list(reads.KEY), ["event_id"], ["weighted_form"]).withColumn("weighted_form", F.round("weighted_form", 6))
    return reads.form_leaders(reads.rolling_view(season), last).select("player_code", "points_avg_3gw", "weighted_form")


_LISTED = [3, 30, 33, 100, 199, 10**9]


@query("approval_lookups", f"""WITH {_DIMS}, {_PRICES}, ids AS (SELECT *, player_code * 3 + 1 AS fpl_id FROM player_seasons)
SELECT player_code, fpl_id, now_cost FROM ids LEFT JOIN now_ USING (season, player_code) WHERE ids.season = '1997' AND player_code IN ({", ".join(map(str, _LISTED))})""")
def approval_lookups(s, d):
    """The season's own ids and the newest prices of listed players."""
    ids = player_seasons(s, d).withColumn("fpl_id", F.col("player_code") * 3 + 1)
    now = approvals.latest_prices(prices(s, d), SEASON, _LISTED)
    return approvals.id_map(ids, SEASON, _LISTED).join(now, "player_code", "left").select("player_code", "fpl_id", "now_cost")


@query("live_squad", f"""WITH {_STATS}, {_DIMS}, {_PREDICTED}
SELECT player_code * 3 + 1 AS element, player_code, web_name, {_POSITION} AS position, coalesce(predicted_points, 0.0) AS predicted_points
FROM player_seasons ps JOIN players USING (player_code) LEFT JOIN predictions r USING (season, player_code)
WHERE season = '1997' AND player_code BETWEEN 5 AND 19 AND (r.event_id IS NULL OR r.event_id = (SELECT max(event_id) FROM predictions WHERE season = '1997'))
UNION ALL SELECT player_code * 3 + 1, player_code, web_name, {_POSITION}, 0.0 FROM player_seasons ps JOIN players USING (player_code)
WHERE season = '1997' AND player_code BETWEEN 5 AND 19 AND EXISTS (SELECT 1 FROM predictions r WHERE r.season = '1997' AND r.player_code = ps.player_code)
  AND NOT EXISTS (SELECT 1 FROM predictions r WHERE r.season = '1997' AND r.player_code = ps.player_code AND r.event_id = (SELECT max(event_id) FROM predictions WHERE season = '1997'))""")
def live_squad(s, d):
    """Fifteen players by the season's own ids, with the predictions of the last predicted week."""
    ids = player_seasons(s, d).withColumn("fpl_id", F.col("player_code") * 3 + 1)
    return approvals.live_squad([c * 3 + 1 for c in range(5, 20)], ids, players(s, d), predictions(s, d), SEASON)


@query("newest_models", """SELECT o_orderpriority AS model_type, o_orderstatus AS target, o_orderdate AS trained_at, o_orderkey AS id, o_totalprice AS mae FROM orders WHERE o_orderpriority LIKE '%-%'
QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def newest_models(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderpriority").alias("model_type"), F.col("o_orderstatus").alias("target"), F.col("o_orderdate").alias("trained_at"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("mae"))
    return reads.newest_models(rows, "%-%", ("trained_at", "id"))


@query("worst_misses", "SELECT o_orderkey, o_totalprice - 150000 AS residual FROM orders ORDER BY abs(o_totalprice - 150000) DESC, o_orderkey LIMIT 15")
def worst_misses(s, d):
    rows = table(s, d, "orders").withColumn("p", F.lit(150_000.0))
    return reads.worst_misses(rows, "o_totalprice", "p", "o_orderkey").select("o_orderkey", "residual")


@query("baselines", f"""WITH {_STATS} SELECT season, player_code, event_id, round(coalesce(CASE WHEN minutes > 0 THEN total_points * 90.0 / minutes END, 0) * coalesce(minutes, 0) / 90, 6) AS naive,
  round(expected_goals * least(90, greatest(0, minutes)) / 90, 6) AS decomposed FROM stats""")
def baselines(s, d):
    rows = stats(s, d).withColumns({"rate": F.when(F.col("minutes") > 0, F.col("total_points") * 90.0 / F.col("minutes"))})
    return rows.select("season", "player_code", "event_id", F.round(reads.naive_points("rate", "minutes"), 6).alias("naive"), F.round(reads.decomposed_points("expected_goals", "minutes"), 6).alias("decomposed"))


@query("next_fixture", """WITH fx AS (SELECT l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS home, l_partkey % 100 AS away, l_shipdate AS kickoff, l_returnflag <> 'N' AS finished FROM lineitem),
both_ AS (SELECT k1, k2, home AS team, away AS opponent, true AS is_home, kickoff FROM fx WHERE NOT finished UNION ALL SELECT k1, k2, away, home, false, kickoff FROM fx WHERE NOT finished)
SELECT team, opponent, is_home, kickoff FROM both_ QUALIFY row_number() OVER (PARTITION BY team ORDER BY kickoff, k1, k2, opponent, is_home) = 1""")
def next_fixture(s, d):
    fx = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_suppkey").alias("home"), (F.col("l_partkey") % 100).alias("away"), F.col("l_shipdate").alias("kickoff"), (F.col("l_returnflag") != "N").alias("finished"),
        F.lit(None).cast("int").alias("home_score"), F.lit(None).cast("int").alias("away_score"),
    )
    return tm.next_fixture(fx, ["k1", "k2"])
