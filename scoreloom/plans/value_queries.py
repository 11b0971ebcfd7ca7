"""Queries over reads, features and page figures that the other modules don't register, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.models import metrics
from scoreloom.operators import aggregates, intervals, windows
from scoreloom.plans import features, payloads, reads
from scoreloom.plans.read_queries import _PREDICTED, _RANKINGS, _STATS, SEASON, player_rankings, players, stats
from scoreloom.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_EDGES = " + ".join(f"CAST(p > e[{i}] AS INTEGER)" for i in range(1, 10))


@query("calibration_curve", f"""
WITH x AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, (o_custkey * 7919 + o_orderkey) % 1000 / 1000.0 AS p FROM orders),
edges AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM x)
SELECT {_EDGES} AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS positive_rate FROM x, edges GROUP BY 1""")
def calibration_curve(s, d):
    x = table(s, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_custkey") * 7919 + F.col("o_orderkey")) % 1000 / 1000).alias("p"))
    return metrics.calibration_curve(x, "y", "p").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("positive_rate", 6).alias("positive_rate"))


_SPELLS = "spells AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS since, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 + 1 AS INTEGER) AS until FROM orders WHERE o_orderpriority LIKE '1%')"


def _spells(s, d):
    o = table(s, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    since = F.col("o_orderdate").cast("date")
    return o.select(F.col("o_custkey").alias("code"), since.alias("injury_from"), F.date_add(since, (F.col("o_orderkey") % 40 + 1).cast("int")).alias("injury_until"))


@query("injury_history", f"""
WITH {_SPELLS}, told AS (
  SELECT o_orderkey AS element, o.o_orderdate AS moment, max(until) FILTER (WHERE since < o.o_orderdate) AS last_until, count(*) FILTER (WHERE since < o.o_orderdate AND since >= o.o_orderdate - INTERVAL 365 DAY) AS n, count(code) > 0 AS known
  FROM orders o LEFT JOIN spells ON code = o_custkey GROUP BY 1, 2)
SELECT element, round(days, 6) AS days_since_injury, n AS injuries_365d, CAST(days <= 14 AS INTEGER) AS returning, CAST(known AS INTEGER) AS injury_data_available
FROM (SELECT *, CASE WHEN last_until IS NULL THEN 9999.0 ELSE greatest(0.0, (epoch_us(moment) - epoch_us(CAST(last_until AS TIMESTAMP))) / 86400000000.0) END AS days FROM told)""")
def injury_history(s, d):
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("code"), F.lit("s").alias("season"), F.col("o_orderkey").alias("element"), F.lit(1).alias("GW"), F.col("o_orderdate").cast("timestamp").alias("kickoff_time"))
    out = features.injury_features(rows, _spells(s, d))
    return out.select("element", F.round("days_since_injury", 6).alias("days_since_injury"), "injuries_365d", "returning", "injury_data_available")


@query("open_spells", f"""
WITH {_SPELLS} SELECT o_orderkey, count(code) AS n_open FROM orders o LEFT JOIN spells ON code = o_custkey AND since <= o.o_orderdate AND until > o.o_orderdate GROUP BY 1""")
def open_spells(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("code"), "o_orderkey", "o_orderdate")
    return intervals.open_intervals(o, _spells(s, d), ["code"], "o_orderdate", "injury_from", "injury_until", ["o_orderkey"]).select("o_orderkey", "n_open")


@query("text_forms", """
SELECT p_partkey, CAST(nullif(regexp_extract(p_size || ' ' || p_name, '^([0-9]+)', 1), '') AS INTEGER) AS leading, CAST(nullif(regexp_extract(p_name, '^([0-9]+)', 1), '') AS INTEGER) AS none,
  CAST(1989 + p_size % 20 AS VARCHAR) || '-' || lpad(CAST((1990 + p_size % 20) % 100 AS VARCHAR), 2, '0') AS before,
  CASE WHEN length(p_name) <= 9 THEN p_name ELSE rtrim(left(p_name, 8)) || '…' END AS shown FROM part""")
def text_forms(s, d):
    year = F.col("p_size") % 20 + 1990
    p = table(s, d, "part").withColumns({"sized": F.concat_ws(" ", "p_size", "p_name"), "season": F.concat_ws("-", year, F.lpad(((year + 1) % 100).cast("string"), 2, "0"))})
    return p.select("p_partkey", tx.leading_int("sized").alias("leading"), tx.leading_int("p_name").alias("none"), tx.season_before(F.col("season")).alias("before"), tx.shortened(F.col("p_name"), 9).alias("shown"))


@query("coming_rows", f"""WITH {_STATS}, w AS (SELECT season, player_code AS element, event_id AS "GW", CAST(total_points AS DOUBLE) AS total_points, CAST(minutes AS DOUBLE) AS minutes FROM stats WHERE season = '1997')
SELECT * FROM w UNION ALL SELECT season, element, max("GW") + 1, 0.0, 0.0 FROM w GROUP BY season, element""")
def coming_rows(s, d):
    week = stats(s, d).where(F.col("season") == SEASON)
    return features.next_week_rows(week.select("season", F.col("player_code").alias("element"), F.col("event_id").alias("GW"), F.col("total_points").cast("double").alias("total_points"), F.col("minutes").cast("double").alias("minutes")))


@query("form_or_season", f"""WITH {_STATS} SELECT season, player_code, event_id, round(coalesce(avg(total_points) OVER (PARTITION BY season, player_code ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  avg(total_points) OVER (PARTITION BY season)), 6) AS form FROM stats""")
def form_or_season(s, d):
    week = stats(s, d)
    form = windows.form_or_mean(week, list(reads.KEY), ["event_id"], "total_points", ["season"], "form")
    return form.select("season", "player_code", "event_id", F.round("form", 6).alias("form"))


@query("browse_players", f"""{_RANKINGS} SELECT player_code, round(predicted_points, 6) AS predicted_points FROM rankings
WHERE position = 'MID' AND predicted_points >= 2 AND selected_by_percent < 0.09 AND status = 'a' ORDER BY predicted_points DESC NULLS LAST, player_code LIMIT 25""")
def browse_players(s, d):
    rows = player_rankings(s, d).withColumn("ownership", F.col("selected_by_percent"))
    return payloads.browse(rows, position="MID", least=2, most_owned=0.09, available=True).select("player_code", F.round("predicted_points", 6).alias("predicted_points"))


@query("players_table", f"""{_RANKINGS} SELECT player_code, web_name, position, team, round_even(predicted_points, 1) AS predicted, round_even(price, 1) AS price, CAST(round_even(p_return_6plus * 100, 0) AS INTEGER) AS haul,
  round_even(predicted_points / nullif(price, 0), 2) AS value FROM rankings WHERE status = 'a' AND predicted_points >= 0""")
def players_table(s, d):
    return payloads.players_page(player_rankings(s, d).withColumn("haul_probability", F.col("p_return_6plus")))


@query("due_reminders", """
WITH h AS (SELECT '1997' AS season, o_orderkey AS event_id, o_orderkey % 60 - 10.0 AS hours FROM orders), sent AS (SELECT '1997' AS season, o_orderkey AS event_id, 24 AS tier FROM orders WHERE o_orderkey % 7 = 0)
SELECT season, event_id, tier, CAST(hours AS DOUBLE) AS hours FROM h CROSS JOIN (SELECT unnest([24, 6, 2]) AS tier) t WHERE hours >= 0 AND hours <= tier
  AND NOT EXISTS (SELECT 1 FROM sent WHERE sent.season = h.season AND sent.event_id = h.event_id AND sent.tier = t.tier)""")
def due_reminders(s, d):
    o = table(s, d, "orders").select(F.lit(SEASON).alias("season"), F.col("o_orderkey").alias("event_id"))
    log = o.where("event_id % 7 = 0").withColumn("tier", F.lit(24))
    return payloads.due_tiers(o.withColumn("hours", (F.col("event_id") % 60 - 10).cast("double")), log)


@query("unique_names", "SELECT p_name AS web_name, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS player_code FROM part GROUP BY p_name")
def unique_names(s, d):
    everyone = players(s, d)
    return reads.codes_of(everyone, everyone)


@query("manager_weeks", "SELECT o_orderkey AS event_id, o_totalprice AS points FROM orders WHERE o_custkey = 7")
def manager_weeks(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("entry_id"), F.lit(SEASON).alias("season"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("points"))
    return reads.manager_history(o, SEASON, 7).select("event_id", "points")


_SHAPE = {"GKP": 2, "DEF": 3, "MID": 2, "FWD": 1}


@query("squad_problems", """
WITH p AS (SELECT p_brand AS g, p_partkey AS player, ['GKP', 'DEF', 'MID', 'FWD'][p_partkey % 4 + 1] AS position, p_size % 5 AS team, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
t AS (SELECT g, max(c) AS most FROM (SELECT g, team, count(*) AS c FROM p WHERE n <= 8 GROUP BY g, team) GROUP BY g),
c AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE position = 'GKP') AS gkp, count(*) FILTER (WHERE position = 'DEF') AS def, count(*) FILTER (WHERE position = 'MID') AS mid, count(*) FILTER (WHERE position = 'FWD') AS fwd,
  sum(CAST(price AS DECIMAL(18,4))) AS cost FROM p WHERE n <= 8 GROUP BY g)
SELECT g AS "group", concat_ws('; ', CASE WHEN n <> 8 THEN n || ' players, not 8' END, CASE WHEN gkp <> 2 THEN gkp || ' GKP, not 2' END, CASE WHEN def <> 3 THEN def || ' DEF, not 3' END, CASE WHEN mid <> 2 THEN mid || ' MID, not 2' END,
  CASE WHEN fwd <> 1 THEN fwd || ' FWD, not 1' END, CASE WHEN most > 3 THEN most || ' players of one team, more than 3' END, CASE WHEN cost > 9000 THEN 'costs ' || CAST(CAST(cost AS DECIMAL(18,1)) AS VARCHAR) || ', more than 9000.0' END) AS problems
FROM c JOIN t USING (g)""")
def squad_problems(s, d):
    key = F.col("p_partkey")
    p = table(s, d, "part").select(F.col("p_brand").alias("group"), key.alias("player"), F.get(F.array(*map(F.lit, ["GKP", "DEF", "MID", "FWD"])), (key % 4).cast("int")).alias("position"), (F.col("p_size") % 5).alias("team"), F.col("p_retailprice").alias("price"))
    squad = p.withColumn("n", F.row_number().over(windows._w(["group"], ["player"]))).where("n <= 8")
    return aggregates.squad_problems(squad, _SHAPE, 9000.0).withColumn("problems", F.array_join("problems", "; "))
