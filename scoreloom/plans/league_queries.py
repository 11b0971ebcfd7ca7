"""Queries over suppliers, parts and documents as teams, players and texts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.models import metrics
from scoreloom.operators import aggregates as agg
from scoreloom.operators import bands, decisions, teams
from scoreloom.plans.panel_queries import _rounded
from scoreloom.semantics import uniform_sql
from scoreloom.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# Line items as matches: a row per (order, line), supplier against part, scores from quantity and discount.
_FIX_SQL = """fx AS (
  SELECT l_orderkey AS k1, l_linenumber AS k2, min(l_suppkey) AS home, min(l_partkey) % 100 AS away, max(l_shipdate) AS kickoff,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS hs, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS as_
  FROM lineitem GROUP BY 1, 2)"""
_RES_SQL = _FIX_SQL + """, res AS (
  SELECT k1, k2, home AS team, away AS opponent, kickoff, true AS is_home, hs AS scored, as_ AS conceded FROM fx
  UNION ALL SELECT k1, k2, away, home, kickoff, false, as_, hs FROM fx)"""
_FORM_SQL = _RES_SQL + """, form AS (
  SELECT *, avg(scored) OVER w AS att, avg(conceded) OVER w AS def FROM res
  WINDOW w AS (PARTITION BY team ORDER BY kickoff, k1, k2, is_home ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
_LATEST_SQL = _FORM_SQL + """, latest AS (
  SELECT team, round(att, 2) AS att, round(def, 2) AS def FROM form QUALIFY row_number() OVER (PARTITION BY team ORDER BY kickoff DESC, k1 DESC, k2 DESC, is_home DESC) = 1)"""


def _fixtures(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2")).agg(
        F.min("l_suppkey").alias("home"), (F.min("l_partkey") % 100).alias("away"), F.max("l_shipdate").alias("kickoff"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("home_score"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("away_score"),
    )


@query("match_results", f"WITH {_RES_SQL} SELECT k1, k2, team, opponent, is_home, scored, conceded FROM res")
def match_results(s, d):
    return teams.match_results(_fixtures(s, d), ["k1", "k2"]).select("k1", "k2", "team", "opponent", "is_home", "scored", "conceded")


@query("team_form", f"WITH {_FORM_SQL} SELECT k1, k2, team, is_home, round(att, 6) AS att, round(def, 6) AS def FROM form")
def team_form(s, d):
    out = teams.team_form(teams.match_results(_fixtures(s, d), ["k1", "k2"]), ["team"], ["kickoff", "k1", "k2", "is_home"])
    return out.select("k1", "k2", "team", "is_home", *_rounded("att", "def"))


def _latest(s, d):
    return teams.form_now(teams.match_results(_fixtures(s, d), ["k1", "k2"]), ["team"], ["kickoff", "k1", "k2", "is_home"])


@query("latest_form", f"WITH {_LATEST_SQL} SELECT team, att, def FROM latest")
def latest_form(s, d):
    return _latest(s, d)


@query("fixture_difficulty", f"""WITH {_LATEST_SQL}, norm AS (SELECT avg(att) AS am, stddev_samp(att) AS asd, avg(def) AS dm, stddev_samp(def) AS dsd FROM latest),
up AS (SELECT s_suppkey AS team, (s_suppkey * 7 + 3) % 100 AS opponent, s_suppkey % 2 = 0 AS is_home, s_nationkey % 5 + 1 AS fdr FROM supplier)
SELECT up.team, up.opponent, round(
  coalesce(-0.30 * (o.def - dm) / nullif(dsd, 0), 0) + coalesce(0.30 * (o.att - am) / nullif(asd, 0), 0) + 0.20 * CASE WHEN is_home THEN -0.5 ELSE 0.5 END
  - coalesce(0.10 * (am - m.att) / nullif(asd, 0), 0) + 0.10 * (fdr - 3), 3) AS difficulty
FROM up CROSS JOIN norm LEFT JOIN latest o ON o.team = up.opponent LEFT JOIN latest m ON m.team = up.team""")
def fixture_difficulty(s, d):
    up = table(s, d, "supplier").select(
        F.col("s_suppkey").alias("team"), ((F.col("s_suppkey") * 7 + 3) % 100).alias("opponent"), (F.col("s_suppkey") % 2 == 0).alias("is_home"), (F.col("s_nationkey") % 5 + 1).alias("fdr")
    )
    return teams.fixture_difficulty(up, _latest(s, d)).select("team", "opponent", "difficulty")


@query("horizon_points", """
WITH fx AS (SELECT l_partkey AS player, least(greatest(1 - 0.4 * (l_discount * 20 - 1), 0.6), 1.5) AS m FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01')
SELECT p_partkey AS player, round(p_retailprice * coalesce(sum(m), 0), 4) AS horizon_points, count(m) AS fixtures FROM part LEFT JOIN fx ON player = p_partkey GROUP BY p_partkey, p_retailprice""")
def horizon_points(s, d):
    fx = table(s, d, "lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("player"), (F.col("l_discount") * 20 - 1).alias("score"))
    p = table(s, d, "part").select(F.col("p_partkey").alias("player"), F.col("p_retailprice").alias("predicted"))
    return decisions.horizon_points(p, fx, 3).select("player", F.round("horizon_points", 4).alias("horizon_points"), "fixtures")


@query("semi_bench", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_bench(s, d):
    urgent = table(s, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    return table(s, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_bench", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_bench(s, d):
    urgent = table(s, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    return table(s, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("self_join_roles", """
SELECT n1.n_name AS buyer, n2.n_name AS seller, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey GROUP BY 1, 2""")
def self_join_roles(s, d):
    nation = table(s, d, "nation")
    buyer = F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer")))
    seller = F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller")))
    # Both joins keep the lines where they are if supplier and customer are small, and shuffle them otherwise; lines are counted once, at the end.
    sold = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    bought = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    pairs = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    return pairs.join(buyer, "c_nationkey").join(seller, "s_nationkey").select("buyer", "seller", "n")


@query("candidate_pairs", """
WITH squad AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 2), held AS (SELECT p_brand, count(*) AS h FROM squad GROUP BY 1)
SELECT s.p_partkey AS sell_player, b.p_partkey AS buy_player, CAST(b.p_size - s.p_size AS DOUBLE) AS gain, CAST(b.p_size - s.p_size AS DOUBLE) - 4 AS gain_after_hit, choice FROM (
  SELECT s.p_partkey AS sk, b.p_partkey AS bk, row_number() OVER (PARTITION BY s.p_partkey ORDER BY b.p_size - s.p_size DESC, b.p_partkey) AS choice
  FROM squad s JOIN part b ON b.p_type = s.p_type LEFT JOIN held ON held.p_brand = b.p_brand
  WHERE b.p_partkey NOT IN (SELECT p_partkey FROM squad) AND b.p_partkey % 7 <> 0 AND b.p_retailprice <= s.p_retailprice + 50 AND b.p_size > s.p_size
    AND coalesce(h, 0) - CAST(s.p_brand = b.p_brand AS INTEGER) + 1 <= 3) x
JOIN part s ON s.p_partkey = sk JOIN part b ON b.p_partkey = bk WHERE choice <= 3""")
def candidate_pairs(s, d):
    p = table(s, d, "part").select(
        F.col("p_partkey").alias("player"), F.col("p_type").alias("position"), F.col("p_brand").alias("team"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("value"),
        F.when(F.col("p_partkey") % 7 == 0, "i").otherwise("a").alias("status"),
    )
    w = Window.partitionBy("team").orderBy("player")
    squad = p.withColumn("n", F.row_number().over(w)).where("n <= 2").drop("status", "n")
    out = decisions.suggestions(squad, p, 50.0)
    return out.select("sell_player", "buy_player", "gain", "gain_after_hit", F.col("choice").cast("long").alias("choice"))


@query("collapse_dgw", """
SELECT l_orderkey, l_linenumber, CAST(sum(CAST(coalesce(l_quantity, 0) AS DECIMAL(18,2))) AS DOUBLE) AS quantity, arg_min(l_returnflag, (l_shipdate, l_returnflag)) AS l_returnflag, round(avg(l_tax), 8) AS l_tax
FROM lineitem GROUP BY ALL""")
def collapse_dgw(s, d):
    li = table(s, d, "lineitem").withColumn("quantity", F.col("l_quantity").cast("decimal(18,2)"))
    out = agg.collapse(li, ["l_orderkey", "l_linenumber"], ["quantity"], ["l_returnflag"], ["l_tax"], ["l_shipdate", "l_returnflag"])
    return out.withColumn("quantity", F.col("quantity").cast("double")).withColumn("l_tax", F.round("l_tax", 8))


@query("team_limit", "SELECT p_brand, p_type, count(*) AS n, count(*) <= 3 AS ok FROM part GROUP BY ALL")
def team_limit(s, d):
    return agg.within_limit(table(s, d, "part"), ["p_brand", "p_type"], 3)


_BANDS = [-1.0, 0.0, 50_000.0, 150_000.0, 300_000.0, 1e9]
_NAMES = ["none", "low", "mid", "high", "top"]
_CASE = "CASE " + " ".join(f"WHEN o_totalprice > {a} AND o_totalprice <= {b} THEN '{n}'" for a, b, n in zip(_BANDS, _BANDS[1:], _NAMES)) + " END"


@query("bucket_residuals", f"""
SELECT {_CASE} AS bucket, count(*) AS n, round(avg(o_totalprice), 4) AS mean_actual, round(avg(c_acctbal * 20), 4) AS mean_predicted,
  round(avg(c_acctbal * 20 - o_totalprice), 4) AS bias, round(avg(abs(o_totalprice - c_acctbal * 20)), 4) AS mae FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def bucket_residuals(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(bands.right_closed(F.col("o_totalprice"), _BANDS, _NAMES).alias("bucket"), F.col("o_totalprice").alias("y"), (F.col("c_acctbal") * 20).alias("p"))
    out = metrics.residuals(o, "bucket", "y", "p")
    return out.select("bucket", "n", *[F.round(c, 4).alias(c) for c in ("mean_actual", "mean_predicted", "bias", "mae")])


_Y = "o_totalprice AS y, c_acctbal * 20 AS p"


def _scored(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", "o_orderdate", "o_orderstatus", F.col("o_totalprice").alias("y"), (F.col("c_acctbal") * 20).alias("p"))


@query("period_metrics", f"""
WITH x AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, {_Y} FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT period, count(*) AS n, round(1 - sum((y - p) * (y - p)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0), 6) AS r2, round(avg(abs(y - p)), 3) AS mae, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse
FROM x GROUP BY period HAVING count(*) >= 20""")
def period_metrics(s, d):
    x = _scored(s, d).withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    out = metrics.by_period(x, "period", "y", "p")
    return out.select("period", "n", F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))


@query("quantile_metrics", f"""
WITH x AS (SELECT {_Y} FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT round(avg(greatest(0.1 * (y - p), -0.9 * (y - p))), 3) AS pinball_10, round(avg(greatest(0.9 * (y - p), -0.1 * (y - p))), 3) AS pinball_90,
  avg(CAST(y <= p AS DOUBLE)) AS calibration, avg(CAST(p > y OR y > 2 * p AS DOUBLE)) AS crossing FROM x""")
def quantile_metrics(s, d):
    x = _scored(s, d).withColumn("hi", F.col("p") * 2)
    return x.agg(
        F.round(metrics.pinball("y", "p", 0.1), 3).alias("pinball_10"), F.round(metrics.pinball("y", "p", 0.9), 3).alias("pinball_90"),
        metrics.calibration("y", "p").alias("calibration"), metrics.crossing("p", "y", "hi").alias("crossing"),
    )


@query("auc_brier", """
WITH x AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, (o_custkey * 7919 + o_orderkey) % 1000 / 1000.0 AS p FROM orders),
r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM x)
SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 8) AS auc, round(avg((p - y) * (p - y)), 8) AS brier, avg(CAST(y AS DOUBLE)) AS base_rate FROM r""")
def auc_brier(s, d):
    x = table(s, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_custkey") * 7919 + F.col("o_orderkey")) % 1000 / F.lit(1000.0)).alias("p"))
    return metrics.auc_brier(x, "y", "p").select(F.round("auc", 8).alias("auc"), F.round("brier", 8).alias("brier"), "base_rate")


@query("correlation_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS corr FROM lineitem"
    for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i:]))
def correlation_pairs(s, d):
    return agg.correlation_pairs(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("corr", F.round("corr", 8))


_POS = "CASE p_size % 4 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END"
_TOP = ", ".join(f"max(CASE WHEN pos = '{p}' AND n = {n} THEN top END) AS {p}{n}" for p in ("GKP", "DEF", "MID", "FWD") for n in range(1, 6))
_UNION = " UNION ALL ".join(f"SELECT p_brand, '{a}-{b}-{c}' AS formation, GKP1 + DEF{a} + MID{b} + FWD{c} AS total, {i} AS i FROM wide" for i, (a, b, c) in enumerate(decisions.FORMATIONS))


@query("best_xi", f"""
WITH p AS (SELECT p_brand, {_POS} AS pos, CAST(p_retailprice AS DECIMAL(18,2)) AS v, p_partkey FROM part),
r AS (SELECT *, row_number() OVER w AS n, sum(v) OVER w AS top FROM p WINDOW w AS (PARTITION BY p_brand, pos ORDER BY v DESC, p_partkey ROWS UNBOUNDED PRECEDING)),
wide AS (SELECT p_brand, {_TOP} FROM r WHERE n <= 5 GROUP BY p_brand)
SELECT p_brand, formation, CAST(total AS DOUBLE) AS total FROM ({_UNION}) WHERE total IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY total DESC, i) = 1""")
def best_xi(s, d):
    size = F.col("p_size") % 4
    p = table(s, d, "part").select("p_brand", "p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("v"), F.when(size == 0, "GKP").when(size == 1, "DEF").when(size == 2, "MID").otherwise("FWD").alias("pos"))
    return decisions.best_line_up(p, ["p_brand"], "pos", "v", ["p_partkey"]).withColumn("total", F.col("total").cast("double"))


@query("grade_bands", """
WITH x AS (SELECT o_orderkey, (o_orderkey % 201 - 100) / 100.0 AS s FROM orders)
SELECT o_orderkey, CASE WHEN s <= -0.35 THEN 1 WHEN s <= -0.1 THEN 2 WHEN s <= 0.1 THEN 3 WHEN s <= 0.35 THEN 4 ELSE 5 END AS grade,
  CASE WHEN s <= -0.2 THEN 'Easy' WHEN s >= 0.25 THEN 'Brutal' ELSE 'Mixed' END AS run,
  CASE WHEN s > 0.15 THEN 'overfit' WHEN s <= 0 THEN 'underfit' ELSE 'ok' END AS fit, CASE WHEN s < 0 THEN 'worse' WHEN s > 0 THEN 'better' ELSE 'none' END AS verdict FROM x""")
def grade_bands(s, d):
    x = table(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 201 - 100) / F.lit(100.0)).alias("s"))
    v, zero = F.col("s"), F.lit(0.0)
    return x.select("o_orderkey", bands.fixture_grade(v).alias("grade"), bands.run_rating(v).alias("run"), bands.fit_flag(v, F.when(v <= 0, v).otherwise(zero + 1e-12), zero).alias("fit"), bands.verdict(v, F.lit(0.01)).alias("verdict"))


@query("token_match", """
WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part), v AS (SELECT unnest(['ring', 'bolt', 'red', 'none']) AS token)
SELECT token, count(*) AS n FROM t JOIN v USING (token) GROUP BY token""")
def token_match(s, d):
    names = s.createDataFrame([("ring",), ("bolt",), ("red",), ("none",)], "token string")
    return tx.tokens(table(s, d, "part"), "p_partkey", "p_name").join(F.broadcast(names), "token").groupBy("token").agg(F.count("*").alias("n"))


@query("keyword_flag", """
SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'muscle|muscular|strain|licensed under|rights reserved') AS flagged FROM documents""")
def keyword_flag(s, d):
    return table(s, d, "documents").select("doc_id", bands.contains_any(F.col("text"), ["muscle", "muscular", "strain", "licensed under", "rights reserved"]).alias("flagged"))


@query("unpivot_concat", """
SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, NULL FROM supplier""")
def unpivot_concat(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("set_checks", """
WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier)
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)) AS only_b""")
def set_checks(s, d):
    a, b = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).join(b.exceptAll(a).agg(F.count("*").alias("only_b")))


@query("top_k_report", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_k_report(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(15)


@query("top_n_per_group", """
SELECT n_name, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) <= 3""")
def top_n_per_group(s, d):
    x = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 3").select("n_name", "s_suppkey", "s_acctbal")


_FORMATIONS = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(decisions.FORMATIONS))


@query("season_score", f"""
WITH p AS (SELECT p_brand AS g, p_partkey AS player, CASE WHEN p_partkey % 15 < 2 THEN 'GKP' WHEN p_partkey % 15 < 7 THEN 'DEF' WHEN p_partkey % 15 < 12 THEN 'MID' ELSE 'FWD' END AS position, p_size FROM part),
w AS (SELECT p.*, gw, p_size + (player * gw) % 7 AS v, (player * 31 + gw * 17) % 11 AS actual FROM p, range(1, 6) t(gw)),
r AS (SELECT *, row_number() OVER k AS n, sum(v) OVER (k ROWS UNBOUNDED PRECEDING) AS top FROM w WINDOW k AS (PARTITION BY g, gw, position ORDER BY v DESC, player)),
f AS (SELECT * FROM (VALUES {_FORMATIONS}) t(i, d, m, f)),
best AS (
  SELECT a.g, a.gw, f.d, f.m, f.f FROM r a JOIN r b USING (g, gw) JOIN r c USING (g, gw) JOIN r e USING (g, gw) JOIN f ON b.n = f.d AND c.n = f.m AND e.n = f.f
  WHERE a.position = 'GKP' AND a.n = 1 AND b.position = 'DEF' AND c.position = 'MID' AND e.position = 'FWD'
  QUALIFY row_number() OVER (PARTITION BY a.g, a.gw ORDER BY a.top + b.top + c.top + e.top DESC, i) = 1),
xi AS (SELECT r.*, best.d, best.m, best.f FROM r JOIN best USING (g, gw) WHERE n <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN best.d WHEN 'MID' THEN best.m ELSE best.f END)
SELECT g AS "group", gw, d || '-' || m || '-' || f AS formation, arg_max(player, (v, -player)) AS captain, CAST(sum(actual) + arg_max(actual, (v, -player)) AS DOUBLE) AS points FROM xi GROUP BY g, gw, d, m, f""")
def season_score(s, d):
    """Five weeks of squads (the parts of a brand), picked by what was foreseen and scored by what came."""
    key = F.col("p_partkey")
    place = F.when(key % 15 < 2, "GKP").when(key % 15 < 7, "DEF").when(key % 15 < 12, "MID").otherwise("FWD")
    p = table(s, d, "part").select(F.col("p_brand").alias("group"), key.alias("player"), place.alias("position"), "p_size", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("gw"))
    weeks = p.select("gw", "player", "position", (F.col("p_size") + F.col("player") * F.col("gw") % 7).cast("double").alias("predicted"), ((F.col("player") * 31 + F.col("gw") * 17) % 11).cast("double").alias("actual"))
    return decisions.score_weeks(p.select("group", "player"), weeks)


_DRAW = uniform_sql(42, "p_partkey", "draw")


@query("monte_carlo", f"""
WITH xi AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n, p_size / 10.0 AS lo, p_size / 5.0 AS mi, p_size / 2.0 AS hi FROM part),
drawn AS (SELECT xi.*, draw, {_DRAW} AS u FROM xi, range(1, 10001) r(draw) WHERE n <= 11),
totals AS (
  SELECT p_brand, draw, sum(greatest(0.0, CASE WHEN u < 0.1 THEN lo WHEN u < 0.5 THEN lo + (mi - lo) * (u - 0.1) / 0.4 ELSE mi + (hi - mi) * (u - 0.5) / 0.4 END) * CASE WHEN n = 1 THEN 2 ELSE 1 END) AS total
  FROM drawn GROUP BY 1, 2)
SELECT p_brand, round(avg(total), 6) AS mean, round(quantile_cont(total, 0.1), 6) AS p10, round(quantile_cont(total, 0.5), 6) AS p50, round(quantile_cont(total, 0.9), 6) AS p90 FROM totals GROUP BY 1""")
def monte_carlo(s, d):
    """Simulated totals of the dearest 11 parts of each brand, summarised."""
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    xi = table(s, d, "part").withColumn("n", F.row_number().over(w)).where("n <= 11").select(
        "p_brand", "p_partkey", F.when(F.col("n") == 1, 2).otherwise(1).alias("multiplier"), (F.col("p_size") / 10).alias("floor"), (F.col("p_size") / 5).alias("median"), (F.col("p_size") / 2).alias("ceiling"), F.col("p_size").cast("double").alias("predicted")
    )
    t = decisions.simulate(xi, ["p_brand"], "p_partkey")
    q = F.percentile("total", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return t.groupBy("p_brand").agg(F.round(F.avg("total"), 6).alias("mean"), *[F.round(q[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


_COUNT = "CASE " + " ".join(f"WHEN u < {cut!r} THEN {k}" for k, cut in enumerate(metrics.poisson_cuts())) + " ELSE 8 END"


@query("bootstrap_r2", f"""
WITH x AS (SELECT o_orderkey, {_Y} FROM orders JOIN customer ON o_custkey = c_custkey),
weighted AS (SELECT y, p, r, {_COUNT} AS w FROM (SELECT x.*, r, {uniform_sql(42, "o_orderkey", "r")} AS u FROM x, range(1, 1001) t(r))),
sums AS (
  SELECT r, CAST(sum(w) AS DOUBLE) AS n, sum(w * y) AS sy, sum(w * y * y) AS syy, sum(w * (y - 150000.0) * (y - 150000.0)) AS sa, sum(w * (y - p) * (y - p)) AS sb FROM weighted GROUP BY r),
each AS (SELECT 1 - sa / (syy - sy * sy / n) AS r2, (sb - sa) / n AS gain FROM sums)
SELECT round(avg(r2), 6) AS r2, round(quantile_cont(r2, 0.025), 6) AS low, round(quantile_cont(r2, 0.975), 6) AS high,
  least(1.0, 2 * least(avg(CAST(gain <= 0 AS DOUBLE)), avg(CAST(gain >= 0 AS DOUBLE)))) AS p_value FROM each""")
def bootstrap_r2(s, d):
    x = _scored(s, d).withColumn("q", F.lit(150_000.0))
    out = metrics.bootstrap(x, "o_orderkey", "y", "q", "p")
    return out.select(*[F.round(c, 6).alias(c) for c in ("r2", "low", "high")], "p_value")


@query("greedy_plan")
def greedy_plan(s, d):
    p = table(s, d, "part").select(
        F.col("p_partkey").alias("player"), F.col("p_type").alias("position"), F.col("p_brand").alias("team"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("value"), F.lit("a").alias("status")
    )
    w = Window.partitionBy("team").orderBy("player")
    squads = p.withColumn("n", F.row_number().over(w)).where("n <= 15").withColumns({"group": F.col("team"), "bank": F.lit(20.0)}).drop("status", "n")
    return decisions.greedy_plans(squads, p, free=2)
