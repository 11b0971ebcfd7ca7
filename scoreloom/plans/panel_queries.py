"""Queries over events and orders as panels: rolling form, as-of history, totals, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.operators import aggregates as agg
from scoreloom.operators import asof, merge, windows
from scoreloom.semantics import DAY_US, latest_by, safe_div
from scoreloom.session import table
from scoreloom.sources import archive

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


EV = ["ts", "event_id"]


def _rounded(*names: str):
    """Columns at six places: two engines add the same doubles in different orders."""
    return [F.round(c, 6).alias(c) for c in names]


@query("rolling_form", """
SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS form_3,
  CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS form_5, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) / count(value) OVER w AS form_all
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rolling_form(s, d):
    out = windows.rolling_form(table(s, d, "events"), ["user_id"], EV, "value", exact=4)
    return out.select("event_id", "user_id", "form_3", "form_5", "form_all")


@query("rolling_form_leakfree", """
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) / count(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior_mean_3,
  CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) / count(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prior_mean_5,
  round(stddev_samp(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS prior_std_5,
  round(max(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS prior_max_5,
  CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS prior_sum,
  CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / count(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def rolling_form_leakfree(s, d):
    out = windows.leakfree_form(table(s, d, "events"), ["user_id"], EV, "value", exact=4)
    return out.select("event_id", "prior_mean_3", "prior_mean_5", *_rounded("prior_std_5", "prior_max_5"), "prior_sum", "prior_mean")


_K_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query("per90_ratio", f"""
SELECT event_id, CASE WHEN sum({_K_SQL}) OVER w > 0 THEN sum(value) OVER w * 90.0 / sum({_K_SQL}) OVER w END AS per90
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def per90_ratio(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    return windows.prior_rate(e, ["user_id"], EV, "value", "k", "per90").select("event_id", "per90")


_W_SQL = " + ".join(f"coalesce(lag(value, {k}) OVER w, 0.0) * {x}" for k, x in enumerate(windows.FORM_WEIGHTS))
_D_SQL = " + ".join(f"CASE WHEN lag(1, {k}) OVER w = 1 THEN {x} ELSE 0.0 END" for k, x in enumerate(windows.FORM_WEIGHTS))


@query("weighted_form", f"SELECT event_id, CAST(({_W_SQL}) AS DOUBLE) / CAST(({_D_SQL}) AS DOUBLE) AS weighted_form FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def weighted_form(s, d):
    return windows.weighted_form(table(s, d, "events"), ["user_id"], EV, "value").select("event_id", "weighted_form")


@query("price_trend", """
SELECT o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS o_totalprice_change FROM orders""")
def price_trend(s, d):
    return windows.deltas(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"]).select("o_orderkey", "o_totalprice_change")


@query("latest_snapshot", """
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_snapshot(s, d):
    return latest_by(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("season_totals", """
WITH t AS (
  SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_played,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price
  FROM orders GROUP BY o_custkey)
SELECT c_custkey, n_name, n_rows, n_played, CAST(total AS DOUBLE) AS total, price,
  CAST(total AS DOUBLE) / nullif(n_played, 0) AS per_played, CAST(total AS DOUBLE) / nullif(price, 0) AS per_price
FROM t JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey""")
def season_totals(s, d):
    o = table(s, d, "orders").withColumn("exact", F.col("o_totalprice").cast("decimal(18,2)"))
    t = agg.season_totals(o, ["o_custkey"], "exact", F.col("o_orderstatus") == "F", "o_totalprice", ["o_orderdate", "o_orderkey"])
    t = t.withColumn("total", F.col("total").cast("double")).withColumns({"per_played": safe_div(F.col("total"), F.col("n_played")), "per_price": safe_div(F.col("total"), F.col("price"))})
    dims = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.join(dims, t.o_custkey == dims.c_custkey).select("c_custkey", "n_name", "n_rows", "n_played", "total", "price", "per_played", "per_price")


@query("movers", """
WITH latest AS (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, n_name, o_totalprice - c_acctbal AS net FROM latest JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey""")
def movers(s, d):
    latest = latest_by(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    c = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return latest.join(c, latest.o_custkey == c.c_custkey).select("c_custkey", "n_name", (F.col("o_totalprice") - F.col("c_acctbal")).alias("net"))


@query("asof_latest_le", """
SELECT o.o_orderkey, p.o_totalprice AS known_price, p.o_orderkey AS known_key FROM orders o
JOIN LATERAL (SELECT x.o_totalprice, x.o_orderkey FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderdate <= o.o_orderdate
  AND x.o_orderpriority LIKE '1%' ORDER BY x.o_orderdate DESC, x.o_orderkey DESC LIMIT 1) p ON true""")
def asof_latest_le(s, d):
    o = table(s, d, "orders")
    ev = o.where(F.col("o_orderpriority").startswith("1")).withColumns({"known_key": F.col("o_orderkey"), "known_price": F.col("o_totalprice")})
    out = asof.latest_at(o, ev, ["o_custkey"], "o_orderdate", "o_orderdate", ["known_key"], ["known_price", "known_key"], ["o_orderkey"])
    return out.select("o_orderkey", "known_price", "known_key")


@query("asof_strict_history", """
SELECT e.event_id, epoch_us(max(h.ts)) AS last_us, count(h.event_id) AS n_before FROM events e
LEFT JOIN events h ON h.user_id = e.user_id AND h.event_type = 'error' AND h.ts < e.ts GROUP BY e.event_id""")
def asof_strict_history(s, d):
    e = table(s, d, "events")
    return asof.strict_history(e, e.where("event_type = 'error'"), ["user_id"], "ts", "ts", ["event_id"]).select("event_id", "last_us", "n_before")


@query("windowed_count_7d", """
SELECT e.event_id, count(h.event_id) AS n_within FROM events e
LEFT JOIN events h ON h.user_id = e.user_id AND h.event_type = 'error' AND h.ts < e.ts AND h.ts >= e.ts - INTERVAL 7 DAY GROUP BY e.event_id""")
def windowed_count_7d(s, d):
    return asof.count_within(table(s, d, "events"), ["user_id"], "ts", F.col("event_type") == "error", 7 * DAY_US).select("event_id", "n_within")


@query("congestion", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
  (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) / 86400000000.0 AS gap FROM orders)
SELECT a.o_orderkey, coalesce(a.gap, 14.0) AS days_since,
  (SELECT count(*) FROM x b WHERE b.o_custkey = a.o_custkey AND b.rn < a.rn AND b.o_orderdate >= a.o_orderdate - INTERVAL 90 DAY) AS recent_count,
  CAST(coalesce(a.gap, 14.0) <= 4.0 AS INTEGER) AS is_congested FROM x a""")
def congestion(s, d):
    return windows.congestion(table(s, d, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"], 90, idle=14.0).select("o_orderkey", "days_since", "recent_count", "is_congested")


@query("scalar_max_slice", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def scalar_max_slice(s, d):
    o = table(s, d, "orders")
    return o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("o_orderdate"))), "o_orderdate").select("o_orderkey", "o_custkey")


@query("prior_period_join", """
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(DISTINCT o_orderdate) AS n_days FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.y, a.total, a.n_days, coalesce(b.total, 0) AS prior_total, coalesce(b.n_days, 0) AS prior_n_days, CAST(b.y IS NOT NULL AS INTEGER) AS had_prior
FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND b.y = a.y - 1""")
def prior_period_join(s, d):
    y = table(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.countDistinct("o_orderdate").alias("n_days")
    )
    return agg.prior_period(y, ["o_custkey"], "y", ["total", "n_days"])


@query("cumulative_policy", """
WITH t AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL)
SELECT *, sum(total) OVER (PARTITION BY event_type ORDER BY day) AS cumulative FROM t""")
def cumulative_policy(s, d):
    e = table(s, d, "events").select("event_type", F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("value"))
    out = agg.cumulative_by_step(e, ["event_type"], "day", "value")
    return out.withColumns({"total": F.col("total").cast("double"), "cumulative": F.col("cumulative").cast("double")})


@query("fold_summary", """
SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY event_type""")
def fold_summary(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@query("free_transfer_fold", """
WITH RECURSIVE days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS made, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS n
  FROM events GROUP BY user_id, CAST(ts AS DATE)
), fold AS (
  SELECT user_id, n, CAST(1 AS BIGINT) AS free_moves FROM days WHERE n = 1
  UNION ALL SELECT d.user_id, d.n, least(5, greatest(0, f.free_moves - d.made) + 1) FROM fold f JOIN days d ON d.user_id = f.user_id AND d.n = f.n + 1
)
SELECT user_id, arg_max(free_moves, n) AS free_moves FROM fold GROUP BY user_id""")
def free_transfer_fold(s, d):
    days = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("made"))
    numbered = days.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return windows.capped_fold(numbered, ["user_id"], "n", "made")


@query("upsert_merge", """
WITH new AS (SELECT o_orderkey, o_custkey, 'new' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 3 > 0),
old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 < 2)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey,
  coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice
FROM old o FULL JOIN new n USING (o_orderkey)""")
def upsert_merge(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 3 > 0").withColumns({"o_orderstatus": F.lit("new"), "o_totalprice": F.col("o_totalprice") * 2, "seq": F.lit(2)})
    return merge.upsert(o.where("o_orderkey % 3 < 2").withColumn("seq", F.lit(1)), new, ["o_orderkey"], "seq").drop("seq")


@query("upsert_keep", """
WITH new AS (SELECT o_orderkey, 'new' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 3 > 0),
old AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 < 2)
SELECT o_orderkey, coalesce(o.o_orderstatus, n.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice
FROM old o FULL JOIN new n USING (o_orderkey)""")
def upsert_keep(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderkey % 3 < 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")))
    new = o.where("o_orderkey % 3 > 0").withColumns({"o_orderstatus": F.lit("new"), "o_totalprice": F.col("o_totalprice") * 2})
    return merge.upsert_keeping(old, new, ["o_orderkey"], ["o_orderstatus"])


@query("insert_absent", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 2""")
def insert_absent(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.lit("new"))
    return merge.insert_absent(o.where("o_orderkey % 3 < 2"), new.union(new), ["o_orderkey"], ["o_orderstatus"])


@query("json_flatten", """
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS k_distinct FROM events GROUP BY event_type""")
def json_flatten(s, d):
    landed = table(s, d, "events").select("event_type", F.array(F.from_json("props", "k string")).alias("items"))
    e = archive.flatten(landed, "items", {"k": "long"}, keep=("event_type",))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.countDistinct("k").alias("k_distinct"))


@query("percentile_summary", """
WITH t AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 100 AS total FROM events GROUP BY user_id)
SELECT avg(total) AS mean, quantile_cont(total, 0.1) AS p10, quantile_cont(total, 0.5) AS p50, quantile_cont(total, 0.9) AS p90,
  avg(CAST(total >= 60 AS DOUBLE)) AS p_ge_60, avg(CAST(total >= 80 AS DOUBLE)) AS p_ge_80 FROM t""")
def percentile_summary(s, d):
    t = table(s, d, "events").groupBy("user_id").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 100).alias("total"))
    return agg.simulation_summary(t, "total")


@query("histogram36", """
WITH t AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY user_id),
e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 36 AS w FROM t),
c AS (SELECT CAST(least(35, floor((v - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM t, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * w AS start, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(36)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""")
def histogram36(s, d):
    t = table(s, d, "events").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    return agg.histogram(t, "v")


@query("injury_interval_state", """
SELECT a.event_id, count(b.event_id) AS n_open FROM events a
LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts <= a.ts AND a.ts < b.ts + INTERVAL 2 DAY GROUP BY a.event_id""")
def injury_interval_state(s, d):
    """Intervals [start, start + 2 days) open at each row: starts before, less ends before, on one time line."""
    from scoreloom.operators.intervals import open_intervals

    e = table(s, d, "events")
    iv = e.where("event_type = 'purchase'").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("until"))
    return open_intervals(e, iv, ["user_id"], "ts", "ts", "until", ["event_id"]).select("event_id", "n_open")
