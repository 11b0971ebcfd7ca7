"""Queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries`` holds the headline queries, the least of three runs each, and
``value`` is their sum. ``more`` holds one run each of the model queries, of
the design frame of some 156,000 weekly rows and of the corpus operators; none
of these is started later than ``LATEST`` seconds after the first.
"""

from __future__ import annotations

import importlib.util
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.catalogue import queries
from scoreloom.plans.live import design_frame
from scoreloom.session import materialise, session, table
from scoreloom.sources.archive import DC_COLUMNS, STATS, XG_COLUMNS

HEADLINE = [
    "season_totals", "rolling_form", "rolling_form_leakfree", "weighted_form", "price_trend", "latest_snapshot", "asof_strict_history", "asof_latest_le",
    "windowed_count_7d", "congestion", "collapse_dgw", "team_form", "fixture_difficulty", "self_join_roles", "best_xi", "auc_brier", "upsert_merge", "prior_period_join",
]
RUNS = 3
LATEST = 150
MORE = ["monte_carlo", "bootstrap_r2", "candidate_pairs", "percentile_summary", "calibration_curve", "feature_subsets", "feature_importance", "model_regression"]


def weekly_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as an archive's rows: seven seasons of 38 weeks, 660 players in 20 teams, a fixture a team and week."""
    li = table(spark, sf, "lineitem")
    element, gw = F.col("l_partkey") % 660, F.dayofyear("l_shipdate") % 38 + 1
    year = F.year("l_shipdate")
    season = F.concat_ws("-", year, F.lpad(((year + 1) % 100).cast("string"), 2, "0"))
    keyed = li.groupBy(season.alias("season"), element.cast("int").alias("element"), gw.alias("GW")).agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    team = F.col("element") % 20
    rival = (F.col("GW") * 2 + 1 - team + 20) % 20  # an odd sum pairs all teams
    home = team < rival
    pair = F.least(team, rival)
    stats = {c: (F.col("q") * (i + 1)) % 11 for i, c in enumerate(STATS + XG_COLUMNS + DC_COLUMNS)} | {"minutes": F.col("q") % 91}
    return keyed.withColumns(
        {
            "fixture": (F.col("GW") * 20 + pair).cast("int"), "name": F.col("element").cast("string"), "position": F.get(F.array(*map(F.lit, ("GKP", "DEF", "MID", "FWD"))), (F.col("element") % 4).cast("int")),
            "team": team.cast("string"), "opponent": rival.cast("string"), "was_home": home, "kickoff_time": F.timestamp_add("DAY", F.col("GW") * 7, F.make_timestamp(F.left("season", F.lit(4)).cast("int"), F.lit(8), F.lit(1), F.lit(15), F.lit(0), F.lit(0))),
            "team_h_score": (pair + F.col("GW")).cast("int") % 4, "team_a_score": (pair * F.col("GW")).cast("int") % 3, "value": (F.col("element") % 60 + 40).cast("int"), "selected": F.lit(1).cast("long"),
            "xg_data_available": F.lit(1), "dc_data_available": F.lit(1), "code": F.col("element").cast("long"), **stats,
        }
    ).drop("q", "d")


def design(spark: SparkSession, sf: str) -> DataFrame:
    injuries = table(spark, sf, "orders").where("o_orderkey % 10 = 0").select((F.col("o_custkey") % 660).alias("code"), F.lit("hamstring").alias("injury_type"), F.col("o_orderdate").cast("date").alias("injury_from"), F.date_add(F.col("o_orderdate").cast("date"), 20).alias("injury_until"))
    return design_frame(materialise(weekly_rows(spark, sf), "bench-weeks"), injuries)


def once(spark: SparkSession, sf: str, f: Callable[[SparkSession, str], DataFrame]) -> float:
    t = time.perf_counter()
    f(spark, sf).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    known = queries()
    once(spark, sf, known["season_totals"])  # starts the session
    took = {name: min(once(spark, sf, known[name]) for _ in range(RUNS)) for name in HEADLINE}
    more = {"design_frame": design}
    if importlib.util.find_spec("scoreloom.llm"):
        from scoreloom.llm import registry

        more |= registry.queries()
    more |= {name: known[name] for name in MORE}
    begun, extra = time.perf_counter(), {}
    for name, f in more.items():
        if time.perf_counter() - begun < LATEST:
            extra[name] = once(spark, sf, f)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "more": extra, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
