"""Model, matching and streaming queries on the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.models import boosting, gram, training
from scoreloom.models.experiments import permutation_importance
from scoreloom.models.squad_solver import sweep
from scoreloom.operators.matching import match_names
from scoreloom.session import shared_folder, table
from scoreloom.streaming.incremental import run_to_table, windowed_counts

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _orders(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-5, -1)
    o = table(s, d, "orders").withColumns({"mean5": F.avg("o_totalprice").over(w), "max5": F.max("o_totalprice").over(w), "month": F.month("o_orderdate").cast("double"), "year": F.year("o_orderdate")})
    return o.select("o_orderkey", "o_totalprice", "mean5", "max5", "month", "year")


FEATURES = ["mean5", "max5", "month"]


@query("model_regression")
def model_regression(s, d):
    kinds = {
        "linear_regression": LinearRegression(solver="normal", labelCol="o_totalprice"),
        "random_forest": RandomForestRegressor(numTrees=10, maxDepth=5, minInstancesPerNode=10, featureSubsetStrategy="all", seed=training.SEED, labelCol="o_totalprice"),
        "boosted": GBTRegressor(maxIter=5, maxDepth=4, stepSize=0.05, seed=training.SEED, labelCol="o_totalprice"),
    }
    return training.fit_regressors(_orders(s, d), FEATURES, "o_totalprice", "mean5", F.col("year") < 2000, kinds)[1]


@query("model_quantiles")
def model_quantiles(s, d):
    o = _orders(s, d)
    model = boosting.fit(o.where("year < 2000"), FEATURES, "o_totalprice")
    return training.quantile_scores(boosting.predict(o.where("year >= 2000"), model), "o_totalprice")


_LINES = "SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, CAST(l_extendedprice AS DOUBLE) / 1000 AS price FROM lineitem"
NUMBERS = ["quantity", "discount", "tax", "price"]


def _lines(s, d):
    li = table(s, d, "lineitem")
    return li.select("l_orderkey", *[F.col(f"l_{c}").cast("double").alias(c) for c in NUMBERS[:3]], (F.col("l_extendedprice").cast("double") / 1000).alias("price"))


@query("gram_covariances", f"WITH x AS ({_LINES}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(avg({a}), 6) AS mean_a, round(avg({b}), 6) AS mean_b, round(covar_samp({a}, {b}), 6) AS covariance FROM x"
    for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]))
def gram_covariances(s, d):
    out = gram.covariances(_lines(s, d), NUMBERS)
    return out.select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "covariance")])


@query("feature_subsets", f"WITH x AS ({_LINES}), " + """told AS (
  SELECT unnest(['quantity', 'discount', 'tax']) AS name, unnest([quantity, discount, tax]) AS v, price AS y, l_orderkey % 5 <> 0 AS train FROM x
), fits AS (SELECT name, regr_slope(y, v) AS b, regr_intercept(y, v) AS a, regr_r2(y, v) AS train_r2 FROM told WHERE train GROUP BY name)
SELECT name, round(train_r2, 6) AS train_r2, round(1 - sum((y - a - b * v) * (y - a - b * v)) / (count(*) * var_pop(y)), 6) AS r2, count(*) AS n
FROM told JOIN fits USING (name) WHERE NOT train GROUP BY name, train_r2""")
def feature_subsets(s, d):
    """Prices fitted on single features, trained and tested from one pass over the lines."""
    by = gram.grams(_lines(s, d), NUMBERS[:3], "price", F.col("l_orderkey") % 5 != 0)
    rows = gram.subsets(by[True], by[False], {c: [c] for c in NUMBERS[:3]})
    return s.createDataFrame([(r["name"], round(r["train_r2"], 6), round(r["r2"], 6), r["n"]) for r in rows], "name string, train_r2 double, r2 double, n long")


@query("feature_importance")
def feature_importance(s, d):
    """Loss of R2 of a linear fit of prices when a feature is dealt anew among the test lines, ten times each."""
    lines = _lines(s, d).withColumn("id", F.monotonically_increasing_id())
    data = training.design(lines, NUMBERS[:3], "price")
    model = Pipeline(stages=[training.assembler(NUMBERS[:3]), LinearRegression(solver="normal", labelCol="price")]).fit(data.where("l_orderkey % 5 <> 0"))
    return permutation_importance(model, lines.where("l_orderkey % 5 = 0"), NUMBERS[:3], "price", "id")


@query("squad_sweep")
def squad_sweep(s, d):
    size = F.col("p_partkey") % 15
    p = table(s, d, "part").select(
        F.col("p_partkey").alias("player"), F.col("p_brand").alias("team"), F.when(size < 2, "GKP").when(size < 7, "DEF").when(size < 12, "MID").otherwise("FWD").alias("position"),
        (F.round(F.col("p_retailprice") / 100) / 2).alias("price"), (F.col("p_size") / 5.0).alias("predicted"), F.lit("a").alias("status"),
    )
    budgets = s.createDataFrame([("predicted", b) for b in (60.0, 80.0, 100.0)], "basis string, budget double")
    return sweep(p, budgets, seconds=5.0).select("basis", "budget", F.round("objective", 6).alias("objective"), F.size("players").alias("n"), "proven", F.round("bound", 6).alias("bound"))


def name_tables(s, d):
    """Names as another source writes them, and the directory: parts as people, brands as clubs.

    A person's last word spells the key; the short name spells it mod 50, so
    that people share short names. A sixth each of the raw names is plain,
    accented, in another order, short with a club, misspelt with a club, and of
    nobody's full name.
    """
    word = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    key = F.col("p_partkey")
    p = table(s, d, "part").select(key.alias("code"), F.concat_ws(" ", "p_name", word(key)).alias("full_name"), word(key % 50).alias("web_name"), F.col("p_brand").alias("team"))
    name, kind = F.col("full_name"), F.col("code") % 6
    other = (
        F.when(kind == 0, F.initcap(name))
        .when(kind == 1, F.upper(F.translate(name, "aeiou", "áéíóú")))
        .when(kind == 2, F.array_join(F.reverse(F.split(name, " ")), " "))
        .when(kind == 3, F.concat(F.lit("X. "), "web_name"))
        .when(kind == 4, F.concat(F.substring(name, 1, 2), F.substring(name, 2, 100)))
        .otherwise(F.concat(F.lit("nobody "), word(F.col("code") * 7)))
    )
    club = F.when(kind == 3, F.concat(F.upper("team"), F.lit(" FC"))).when(kind == 4, F.col("team"))
    return p.select(other.alias("raw_name"), club.alias("club"), F.col("code").alias("seq")), p


@query("name_match")
def name_match(s, d):
    return match_names(*name_tables(s, d))


@query("stream_counts", """
WITH x AS (SELECT *, event_id % 5 = 0 AS late FROM events), m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM x WHERE NOT late)
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM x, m
WHERE NOT late OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY ALL""")
def stream_counts(s, d):
    """Daily counts of a stream in two arrivals; of the second, days that the watermark has closed are dropped, others are counted on."""
    events, path = table(s, d, "events"), shared_folder(s, "counts")
    for late in (False, True):
        events.where((F.col("event_id") % 5 == 0) == late).write.parquet(f"{path}/landed/late={late}")
        stream = s.readStream.schema(events.schema).parquet(f"{path}/landed/late=*")
        out = run_to_table(windowed_counts(stream, "ts", ["event_type"]), ["start", "event_type"], path)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
