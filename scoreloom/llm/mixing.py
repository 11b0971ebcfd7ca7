"""Mixing sources to target weights, by budgets down a domain-language-source tree.

DataFrame operations only. Every node has a weight among its siblings and a
capacity, the tokens below it times the epochs allowed. From the root down a
node's budget is shared among its children in proportion to their weights;
a child never gets more than its capacity, and what it can't take goes to its
siblings. A node can't fall short while a descendant of it has tokens left,
so shortages reach an ancestor's other children only when all siblings are
spent.

A leaf's budget is filled epoch by epoch. In each epoch the leaf's documents
have an own seeded order, and the documents are taken from its start for as
long as their running token count stays within the budget. The running count
of a hot leaf is no window over all of it: the order is cut in slices by its
leading hash bits, slices are summed before any shuffle, and only the one
slice that the budget ends in is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm.common import materialise

LEVELS = ("domain", "lang", "source")
SLICE_BITS = 10
#: Leaves whose budgets are broadcast: some 200 bytes each, 10 MB at most.
BROADCAST_LEAVES = 50_000


def n_words(text: str = "text") -> Column:
    """Tokens of a text for the mixture: its words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column) -> Column:
    """32 bits of the seeded order of documents in an epoch, from md5."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Budgets of siblings: ``nodes`` has parent keys, weight, capacity and the parent's budget as ``purse``.

    Siblings are ordered by capacity a unit of weight. One is filled to the
    brim if the level at which it fills, taken by all after it, still leaves
    the purse enough; the rest share what is left by weight.
    """
    w = W.partitionBy(*parent).orderBy("ratio", "capacity", "name")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = W.partitionBy(*parent)
    nodes = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    nodes = nodes.withColumn("below", F.sum("capacity").over(upto)).withColumn("above", F.sum("weight").over(rest) - F.sum("weight").over(upto))
    nodes = nodes.withColumn(
        "full", (F.col("weight") > 0) & (F.col("below") + F.when(F.col("above") > 1e-12, F.col("ratio") * F.col("above")).otherwise(F.lit(0.0)) <= F.col("purse") + 1e-6)
    )
    spent = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(rest)
    left = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(rest)
    return nodes.withColumn(
        "budget",
        F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(
            F.when(left > 0, F.least(F.col("capacity").cast("double"), F.greatest(F.lit(0.0), F.col("purse") - spent) * F.col("weight") / left)).otherwise(F.lit(0.0))
        ),
    ).drop("ratio", "below", "above", "full")


def leaf_budgets(leaves: DataFrame, weights: dict[str, DataFrame], total: float, epochs: int, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Weight, capacity and budget of each of ``leaves`` (levels, tokens).

    ``weights`` may give a frame for a level, with the level's path down to it
    and a ``weight``; nodes without one weigh 1. Nodes of weight 0 get
    nothing. The sum of the budgets is ``total``, or all capacity if that is less.
    """
    for depth, level in enumerate(levels, 1):
        path = list(levels[:depth])
        if level in weights:
            given = weights[level].select(*path, F.col("weight").cast("double").alias(f"w{depth}"))
            leaves = leaves.join(given, path, "left")
        else:
            leaves = leaves.withColumn(f"w{depth}", F.lit(None).cast("double"))
        leaves = leaves.withColumn(f"w{depth}", F.greatest(F.lit(0.0), F.coalesce(f"w{depth}", F.lit(1.0))))
    # Nothing flows to or through a node of weight 0, so what lies below it is no capacity.
    alive = F.least(*(F.col(f"w{d}") for d in range(1, len(levels) + 1))) > 0
    leaves = leaves.withColumn("usable", F.when(alive, F.col("tokens") * epochs).otherwise(F.lit(0)).cast("double"))
    shared = None
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("usable").alias("capacity"), F.max(f"w{depth}").alias("weight")).withColumn("name", F.col(path[-1]))
        if shared is None:
            nodes = nodes.withColumn("purse", F.lit(float(total))).withColumn("root", F.lit(1))
            shared = _share(nodes, ["root"])
        else:
            shared = _share(nodes.join(shared.select(*path[:-1], F.col("budget").alias("purse")), path[:-1]), path[:-1])
    return shared.select(*levels, "weight", "capacity", "budget")


def mix(
    docs: DataFrame,
    domain: Column,
    share: float,
    weights: dict[str, DataFrame] | None = None,
    epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, once for each epoch that takes them.

    ``docs`` has doc_id, text, lang and source; ``domain`` names each row's
    domain. Added are domain, epoch (from 1), tokens and leaf_budget; a column
    of ``docs`` with such a name is replaced. The mixture has ``share`` times
    the tokens of ``docs``, or all it can get if that is less. Rows of a leaf are taken in order while the running count stays
    within the leaf's budget. Null levels are levels of their own, named
    ``(none)``; null and empty texts have no tokens and ride along in order.
    Repeated ids tie in the order and are taken or left by their text, then
    a hash of the row. An empty table gives an empty mixture.
    """
    base = docs.drop("domain", "epoch", "tokens", "leaf_budget")
    none = F.lit("(none)")
    # The row as it came is one column, so no name of its own clashes with one made here.
    rows = base.select(
        F.struct(*base.columns).alias("row"),
        "doc_id",
        "text",
        F.coalesce(domain.cast("string"), none).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), none).alias("lang"),
        F.coalesce(F.col("source").cast("string"), none).alias("source"),
        n_words().alias("tokens"),
    )
    leaf = ["domain", "lang", "source"]
    turns = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("order", order_hash(seed, F.col("epoch")))
    turns = turns.withColumn("slice", F.shiftright("order", 32 - SLICE_BITS))
    slices = materialise(
        turns.groupBy(*leaf, "epoch", "slice").agg(F.sum("tokens").alias("slice_tokens")), "mix-slices"
    )
    leaves = (
        slices.where("epoch = 1")
        .groupBy(*leaf)
        .agg(F.sum("slice_tokens").alias("tokens"))
        .toDF("domain", "lang", "source", "tokens")
    )
    total = share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    budgets = leaf_budgets(leaves, weights or {}, total, epochs).select(
        "domain", "lang", "source", F.floor(F.col("budget") + 1e-6).alias("leaf_budget")
    )
    before = F.sum("slice_tokens").over(W.partitionBy(*leaf).orderBy("epoch", "slice").rowsBetween(W.unboundedPreceding, -1))
    placed = slices.withColumn("before", F.coalesce(before, F.lit(0))).join(budgets, leaf)
    # Of each leaf: the slice the budget ends in, if it ends before the last, and how much comes before it.
    ends = materialise(
        placed.groupBy(*leaf, "leaf_budget").agg(
            F.min(
                F.when(F.col("before") + F.col("slice_tokens") > F.col("leaf_budget"), F.struct("epoch", "slice", "before"))
            ).alias("end")
        ),
        "mix-ends",
    )
    few = ends.count() <= BROADCAST_LEAVES
    known = turns.join(F.broadcast(ends) if few else ends, leaf)
    here = F.struct(F.col("epoch"), F.col("slice"))
    stop = F.struct("end.epoch", "end.slice")
    whole = known.where(F.col("end").isNull() | (here < stop))
    last = known.where(here == stop)
    rest = F.xxhash64(*(f"row.`{c}`" for c, kind in base.dtypes if "map<" not in kind and "variant" not in kind))
    by = W.partitionBy(*leaf).orderBy("order", "doc_id", "text", rest).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("running", F.col("end.before") + F.sum("tokens").over(by)).where("running <= leaf_budget")
    names = ["row.*", "domain", "epoch", "tokens", "leaf_budget"]
    return whole.select(*names).unionByName(last.select(*names))


#: Target weights of the registered query.
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "code": 0.15, "other": 0.05}
LANG_WEIGHTS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}
SHARE = 0.8


def target_weights(spark: SparkSession) -> dict[str, DataFrame]:
    """The registered query's weights as frames; sources weigh the same within a language."""
    domains = spark.createDataFrame(list(DOMAIN_WEIGHTS.items()), "domain string, weight double")
    langs = spark.createDataFrame([(d, x, w) for d in DOMAIN_WEIGHTS for x, w in LANG_WEIGHTS.items()], "domain string, lang string, weight double")
    return {"domain": domains, "lang": langs}


def domain_of(source: str = "source") -> Column:
    """Domain of a source of the driver's documents: numbered sources fall into three families."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]+)$", 1)
    n = F.when(number == "", F.lit(None)).otherwise(number.cast("long"))
    return F.when(n.isNull(), "other").when(n % 3 == 0, "web").when(n % 3 == 1, "books").otherwise("code")
