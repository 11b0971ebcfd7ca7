"""Windows over keyed time lines, cut in slices where one key holds very many rows.

A window puts all rows of a key into one task. Here the line of a key with
more rows than a task should sort is cut at quantiles of its first order
column, and windows run inside slices:

* a frame that looks back some rows gets the last rows of the slices before,
  carried over from slice to slice;
* a running sum, count or maximum adds that of all slices before, which is a
  window over one row a slice.

Cuts come from a mergeable sketch, so no key is gathered to find them. Rows
that are equal in the first order column stay in one slice. Small inputs, and
inputs without such a key, get plain windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from scoreloom.semantics import micros

#: Rows of a key that one task sorts whole, and the estimated size of an input (bytes) below which nobody looks for such keys.
SLICE_ROWS = 1_000_000
LEAST_BYTES = 256 << 20
#: Slices of all keys together, and of one key: cuts are broadcast, some 16 bytes each.
ALL_SLICES = 65_536
KEY_SLICES = 4_096
GROUP = 64

Frame = Callable[[WindowSpec], WindowSpec]
#: Rows up to the current one, and rows before it.
UP_TO: Frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
BEFORE: Frame = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _same(left: DataFrame, right: DataFrame, names: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in names])


def _position(df: DataFrame, first) -> Column | None:
    """The first order column as a number; None where it has no such order."""
    if not isinstance(first, str):
        return None
    kind = df.schema[first].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return micros(first)
    return F.col(first) if isinstance(kind, T.NumericType) else None


def find_cuts(df: DataFrame, keys: list[str], at: Column) -> list[tuple] | None:
    """(key values..., cuts in groups, last cut of each group but the last) of each key with too many rows; None without any."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(SLICE_ROWS, (total or 0) // ALL_SLICES)
    if not most or most <= limit:
        return None
    hot = counts.where(F.col("__n") > limit)
    hot = hot.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n")
    n_slices = lambda n: min(KEY_SLICES, math.ceil(n / limit))
    widest = n_slices(most)
    shares = [i / widest for i in range(1, widest)]
    rows = df.withColumn("__at", at)
    # At most ALL_SLICES keys have that many rows.
    rows = rows.join(F.broadcast(hot), _same(rows, hot, [(k, f"__k{i}") for i, k in enumerate(keys)]))
    names = [f"__k{i}" for i in range(len(keys))]
    told = rows.groupBy(*names).agg(F.max("__n").alias("n"), F.percentile_approx("__at", shares, max(10_000, 4 * widest)).alias("cuts")).collect()
    out = []
    for r in told:
        k = n_slices(r["n"])
        cuts = sorted({r["cuts"][min(widest - 2, round(i * widest / k) - 1)] for i in range(1, k)} if r["cuts"] else set())
        groups = [cuts[i : i + GROUP] for i in range(0, len(cuts), GROUP)] or [[]]
        out.append((*[r[c] for c in names], groups, [g[-1] for g in groups[:-1]]))
    return out


class Line:
    """Rows of ``df`` by keys, in the order of columns whose first is a name; columns are added by :meth:`rows` and :meth:`running`."""

    def __init__(self, df: DataFrame, keys: list[str], order: list):
        self.keys, self.order, self.columns = keys, order, df.columns
        self.df, self.by, self.cut = df, list(keys), False
        at = _position(df, order[0])
        if at is None or estimated_bytes(df) < LEAST_BYTES:
            return
        found = find_cuts(df, keys, at)
        if found is None:
            return
        kind = df.select(at.alias("a")).schema["a"].dataType
        fields = [T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        fields += [T.StructField("__groups", T.ArrayType(T.ArrayType(kind))), T.StructField("__ends", T.ArrayType(kind))]
        cuts = df.sparkSession.createDataFrame(found, T.StructType(fields))
        rows = df.withColumn("__at", at)
        joined = rows.join(F.broadcast(cuts), _same(rows, cuts, [(k, f"__k{i}") for i, k in enumerate(keys)]), "left")
        below = lambda c: F.size(F.filter(c, lambda x: x < F.col("__at")))
        group = below(F.col("__ends"))
        slice_ = F.when(F.col("__groups").isNotNull(), group * GROUP + below(F.get("__groups", group))).otherwise(0)
        self.df = joined.select(*[rows[c] for c in df.columns], slice_.cast("int").alias("__slice"), F.col("__groups").isNotNull().alias("__hot"))
        self.by, self.cut = [*keys, "__slice"], True

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def _carried(self, n: int) -> DataFrame:
        """For each slice the last n rows before it, as rows of that slice."""
        latest = Window.partitionBy(*self.by).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in self.order])
        whole = F.struct(*[F.col(f"`{c}`") for c in self.df.columns])
        tails = self.df.where("__hot").withColumn("__back", F.row_number().over(latest)).where(F.col("__back") <= n)
        ends = tails.groupBy(*self.by).agg(F.sort_array(F.collect_list(F.struct((-F.col("__back")).alias("b"), whole.alias("r")))).alias("__tail"))
        # A slice has a row at least, so n slices hold n rows, or all.
        before = Window.partitionBy(*self.keys).orderBy("__slice").rowsBetween(-n, -1)
        given = ends.withColumn("__given", F.slice(F.reverse(F.flatten(F.collect_list("__tail").over(before))), 1, n))
        rows = given.select(F.col("__slice").alias("__target"), F.explode("__given.r").alias("r")).select("__target", "r.*")
        return rows.withColumn("__slice", F.col("__target")).drop("__target")

    def rows(self, back: int, make: Callable[[WindowSpec], dict[str, Column]]) -> Line:
        """Columns over frames that look back ``back`` rows at most, and not ahead."""
        if not self.cut:
            self.df = self.df.withColumns(make(self._window()))
            return self
        both = self.df.withColumn("__carried", F.lit(False)).unionByName(self._carried(back).withColumn("__carried", F.lit(True)))
        self.df = both.withColumns(make(self._window())).where(~F.col("__carried")).drop("__carried")
        return self

    def running(self, frame: Frame, aggregates: dict[str, tuple[str, Column]]) -> Line:
        """Columns name: (``sum``, ``count`` or ``max``, column) over a frame that starts with the key's first row and ends at or before the current row or its peers."""
        w = frame(self._window())
        inside = {name: getattr(F, kind)(c).over(w) for name, (kind, c) in aggregates.items()}
        if not self.cut:
            self.df = self.df.withColumns(inside)
            return self
        totals = self.df.where("__hot").groupBy(*self.by).agg(*[getattr(F, kind)(c).alias(name) for name, (kind, c) in aggregates.items()])
        before = BEFORE(Window.partitionBy(*self.keys).orderBy("__slice"))
        prefix = totals.select(
            *[F.col(k).alias(f"__p{i}") for i, k in enumerate(self.by)],
            *[(F.max(name) if kind == "max" else F.sum(name)).over(before).alias(f"__p_{name}") for name, (kind, _) in aggregates.items()],
        )
        told = self.df.withColumns(inside)
        joined = told.join(F.broadcast(prefix), _same(told, prefix, [(k, f"__p{i}") for i, k in enumerate(self.by)]), "left")

        def whole(name: str, kind: str) -> Column:
            here, old = F.col(name), F.col(f"__p_{name}")
            return F.greatest(here, old) if kind == "max" else F.coalesce(here + old, here, old)

        self.df = joined.select(*[whole(c, aggregates[c][0]).alias(c) if c in aggregates else told[c] for c in told.columns])
        return self

    def done(self) -> DataFrame:
        return self.df.drop("__slice", "__hot") if self.cut else self.df


def count_before(df: DataFrame, keys: list[str], us: str, hit: Column, width: int, name: str, closed: bool) -> DataFrame:
    """``df`` with the hits of the key in [us - width, us), or with ``closed`` in [us - width, us], by two running counts.

    The count at us less the count before us - width, which rows ask for at
    that place of the key's line. No frame holds the width's rows.
    """
    ends = (lambda w: w.rangeBetween(Window.unboundedPreceding, 0)) if closed else (lambda w: w.rangeBetween(Window.unboundedPreceding, -1))
    here = Line(df, keys, [us]).running(ends, {"__upto": ("count", F.when(hit & F.col(us).isNotNull(), 1))}).done()
    asks = here.select(*keys, (F.col(us) - width).alias("__us"), F.lit(0).alias("__kind"), F.struct(*[F.col(f"`{c}`") for c in here.columns]).alias("__row"))
    events = df.where(hit & F.col(us).isNotNull()).select(*keys, F.col(us).alias("__us"), F.lit(1).alias("__kind"), F.lit(None).cast(asks.schema["__row"].dataType).alias("__row"))
    line = Line(asks.unionByName(events), keys, ["__us", "__kind"]).running(UP_TO, {"__older": ("sum", F.col("__kind"))}).done()
    got = line.where("__kind = 0").select("__row.*", "__older")
    return got.select(*df.columns, F.when(F.col(us).isNotNull(), F.coalesce("__upto", F.lit(0)) - F.coalesce("__older", F.lit(0))).otherwise(0).cast("long").alias(name))
