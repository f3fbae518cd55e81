"""Ordered analytics over rows: the relational forms of the array verbs, as windows.

Every function adds a column to a DataFrame, by a partition and an order that end in a unique key. Windows of one
order share a sort. Nulls and non-numbers follow the verbs' rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _window(partition, order):
    if not partition:
        raise ValueError("name a partition: a window over all rows runs in one task")
    return Window.partitionBy(*partition).orderBy(*order)


def _add(df: DataFrame, name: str, c: Column) -> DataFrame:
    return df.withColumn(name, c)


def cumulative_sum(df, column, *, partition, order, name="cumsum"):
    w = _window(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    return _add(df, name, F.when(F.col(column).isNotNull(), F.sum(column).over(w)))


def difference(df, column, lag=1, *, partition, order, name="diff"):
    return _add(df, name, F.col(column) - F.lag(column, lag).over(_window(partition, order)))


def percent_change(df, column, lag=1, *, partition, order, name="pct_change"):
    before = F.lag(column, lag).over(_window(partition, order))
    return _add(df, name, F.try_divide(F.col(column) - before, before))


def shift(df, column, by=1, fill=None, *, partition, order, name="shift"):
    w = _window(partition, order)
    return _add(df, name, F.lag(column, by, fill).over(w) if by >= 0 else F.lead(column, -by, fill).over(w))


def dense_rank(df, column, *, partition, descending=True, name="rank"):
    """Dense rank of the values, the largest first; null for null."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return _add(df, name, F.when(F.col(column).isNotNull(), F.dense_rank().over(Window.partitionBy(*partition).orderBy(key))))


def fill_forward(df, column, *, partition, order, name="filled"):
    return _add(df, name, F.last(column, True).over(_window(partition, order).rowsBetween(Window.unboundedPreceding, 0)))


def fill_backward(df, column, *, partition, order, name="filled"):
    return _add(df, name, F.first(column, True).over(_window(partition, order).rowsBetween(0, Window.unboundedFollowing)))


def moving_average(df, column, n, *, partition, order, name="moving_avg"):
    return _add(df, name, F.avg(F.coalesce(F.col(column), F.lit(0.0))).over(_window(partition, order).rowsBetween(1 - n, 0)))


def drop_repeats(df, column, *, partition, order):
    """Rows whose value differs from the one before."""
    before = F.lag(F.struct(column)).over(_window(partition, order))
    marked = df.withColumn("__before", before)
    return marked.where(F.col("__before").isNull() | ~F.col(column).eqNullSafe(F.col("__before").getField(column))).drop("__before")


def group_statistics(df, by, column):
    """The statistics verbs over groups: one aggregation, and exact quantiles that need no task for a group."""
    c = F.col(column).cast("double")
    whole = df.groupBy(*by).agg(
        F.count("*").alias("count"), F.coalesce(F.sum(c), F.lit(0.0)).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.stddev_pop(c).alias("std"), F.stddev_samp(c).alias("std_sample"),
        F.var_pop(c).alias("variance"), F.var_samp(c).alias("variance_sample"),
    )
    marks = group_quantiles(df, by, column, {"median": 0.5, "p90": 0.9})
    return _beside(whole, marks, by)


def _beside(left, right, by):
    """A left join on ``by``, in which null keys meet."""
    keys = [f"__by{i}" for i in range(len(by))]
    right = right.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[c for c in right.columns if c not in by])
    test = F.lit(True)
    for b, k in zip(by, keys, strict=True):
        test = test & F.col(b).eqNullSafe(F.col(k))
    return left.join(right, test, "left").drop(*keys)


def group_quantiles(df, by, column, shares: dict, *, parts=None):
    """Exact quantiles of each group, interpolated between neighbours: a column for each name in ``shares``.

    Equal values are counted first. The counts are dealt to ranges of (group, value), so a group may span many tasks; the
    sums of the ranges give each its offset, and the values at the wanted ranks are picked within the ranges.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(column).cast("double").alias("__v")
    counts = cut(df.where(F.col(column).isNotNull()).groupBy(*by, v).agg(F.count("*").alias("__n")))
    # The ranges come from a sample, so they are fixed as a table before they are read twice.
    ranged = cut(counts.repartitionByRange(n, *by, "__v").withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__m"))
    own = Window.partitionBy(*by)
    before = own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__offset"), F.sum("__m").over(own).alias("__all"))
    placed = _beside(ranged, sums, [*by, "__range"])
    up = F.col("__offset") + F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("__up", up)

    def at(rank):
        return F.max(F.when((F.col("__up") > rank) & (F.col("__up") - F.col("__n") <= rank), F.col("__v")))

    out = []
    for name, share in shares.items():
        place = (F.col("__all") - 1) * F.lit(float(share))
        out += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}"), F.max(place - F.floor(place)).alias(f"__part_{name}")]
    found = placed.groupBy(*by).agg(*out)
    between = lambda m: F.col(f"__lo_{m}") + (F.col(f"__hi_{m}") - F.col(f"__lo_{m}")) * F.col(f"__part_{m}")
    return found.select(*by, *[between(m).alias(m) for m in shares])


def group_mode(df, by, column, order):
    """The most frequent value of each group; of equal counts the one that comes first in ``order``."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    best = counts.groupBy(*by).agg(F.max_by(column, F.struct("__n", -F.col("__first"))).alias("mode"))
    return best


def weighted_average(df, by, value, weight):
    v, w = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (value, weight))
    return df.groupBy(*by).agg(F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted_avg"))


def lookup_join(df, table, keys: dict, value: str, *, order: str, default=None):
    """Left join to the first row (by ``order``) of each key; ``default`` only where no row matches.

    Spark broadcasts the table if its measured size allows it, and splits hot keys otherwise.
    """
    first = table.groupBy(*keys.values()).agg(F.min_by(F.struct(F.col(value).alias("v")), order).alias("__hit"))
    first = first.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys.values())], "__hit")
    test = None
    for i, c in enumerate(keys):
        one = df[c].cast("string") == F.col(f"__k{i}").cast("string")
        test = one if test is None else test & one
    out = df.join(first, test, "left")
    return out.withColumn(value, F.when(F.col("__hit").isNull(), F.lit(default)).otherwise(F.col("__hit.v"))).drop("__hit", *[f"__k{i}" for i in range(len(keys))])


def top_k(df, by, order, k):
    """The first ``k`` rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def running_over_all(df, column, *, order, total="running", place="place", parts=None):
    """Running sum and row number over all rows, without one task for all: a two-level prefix sum.

    Rows are dealt to ranges of the order; a table of one row per range gives each its offsets, and a window runs
    within each range. ``order`` ends in a unique key.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The ranges come from a sample, so they are fixed as a table before they are read twice.
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.coalesce(F.sum(column), F.lit(0)).alias("__sum"), F.count("*").alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__sum"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows"))
    # One row per range: as many as the named number of partitions.
    joined = ranged.join(F.broadcast(offsets), "__range")
    w = Window.partitionBy("__range").orderBy(*order)
    running = F.coalesce(F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return joined.withColumns({total: F.col("__sum") + running, place: F.col("__rows") + F.row_number().over(w)}).drop("__range", "__sum", "__rows")
