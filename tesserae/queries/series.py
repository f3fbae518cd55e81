"""Queries of ordered analytics, group statistics and lookups over rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from .mappings import read

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


KEYS = {"partition": ["user_id"], "order": ["ts", "event_id"]}
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumsum, round(value - lag(value) OVER w, 4) AS diff,
    round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 4) AS pct_change, lag(value, 2, 0) OVER w AS shifted, lead(value, 1, -1) OVER w AS led,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 4) AS moving_avg FROM events {_W}""")
def series_windows(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    df = S.cumulative_sum(df, "value", **KEYS)
    df = S.difference(df, "value", **KEYS)
    df = S.percent_change(df, "value", **KEYS)
    df = S.shift(df, "value", 2, 0.0, name="shifted", **KEYS)
    df = S.shift(df, "value", -1, -1.0, name="led", **KEYS)
    df = S.moving_average(df, "value", 3, **KEYS)
    return df.select("event_id", *[F.round(c, 4).alias(c) for c in ("cumsum", "diff", "pct_change")], "shifted", "led", F.round("moving_avg", 4).alias("moving_avg"))


@query("""SELECT event_id, CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST) END AS rank,
    last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS forward,
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward
    FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)""")
def series_rank_fill(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    df = S.dense_rank(df, "v", partition=["user_id"])
    df = S.fill_forward(df, "v", name="forward", **KEYS)
    return S.fill_backward(df, "v", name="backward", **KEYS).select("event_id", F.col("rank").cast("long").alias("rank"), "forward", "backward")


@query("""SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 OR b IS DISTINCT FROM event_type""")
def series_dedupe(spark, sf_dir):
    return S.drop_repeats(read(spark, sf_dir, "events"), "event_type", **KEYS).select("event_id", "event_type")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_extendedprice), 2) AS sum, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS avg, round(stddev_pop(l_extendedprice), 4) AS std,
    round(stddev_samp(l_extendedprice), 4) AS std_sample, round(var_pop(l_extendedprice) / 1e6, 4) AS variance, round(var_samp(l_extendedprice) / 1e6, 4) AS variance_sample, round(median(l_extendedprice), 4) AS median,
    round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY ALL""")
def group_statistics(spark, sf_dir):
    df = S.group_statistics(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    scale = {"sum": 2, "avg": 4, "std": 4, "std_sample": 4, "median": 4, "p90": 4}
    wide = [F.round(F.col(c) / 1e6, 4).alias(c) for c in ("variance", "variance_sample")]
    return df.select("l_returnflag", "l_linestatus", "count", "min", "max", *[F.round(c, n).alias(c) for c, n in scale.items()], *wide)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), m AS (SELECT user_id, arg_max(event_type, n * 1000000000 - f) AS mode FROM c GROUP BY user_id),
    w AS (SELECT user_id, round(sum(value * (event_id % 5)) / nullif(sum(event_id % 5), 0), 4) AS weighted_avg FROM events GROUP BY user_id) SELECT * FROM m JOIN w USING (user_id)""")
def group_mode_weighted(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 5)
    w = S.weighted_average(df, ["user_id"], "value", "w").withColumn("weighted_avg", F.round("weighted_avg", 4))
    return S.group_mode(df, ["user_id"], "event_type", "event_id").join(w, "user_id")


@query("SELECT c_custkey, coalesce(n_name, 'nowhere') AS n_name FROM customer LEFT JOIN nation ON c_nationkey + 1 = n_nationkey")
def lookup_join(spark, sf_dir):
    """The nation after the customer's own; the last has none after it and gets the default."""
    customer = read(spark, sf_dir, "customer").withColumn("next", F.col("c_nationkey") + 1)
    return S.lookup_join(customer, read(spark, sf_dir, "nation"), {"next": "n_nationkey"}, "n_name", order="n_nationkey", default="nowhere").select("c_custkey", "n_name")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k(spark, sf_dir):
    return S.top_k(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS running, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def series_running_over_all(spark, sf_dir):
    return S.running_over_all(read(spark, sf_dir, "events"), "value", order=["ts", "event_id"]).select("event_id", F.round("running", 3).alias("running"), "place")
