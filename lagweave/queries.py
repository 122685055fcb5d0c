"""Registered queries over the sample tables, each with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators import density, filters, graph, prepare, simulate
from lagweave.plans.network import Network, estimate_parents, history, independence, information_of, long_measures, network_of, shares
from lagweave.sources import series
from lagweave.streaming.windows import window_information

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K = 5

# A published lagged causal graph of six stream-chemistry variables, (parent variable, lag) by variable.
CHEM6 = {
    0: [(0, -1), (0, -3), (0, -4), (0, -5), (1, -1)],
    1: [(0, -1), (1, -1), (1, -2), (1, -4), (4, -1)],
    2: [(0, -1), (1, -2), (2, -1), (3, -1), (5, -3)],
    3: [(3, -1), (3, -3), (3, -4), (4, -3), (5, -2)],
    4: [(1, -1), (4, -1), (4, -3)],
    5: [(5, -1)],
}
#: Every variable depends on all three, one step back.
FULL3 = {v: [(0, -1), (1, -1), (2, -1)] for v in range(3)}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


HOURLY = "h AS (SELECT datediff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS t, avg(value) AS x FROM events GROUP BY 1)"
DAILY = (
    "d AS (SELECT CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t, sum(l_quantity) AS x0, avg(l_extendedprice) AS x1, "
    "avg(l_discount) AS x2 FROM lineitem GROUP BY 1)"
)
N_DAILY = (
    DAILY + ", n AS (SELECT row_number() OVER (ORDER BY t) - 1 AS t, (x0 - avg(x0) OVER ()) / stddev_pop(x0) OVER () AS x0, "
    "(x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS x1, (x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER () AS x2 FROM d)"
)
PSI = "psi AS (SELECT n, -0.5772156649015329 + coalesce(sum(1.0 / nullif(n - 1, 0)) OVER (ORDER BY n), 0) AS v FROM (SELECT unnest(range(1, 4001)) AS n))"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipments, numbered from 0 and normalised."""
    return prepare.normalize(series.indexed(series.daily_shipments(spark, sf_dir)), ["x0", "x1", "x2"])


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or [c for c, t in df.dtypes if t == "double"]})


def knn_sql(source: str, spaces: dict[str, list[str]], joint: list[str], result: str, k: int = K, floor: bool = False) -> str:
    """Neighbour counts per subspace (name: columns) as psi averages m_<name>, psi of N and k, mean log radius; result is a SELECT list.

    Radii of 0 are 1e-14; with `floor` so are all smaller ones, as equal values may differ by rounding.
    """

    def dist(cols):
        parts = ", ".join(f"abs(a.{c} - b.{c})" for c in cols)
        return f"greatest({parts})" if len(cols) > 1 else parts

    counts = ", ".join(f"count(*) FILTER ({dist(c)} < r.r * (1 - 1e-10)) AS k_{n}" for n, c in spaces.items())
    kth = f"min({dist(joint)}, {k + 1})[{k + 1}]"
    radius = f"greatest({kth}, 1e-14::DOUBLE)" if floor else f"CASE WHEN {kth} = 0 THEN 1e-14 ELSE {kth} END"
    means = ", ".join(f"(SELECT avg(v) FROM c JOIN psi ON psi.n = c.k_{n}) AS m_{n}" for n in spaces)
    return (
        f"WITH {source}, r AS MATERIALIZED (SELECT a.id, {radius} AS r "
        f"FROM p a, p b GROUP BY a.id), c AS MATERIALIZED (SELECT a.id, {counts} FROM p a JOIN r ON r.id = a.id, p b GROUP BY a.id), {PSI}, "
        f"m AS (SELECT {means}, (SELECT v FROM psi WHERE n = (SELECT count(*) FROM p)) AS psi_n, (SELECT v FROM psi WHERE n = {k}) AS psi_k, "
        f"(SELECT avg(ln(r)) FROM r) AS lr) SELECT {result} FROM m"
    )


LAG_POINTS = HOURLY + ", p AS MATERIALIZED (SELECT a.t AS id, a.x AS x, b.x AS y FROM h a JOIN h b ON b.t = a.t - 1)"


@query(knn_sql(LAG_POINTS, {"x": ["x"], "y": ["y"]}, ["x", "y"], "round(psi_n + psi_k - m_x - m_y, 6) AS mi"))
def knn_mi_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = prepare.drop_missing(prepare.align(series.hourly_events(spark, sf_dir), [("x", 0), ("x", -1)]))

    return _round(information_of(aligned, {"x": ["c0"], "y": ["c1"]}, ["ixy"], k=K).withColumnRenamed("ixy", "mi"), "mi")


def _measures(df: DataFrame, blocks: dict[str, list[str]], names: list[str], approach: str = "knn", **kw) -> DataFrame:
    return _round(information_of(df, blocks, names, approach, K, **kw))


DAILY_POINTS = N_DAILY + ", p AS MATERIALIZED (SELECT t AS id, x0 AS x, x1 AS y, x2 AS z FROM n)"


@query(knn_sql(DAILY_POINTS, {"x": ["x"], "y": ["y"]}, ["x", "y"],
               "round(psi_n - m_x + lr, 6) AS hx, round(psi_n - m_y + lr, 6) AS hy, round(psi_n - psi_k + 2 * lr, 6) AS hxy, round(psi_n + psi_k - m_x - m_y, 6) AS ixy"))
def info_2d_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(_daily(spark, sf_dir), {"x": ["x0"], "y": ["x1"]}, ["hx", "hy", "hxy", "ixy"])


@query(knn_sql(DAILY_POINTS, {"x": ["x"]}, ["x"], "round(psi_n - psi_k + lr, 6) AS hx"))
def info_1d_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(_daily(spark, sf_dir), {"x": ["x0"]}, ["hx"])


@query(knn_sql(DAILY_POINTS, {"xw": ["x", "z"], "yw": ["y", "z"], "w": ["z"]}, ["x", "y", "z"], "round(m_w + psi_k - m_xw - m_yw, 6) AS ixy_w"))
def info_2d_conditioned_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(_daily(spark, sf_dir), {"x": ["x0"], "y": ["x1"], "w": ["x2"]}, ["ixy_w"])


PID_SPACES = {"x": ["x"], "y": ["y"], "z": ["z"], "xy": ["x", "y"], "xz": ["x", "z"], "yz": ["y", "z"]}
PID_SQL = knn_sql(DAILY_POINTS, PID_SPACES, ["x", "y", "z"], "psi_n, psi_k, lr, " + ", ".join(f"m_{s}" for s in PID_SPACES))


@query(
    f"WITH q AS ({PID_SQL}), e AS (SELECT psi_n - m_x + lr AS hx, psi_n - m_y + lr AS hy, psi_n - m_z + lr AS hz, psi_n - m_xy + 2 * lr AS hxy, psi_n - m_xz + 2 * lr AS hxz, "
    "psi_n - m_yz + 2 * lr AS hyz, psi_n - psi_k + 3 * lr AS hxyz FROM q), i AS (SELECT *, hx + hy - hxy AS ixy, hx + hz - hxz AS ixz, hy + hz - hyz AS iyz, hxy + hz - hxyz AS ixyz FROM e), "
    "j AS (SELECT *, ixyz - ixz - iyz AS ii, least(ixz, iyz) AS rmmi, ixy / least(hx, hy) AS isource FROM i), k AS (SELECT *, CASE WHEN ii < 0 THEN -ii ELSE 0 END AS rmin FROM j), "
    "l AS (SELECT *, rmin + isource * (rmmi - rmin) AS r FROM k) SELECT round(ixyz, 6) AS ixyz, round(ii, 6) AS ii, round(r, 6) AS r, round(r + ii, 6) AS s, round(ixz - r, 6) AS uxz, round(iyz - r, 6) AS uyz FROM l"
)
def info_3d_pid_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(_daily(spark, sf_dir), {"x": ["x0"], "y": ["x1"], "z": ["x2"]}, ["ixyz", "ii", "r", "s", "uxz", "uyz"])


CONDITIONED = N_DAILY + ", p AS MATERIALIZED (SELECT a.t AS id, b.x1 AS x, b.x2 AS y, a.x0 AS z, b.x0 AS w FROM n a JOIN n b ON b.t = a.t - 1)"
CONDITIONED_SPACES = {"w": ["w"], "xw": ["x", "w"], "yw": ["y", "w"], "zw": ["z", "w"], "xyw": ["x", "y", "w"], "xzw": ["x", "z", "w"], "yzw": ["y", "z", "w"]}


@query(
    f"WITH q AS ({knn_sql(CONDITIONED, CONDITIONED_SPACES, ['x', 'y', 'z', 'w'], 'psi_n, psi_k, lr, ' + ', '.join(f'm_{s}' for s in CONDITIONED_SPACES))}), "
    "e AS (SELECT psi_n - m_w + lr AS hw, psi_n - m_xw + 2 * lr AS hx, psi_n - m_yw + 2 * lr AS hy, psi_n - m_zw + 2 * lr AS hz, psi_n - m_xyw + 3 * lr AS hxy, psi_n - m_xzw + 3 * lr AS hxz, "
    "psi_n - m_yzw + 3 * lr AS hyz, psi_n - psi_k + 4 * lr AS hxyz FROM q), i AS (SELECT *, hx + hy - hw - hxy AS ixy, hx + hz - hw - hxz AS ixz, hy + hz - hw - hyz AS iyz, hxy + hz - hw - hxyz AS ixyz FROM e), "
    "j AS (SELECT *, ixyz - ixz - iyz AS ii, least(ixz, iyz) AS rmmi, ixy / least(hx - hw, hy - hw) AS isource FROM i), k AS (SELECT *, CASE WHEN ii < 0 THEN -ii ELSE 0 END AS rmin FROM j), "
    "l AS (SELECT *, rmin + isource * (rmmi - rmin) AS r FROM k) SELECT round(ixyz, 6) AS ixyz, round(ii, 6) AS ii, round(r, 6) AS r, round(r + ii, 6) AS s, round(ixz - r, 6) AS uxz, round(iyz - r, 6) AS uyz FROM l"
)
def info_3d_conditioned_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = prepare.align(_daily(spark, sf_dir), [("x0", 0), ("x1", -1), ("x2", -1), ("x0", -1)])
    return _measures(aligned, {"x": ["c1"], "y": ["c2"], "z": ["c0"], "w": ["c3"]}, ["ixyz", "ii", "r", "s", "uxz", "uyz"])


@query(f"WITH {HOURLY} SELECT a.t, round(a.x, 6) AS c0, round(b.x, 6) AS c1, round(c.x, 6) AS c2 FROM (SELECT t - 2 AS t, x FROM h) a JOIN (SELECT t - 1 AS t, x FROM h) b USING (t) JOIN h c USING (t)")
def align_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prepare.align(series.hourly_events(spark, sf_dir), [("x", 0), ("x", -1), ("x", -2)]))


TYPES = "y AS (SELECT event_type AS e, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))"
BY_TYPE = (
    TYPES + ", b AS (SELECT datediff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS t, "
    + ", ".join(f"avg(value) FILTER (i = {i}) AS x{i}" for i in range(5)) + " FROM events JOIN y ON e = event_type GROUP BY 1)"
)


@query(f"WITH {BY_TYPE} SELECT t, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x3, 6) AS x3, round(x4, 6) AS x4 FROM b WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL")
def drop_missing_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prepare.drop_missing(series.hourly_events(spark, sf_dir, by_type=True)))


@query(f"WITH {N_DAILY} SELECT t, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM n")
def normalize_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_daily(spark, sf_dir))


@query(
    f"WITH {BY_TYPE}, s AS (SELECT t, x0, last_value(CASE WHEN x0 IS NOT NULL THEN t END IGNORE NULLS) OVER w AS ta, last_value(x0 IGNORE NULLS) OVER w AS va, "
    "first_value(CASE WHEN x0 IS NOT NULL THEN t END IGNORE NULLS) OVER v AS tb, first_value(x0 IGNORE NULLS) OVER v AS vb FROM b "
    "WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT t, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) AS x0 FROM s"
)
def interpolate_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prepare.interpolate(series.hourly_events(spark, sf_dir, by_type=True).select("t", "x0"), ["x0"]))


@query(f"WITH {DAILY}, i AS (SELECT row_number() OVER (ORDER BY t) - 1 AS t, x0 FROM d) SELECT t // 7 AS t, round(sum(x0), 6) AS x0 FROM i GROUP BY 1 HAVING count(*) = 7")
def aggregate_weekly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prepare.aggregate(series.indexed(series.daily_shipments(spark, sf_dir)).select("t", "x0"), ["x0"], 7))


@query(f"WITH {DAILY}, i AS (SELECT row_number() OVER (ORDER BY t) - 1 AS t, x1 FROM d) SELECT t // 7 AS t, round(avg(x1), 6) AS x1 FROM i GROUP BY 1 HAVING count(*) = 7")
def aggregate_weekly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prepare.aggregate(series.indexed(series.daily_shipments(spark, sf_dir)).select("t", "x1"), ["x1"], 7, "average"))


@query(f"WITH {N_DAILY}, l AS (SELECT CAST(unnest([-3, -1, 0, 1, 2, 5]) AS INTEGER) AS lag) SELECT lag, round(corr(a.x0, b.x1), 6) AS r FROM l, n a JOIN n b ON b.t = a.t + lag GROUP BY lag")
def lagged_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(prepare.lagged_correlations(_daily(spark, sf_dir), "x0", "x1", [-3, -1, 0, 1, 2, 5]))


@query()
def butterworth_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.butter_filter(_daily(spark, sf_dir).withColumn("series_id", F.lit("daily")), ["x0", "x1", "x2"], 3, 1.0, 0.1)


@query("WITH e AS (SELECT CAST(max(date_trunc('hour', ts)) AS TIMESTAMP) AS z, CAST(min(date_trunc('hour', ts)) AS TIMESTAMP) AS a FROM events), s AS (SELECT unnest(generate_series(a, z, INTERVAL 7 HOURS)) AS ts FROM e), v AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS x FROM events GROUP BY 1) SELECT epoch(s.ts)::BIGINT AS at, round(x, 6) AS x FROM s LEFT JOIN v ON v.ts = s.ts")
def calendar_7_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("x"))
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("long").alias("at")
    return series.regular(hourly, "ts", "7 HOURS").select(at, F.round("x", 6).alias("x"))


@query(
    "SELECT unnest(['hx', 'hy', 'hxy', 'ixy']) AS measure, round(unnest([hx, hy, hxy, ixy]), 6) AS value FROM ("
    + knn_sql(DAILY_POINTS, {"x": ["x"], "y": ["z"]}, ["x", "z"], "psi_n - m_x + lr AS hx, psi_n - m_y + lr AS hy, psi_n - psi_k + 2 * lr AS hxy, psi_n + psi_k - m_x - m_y AS ixy", floor=True) + ")"
)
def measures_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(long_measures(information_of(_daily(spark, sf_dir), {"x": ["x0"], "y": ["x2"]}, ["hx", "hy", "hxy", "ixy"], k=K)))


@query(
    "SELECT round(ixy / hxy, 6) AS ixy, round(hx / hxy, 6) AS hx FROM ("
    + knn_sql(DAILY_POINTS, {"x": ["x"], "y": ["y"]}, ["x", "y"], "psi_n - m_x + lr AS hx, psi_n - psi_k + 2 * lr AS hxy, psi_n + psi_k - m_x - m_y AS ixy") + ")"
)
def measures_as_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(shares(information_of(_daily(spark, sf_dir), {"x": ["x0"], "y": ["x1"]}, ["ixy", "hx", "hxy"], k=K), "hxy"))


DECIMAL = (
    "y AS (SELECT DISTINCT year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.0::DOUBLE * 0.99 AS y FROM orders), "
    "h AS (SELECT y, CAST(floor(y) AS INTEGER) AS w, (y - floor(y)) * CASE WHEN (floor(y) % 4 = 0 AND floor(y) % 100 <> 0) OR floor(y) % 400 = 0 THEN 8784 ELSE 8760 END AS n FROM y)"
)


@query(
    f"WITH {DECIMAL} SELECT round(y, 6) AS y, CAST(make_timestamp(w, 1, 1, 0, 0, 0) + to_hours(CAST(round(n) AS BIGINT)) AS VARCHAR) AS by_hour, "
    "CAST(make_timestamp(w, 1, 1, 0, 0, 0) + to_hours(168 * CAST(round(n / 168) AS BIGINT)) AS VARCHAR) AS by_week FROM h"
)
def decimal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.year("o_orderdate") + (F.dayofyear("o_orderdate") - 1) / F.lit(365.0) * 0.99).alias("y")).distinct()
    y = F.col("y")
    return dates.select(F.round(y, 6).alias("y"), series.decimal_year(y).cast("string").alias("by_hour"), series.decimal_year(y, "weeks").cast("string").alias("by_week"))


@query("SELECT DISTINCT l_orderkey % 400 AS i, CAST(((l_orderkey % 400) * 0.25 + 738000 - 719529) * 86400000000 AS BIGINT) AS micros FROM lineitem")
def day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 400).alias("i")).distinct()
    return i.select("i", F.unix_micros(series.datenum(F.col("i") * 0.25 + 738000)).alias("micros"))


@query("SELECT DISTINCT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS at, strftime(ts, '%-m/%-d/%y %-H:%M') AS text FROM events")
def parsed_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format(F.col("ts"), "M/d/yy H:mm")
    texts = spark.read.parquet(f"{sf_dir}/events.parquet").select(text.alias("text")).distinct()
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', at)")
    return texts.select("text", series.month_day_time(F.col("text")).cast("timestamp_ntz").alias("at")).select("text", seconds.cast("long").alias("at"))


@query("SELECT event_id, CAST(epoch(date_trunc('minute', ts + INTERVAL 1 SECOND)) AS BIGINT) AS at FROM events")
def minutes_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", series.minute_rounded(F.col("ts")).cast("timestamp_ntz").alias("at"))
    return events.select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', at)").cast("long").alias("at"))


@query(f"WITH {N_DAILY} SELECT t, round(CASE WHEN x2 <= 1 THEN x0 END, 6) AS value, x2 > 1 AS masked, round(CASE WHEN x2 > 1 THEN x0 END, 6) AS grey FROM n")
def masked_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(filters.masked_series(_daily(spark, sf_dir), "x0", F.col("x2") > 1, keep=True))


# Densities


def _all_pairs_sql(kernel: str, before: str = "") -> str:
    """t, p: mean over all points b of an expression in a, b and hh."""
    return f"WITH {N_DAILY}, {before} q AS (SELECT a.t, avg({kernel}) AS p FROM n a, n b, hh GROUP BY a.t) SELECT t, round(p, 6) AS p FROM q"


def _epanechnikov(a: str, h: str) -> str:
    return f"CASE WHEN abs((a.{a} - b.{a}) / {h}) < 1 THEN 0.75 * (1 - pow((a.{a} - b.{a}) / {h}, 2)) ELSE 0 END / {h}"


SCOTT = "hh AS (SELECT pow(count(*), -1.0 / 6) * stddev_samp(x0) AS h0, pow(count(*), -1.0 / 6) * stddev_samp(x1) AS h1 FROM n),"


@query(_all_pairs_sql(f"({_epanechnikov('x0', 'h0')}) * ({_epanechnikov('x1', 'h1')})", SCOTT))
def kde_epanechnikov_scott(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.density(_daily(spark, sf_dir), ["x0", "x1"], "scott", "epanechnikov"))


@query(_all_pairs_sql("exp(-(pow((a.x0 - b.x0) / h, 2) + pow((a.x2 - b.x2) / h, 2)) / 2) / (2 * pi()) / h / h", "hh AS (SELECT 0.3::DOUBLE AS h),"))
def kde_one_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.density(_daily(spark, sf_dir), ["x0", "x2"], bandwidth=0.3))


# H = f^2 times the sample covariance, f = n^(-1/6) for both rules in two dimensions; q = u' H^-1 u.
FULL_H = (
    "c AS (SELECT pow(count(*), -1.0 / 3) * var_samp(x0) AS s, pow(count(*), -1.0 / 3) * var_samp(x1) AS r, pow(count(*), -1.0 / 3) * covar_samp(x0, x1) AS m FROM n), "
    "hh AS (SELECT s, r, m, s * r - m * m AS det FROM c),"
)
FULL_Q = "((r * pow(a.x0 - b.x0, 2) - 2 * m * (a.x0 - b.x0) * (a.x1 - b.x1) + s * pow(a.x1 - b.x1, 2)) / det)"


@query(_all_pairs_sql(f"exp(-{FULL_Q} / 2) / (2 * pi()) / sqrt(det)", FULL_H))
def kde_full_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.general_density(_daily(spark, sf_dir), ["x0", "x1"]))


@query(_all_pairs_sql(f"CASE WHEN {FULL_Q} <= 1 THEN 2 / pi() * (1 - {FULL_Q}) ELSE 0 END / sqrt(det)", FULL_H))
def kde_full_epanechnikov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.general_density(_daily(spark, sf_dir), ["x0", "x1"], name="epanechnikov"))


@query(_all_pairs_sql(f"CASE WHEN {FULL_Q} <= 1 THEN 3 / pi() * pow(1 - {FULL_Q}, 2) ELSE 0 END / sqrt(det)", FULL_H))
def kde_full_quartic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.general_density(_daily(spark, sf_dir), ["x0", "x1"], name="quartic"))


def _kde_ctes(cols: list[str]) -> str:
    """q: density p at every t of n."""
    d = len(cols)
    dev = "stddev_samp" if d > 1 else "stddev_pop"
    hs = ", ".join(f"pow(4.0 / {d + 2}, 1.0 / {d + 4}) * pow(count(*), -1.0 / {d + 4}) * {dev}({c}) AS h{i}" for i, c in enumerate(cols))
    ker = " * ".join(f"exp(-pow((a.{c} - b.{c}) / h{i}, 2) / 2) / sqrt(2 * pi()) / h{i}" for i, c in enumerate(cols))
    return f"hh AS (SELECT {hs} FROM n), q AS (SELECT a.t, avg({ker}) AS p FROM n a, n b, hh GROUP BY a.t)"


def _kde_sql(cols: list[str], result: str) -> str:
    return f"WITH {N_DAILY}, {_kde_ctes(cols)} SELECT {result} FROM q"


@query(_kde_sql(["x0", "x1"], "t, round(p, 6) AS p"))
def kde_density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.density(_daily(spark, sf_dir), ["x0", "x1"]))


@query(_kde_sql(["x0"], "round(-avg(ln(p)), 6) AS h"))
def kde_entropy_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.entropy_of(density.density(_daily(spark, sf_dir), ["x0"])))


def _kde_sets(sets: dict[str, list[str]], result: str) -> str:
    """SQL of a SELECT over p: densities p_<name> at every t, one per set of columns."""
    each = [f"q_{s} AS MATERIALIZED (WITH {_kde_ctes(cols)} SELECT t, p AS p_{s} FROM q)" for s, cols in sets.items()]
    joined = " JOIN ".join(f"q_{s}" + (" USING (t)" if i else "") for i, s in enumerate(sets))
    return f"WITH {N_DAILY}, {', '.join(each)} SELECT {result} FROM {joined}"


@query(_kde_sets({"xyw": ["x0", "x1", "x2"], "xw": ["x0", "x2"], "yw": ["x1", "x2"], "w": ["x2"]},
                 "round(sum(CASE WHEN p_xyw * p_w / (p_xw * p_yw) > 0 THEN p_xyw * ln(p_xyw * p_w / (p_xw * p_yw)) ELSE 0 END) / sum(p_xyw), 6) AS i"))
def kde_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.weighted_information(_daily(spark, sf_dir), ["x0"], ["x1"], ["x2"]))


@query(
    "WITH e AS (" + _kde_sets({"x": ["x0"], "y": ["x1"], "z": ["x2"], "xy": ["x0", "x1"], "xz": ["x0", "x2"], "yz": ["x1", "x2"], "xyz": ["x0", "x1", "x2"]},
                              ", ".join(f"-avg(ln(p_{s})) AS h{s}" for s in ("x", "y", "z", "xy", "xz", "yz", "xyz")))
    + "), i AS (SELECT *, hx + hy - hxy AS ixy, hx + hz - hxz AS ixz, hy + hz - hyz AS iyz, hxy + hz - hxyz AS ixyz FROM e), "
    "j AS (SELECT *, ixyz - ixz - iyz AS ii, least(ixz, iyz) AS rmmi, ixy / least(hx, hy) AS isource FROM i), k AS (SELECT *, CASE WHEN ii < 0 THEN -ii ELSE 0 END AS rmin FROM j), "
    "l AS (SELECT *, rmin + isource * (rmmi - rmin) AS r FROM k) SELECT round(ixyz, 6) AS ixyz, round(ii, 6) AS ii, round(r, 6) AS r, round(r + ii, 6) AS s, round(ixz - r, 6) AS uxz, round(iyz - r, 6) AS uyz FROM l"
)
def info_3d_pid_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(_daily(spark, sf_dir), {"x": ["x0"], "y": ["x1"], "z": ["x2"]}, ["ixyz", "ii", "r", "s", "uxz", "uyz"], "kde")


BINS = f"WITH {DAILY}, e AS (SELECT min(x0) a0, max(x0) z0, min(x1) a1, max(x1) z1 FROM d), g AS (SELECT CAST(least(10, floor((x0 - a0) / (z0 - a0) * 10) + 1) AS INTEGER) AS b_x0, CAST(least(10, floor((x1 - a1) / (z1 - a1) * 10) + 1) AS INTEGER) AS b_x1 FROM d, e), c AS (SELECT b_x0, b_x1, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM g GROUP BY 1, 2)"


@query(f"{BINS} SELECT b_x0, b_x1, n, round(p, 6) AS p FROM c")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.histogram(series.daily_shipments(spark, sf_dir), ["x0", "x1"], 10))


@query(f"{BINS}, x AS (SELECT b_x0, sum(p) p FROM c GROUP BY 1), y AS (SELECT b_x1, sum(p) p FROM c GROUP BY 1), h AS (SELECT (SELECT -sum(p * ln(p)) FROM x) hx, (SELECT -sum(p * ln(p)) FROM y) hy, (SELECT -sum(p * ln(p)) FROM c) hxy) SELECT round(hx, 6) AS hx, round(hy, 6) AS hy, round(hxy, 6) AS hxy, round(hxy - hx, 6) AS hy_x, round(hx + hy - hxy, 6) AS ixy FROM h")
def histogram_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.table_information(density.histogram(series.daily_shipments(spark, sf_dir), ["x0", "x1"], 10), "b_x0", "b_x1"))


@query('SELECT \'l_discount\' AS "column", round(avg(CASE WHEN l_discount <> 0 THEN 1.0 ELSE 0.0 END), 6) AS nonzero, avg(CASE WHEN l_discount <> 0 THEN 1.0 ELSE 0.0 END) < 0.9 AS atom FROM lineitem')
def atom_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(density.atoms(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_discount"]))


@query()
def grid_density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(key, pdf):
        import pandas as pd

        (x, y), p = density.grid_density(pdf[["x0", "x2"]].to_numpy(), [12, 12])
        return pd.DataFrame({"x": np.repeat(x, len(y)), "y": np.tile(y, len(x)), "p": p.ravel()})

    return series.daily_shipments(spark, sf_dir).groupBy().applyInPandas(run, "x double, y double, p double")


# Graphs

EDGES = "e(dst, src, lag) AS (VALUES " + ", ".join(f"({d}, {s}, {lag})" for d, ps in CHEM6.items() for s, lag in ps) + ")"
DAG = f"{EDGES}, g AS (SELECT CAST(src + 6 * (k - lag) AS INTEGER) AS src_node, CAST(dst + 6 * k AS INTEGER) AS dst_node FROM e, (SELECT unnest(range(0, 13)) AS k) WHERE k - lag <= 12)"


@query(f"WITH {DAG} SELECT src_node, dst_node FROM g")
def unrolled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dag(graph.edge_table(spark, CHEM6), 6, 12)


@query(f"WITH RECURSIVE {DAG}, up(node) AS (SELECT src_node FROM g WHERE dst_node = 4 UNION SELECT src_node FROM g JOIN up ON dst_node = node) SELECT node FROM up")
def graph_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(graph.dag(graph.edge_table(spark, CHEM6), 6, 12), 4)


def _nodes(spark: SparkSession, nodes) -> DataFrame:
    return spark.createDataFrame([(int(v), int(lag)) for v, lag in nodes], "var int, lag int")


REACH = (
    f"WITH RECURSIVE {DAG}, up(node) AS (SELECT 4 UNION SELECT src_node FROM g JOIN up ON dst_node = node), down(node) AS (SELECT unnest([30, 31, 32, 33, 34, 35]) UNION SELECT dst_node FROM g JOIN down ON src_node = node), "
    "c AS (SELECT node FROM up WHERE node <> 4 INTERSECT SELECT node FROM down), w AS (SELECT src_node AS node FROM g WHERE dst_node = 4 AND src_node NOT IN (SELECT node FROM c) UNION SELECT src_node FROM g WHERE dst_node IN (SELECT node FROM c) AND src_node NOT IN (SELECT node FROM c)) "
)


@query(REACH + "SELECT CAST(node % 6 AS INTEGER) AS var, CAST(-(node // 6) AS INTEGER) AS lag FROM w")
def distant_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _, _ = graph.CausalGraph(CHEM6, taumax=12).cit_components([(v, -5) for v in range(6)], (4, 0))
    return _nodes(spark, w)


@query(REACH + "SELECT CAST(node % 6 AS INTEGER) AS var, CAST(-(node // 6) AS INTEGER) AS lag FROM c WHERE node IN (SELECT src_node FROM g WHERE dst_node = 4)")
def immediate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ptc, _ = graph.CausalGraph(CHEM6, taumax=12).cit_components([(v, -5) for v in range(6)], (4, 0))
    return _nodes(spark, ptc)


@query(f"WITH {EDGES} SELECT src AS var, lag - 2 AS lag FROM e WHERE dst = 1 UNION SELECT src, lag FROM e WHERE dst = 4 AND NOT (src = 1 AND lag = -2)")
def mit_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, graph.CausalGraph(CHEM6, taumax=12).mit_condition((1, -2), (4, 0)))


def _between_sql(name: str, source: int) -> str:
    """CTE `name`: nodes on directed paths from node `source` to node 4 of g, the latter left out."""
    return (
        f"u_{name}(node) AS (SELECT 4 UNION SELECT src_node FROM g JOIN u_{name} ON dst_node = node), d_{name}(node) AS (SELECT {source} UNION SELECT dst_node FROM g JOIN d_{name} ON src_node = node), "
        f"{name} AS (SELECT node FROM u_{name} WHERE node <> 4 INTERSECT SELECT node FROM d_{name})"
    )


@query(
    f"WITH RECURSIVE {DAG}, {_between_sql('a', 12)}, {_between_sql('b', 19)}, w AS (SELECT src_node AS node FROM g WHERE dst_node = 4 UNION SELECT src_node FROM g WHERE dst_node IN (SELECT node FROM a) "
    "UNION SELECT src_node FROM g WHERE dst_node IN (SELECT node FROM b)) SELECT CAST(node % 6 AS INTEGER) AS var, CAST(-(node // 6) AS INTEGER) AS lag FROM w "
    "WHERE node <> 4 AND node NOT IN (SELECT node FROM a) AND node NOT IN (SELECT node FROM b)"
)
def mpid_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, graph.CausalGraph(CHEM6, taumax=12).mpid_condition([(0, -2)], [(1, -3)], (4, 0)))


@query(
    f"WITH RECURSIVE {DAG}, {_between_sql('a', 12)}, {_between_sql('b', 19)}, w AS (SELECT src_node AS node FROM g WHERE dst_node = 4 UNION SELECT src_node FROM g WHERE dst_node IN (SELECT node FROM a) "
    "UNION SELECT src_node FROM g WHERE dst_node IN (SELECT node FROM b)), c AS (SELECT node FROM a UNION SELECT node FROM b), m AS (SELECT node, CASE node WHEN 12 THEN 'source1' WHEN 19 THEN 'source2' ELSE 'path' END AS part FROM c "
    "UNION ALL SELECT node, 'condition' FROM w WHERE node <> 4 AND node NOT IN (SELECT node FROM c) UNION ALL SELECT 4, 'target') "
    "SELECT CAST(node % 6 AS INTEGER) AS var, CAST(-(node // 6) AS INTEGER) AS lag, part FROM m"
)
def path_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.CausalGraph(CHEM6, taumax=12).marks([(0, -2)], [(1, -3)], (4, 0))
    return spark.createDataFrame([(v, lag, part) for (v, lag), part in rows], "var int, lag int, part string")


@query(
    f"WITH RECURSIVE {DAG}, p(node, path) AS (SELECT 24, '0,-4' UNION ALL SELECT dst_node, path || ';' || (dst_node % 6) || ',' || (CASE WHEN dst_node // 6 = 0 THEN '0' ELSE '-' || (dst_node // 6) END) "
    "FROM g JOIN p ON src_node = node) SELECT path FROM p WHERE node = 4"
)
def causal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.CausalGraph(CHEM6, taumax=12).paths((0, -4), (4, 0))
    return spark.createDataFrame([(";".join(f"{v},{lag}" for v, lag in p),) for p in paths], "path string")


def _bundled_sql() -> str:
    inside = "(0, 1)"
    return (
        f"WITH {DAG}, u AS (SELECT CAST(unnest([1, 3]) AS INTEGER) AS tau), h AS (SELECT tau, v + 6 * i AS node FROM u, (SELECT unnest([0, 1]) AS v), (SELECT unnest(range(1, 4)) AS i) WHERE i <= tau), "
        f"w AS (SELECT DISTINCT h.tau, src_node AS node FROM g JOIN h ON dst_node = h.node WHERE src_node // 6 > h.tau AND src_node % 6 IN {inside}), pt AS (SELECT tau, src_node AS node FROM g, u WHERE dst_node = 0), "
        f"ptc AS (SELECT * FROM pt WHERE node % 6 IN {inside} AND node // 6 <= tau), rest AS (SELECT * FROM pt EXCEPT SELECT * FROM ptc), wp AS (SELECT * FROM w UNION SELECT * FROM ptc), "
        f"o AS (SELECT DISTINCT wp.tau, src_node AS node FROM g JOIN wp ON dst_node = wp.node WHERE src_node % 6 NOT IN {inside}), "
        "l AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS level), parts AS (SELECT level, 'w' AS part, tau, node FROM w, l UNION ALL SELECT level, 'ptc', tau, node FROM ptc, l "
        "UNION ALL SELECT 1, 'f', tau, node FROM rest UNION ALL SELECT 2, 'f', tau, node FROM (SELECT * FROM rest UNION SELECT * FROM o)) "
        "SELECT level, tau, part, CAST(node % 6 AS INTEGER) AS var, CAST(-(node // 6) AS INTEGER) AS lag FROM parts"
    )


@query(_bundled_sql())
def bundled_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chem, rows = graph.CausalGraph(CHEM6, taumax=12), []
    for level in (0, 1, 2):
        for tau in (1, 3):
            for part, nodes in zip(("w", "ptc", "f"), chem.bundled_components([0, 1], (0, 0), tau, level)[:3], strict=True):
                rows += [(level, tau, part, v, lag) for v, lag in nodes]
    return spark.createDataFrame(rows, "level int, tau int, part string, var int, lag int")


CHAIN = "g AS (SELECT CAST(k + 1 AS INTEGER) AS src_node, CAST(k AS INTEGER) AS dst_node FROM (SELECT unnest(range(0, 40)) AS k))"


@query(f"WITH RECURSIVE {CHAIN}, up(node) AS (SELECT src_node FROM g WHERE dst_node = 0 UNION SELECT src_node FROM g JOIN up ON dst_node = node) SELECT node FROM up")
def chain_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(graph.dag(graph.edge_table(spark, {0: [(0, -1)]}), 1, 40), 0)


@query()
def transitive_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    strengths = np.add.outer(np.arange(6) * 0.01, np.add.outer(np.arange(6) * 0.02, np.linspace(0.9, 0.1, 6)))
    w, _, _ = graph.CausalGraph(CHEM6, strengths, 12).cit_components([(v, -5) for v in range(6)], (4, 0), reduce=True)
    return _nodes(spark, w)


# Filters of networks

LINKS = "WITH l AS (SELECT CAST(s AS INTEGER) AS src, CAST(d AS INTEGER) AS dst, CAST(k AS INTEGER) AS lag, CAST((s * 7 + d * 5 + k * 3) % 11 AS DOUBLE) / 20 - 0.2 AS mit, CAST(0.15 AS DOUBLE) AS sig FROM (SELECT unnest(range(0, 4)) AS s), (SELECT unnest(range(0, 4)) AS d), (SELECT unnest(range(0, 6)) AS k))"


def _links(spark: SparkSession) -> DataFrame:
    rows = [(s, d, k, ((s * 7 + d * 5 + k * 3) % 11) / 20 - 0.2, 0.15) for s in range(4) for d in range(4) for k in range(6)]
    return spark.createDataFrame(rows, "src int, dst int, lag int, mit double, sig double")


@query(LINKS + " SELECT dst, src, CAST(-lag AS INTEGER) AS lag FROM l WHERE abs(mit) > sig AND NOT (src = dst AND lag = 0)")
def parents_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.parents(_links(spark))


@query(LINKS + ", r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY (abs(mit) > sig AND lag > 0) DESC, abs(mit) DESC, lag) AS k FROM l) SELECT src, dst, lag, round(mit, 6) AS mit, CASE WHEN lag = 0 OR (abs(mit) > sig AND lag > 0 AND k = 1) THEN sig ELSE 1.0 END AS sig FROM r")
def strongest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.strongest(_links(spark)).withColumn("mit", F.round("mit", 6))


@query(LINKS + ", r AS (SELECT *, min(CASE WHEN abs(mit) > sig AND lag > 0 THEN lag END) OVER (PARTITION BY src, dst) AS k FROM l) SELECT src, dst, lag, round(mit, 6) AS mit, CASE WHEN lag = 0 OR lag = k THEN sig ELSE 1.0 END AS sig FROM r")
def nearest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.nearest(_links(spark)).withColumn("mit", F.round("mit", 6))


@query(LINKS + " SELECT src, dst, lag, round(mit, 6) AS mit, round(CASE WHEN mit < 0.1 THEN max(mit) OVER () + 1e-5 ELSE sig END, 6) AS sig FROM l")
def links_above_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(filters.above_level(_links(spark), 0.1))


@query(LINKS + " SELECT src, dst, round(arg_max(mit, (abs(mit), -lag)), 6) AS mit, arg_max(lag, (abs(mit), -lag)) AS lag FROM l GROUP BY src, dst")
def strongest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.strongest_lag(_links(spark)).withColumn("mit", F.round("mit", 6))


@query(LINKS + ", a AS (SELECT dst, src, -lag AS lag FROM l WHERE abs(mit) > sig AND NOT (src = dst AND lag = 0)), b AS (SELECT dst, src, lag FROM a WHERE lag >= -2 UNION SELECT 0, 0, -6), u AS (SELECT a.dst IS NOT NULL AS t, b.dst IS NOT NULL AS f FROM a FULL JOIN b ON a.dst = b.dst AND a.src = b.src AND a.lag = b.lag) SELECT round(count(*) FILTER (t AND f) / count(*) FILTER (t), 6) AS dr, round(count(*) FILTER (NOT t AND f) / (count(*) FILTER (NOT t AND f) + 4 * 27 - count(*)), 6) AS fpr FROM u")
def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    true = filters.parents(_links(spark))
    found = true.filter("lag >= -2").unionByName(spark.createDataFrame([(0, 0, -6)], "dst int, src int, lag int"))
    return _round(filters.detection_rates(true, found, 4, 6))


OK_SQL = "abs(mit) > sig AND lag > 0"


def _strongest_sql(source: str) -> str:
    return (
        f"SELECT src, dst, lag, mit, CASE WHEN lag = 0 OR (ok AND k = 1) THEN sig ELSE 1.0 END AS sig FROM (SELECT *, {OK_SQL} AS ok, "
        f"row_number() OVER (PARTITION BY src, dst ORDER BY ({OK_SQL}) DESC, abs(mit) DESC, lag) AS k FROM {source})"
    )


PARENT_SETS = (
    LINKS.replace("WITH l AS", "WITH l0 AS") + ", l AS (SELECT src, dst, lag, CASE WHEN lag = 0 THEN 0.0 ELSE mit END AS mit, sig FROM l0), "
    "v AS (SELECT src, dst, lag, mit, CASE WHEN mit < 0.1 THEN max(mit) OVER () + 1e-5 ELSE sig END AS sig FROM l), "
    f"r AS (SELECT src, dst, lag, mit, CASE WHEN lag = 0 OR lag = f THEN sig ELSE 1.0 END AS sig FROM (SELECT *, min(CASE WHEN {OK_SQL} THEN lag END) OVER (PARTITION BY src, dst) AS f FROM l)), "
    f"a AS (SELECT 'all' AS name, * FROM l UNION ALL SELECT 'strongest', * FROM ({_strongest_sql('l')}) UNION ALL SELECT 'level_strongest', * FROM ({_strongest_sql('v')}) "
    "UNION ALL SELECT 'nearest', * FROM r UNION ALL SELECT 'level', * FROM v) "
    "SELECT name, dst, src, CAST(-lag AS INTEGER) AS lag FROM a WHERE abs(mit) > sig AND NOT (src = dst AND lag = 0)"
)
PARENTS_SQL = "e AS (SELECT dst, src, lag FROM l WHERE abs(mit) > sig AND NOT (src = dst AND lag = 0))"


@query(LINKS + f", {PARENTS_SQL} SELECT l.src, l.dst, l.lag, round(mit, 6) AS mit, sig, e.lag IS NOT NULL AS present, round(CASE WHEN e.lag IS NOT NULL THEN mit ELSE 0 END, 6) AS strength FROM l LEFT JOIN e ON e.src = l.src AND e.dst = l.dst AND e.lag = l.lag AND e.lag <= 3")
def strength_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark)
    return _round(filters.cube(filters.parents(links).filter("lag >= -3"), links))


@query(LINKS + ", s AS (SELECT * FROM l WHERE abs(mit) >= sig) SELECT src, dst, round(arg_max(mit, (abs(mit), -lag)), 6) AS mit, string_agg(lag, ',' ORDER BY abs(mit) DESC, lag) AS lags FROM s GROUP BY src, dst")
def collapsed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(filters.collapsed(_links(spark)), "mit").withColumn("lags", F.concat_ws(",", F.col("lags").cast("array<string>")))


@query(LINKS + f", {PARENTS_SQL}, r AS (SELECT l.dst, l.src, l.lag, row_number() OVER (PARTITION BY l.dst, l.src ORDER BY (l.lag > 0) DESC, mit DESC, l.lag) AS k FROM l JOIN e ON e.src = l.src AND e.dst = l.dst AND e.lag = l.lag) SELECT dst, src, CAST(-lag AS INTEGER) AS lag FROM r WHERE lag = 0 OR k = 1")
def filtered_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filtered_network(filters.parents(_links(spark)), _links(spark))


@query(LINKS + " SELECT src, dst, lag, round(mit, 6) AS mit, sig, abs(mit) >= sig AS is_significant FROM l WHERE lag >= 2")
def flagged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(filters.flagged(_links(spark), 2))


def _as_correlation(x: str) -> str:
    return f"round(sqrt(1 - exp(-2 * CASE WHEN {x} < 0 THEN 1e-8 ELSE {x} END)), 6)"


@query(LINKS + f" SELECT src, dst, lag, {_as_correlation('mit')} AS strength, {_as_correlation('sig')} AS threshold, abs(mit) >= sig AS is_significant, {_as_correlation('(mit - 0.05)')} AS lower, {_as_correlation('(mit + 0.05)')} AS upper FROM l WHERE lag > 0 OR src <> dst")
def lag_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark).withColumns({"a": F.col("mit") - 0.05, "b": F.col("mit") + 0.05})
    return _round(filters.lag_panels(links, correlation=True, bounds=("a", "b")))


@query(LINKS + " SELECT src, dst, lag, round(mit, 6) AS strength, sig AS threshold, abs(mit) >= sig AS is_significant FROM l WHERE lag > 0")
def lagged_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(filters.lag_panels(_links(spark), contemporaneous=False))


@query(LINKS + " SELECT CASE src WHEN 0 THEN 'Cl' WHEN 1 THEN 'Na' ELSE CAST(src AS VARCHAR) END AS src, CASE dst WHEN 0 THEN 'Cl' WHEN 1 THEN 'Na' ELSE CAST(dst AS VARCHAR) END AS dst, lag FROM l")
def labelled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.labelled(_links(spark), {0: "Cl", 1: "Na"}, ["src", "dst"]).select("src", "dst", "lag")


@query(
    LINKS + f", {PARENTS_SQL}, pc AS (SELECT dst, src, lag FROM l WHERE lag <= 2), t AS (SELECT dst, src, lag FROM l WHERE lag = 1 AND src <= dst), "
    "a AS (SELECT 'pc' AS network, * FROM pc UNION ALL SELECT 'mit', * FROM e UNION ALL SELECT 'pcmit', * FROM (SELECT * FROM pc INTERSECT SELECT * FROM e) UNION ALL SELECT 'true', * FROM t) "
    "SELECT network, dst, src, CAST(-lag AS INTEGER) AS lag FROM a"
)
def named_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, lag = _links(spark), (-F.col("lag")).cast("int").alias("lag")
    return filters.named_networks(links.filter("lag <= 2").select("dst", "src", lag), links, links.filter("lag = 1 AND src <= dst").select("dst", "src", lag))


@query(PARENT_SETS)
def parent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.parent_sets(_links(spark), 0.1)


@query(LINKS + " SELECT src, t - lag AS from_t, dst, t AS to_t, round(mit, 6) AS mit FROM l, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS t) WHERE abs(mit) >= sig AND t >= lag")
def unrolled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.unrolled(_links(spark), 8).withColumn("mit", F.round("mit", 6))


# Information over a network


def _network(spark: SparkSession, sf_dir: str, **kw) -> Network:
    return Network(_daily(spark, sf_dir), ["x0", "x1", "x2"], FULL3, taumax=5, k=K, **kw)


@query(f"WITH {N_DAILY}, c AS (SELECT 0 AS i, 1 AS j, 0 AS k, corr(a.x0, a.x1) AS v FROM n a UNION ALL SELECT 0, 1, 1, corr(b.x1, a.x0) FROM n a JOIN n b ON b.t = a.t + 1) SELECT i, j, k, round(v, 6) AS v FROM c")
def network_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _network(spark, sf_dir).correlation_set(2).filter("source = '0' AND split(target, ',')[0] = '1'")
    return r.select(F.lit(0).alias("i"), F.lit(1).alias("j"), F.col("tau").alias("k"), F.round("value", 6).alias("v"))


LAGGED = N_DAILY + ", p AS MATERIALIZED (SELECT a.t AS id, a.x1 AS y, b.x0 AS x, b.x1 AS z FROM n a JOIN n b ON b.t = a.t - 1)"


@query(knn_sql(LAGGED, {"yw": ["y", "z"], "xw": ["x", "z"], "w": ["z"]}, ["x", "y", "z"], "round(m_w + psi_k - m_yw - m_xw, 6) AS te"))
def network_transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _network(spark, sf_dir).te_set().filter("source = '0' AND target = '1,0'")
    return r.select(F.round("value", 6).alias("te"))


N_SHIFTED = N_DAILY + ", u AS (SELECT t, unnest([0, 1, 2]) AS v, unnest([x0, x1, x2]) AS x FROM n)"


@query(
    f"WITH {N_SHIFTED}, k AS (SELECT CAST(unnest([0, 1]) AS INTEGER) AS k) SELECT CAST(a.v AS INTEGER) AS i, CAST(b.v AS INTEGER) AS j, k, round(corr(b.x, a.x), 6) AS v "
    "FROM u a, u b, k WHERE b.t = a.t + k GROUP BY 1, 2, 3"
)
def network_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _network(spark, sf_dir).correlation_set(2).withColumn("j", F.split("target", ",")[0].cast("int"))
    return r.select(F.col("source").cast("int").alias("i"), "j", F.col("tau").alias("k"), F.round("value", 6).alias("v"))


def cmi_sql(x: list, y: list, w: list | None = None, columns: str = "") -> str:
    """SELECT of v, n and d: information of nodes (variable, lag) of the daily series, given w if there is one."""
    nodes, spaces = [*x, *y, *(w or [])], {"x": len(x), "y": len(y), "w": len(w or [])}
    at, names = 0, {}
    for s, size in spaces.items():
        names[s] = [f"c{i}" for i in range(at, at + size)]
        at += size
    lags = sorted({lag for _, lag in nodes})
    cells = ", ".join(f"l{lags.index(lag)}.x{v} AS c{i}" for i, (v, lag) in enumerate(nodes))
    joins = " ".join(f"JOIN n l{i} ON l{i}.t = b.t + ({lag})" for i, lag in enumerate(lags))
    source = f"{N_DAILY}, p AS MATERIALIZED (SELECT b.t AS id, {cells} FROM n b {joins})"
    joint = [c for part in names.values() for c in part]
    if w:
        v = knn_sql(source, {"xw": names["x"] + names["w"], "yw": names["y"] + names["w"], "w": names["w"]}, joint, "m_w + psi_k - m_xw - m_yw AS v, (SELECT count(*) FROM p) AS n", floor=True)
    else:
        v = knn_sql(source, {"x": names["x"], "y": names["y"]}, joint, "psi_n + psi_k - m_x - m_y AS v, (SELECT count(*) FROM p) AS n", floor=True)
    return f"SELECT {columns}v, n, {len(nodes)} AS d FROM ({v})"


TE_MATRIX = " UNION ALL ".join(cmi_sql([(j, 0)], [(i, -1)], [(j, -1)], f"{i} AS i, {j} AS j, ") for i in range(3) for j in range(3) if i != j)


@query(f"SELECT i, j, round(v, 6) AS te FROM ({TE_MATRIX})")
def network_transfer_entropy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _network(spark, sf_dir).te_set().withColumn("j", F.split("target", ",")[0].cast("int"))
    return r.select(F.col("source").cast("int").alias("i"), "j", F.round("value", 6).alias("te"))


TOTAL = N_DAILY + ", p AS MATERIALIZED (SELECT a.t AS id, a.x1 AS y, b.x0 AS p, b.x1 AS q, b.x2 AS r FROM n a JOIN n b ON b.t = a.t - 1)"


@query(knn_sql(TOTAL, {"y": ["y"], "x": ["p", "q", "r"]}, ["y", "p", "q", "r"], "round(psi_n + psi_k - m_y - m_x, 6) AS total"))
def network_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, sf_dir)
    return net.run(net.total(1)).select(F.round("value", 6).alias("total"))


PAIRWISE = " UNION ALL ".join(
    [cmi_sql([(j, 0)], [(i, -1)], [(v, -1) for v in range(3) if v != i], f"'pairwise' AS kind, '{j},0' AS target, '{i}' AS source, ") for i in range(3) for j in range(3)]
    + [cmi_sql([(j, 0)], [(v, -1) for v in range(3)], None, f"'total' AS kind, '{j},0' AS target, '0,-1;1,-1;2,-1' AS source, ") for j in range(3)]
)


@query(f"SELECT kind, target, source, n, CAST(d AS INTEGER) AS d, round(v, 6) AS value FROM ({PAIRWISE})")
def network_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir).pairwise_set().select("kind", "target", "source", "n", "d", F.round("value", 6).alias("value"))


MI_SET = " UNION ALL ".join(cmi_sql([(j, 0)], [(i, 0)], None, f"'{i}' AS source, '{j},0' AS target, ") for i in range(3) for j in range(3) if i < j)


@query(f"SELECT source, target, n, round(v, 6) AS value FROM ({MI_SET})")
def network_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir).mi_set().select("source", "target", "n", F.round("value", 6).alias("value"))


# A node of FULL3 at lag 1 has its parents at lag 2, so these are the conditions of momentary information transfer.
LAG_MIT = " UNION ALL ".join(
    [cmi_sql([(1, 0)], [(0, -k)], None, f"'mi' AS kind, {k} AS tau, ") for k in range(3)]
    + [cmi_sql([(1, 0)], [(0, -k)], [n for n in dict.fromkeys([*[(v, -k - 1) for v in range(3)], *[(v, -1) for v in range(3)]]) if n != (0, -k)], f"'mit' AS kind, {k} AS tau, ") for k in range(3)]
)


@query(f"SELECT kind, CAST(tau AS INTEGER) AS tau, n, CAST(d AS INTEGER) AS d, round(v, 6) AS value FROM ({LAG_MIT})")
def network_two_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag functions of the first on the second variable, asked for one by one."""
    net = _network(spark, sf_dir)
    asked = [r for k in range(3) for r in (*net.two_node((0, -k), (1, 0), conditioned=False), *net.two_node((0, -k), (1, 0), causalpath=False))]
    kind = F.when(F.col("d") == 2, "mi").otherwise("mit").alias("kind")
    return net.run(asked).select(kind, "tau", "n", "d", F.round("value", 6).alias("value"))


@query()
def network_mi_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir, ntest=20).mi_set(test=True)


@query()
def network_lag_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir).lag_functions(2)


@query()
def network_two_and_three_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, sf_dir)
    two = net.two_node_set(0, 1, 3).unionByName(net.two_node_set(0, 1, 3, causalpath=False))
    return two.unionByName(net.three_node_set(0, 2, 1, 2))


@query()
def network_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _network(spark, sf_dir)
    return net.mitp_set(2).unionByName(net.mitp_set(2, markov=True)).unionByName(net.mpid_markov_set([2]))


@query()
def causal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(_network(spark, sf_dir).cit_set([0, 1, 2], [0], 5, pid=True))


def _history_sql(target: int, taus: range) -> str:
    """tau, tit, cit, past of FULL3: everything one step back is immediate, everything one step beyond tau is distant."""
    near, each = [(v, -1) for v in range(3)], []
    for tau in taus:
        far = [(v, -tau - 1) for v in range(3)]
        three = {"tit": (near, None), "cit": (near, far), "past": (far, None)}
        values = ", ".join(f"(SELECT v FROM ({cmi_sql([(target, 0)], y, w)})) AS {k}" for k, (y, w) in three.items())
        each.append(f"SELECT '{target},0' AS target, CAST({tau} AS INTEGER) AS tau, {values}")
    return " UNION ALL ".join(each)


@query(f"SELECT target, tau, round(tit, 6) AS tit, round(cit, 6) AS cit, round(past, 6) AS past FROM ({_history_sql(0, range(1, 4))})")
def causal_history_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(history(_network(spark, sf_dir).cit_set([0, 1, 2], [0], 3)).select("target", "tau", "tit", "cit", "past"))


@query(f"SELECT target, tau, round(tit, 6) AS tit, round(cit, 6) AS cit, round(past, 6) AS past FROM ({_history_sql(1, range(1, 4))})")
def causal_history_markov_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(history(_network(spark, sf_dir).cit_set([0, 1, 2], [1], 3, markov=True)).select("target", "tau", "tit", "cit", "past"))


@query(
    f"SELECT target, tau, round(cit, 6) AS immediate, round(past, 6) AS distant, round(cit + past, 6) AS total, round(past / (cit + past), 6) AS share FROM ({_history_sql(2, range(1, 3))})"
)
def history_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(filters.history_curves(history(_network(spark, sf_dir).cit_set([0, 1, 2], [2], 2))))


@query(f"SELECT target, tau, round(CASE WHEN cit / past >= 1 THEN cit / past END, 4) AS from_one, round(CASE WHEN cit / past < 1 THEN cit / past END, 4) AS below_one FROM ({_history_sql(2, range(1, 3))})")
def history_split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.split_ratio(history(_network(spark, sf_dir).cit_set([0, 1, 2], [2], 2)))
    return out.select("target", "tau", F.round("from_one", 4).alias("from_one"), F.round("below_one", 4).alias("below_one"))


TABLE_EDGES = [(0, 0, -1), (0, 1, -1), (1, 1, -1), (1, 0, 0), (2, 2, -1), (2, 2, -2)]
TABLE_TOTALS = " UNION ALL ".join(cmi_sql([(j, 0)], [(s, lag) for d, s, lag in TABLE_EDGES if d == j and lag], None, f"'{j},0' AS target, ") for j in range(3))


@query(f"SELECT target, n, CAST(d AS INTEGER) AS d, round(v, 6) AS value FROM ({TABLE_TOTALS})")
def network_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a network whose edges and strengths are tables; its lag-0 edge is left out."""
    edges = spark.createDataFrame(TABLE_EDGES, "dst int, src int, lag int")
    strengths = edges.select("src", "dst", (-F.col("lag")).alias("lag"), F.lit(0.5).alias("value"))
    net = network_of(_daily(spark, sf_dir), ["x0", "x1", "x2"], edges, strengths, lagged_only=True, taumax=5, k=K)
    return net.run([r for j in range(3) for r in net.total(j)]).select("target", "n", "d", F.round("value", 6).alias("value"))


@query()
def independence_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of quantity and price, and of the same given discount, with one and with two shuffled columns."""
    daily, out = _daily(spark, sf_dir), []
    for w, shuffle in (([], None), (["x2"], None), (["x2"], ["x0", "x1"])):
        one = independence(daily, ["x0"], ["x1"], w, shuffle, approach="knn", k=K, ntest=20)
        out.append(one.withColumns({"given": F.lit(",".join(w)), "shuffled": F.lit(",".join(shuffle or ["x0"]))}))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query()
def causal_history_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(_network(spark, sf_dir).cit_set([0, 1, 2], [1], 5, markov=True))


@query()
def causal_history_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(_network(spark, sf_dir, ntest=20).cit_set([0, 1, 2], [0], 1, test=True))


@query()
def bundled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir).bundled_set([0], [1], 0, 3)


@query()
def estimated_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = estimate_parents(_daily(spark, sf_dir), ["x0", "x1", "x2"], 1)
    return graph.edge_table(spark, found)


# Simulators and streams


@query()
def simulated_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = np.ones((3, 3)) - np.eye(3)
    return simulate.ensemble(spark, "logistic_network", 4, 3, n=3, adjacency=full, lags=full.astype(int), e=1.0, ez=0.3, steps=500)


@query()
def simulated_lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.ensemble(spark, "lorenz", 2, 3, n=1000, e=1.0)


@query()
def simulated_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    henon = simulate.ensemble(spark, "henon", 1, 2, n=200)
    fishery = simulate.ensemble(spark, "fishery", 1, 3, n=200)
    return fishery.unionByName(henon, allowMissingColumns=True).unionByName(simulate.ensemble(spark, "two_species", 1, 2, n=200), allowMissingColumns=True)


@query(
    "WITH RECURSIVE s(t, x, y) AS (SELECT 0, 0.3::DOUBLE, 0.2::DOUBLE UNION ALL SELECT t + 1, 1::DOUBLE - 1.4::DOUBLE * x * x + y, 0.3::DOUBLE * x FROM s WHERE t < 300) "
    "SELECT '0' AS series_id, CAST(t - 20 AS BIGINT) AS t, round(x, 6) AS x0, round(y, 6) AS x1 FROM s WHERE t >= 20 AND t <= 50"
)
def simulated_henon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(simulate.ensemble(spark, "henon", 1, 2, n=30, init=(0.3, 0.2), burn=20))


@query(
    "WITH RECURSIVE s(t, x, y, p, pp) AS (SELECT 2, 0.4::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 0.4::DOUBLE UNION ALL SELECT t + 1, x * (3.8::DOUBLE - 3.8::DOUBLE * x - 0.02::DOUBLE * y), "
    "y * (3.5::DOUBLE - 3.5::DOUBLE * y - 0.1::DOUBLE * pp), x, p FROM s WHERE t < 39) SELECT '0' AS series_id, CAST(t AS BIGINT) AS t, round(x, 6) AS x0, round(y, 6) AS x1 FROM s "
    "UNION ALL SELECT '0', CAST(unnest([0, 1]) AS BIGINT), 0.4, 0.2"
)
def simulated_two_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(simulate.ensemble(spark, "two_species", 1, 2, n=40, tau=2))


@query()
def sliding_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value", F.col("user_id").cast("double").alias("user"))
    return window_information(events, "value", "user")
