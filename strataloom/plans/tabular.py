"""Profiles, distributions, correlation and time series over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.numeric import rnd
from strataloom.operators import correlation, profile, stats, timeseries
from strataloom.plans.registry import COLUMNS, query, union_sql
from strataloom.session import load

PROFILED = ("lineitem", "orders", "customer")
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRICES = {"orders": ["o_totalprice"], "part": ["p_size", "p_retailprice"]}


def text_cell(c: str) -> str:
    return f"nullif(trim(CAST({c} AS VARCHAR)), '')"


def _profile_sql(table: str, c: str) -> str:
    v = text_cell(c)
    return f"""SELECT '{table}' AS "table", '{c}' AS "column", count(*) AS "rows", count({v}) AS filled,
  count(*) - count({v}) AS nulls, round(100.0 * (count(*) - count({v})) / count(*), 2) AS null_pct,
  count(DISTINCT {v}) AS cardinality,
  round(count(DISTINCT {v}) / CAST(greatest(1, count({v})) AS DOUBLE), 6) AS uniqueness_ratio,
  count({v}) - count(DISTINCT {v}) AS duplicate_proxy FROM {table}"""


def profile_sql(names) -> str:
    return union_sql(_profile_sql(t, c) for t in names for c in COLUMNS[t])


def profiles(spark, sf_dir, names):
    out = profile.tables({t: load(spark, sf_dir, t) for t in names})
    return out.withColumn("uniqueness_ratio", rnd("uniqueness_ratio", 6))


@query("column_profile", profile_sql(PROFILED))
def column_profile(spark, sf_dir):
    return profiles(spark, sf_dir, PROFILED)


@query(
    "column_moments",
    union_sql(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", round(CAST(min({c}) AS DOUBLE), 6) AS "min",
  round(CAST(max({c}) AS DOUBLE), 6) AS "max", round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST({c} AS DOUBLE)), 6) AS std FROM {t}"""
        for t, cs in (("orders", ["o_orderkey", "o_custkey", "o_totalprice"]), ("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
        for c in cs
    ),
)
def column_moments(spark, sf_dir):
    return profile.column_moments(load(spark, sf_dir, "orders"), "orders").unionByName(
        profile.column_moments(load(spark, sf_dir, "customer"), "customer")
    )


@query(
    "column_samples",
    union_sql(
        f"""SELECT '{c}' AS "column", CAST(rn AS INTEGER) AS position, substr(v, 1, 120) AS value FROM (
  SELECT v, row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT {text_cell(c)} AS v FROM orders) WHERE v IS NOT NULL) WHERE rn <= 20"""
        for c in COLUMNS["orders"]
    ),
)
def column_samples(spark, sf_dir):
    return profile.samples(load(spark, sf_dir, "orders"))


def _counts_sql(table: str, cols) -> str:
    return union_sql(
        f"SELECT '{c}' AS col, {text_cell(c)} AS v, count(*) AS n FROM {table} WHERE {text_cell(c)} IS NOT NULL GROUP BY 2" for c in cols
    )


TOP_COLUMNS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate", "l_suppkey"]


@query(
    "top_values",
    f"""SELECT col AS "column", v AS value, n AS copies, CAST(rn AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rn FROM ({_counts_sql('lineitem', TOP_COLUMNS)})) WHERE rn <= 5""",
)
def top_values(spark, sf_dir):
    counts = profile.value_counts(load(spark, sf_dir, "lineitem"), TOP_COLUMNS)
    return profile.top_values(counts).select("column", "value", "copies", "position")


@query(
    "cell_stats",
    union_sql(
        f"""SELECT '{c}' AS "column", count({text_cell(c)}) AS count, count(*) - count({text_cell(c)}) AS nulls,
  round((count(*) - count({text_cell(c)})) / CAST(greatest(1, count(*)) AS DOUBLE), 4) AS null_rate, count(DISTINCT {text_cell(c)}) AS cardinality,
  count(TRY_CAST(replace({text_cell(c)}, ',', '') AS DOUBLE)) AS parsed,
  count(TRY_CAST(replace({text_cell(c)}, ',', '') AS DOUBLE)) >= greatest(3, floor(0.6 * greatest(1, count({text_cell(c)})))) AS is_numeric FROM orders"""
        for c in COLUMNS["orders"]
    ),
)
def cell_stats(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    counts = profile.value_counts(df)
    return profile.cell_stats(counts, profile.columns(df, "orders", counts=counts))


def _facts(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS col, count(v) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, var_pop(v) AS variance, stddev_pop(v) AS std,
  quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3,
  quantile_cont(v, 0.9) AS p90 FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table})"""


def _cells(table: str, cols) -> str:
    return union_sql(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL" for c in cols)


def _with_facts(table: str, cols) -> str:
    return f"WITH facts AS ({union_sql(_facts(table, c) for c in cols)}), cells AS ({_cells(table, cols)})"


HEALTH_SQL = f"""{_with_facts('lineitem', NUMBERS)}
SELECT f.col AS "column", any_value(f.n) AS n, round(any_value(f.mean), 4) AS mean, round(any_value(f.std), 4) AS std,
  round(avg(((v - mean) / std) ** 3), 4) AS skewness, round(avg(((v - mean) / std) ** 4) - 3, 4) AS kurtosis,
  round(any_value(f.p10), 4) AS p10, round(any_value(f.q1), 4) AS q1, round(any_value(f.median), 4) AS median,
  round(any_value(f.q3), 4) AS q3, round(any_value(f.p90), 4) AS p90,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
  count(*) FILTER (abs((v - mean) / std) >= 3) AS zscore_outliers
FROM cells JOIN facts f USING (col) GROUP BY f.col"""


@query("column_health", HEALTH_SQL)
def column_health(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    facts = stats.column_facts(df, NUMBERS)
    counts = stats.outliers(df, NUMBERS, facts=facts)
    measures = ("mean", "std", "skewness", "kurtosis", "p10", "q1", "median", "q3", "p90")
    table = spark.createDataFrame([(c, *[facts[c][m] for m in measures]) for c in NUMBERS], "column string, " + ", ".join(f"{m} double" for m in measures))
    return counts.join(F.broadcast(table), "column").select(
        "column", "n", *[rnd(m).alias(m) for m in measures], "iqr_outliers", "zscore_outliers"
    )


@query(
    "describe_numeric",
    f"""{_with_facts('orders', ['o_totalprice', 'o_custkey'])}
SELECT f.col AS "column", any_value(n) AS n, round(any_value(lo), 4) AS "min", round(any_value(hi), 4) AS "max", round(any_value(mean), 4) AS mean,
  round(any_value(variance), 2) AS variance, round(avg(((v - mean) / std) ** 3), 6) AS skewness, round(avg(((v - mean) / std) ** 4) - 3, 6) AS kurtosis,
  round(any_value(p10), 4) AS p10, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
  round(any_value(p90), 4) AS p90, round(any_value(q3 - q1), 4) AS iqr, round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower_fence,
  round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper_fence FROM cells JOIN facts f USING (col) GROUP BY f.col""",
)
def describe_numeric(spark, sf_dir):
    d = stats.describe(load(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
    digits = {"variance": 2, "skewness": 6, "kurtosis": 6}
    names = ("min", "max", "mean", "variance", "skewness", "kurtosis", "p10", "q1", "median", "q3", "p90", "iqr", "lower_fence", "upper_fence")
    return d.select("column", "n", *[rnd(c, digits.get(c, 4)).alias(c) for c in names])


@query(
    "box_fences",
    f"""{_with_facts('lineitem', NUMBERS)}
SELECT f.col AS "column", round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS lower_whisker, round(any_value(q1), 6) AS q1,
  round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS upper_whisker
FROM cells JOIN facts f USING (col) GROUP BY f.col""",
)
def box_fences(spark, sf_dir):
    names = ("lower_whisker", "q1", "median", "q3", "upper_whisker")
    return stats.box(load(spark, sf_dir, "lineitem"), NUMBERS).select("column", *[rnd(c, 6).alias(c) for c in names])


@query(
    "iqr_and_z_outliers",
    f"""{_with_facts('events', ['value'])}
SELECT f.col AS "column", any_value(n) AS n, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
  count(*) FILTER (abs((v - mean) / std) >= 3) AS zscore_outliers FROM cells JOIN facts f USING (col) GROUP BY f.col""",
)
def iqr_and_z_outliers(spark, sf_dir):
    return stats.outliers(load(spark, sf_dir, "events"), ["value"])


@query(
    "outlier_values",
    f"""{_with_facts('events', ['value'])}
SELECT col AS "column", CAST(rn AS INTEGER) AS position, v AS value FROM (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY v) AS rn FROM (
  SELECT DISTINCT col, round(v, 6) AS v FROM cells JOIN facts USING (col) WHERE abs((v - mean) / std) > 3)) WHERE rn <= 25""",
)
def outlier_values(spark, sf_dir):
    return stats.outlier_values(load(spark, sf_dir, "events"), ["value"], strict=True)


@query(
    "outlier_summary",
    f"""{_with_facts('lineitem', NUMBERS)}, per AS (SELECT f.col,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS i, count(*) FILTER (abs((v - mean) / std) >= 3) AS z
  FROM cells JOIN facts f USING (col) GROUP BY f.col)
SELECT count(*) FILTER (i > 0 OR z > 0) AS affected_columns, CAST(sum(z) AS BIGINT) AS zscore_anomaly_count, CAST(sum(i) AS BIGINT) AS iqr_outlier_count FROM per""",
)
def outlier_summary(spark, sf_dir):
    return stats.outlier_summary(stats.outliers(load(spark, sf_dir, "lineitem"), NUMBERS))


@query(
    "z_bands",
    f"""{_with_facts('events', ['value', 'user_id'])}, bands(k, band) AS (VALUES (0, '<-3'), (1, '-3..-2'), (2, '-2..2'), (3, '2..3'), (4, '>3')),
placed AS (SELECT col, CASE WHEN z < -3 THEN 0 WHEN z < -2 THEN 1 WHEN z <= 2 THEN 2 WHEN z <= 3 THEN 3 ELSE 4 END AS k
  FROM (SELECT col, (v - mean) / std AS z FROM cells JOIN facts USING (col)))
SELECT f.col AS "column", b.band, count(p.k) AS count FROM facts f CROSS JOIN bands b LEFT JOIN placed p ON p.col = f.col AND p.k = b.k GROUP BY ALL""",
)
def z_bands(spark, sf_dir):
    return stats.z_bands(load(spark, sf_dir, "events"), ["value", "user_id"])


@query(
    "histogram_equal_width",
    union_sql(
        f"""SELECT '{c}' AS "column", b AS bin, round(lo + b * w, 6) AS low, round(lo + b * w + w, 6) AS high,
  count(v) FILTER ((v >= lo + b * w AND v < lo + b * w + w) OR (b = 7 AND v = hi)) AS count
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {t}) , (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi,
  (max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE))) / 8 AS w FROM {t}), (SELECT CAST(unnest(range(8)) AS INTEGER) AS b) GROUP BY b, lo, w"""
        for t, cs in PRICES.items()
        for c in cs
    ),
)
def histogram_equal_width(spark, sf_dir):
    out = None
    for t, cs in PRICES.items():
        one = stats.histogram(load(spark, sf_dir, t), cs)
        out = one if out is None else out.unionByName(one)
    return out.select("column", "bin", rnd("low", 6).alias("low"), rnd("high", 6).alias("high"), "count")


@query(
    "histogram_equal_frequency",
    union_sql(
        f"""SELECT '{c}' AS "column", CAST((rn - 1) // size AS INTEGER) AS bin, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS count FROM (
  SELECT v, row_number() OVER (ORDER BY v) AS rn, greatest(1, count(*) OVER () // 8) AS size FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {t})) GROUP BY 2"""
        for t, cs in PRICES.items()
        for c in cs
    ),
)
def histogram_equal_frequency(spark, sf_dir):
    out = None
    for t, cs in PRICES.items():
        one = stats.histogram(load(spark, sf_dir, t), cs, mode="frequency")
        out = one if out is None else out.unionByName(one)
    return out.select("column", "bin", rnd("low", 6).alias("low"), rnd("high", 6).alias("high"), "count")


@query("qq_points")
def qq_points(spark, sf_dir):
    return stats.qq_points(load(spark, sf_dir, "orders"), ["o_totalprice"])


@query(
    "qq_sample_values",
    """SELECT 'o_totalprice' AS "column", CAST(rn - 1 AS BIGINT) AS "rank", round(v, 6) AS actual FROM (
  SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS n FROM orders)
WHERE ((rn - 1) % greatest(1, n // 40) = 0 AND (rn - 1) // greatest(1, n // 40) < 39) OR rn = n""",
)
def qq_sample_values(spark, sf_dir):
    return stats.qq_points(load(spark, sf_dir, "orders"), ["o_totalprice"]).select("column", "rank", "actual")


def bands_sql(names) -> str:
    return f"""SELECT count(*) FILTER (r >= 0.5) AS high_null_columns, count(*) FILTER (r >= 0.2 AND r < 0.5) AS medium_null_columns,
  count(*) FILTER (r < 0.2) AS low_null_columns FROM (SELECT nulls / CAST("rows" AS DOUBLE) AS r FROM ({profile_sql(names)}))"""


def bands(spark, sf_dir, names):
    out = None
    for t in names:
        one = profile.null_counts(load(spark, sf_dir, t))
        out = one if out is None else out.unionByName(one)
    return stats.null_bands(out)


@query("null_bands", bands_sql(PROFILED))
def null_bands(spark, sf_dir):
    return bands(spark, sf_dir, PROFILED)


# --- correlation -----------------------------------------------------------------

CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


def _pair_sql(table: str, cols, with_rank: bool) -> str:
    if with_rank:
        base = "WITH b AS (SELECT " + ", ".join(
            f"CAST({c} AS DOUBLE) AS {c}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols
        ) + f" FROM {table})"
    else:
        base = "WITH b AS (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + f" FROM {table})"

    def r(a, b):
        return f"round(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0), 4) + 0.0"

    rows = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            spearman = f", {r('r_' + a, 'r_' + b)} AS spearman" if with_rank else ""
            rows.append(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, {r(a, b)} AS pearson, round(covar_pop({a}, {b}), 4) + 0.0 AS covariance{spearman} FROM b")
    return f"{base} {union_sql(rows)}"


@query("correlation_pearson", _pair_sql("lineitem", CORRELATED, False))
def correlation_pearson(spark, sf_dir):
    return correlation.pairs(load(spark, sf_dir, "lineitem"), CORRELATED, spearman=False)


@query("correlation_spearman", _pair_sql("lineitem", CORRELATED[:4], True))
def correlation_spearman(spark, sf_dir):
    return correlation.pairs(load(spark, sf_dir, "lineitem"), CORRELATED[:4])


@query(
    "correlation_rank_columns",
    """SELECT "column", n, CAST(row_number() OVER (ORDER BY n DESC, variance DESC, "column") AS INTEGER) AS position FROM (
"""
    + union_sql(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, var_pop(CAST({c} AS DOUBLE)) AS variance FROM lineitem"
        for c in COLUMNS["lineitem"][:8]
    )
    + ") QUALIFY position <= 10",
)
def correlation_rank_columns(spark, sf_dir):
    m = stats.moments(load(spark, sf_dir, "lineitem"), COLUMNS["lineitem"][:8])
    return correlation.rank_table(m).select("column", "n", "position")


@query(
    "correlation_top_pairs",
    f"""SELECT "left", "right", pearson FROM ({_pair_sql('lineitem', CORRELATED, False)}) ORDER BY abs(pearson) DESC, "left", "right" LIMIT 40""",
)
def correlation_top_pairs(spark, sf_dir):
    return correlation.top_pairs(correlation_pearson(spark, sf_dir)).select("left", "right", "pearson")


@query(
    "correlation_strongest",
    f"""SELECT arg_max("left" || '~' || "right", (pearson, "left", "right")) AS positive_pair, max(pearson) AS positive_value,
  arg_min("left" || '~' || "right", (pearson, "left", "right")) AS negative_pair, min(pearson) AS negative_value FROM ({_pair_sql('lineitem', CORRELATED, False)})""",
)
def correlation_strongest(spark, sf_dir):
    return correlation.strongest(correlation_pearson(spark, sf_dir))


@query(
    "vif_proxy",
    f"""WITH p AS ({_pair_sql('lineitem', CORRELATED, False)}), s AS (SELECT "left" AS feature, pearson FROM p UNION ALL SELECT "right", pearson FROM p)
SELECT feature, round(1.0 / greatest(1e-6, 1.0 - max(pearson * pearson)), 4) AS vif,
  CASE WHEN round(1.0 / greatest(1e-6, 1.0 - max(pearson * pearson)), 4) > 5 THEN 'high' ELSE 'ok' END AS status FROM s GROUP BY feature""",
)
def vif_proxy(spark, sf_dir):
    return correlation.vif(correlation_pearson(spark, sf_dir))


@query(
    "correlation_pair_gap",
    f"""SELECT "left", "right", round(abs(pearson - spearman), 4) AS gap, abs(pearson - spearman) > 0.18 AS nonlinear FROM ({_pair_sql('orders', ['o_custkey', 'o_totalprice'], True)})""",
)
def correlation_pair_gap(spark, sf_dir):
    return correlation.pair_gap(correlation.pairs(load(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"]))


# --- time series -------------------------------------------------------------------

DAILY_SQL = "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1"
ORDER_DAYS = "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1"


def _dates(df):
    return df.withColumn("date", F.col("date").cast("string"))


@query(
    "daily_counts",
    """SELECT CAST(d AS VARCHAR) AS date, CAST(sum(n) AS BIGINT) AS count FROM (
  SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT CAST(l_shipdate AS DATE), count(*) FROM lineitem GROUP BY 1) GROUP BY d""",
)
def daily_counts(spark, sf_dir):
    days = timeseries.daily(load(spark, sf_dir, "orders")).unionByName(timeseries.daily(load(spark, sf_dir, "lineitem")))
    return _dates(days.groupBy("date").agg(F.sum("count").alias("count")))


@query(
    "moving_average",
    f"""SELECT CAST(d AS VARCHAR) AS date, n AS count, round(avg(n) OVER w, 4) AS moving_average, round(stddev_pop(n) OVER w, 4) AS volatility
FROM ({ORDER_DAYS}) WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def moving_average(spark, sf_dir):
    out = timeseries.smooth(timeseries.daily(load(spark, sf_dir, "orders")))
    return _dates(out).select("date", "count", rnd("moving_average").alias("moving_average"), rnd("volatility").alias("volatility"))


@query(
    "event_spikes",
    f"""SELECT CAST(d AS VARCHAR) AS date, n AS count, round(abs(n - a) / s, 4) AS z_proxy FROM (
  SELECT d, n, avg(n) OVER w AS a, stddev_pop(n) OVER w AS s FROM ({ORDER_DAYS}) WINDOW w AS (ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
WHERE s > 0 AND abs(n - a) >= 2.0 * s""",
)
def event_spikes(spark, sf_dir):
    return _dates(timeseries.spikes(timeseries.daily(load(spark, sf_dir, "orders")), window=30))


@query(
    "change_points",
    f"""SELECT CAST(d AS VARCHAR) AS date, n AS count, delta FROM (SELECT d, n, n - lag(n) OVER (ORDER BY d) AS delta FROM ({DAILY_SQL})) WHERE abs(delta) >= 3""",
)
def change_points(spark, sf_dir):
    return _dates(timeseries.change_points(timeseries.daily(load(spark, sf_dir, "events"), ["ts"])))


@query(
    "daily_counts_by_type",
    """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS count FROM events GROUP BY 1, 2""",
)
def daily_counts_by_type(spark, sf_dir):
    return _dates(timeseries.daily(load(spark, sf_dir, "events"), ["ts"], by=["event_type"]))


@query(
    "date_parse",
    """SELECT source, count(*) AS cells, count(*) AS parsed FROM (
  SELECT 'orders' AS source FROM orders UNION ALL SELECT 'lineitem' FROM lineitem UNION ALL SELECT 'events' FROM events) GROUP BY source""",
)
def date_parse(spark, sf_dir):
    """Dates written in three layouts are all read back."""
    o = load(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("t"))
    li = load(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("source"), F.date_format("l_shipdate", "dd-MM-yyyy").alias("t"))
    e = load(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("ts").cast("string").alias("t"))
    return o.unionByName(li).unionByName(e).groupBy("source").agg(
        F.count("*").alias("cells"), F.count(timeseries.parse_datetime("t")).alias("parsed")
    )
