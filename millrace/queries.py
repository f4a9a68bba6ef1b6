"""Registered queries of the data-preparation operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numbers, places
from millrace.operators import charts, detect, features, impute, joins, metrics, models, ordered, quantiles, rows, stats, structure
from millrace.operators.profile import profile_columns
from millrace.plans import cleaning
from millrace.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Profiles and statistics


def _profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_percentage, "
        f"count(DISTINCT {c}) AS unique_count FROM {name}"
        for c in columns
    )


LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()


@query(_profile_sql("lineitem", LINEITEM))
def profile_lineitem(spark, sf_dir):
    return profile_columns(read(spark, sf_dir, "lineitem"))


@query(f"SELECT column_name FROM ({_profile_sql('orders', ORDERS)}) WHERE unique_count / (row_count - null_count) > 0.95")
def potential_ids(spark, sf_dir):
    p = profile_columns(read(spark, sf_dir, "orders"))
    return p.where("unique_count / (row_count - null_count) > 0.95").select("column_name")


_R4 = "round_even({}, 4)"


@query(
    "SELECT count(*) AS n, "
    + ", ".join(
        f"{_R4.format(e)} AS {a}"
        for a, e in {
            "min": "min(x)", "max": "max(x)", "sum": "sum(x)", "range": "max(x) - min(x)", "mean": "avg(x)", "median": "median(x)", "std": "stddev_samp(x)", "variance": "var_samp(x)",
            "skewness": "skewness(x)", "kurtosis": "kurtosis(x)", "q1": "quantile_cont(x, 0.25)", "q2": "quantile_cont(x, 0.5)", "q3": "quantile_cont(x, 0.75)", "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
        }.items()
    )
    + " FROM (SELECT l_quantity AS x FROM lineitem)"
)
def eda_numeric_quantity(spark, sf_dir):
    return stats.numeric_summary(read(spark, sf_dir, "lineitem"), "l_quantity")


def _hist_sql(name: str, column: str, bins: int) -> str:
    return f"""
    WITH s AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {name}),
    c AS (SELECT least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS b, count(*) AS n FROM {name}, s GROUP BY 1)
    SELECT i::INTEGER AS bin, lo + i * ((hi - lo) / {bins}) AS "left", lo + (i + 1) * ((hi - lo) / {bins}) AS "right", coalesce(n, 0)::BIGINT AS n
    FROM s, range(0, {bins}) t(i) LEFT JOIN c ON b = i"""


@query(_hist_sql("orders", "o_totalprice", 20))
def eda_hist20(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "orders"), "o_totalprice", 20)


@query(_hist_sql("lineitem", "l_extendedprice", 30))
def hist30_price(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 30)


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top20_values(spark, sf_dir):
    return stats.value_counts(read(spark, sf_dir, "part"), "p_type", 20)


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 15")
def bar_count15(spark, sf_dir):
    return stats.value_counts(read(spark, sf_dir, "events"), "event_type", 15)


@query("SELECT o_orderpriority AS x, round_even(avg(o_totalprice), 4) AS y FROM orders GROUP BY 1")
def bar_mean(spark, sf_dir):
    return stats.group_means(read(spark, sf_dir, "orders"), F.col("o_orderpriority"), "o_totalprice")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS x, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def line_month_count(spark, sf_dir):
    month = F.date_format("l_shipdate", "yyyy-MM").alias("x")
    return read(spark, sf_dir, "lineitem").groupBy(month).agg(F.count(F.lit(1)).alias("n")).orderBy("x")


@query(
    "SELECT o_orderpriority AS x, round_even(min(o_totalprice), 4) AS min, round_even(quantile_cont(o_totalprice, 0.25), 4) AS q1, round_even(median(o_totalprice), 4) AS median, "
    "round_even(quantile_cont(o_totalprice, 0.75), 4) AS q3, round_even(max(o_totalprice), 4) AS max FROM orders GROUP BY 1 ORDER BY 1 LIMIT 10"
)
def box_stats(spark, sf_dir):
    return stats.boxes(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query()
def scatter_sample(spark, sf_dir):
    return stats.correlation_free_scatter(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem), "
    "s AS (SELECT avg((l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a))::INTEGER) AS share FROM lineitem, q) "
    "SELECT round_even(share, 6) AS share, share > 0.05 AS many FROM s"
)
def iqr_outliers(spark, sf_dir):
    return stats.outlier_share(read(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(
    "WITH s AS (SELECT count(o_totalprice) AS n, stddev_samp(o_totalprice) / avg(o_totalprice) AS cv FROM orders) "
    "SELECT n, round_even(cv, 6) AS cv, CASE WHEN n < 5 THEN 'low' WHEN cv > 0.5 THEN 'high' WHEN cv > 0.2 THEN 'medium' ELSE 'low' END AS level FROM s"
)
def cv_rule(spark, sf_dir):
    return stats.importance(read(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), g AS (SELECT d - lag(d) OVER (ORDER BY d) AS gap FROM d) "
    "SELECT count(gap) AS n, round_even(stddev_samp(gap) / avg(gap), 6) AS cv, coalesce(count(gap) >= 2 AND stddev_samp(gap) / avg(gap) < 1, false) AS sequential FROM g WHERE gap IS NOT NULL"
)
def date_gap_cv(spark, sf_dir):
    return impute.date_gap_variation(read(spark, sf_dir, "orders"), "o_orderdate")


# Joins, keys, unions


def _customers(spark, sf_dir):
    return read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")


def _join_query(how: str):
    sql_how = {"outer": "FULL"}.get(how, how.upper())

    @query(
        f"SELECT coalesce(o.custkey, c.c_custkey) AS custkey, o_orderkey, o_totalprice, c_name, c_mktsegment FROM "
        f"(SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_custkey - o_custkey % 2 END AS custkey, o_orderkey, o_totalprice FROM orders) o {sql_how} JOIN customer c ON o.custkey IS NOT DISTINCT FROM c.c_custkey",
        f"join_{how}",
    )
    def run(spark, sf_dir):
        # a third of the orders and every second customer match nothing
        key = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_orderkey")).otherwise(F.col("o_custkey") - F.col("o_custkey") % 2)
        o = read(spark, sf_dir, "orders").select(key.alias("custkey"), "o_orderkey", "o_totalprice")
        c = _customers(spark, sf_dir).select("custkey", "c_name", "c_mktsegment")
        return joins.join_tables(o, c, ["custkey"], how, salts=8 if how == "outer" else None)


for _how in ("inner", "left", "right", "outer"):
    _join_query(_how)


@query(
    "SELECT n_name, count(*) AS orders, round_even(avg(o_totalprice), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
)
def join_chain3(spark, sf_dir):
    tables = {
        "orders": read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey"),
        "customer": _customers(spark, sf_dir).withColumnRenamed("c_nationkey", "nationkey"),
        "nation": read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "nationkey"),
    }
    plan = [joins.Join("orders", "customer", ("custkey",), result="oc"), joins.Join("oc", "nation", ("nationkey",), result="ocn")]
    out = joins.run_plan(plan, tables)["ocn"]
    return out.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.bround(F.avg("o_totalprice"), 4).alias("mean_price"))


_NULL_KEYS = "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 END AS k, o_orderkey AS v FROM orders"


@query(f"SELECT a.k, a.v AS v_x, b.v AS v_y FROM ({_NULL_KEYS}) a JOIN (SELECT k, max(v) AS v FROM ({_NULL_KEYS}) GROUP BY k) b ON a.k IS NOT DISTINCT FROM b.k")
def join_nullkeys_suffix(spark, sf_dir):
    """All orders, a fifth of them under the null key, to a table with one row a key, null among them."""
    t = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 1000).alias("k"), F.col("o_orderkey").alias("v"))
    return joins.join_tables(t, t.groupBy("k").agg(F.max("v").alias("v")), ["k"], salts=8)


_SHARED = ("documents", "labels", "benchmark", "conversations")


@query("SELECT column_name FROM (" + " UNION ALL ".join(f"SELECT column_name FROM (DESCRIBE {t})" for t in _SHARED) + ") GROUP BY 1 HAVING count(*) > 1")
def shared_columns(spark, sf_dir):
    found = joins.shared_columns({n: read(spark, sf_dir, n) for n in _SHARED})
    return spark.createDataFrame([(c,) for c in found], "column_name string")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey - c_custkey % 2 FROM customer)")
def foreign_key_orphans(spark, sf_dir):
    parents = read(spark, sf_dir, "customer").select((F.col("c_custkey") - F.col("c_custkey") % 2).alias("k2"))
    return joins.orphans(read(spark, sf_dir, "orders"), parents, "o_custkey", "k2")


@query("SELECT name, nationkey, filename FROM (SELECT c_name AS name, c_nationkey AS nationkey, 'customer' AS filename FROM customer UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier)")
def concat_filename(spark, sf_dir):
    return joins.concat_files(
        {n: read(spark, sf_dir, n).select(F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nationkey")) for n, p in (("customer", "c"), ("supplier", "s"))}
    )


# Cleaning

_COPIED = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 4 = 0"


@query(f"SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM ({_COPIED})")
def dedup_rows(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    t = t.withColumn("row_id", F.lit(0)).unionByName(t.where("l_orderkey % 4 = 0").withColumn("row_id", F.lit(1)))
    return rows.keep_first(t, "row_id").drop("row_id")


def _holes(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 2 != 0, F.col("o_custkey")).alias("a"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("b"), F.when(k % 5 == 0, F.col("o_totalprice")).alias("c")
    )


_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS b, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS c FROM orders"


@query(f"SELECT * FROM ({_HOLES}) WHERE ((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT) / 4.0 < 0.7")
def drop_sparse_rows(spark, sf_dir):
    return rows.drop_sparse_rows(_holes(spark, sf_dir))


@query(f"SELECT o_orderkey, a, b FROM ({_HOLES})")
def drop_sparse_columns(spark, sf_dir):
    return rows.drop_sparse_columns(_holes(spark, sf_dir))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_repeated_columns(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("copy"), "o_totalprice")
    return rows.drop_repeated_columns(t, "o_orderkey")


_TOKENS = "['N/A', 'null', 'ok', '--', ' 12 ', 'ERROR', 'Unknown', '***', 'a-b', '']"


@query(
    f"WITH t AS (SELECT event_id, ({_TOKENS})[(event_id % 10 + 1)::INT] AS s FROM events) SELECT event_id, "
    "CASE WHEN trim(s) IN ('UNKNOWN', 'ERROR', 'N/A', 'NULL', '', 'nan', 'NaN', 'NA', 'None', 'NONE', '#', '%', '&', '^', '@', '!', ')', '(', '*', '~', 'unknown', 'Unknown') "
    "OR NOT regexp_matches(s, '[A-Za-z0-9]') THEN NULL ELSE s END AS s FROM t"
)
def token_nulls(spark, sf_dir):
    words = F.array(*[F.lit(x) for x in ("N/A", "null", "ok", "--", " 12 ", "ERROR", "Unknown", "***", "a-b", "")])
    return read(spark, sf_dir, "events").select("event_id", rows.tokens_to_null(F.element_at(words, (F.col("event_id") % 10 + 1).cast("int"))).alias("s"))


@query(r"""SELECT p_partkey, regexp_replace('[' || p_name || ']! "' || p_brand || '"?', '[|~()\[\]{}"''`!?+]', '', 'g') AS s FROM part""")
def special_symbols(spark, sf_dir):
    s = F.concat(F.lit("["), "p_name", F.lit('"]! "').substr(2, 5), "p_brand", F.lit('"?'))
    return read(spark, sf_dir, "part").select("p_partkey", rows.strip_symbols(s).alias("s"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE (event_id % 100)::VARCHAR END AS v FROM events")
def mixed_clean(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise((F.col("event_id") % 100).cast("string"))
    return rows.clean_mixed(read(spark, sf_dir, "events").select("event_id", v.alias("v")), "v")


@query(r"SELECT page_id, regexp_matches(url, '^(https?|ftp)://[^\s/?#]+') AS is_url FROM pages")
def url_detect(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", places.is_a("url", F.col("url")).alias("is_url"))


@query(r"SELECT avg((regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9#_./-]*$') AND regexp_matches(c_name, '[A-Za-z]') AND regexp_matches(c_name, '[0-9]'))::INT) AS share FROM customer")
def id_like_share(spark, sf_dir):
    return read(spark, sf_dir, "customer").agg(F.avg(numbers.id_like(F.col("c_name")).cast("int")).alias("share"))


@query("SELECT avg(length(text)) > 50 AND avg(len(string_split(text, ' '))) > 5 AS long_text FROM documents")
def long_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(((F.avg(F.length("text")) > 50) & (F.avg(F.size(F.split("text", " "))) > 5)).alias("long_text"))


# Imputation: every seventh price is missing

_GAPS = "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice) END AS v FROM orders"


def _gaps(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.round("o_totalprice")).alias("v"))


def _fill_query(how: str) -> None:
    value = {"mean": "avg(v)", "median": "median(v)", "mode": "(SELECT v FROM t WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)"}[how]
    agg = f"SELECT {value} AS f FROM t" if how != "mode" else f"SELECT {value} AS f"

    @query(f"WITH t AS ({_GAPS}), f AS ({agg}) SELECT o_orderkey, o_orderpriority, round_even(coalesce(v, f), 4) AS v FROM t, f", f"impute_{how}")
    def run(spark, sf_dir):
        return impute.fill_with(_gaps(spark, sf_dir), "v", how).withColumn("v", F.bround("v", 4))


for _how in ("mean", "median", "mode"):
    _fill_query(_how)


@query(
    f"WITH t AS ({_GAPS}), g AS (SELECT o_orderpriority AS p, median(v) AS m FROM t GROUP BY 1), a AS (SELECT median(v) AS m FROM t) "
    "SELECT o_orderkey, o_orderpriority, coalesce(v, g.m, a.m) AS v FROM t LEFT JOIN g ON o_orderpriority IS NOT DISTINCT FROM p, a"
)
def impute_group_median(spark, sf_dir):
    return impute.fill_group_median(_gaps(spark, sf_dir), "v", "o_orderpriority").select("o_orderkey", "o_orderpriority", "v")


_W = "OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN {})"


@query(
    f"WITH t AS ({_GAPS}) SELECT o_orderkey, o_orderpriority, coalesce(last_value(v IGNORE NULLS) {_W.format('UNBOUNDED PRECEDING AND CURRENT ROW')}, "
    f"first_value(v IGNORE NULLS) {_W.format('CURRENT ROW AND UNBOUNDED FOLLOWING')}) AS v FROM t"
)
def ffill_bfill(spark, sf_dir):
    return impute.fill_from_neighbours(_gaps(spark, sf_dir), "v", "o_orderkey", ["o_orderpriority"])


@query(
    f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM ({_GAPS})), "
    "k AS (SELECT *, CASE WHEN v IS NOT NULL THEN r END AS kr FROM t), "
    f"n AS (SELECT *, last_value(v IGNORE NULLS) {_W.format('UNBOUNDED PRECEDING AND CURRENT ROW')} AS v0, last_value(kr IGNORE NULLS) {_W.format('UNBOUNDED PRECEDING AND CURRENT ROW')} AS r0, "
    f"first_value(v IGNORE NULLS) {_W.format('CURRENT ROW AND UNBOUNDED FOLLOWING')} AS v1, first_value(kr IGNORE NULLS) {_W.format('CURRENT ROW AND UNBOUNDED FOLLOWING')} AS r1 FROM k) "
    "SELECT o_orderkey, o_orderpriority, round_even(coalesce(v, v0 + (v1 - v0) * ((r - r0) / nullif(r1 - r0, 0)::DOUBLE), v0, v1), 4) AS v FROM n"
)
def interpolate(spark, sf_dir):
    return impute.interpolate(_gaps(spark, sf_dir), "v", "o_orderkey", ["o_orderpriority"]).withColumn("v", F.bround("v", 4))


# Exact quantiles: all columns of a table by selection, and of groups of very different sizes.

_QUANTILE_COLUMNS = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round_even(quantile_cont({c}::DOUBLE, 0.05), 6) AS p05, round_even(median({c}::DOUBLE), 6) AS p50, round_even(quantile_cont({c}::DOUBLE, 0.999), 6) AS p999 FROM lineitem" for c in _QUANTILE_COLUMNS))
def exact_quantiles(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    found = quantiles.exact_quantile_columns(t, {c: F.col(c) for c in _QUANTILE_COLUMNS}, (0.05, 0.5, 0.999))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.bround(q[i], 6).alias(n) for i, n in enumerate(("p05", "p50", "p999"))]) for c, q in found.items()])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


@query(
    "WITH t AS (SELECT CASE WHEN l_linenumber > 2 THEN 0 ELSE l_suppkey END AS g, l_extendedprice::DOUBLE AS v FROM lineitem) "
    "SELECT g, count(*) AS n, round_even(quantile_cont(v, 0.25), 4) AS q1, round_even(median(v), 4) AS q2, round_even(quantile_cont(v, 0.75), 4) AS q3 FROM t GROUP BY g"
)
def group_quantiles(spark, sf_dir):
    g = F.when(F.col("l_linenumber") > 2, 0).otherwise(F.col("l_suppkey"))
    out = quantiles.group_quantiles(read(spark, sf_dir, "lineitem").select(g.alias("g"), "l_extendedprice"), ["g"], F.col("l_extendedprice"))
    return out.select("g", "n", *[F.bround(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


# The same fills where many rows have equal order; a group holds a fifth of all rows.

_TIED = "SELECT o_orderkey AS k, o_orderpriority AS g, o_orderdate AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS v FROM orders"
_WT = "OVER (PARTITION BY g ORDER BY d, k ROWS BETWEEN {})"


def _tied(spark, sf_dir) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("g"), F.col("o_orderdate").alias("d"), v.alias("v"))


@query(
    f"WITH t AS ({_TIED}) SELECT k, g, d, coalesce(last_value(v IGNORE NULLS) {_WT.format('UNBOUNDED PRECEDING AND CURRENT ROW')}, "
    f"first_value(v IGNORE NULLS) {_WT.format('CURRENT ROW AND UNBOUNDED FOLLOWING')}) AS v FROM t"
)
def ffill_bfill_ties(spark, sf_dir):
    return impute.fill_from_neighbours(_tied(spark, sf_dir), "v", "d", ["g"])


@query(
    f"WITH t AS ({_TIED}), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, k) AS r FROM t), i AS (SELECT *, CASE WHEN v IS NOT NULL THEN r END AS kr FROM n), "
    f"b AS (SELECT *, last_value(v IGNORE NULLS) {_WT.format('UNBOUNDED PRECEDING AND CURRENT ROW')} AS v0, last_value(kr IGNORE NULLS) {_WT.format('UNBOUNDED PRECEDING AND CURRENT ROW')} AS r0, "
    f"first_value(v IGNORE NULLS) {_WT.format('CURRENT ROW AND UNBOUNDED FOLLOWING')} AS v1, first_value(kr IGNORE NULLS) {_WT.format('CURRENT ROW AND UNBOUNDED FOLLOWING')} AS r1 FROM i) "
    "SELECT k, g, d, round_even(coalesce(v, v0 + (v1 - v0) * ((r - r0) / nullif(r1 - r0, 0)::DOUBLE), v0, v1), 8) AS v FROM b"
)
def interpolate_ties(spark, sf_dir):
    return impute.interpolate(_tied(spark, sf_dir), "v", "d", ["g"]).withColumn("v", F.bround("v", 8))


@query("WITH t AS (SELECT o_orderkey AS k, o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT k, d, n FROM t")
def seq_numeric_ties(spark, sf_dir):
    """A running number by date; a fifth of it was lost."""
    by_date = ordered.with_numbers(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d")), "d")
    lost = by_date.select("k", "d", F.when((F.col("k") % 5 != 0) | (F.col("__r") == 1), F.col("__r")).alias("n"))
    return impute.fill_sequence(lost, "n", "d")


@query(
    "WITH w AS (SELECT o_orderkey AS k, o_orderpriority AS g, avg(o_totalprice) OVER () AS m, coalesce(sum(o_totalprice) OVER p, 0) AS s, count(o_totalprice) OVER p AS n FROM orders "
    "WINDOW p AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT k, g, round_even((s + m) / (n + 1), 2) AS enc FROM w"
)
def ordered_target_ties(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("g"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("y"))
    return features.ordered_target_encoded(t, "g", "y", "d").select("k", "g", F.bround("g_enc", 2).alias("enc"))


@query(
    "WITH t AS (SELECT o_orderkey AS k, o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) "
    "SELECT k, d FROM t WHERE floor((r + 1) * 150 / greatest(n, 150)::DOUBLE) > floor(r * 150 / greatest(n, 150)::DOUBLE)"
)
def evenly_spaced_ties(spark, sf_dir):
    return metrics.evenly_spaced(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d")), "d", 150)


@query("SELECT c_custkey, c_custkey AS n FROM customer")
def seq_numeric(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select("c_custkey", F.when((F.col("c_custkey") % 9 != 0) | (F.col("c_custkey") == 0), F.col("c_custkey")).alias("n"))
    return impute.fill_sequence(t, "n", "c_custkey")


@query("SELECT c_custkey, 'EMP' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS code FROM customer")
def seq_text(spark, sf_dir):
    code = F.concat(F.lit("EMP"), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    t = read(spark, sf_dir, "customer").select("c_custkey", F.when((F.col("c_custkey") % 9 != 0) | (F.col("c_custkey") == 0), code).alias("code"))
    return impute.fill_text_sequence(t, "code", "c_custkey")


@query("SELECT o_orderkey, month(o_orderdate)::INTEGER AS m, week(o_orderdate)::INTEGER AS w, quarter(o_orderdate)::INTEGER AS q FROM orders")
def rederive_parts(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", *[impute.calendar_part(p, d).alias(a) for p, a in (("month", "m"), ("week", "w"), ("quarter", "q"))])


@query(
    "SELECT o_orderkey, (make_date(2023, (o_orderkey % 12 + 1)::INT, 1) + (least(31, day(last_day(make_date(2023, (o_orderkey % 12 + 1)::INT, 1)))) - 1)::INT)::DATE AS d FROM orders"
)
def date_clamp(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", impute.clamped_date(F.lit(2023), (F.col("o_orderkey") % 12 + 1).cast("int"), F.lit(31)).alias("d"))


# Features


@query(
    "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 100000 AND 120000 THEN 3 WHEN o_orderstatus IS DISTINCT FROM 'O' THEN 2 WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS target FROM orders"
)
def target_rules(spark, sf_dir):
    rules = [
        {"column": "o_totalprice", "op": ">", "value": 150000},
        {"column": "o_orderstatus", "op": "!=", "value": "O", "output": 2},
        {"column": "o_totalprice", "op": "between", "value": 100000, "value2": 120000, "output": 3},
    ]
    return read(spark, sf_dir, "orders").select("o_orderkey", features.target_by_rules(rules).alias("target"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS target FROM orders")
def target_expr(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", features.target_by_expression(o, "o_totalprice > 1000 and o_orderstatus = 'F'").alias("target"))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS l_returnflag_A, (l_returnflag = 'N')::INT AS l_returnflag_N, (l_returnflag = 'R')::INT AS l_returnflag_R FROM lineitem")
def onehot(spark, sf_dir):
    return features.one_hot(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag").drop("l_returnflag")


@query(
    "WITH p AS (SELECT avg(o_totalprice) AS m FROM orders), s AS (SELECT o_orderpriority AS k, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT o_orderkey, round_even((s + 10 * m) / (n + 10), 4) AS enc FROM orders JOIN s ON k = o_orderpriority, p"
)
def target_enc(spark, sf_dir):
    out = features.target_encoded(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderkey", F.bround("o_orderpriority_enc", 4).alias("enc"))


@query("WITH s AS (SELECT o_orderpriority AS k, count(*) / (SELECT count(*) FROM orders) AS f FROM orders GROUP BY 1) SELECT o_orderkey, f AS freq FROM orders JOIN s ON k = o_orderpriority")
def freq_enc(spark, sf_dir):
    return features.frequency_encoded(read(spark, sf_dir, "orders"), "o_orderpriority").select("o_orderkey", F.col("o_orderpriority_freq").alias("freq"))


@query(
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, (isodow(o_orderdate) - 1)::INTEGER AS wd, "
    "round_even(sin(month(o_orderdate) * (2 * 3.141592653589793 / 12)), 6) + 0.0 AS ms FROM orders"
)
def date_features(spark, sf_dir):
    out = features.date_parts(read(spark, sf_dir, "orders"), "o_orderdate")
    return out.select("o_orderkey", *[F.col(f"o_orderdate_{a}").alias(b) for a, b in (("year", "y"), ("month", "m"), ("day", "d"), ("weekday", "wd"), ("month_sin", "ms"))])


@query("SELECT event_id, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, round_even(cos(hour(ts) * (2 * 3.141592653589793 / 24)), 6) + 0.0 AS hc FROM events")
def time_cyclic(spark, sf_dir):
    out = features.time_parts(read(spark, sf_dir, "events"), "ts")
    return out.select("event_id", F.col("ts_hour").alias("h"), F.col("ts_minute").alias("mi"), F.col("ts_hour_cos").alias("hc"))


for _how, _expr in {
    "z_score": "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()",
    "min_max": "(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())",
    "robust": "(l_quantity - quantile_cont(l_quantity, 0.5) OVER ()) / (quantile_cont(l_quantity, 0.75) OVER () - quantile_cont(l_quantity, 0.25) OVER ())",
    "decimal": "l_quantity / pow(10, ceil(log10(max(abs(l_quantity)) OVER () + 1e-12)))",
}.items():

    @query(f"SELECT l_orderkey, l_linenumber, round_even({_expr}, 6) AS v FROM lineitem", f"scale_{_how}")
    def _scale(spark, sf_dir, how=_how):
        out = features.scaled(read(spark, sf_dir, "lineitem"), "l_quantity", how)
        return out.select("l_orderkey", "l_linenumber", F.bround("l_quantity_scaled", 6).alias("v"))


@query(
    "WITH j AS (SELECT 'l_linestatus' AS feature, l_linestatus::VARCHAR AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL "
    "SELECT 'l_linenumber', l_linenumber::VARCHAR, l_returnflag, count(*) FROM lineitem GROUP BY ALL), "
    "t AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j) "
    "SELECT feature, round_even(sum(n / a * ln(n * a / (nx * ny))), 8) AS mi FROM t GROUP BY 1"
)
def mi_discrete(spark, sf_dir):
    return features.mutual_information(read(spark, sf_dir, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def class_freq(spark, sf_dir):
    return features.class_counts(read(spark, sf_dir, "orders"), "o_orderstatus")


# Metrics


@query("SELECT quality AS label, 1 - toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(read(spark, sf_dir, "labels").withColumn("said", 1 - F.col("toxic")), "quality", "said")


@query(
    "WITH r AS (SELECT quality AS y, 1 - toxic AS p FROM labels), c AS (SELECT c, (SELECT count(*) FROM r WHERE y = c)::DOUBLE AS t, (SELECT count(*) FROM r WHERE p = c)::DOUBLE AS s, "
    "(SELECT count(*) FROM r WHERE p = c AND y = c)::DOUBLE AS h FROM (VALUES (0), (1)) v(c)), "
    "m AS (SELECT *, coalesce(h / nullif(s, 0), 0) AS pr, coalesce(h / nullif(t, 0), 0) AS re FROM c), f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM m), "
    "a AS (SELECT sum(t) AS n, sum(h) AS h, sum(t * s) AS ts, sum(t * t) AS tt, sum(s * s) AS ss, avg(pr) AS pm, avg(re) AS rm, avg(f1) AS fm, sum(pr * t) / sum(t) AS pw, sum(f1 * t) / sum(t) AS fw FROM f) "
    "SELECT round_even(h / n, 8) AS accuracy, round_even(1 - h / n, 8) AS hamming_loss, round_even((n * h - ts) / (sqrt(n * n - ss) * sqrt(n * n - tt)), 8) AS mcc, "
    "round_even((h / n - ts / (n * n)) / (1 - ts / (n * n)), 8) AS kappa, round_even(rm, 8) AS balanced_accuracy, round_even(pm, 8) AS precision_macro, round_even(rm, 8) AS recall_macro, "
    "round_even(fm, 8) AS f1_macro, round_even(pw, 8) AS precision_weighted, round_even(fw, 8) AS f1_weighted FROM a"
)
def clf_metrics(spark, sf_dir):
    out = metrics.classification_metrics(read(spark, sf_dir, "labels").withColumn("said", 1 - F.col("toxic")), "quality", "said")
    return out.select("accuracy", "hamming_loss", "mcc", "kappa", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "f1_weighted")


@query(
    "WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) "
    "SELECT round_even(avg(abs(e)), 6) AS mae, round_even(avg(e * e), 0) AS mse, round_even(sqrt(avg(e * e)), 6) AS rmse, round_even(median(abs(e)), 6) AS median_ae, "
    "round_even(1 - sum(e * e) / (var_pop(y) * count(y)), 6) AS r2, round_even(1 - var_pop(e) / var_pop(y), 6) AS explained_variance, round_even(avg(abs(e) / abs(y)), 6) AS mape, "
    "round_even(avg(2 * abs(e) / (abs(y) + abs(p))), 6) AS smape, round_even(avg(e), 6) AS residual_mean, round_even(stddev_pop(e), 6) AS residual_std FROM r"
)
def reg_metrics(spark, sf_dir):
    out = metrics.regression_metrics(read(spark, sf_dir, "lineitem").withColumn("said", F.col("l_quantity") * 1500), "l_extendedprice", "said")
    return out.withColumn("mse", F.bround("mse", 0))  # beyond that it depends on the order of summation


# Types, plans, streams and models


def _messy(spark, sf_dir):
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(
        F.concat(q.cast("string"), F.when(F.col("l_linenumber") % 3 == 0, F.lit(" lb")).otherwise(F.lit(" kg"))).alias("weight"),
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("cost"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("shipped"),
        F.concat((F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("off"),
        F.col("l_returnflag").alias("flag"),
    )


_MESSY_SQL = (
    "SELECT l_quantity || CASE WHEN l_linenumber % 3 = 0 THEN ' lb' ELSE ' kg' END AS weight, '$' || format('{:,.2f}', l_extendedprice) AS cost, strftime(l_shipdate, '%d/%m/%Y') AS shipped, (l_discount * 100)::INT || '%' AS off, l_returnflag AS flag FROM lineitem"
)


@query(
    f"WITH t AS ({_MESSY_SQL}) SELECT 'weight' AS column_name, CASE WHEN avg(regexp_matches(weight, '^[0-9.]+ (kg|lb)$')::INT) >= 0.5 THEN 'weight' ELSE 'text' END AS kind FROM t "
    "UNION ALL SELECT 'cost', CASE WHEN avg(regexp_matches(cost, '^[$][0-9.,]+$')::INT) >= 0.5 THEN 'currency' ELSE 'text' END FROM t UNION ALL SELECT 'shipped', CASE WHEN avg(regexp_matches(shipped, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$')::INT) >= 0.5 THEN 'date' ELSE 'text' END FROM t "
    "UNION ALL SELECT 'off', CASE WHEN avg(regexp_matches(off, '^[0-9]+%$')::INT) >= 0.5 THEN 'percentage' ELSE 'text' END FROM t UNION ALL SELECT 'flag', CASE WHEN avg(regexp_matches(flag, '^[A-Z]$')::INT) >= 0.5 THEN 'text' ELSE 'varchar' END FROM t"
)
def semantic_choice(spark, sf_dir):
    found = detect.semantic_types(_messy(spark, sf_dir))
    return spark.createDataFrame([(c, k) for c, (k, _) in found.items()], "column_name string, kind string")


@query(
    'SELECT round_even(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 0.45359237 ELSE l_quantity END, 2) AS "weight_(kg)", round_even(l_extendedprice, 2) AS "cost_(USD)", '
    "l_shipdate::DATE AS shipped, round_even(trunc(l_discount * 100) / 100.0, 4) AS off_percentage, l_returnflag AS flag FROM lineitem"
)
def clean_messy(spark, sf_dir):
    t = _messy(spark, sf_dir)
    return cleaning.apply(t, cleaning.decide(t))


@query(
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2"
)
def window_counts(spark, sf_dir):
    return events.window_counts(read(spark, sf_dir, "events"), "ts", "event_type", "value")


def _priced(spark, sf_dir):
    t = read(spark, sf_dir, "orders").withColumn("large", (F.col("o_totalprice") > 150000).cast("int")).withColumn("m", F.month("o_orderdate"))
    return features.split(t.withColumn("half", F.col("o_totalprice") + 1000 * F.col("m")), "o_orderkey")


@query()
def train_predict_lr(spark, sf_dir):
    t = _priced(spark, sf_dir)
    model = models.train(t.where("not is_test"), "large", ["half", "m"], ["o_orderpriority"], "logistic_regression", "classification")
    return models.predict(model, t.where("is_test"), ["o_orderkey", "large"])


@query()
def ensemble_vote(spark, sf_dir):
    t = _priced(spark, sf_dir)
    some = [models.train(t.where("not is_test"), "large", ["half", "m"], [], m, "classification") for m in ("logistic_regression", "decision_tree")]
    return models.vote(some, t.where("is_test"), "o_orderkey", "classification")
