"""Registered queries of operators that decide about, or change, whole tables, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import temporal
from millrace.operators import charts, detect, features, impute, inclusion, inputs, metrics, mixed, models, overview, ranges, rows, sketches, structure
from millrace.plans import cleaning, imputation, steps
from millrace.queries import query, read

# Detection: columns built from orders, told by rules

_DETECT = {
    "odds": ("concat(o_orderkey % 90, ':', o_orderkey % 60)", "(o_orderkey % 90) || ':' || (o_orderkey % 60)"),
    "clock": ("format_string('%02d:%02d', o_orderkey % 24, o_orderkey % 60)", "lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0')"),
    "flag": ("cast(o_orderkey % 2 AS string)", "(o_orderkey % 2)::VARCHAR"),
    "birth_year": ("cast(1950 + o_orderkey % 60 AS string)", "(1950 + o_orderkey % 60)::VARCHAR"),
    "paid": ("CASE WHEN o_orderkey % 2 = 0 THEN concat('$', o_orderkey % 100) ELSE date_format(o_orderdate, 'dd-MM-yyyy') END", "CASE WHEN o_orderkey % 2 = 0 THEN '$' || (o_orderkey % 100) ELSE strftime(o_orderdate, '%d-%m-%Y') END"),
    "load": ("concat(o_orderkey % 50, CASE WHEN o_orderkey % 3 = 0 THEN ' lb' ELSE ' kg' END)", "(o_orderkey % 50) || CASE WHEN o_orderkey % 3 = 0 THEN ' lb' ELSE ' kg' END"),
    "income": ("CASE WHEN o_orderkey % 2 = 0 THEN 'a_b' ELSE '_?_' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'a_b' ELSE '_?_' END"),
    "code": ("concat('AB', o_orderkey)", "'AB' || o_orderkey"),
    "sparse_day": ("CASE WHEN o_orderkey % 4 = 3 THEN date_format(o_orderdate, 'dd-MM-yyyy') END", "CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%d-%m-%Y') END"),
}


def _detect_table(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*[f"{s} AS {c}" for c, (s, _) in _DETECT.items()])


_SHARE = "avg(regexp_matches({0}, '{1}')::INT)"


@query(
    "WITH t AS (SELECT " + ", ".join(f"{d} AS {c}" for c, (_, d) in _DETECT.items()) + " FROM orders) "
    "SELECT 'odds' AS column_name, CASE WHEN sum((split_part(odds, ':', 1)::INT > 23 OR split_part(odds, ':', 2)::INT > 59)::INT) > count(*) / 2 THEN 'ratio' ELSE 'time' END AS kind FROM t "
    "UNION ALL SELECT 'clock', CASE WHEN sum((split_part(clock, ':', 1)::INT > 23 OR split_part(clock, ':', 2)::INT > 59)::INT) > count(*) / 2 THEN 'ratio' ELSE 'time' END FROM t "
    "UNION ALL SELECT 'flag', CASE WHEN bool_and(flag IN ('0', '1')) AND count(DISTINCT flag) = 2 THEN 'boolean' ELSE 'integer' END FROM t "
    "UNION ALL SELECT 'birth_year', CASE WHEN avg((birth_year::INT BETWEEN 1900 AND 2100)::INT) > 0.7 THEN 'year' ELSE 'integer' END FROM t "
    f"UNION ALL SELECT 'paid', CASE WHEN {_SHARE.format('paid', '^[$]')} > 0.2 AND {_SHARE.format('paid', '^[0-9]{2}-[0-9]{2}-[0-9]{4}$')} > 0.2 THEN 'mixed' ELSE 'text' END FROM t "
    f"UNION ALL SELECT 'load', CASE WHEN {_SHARE.format('load', '^[0-9]+ (kg|lb)$')} >= 0.5 THEN 'weight' ELSE 'text' END FROM t "
    f"UNION ALL SELECT 'income', CASE WHEN {_SHARE.format('income', '[0-9]')} > 0 THEN 'text' ELSE 'currency' END FROM t "
    f"UNION ALL SELECT 'code', CASE WHEN {_SHARE.format('code', '^[A-Z]+[0-9]+$')} >= 0.5 THEN 'varchar' ELSE 'text' END FROM t "
    f"UNION ALL SELECT 'sparse_day', CASE WHEN {_SHARE.format('sparse_day', '^[0-9]{2}-[0-9]{2}-[0-9]{4}$')} >= 0.5 THEN 'date' ELSE 'text' END FROM t"
)
def detect_rules(spark, sf_dir):
    found = detect.semantic_types(_detect_table(spark, sf_dir))
    return spark.createDataFrame([(c, k) for c, (k, _) in found.items()], "column_name string, kind string")


@query("SELECT 'weight' AS kind, CASE WHEN count(*) FILTER (l_linenumber % 3 = 0) > count(*) FILTER (l_linenumber % 3 = 1) THEN 'lb' ELSE 'kg' END AS unit FROM lineitem")
def units_in_strings(spark, sf_dir):
    q = F.col("l_quantity").cast("string")
    s = F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit(" lb"))).when(F.col("l_linenumber") % 3 == 1, F.concat(q, F.lit(" kg"))).otherwise(q)
    return spark.createDataFrame([detect.units_in_strings(read(spark, sf_dir, "lineitem").select(s.alias("w")), "w")], "kind string, unit string")


@query(
    "WITH t AS (SELECT unnest(['v', 'w']) AS column_name, unnest([CASE event_id % 3 WHEN 0 THEN (event_id % 50)::VARCHAR WHEN 1 THEN 'true' ELSE event_type END, event_id::VARCHAR]) AS s FROM events) "
    "SELECT column_name, count(*) AS n, count(*) FILTER (regexp_matches(s, '^[0-9]+$')) AS n_number, count(*) FILTER (s IN ('true', 'false')) AS n_boolean, 0::BIGINT AS n_date, "
    "count(*) FILTER (NOT regexp_matches(s, '^[0-9]+$') AND s NOT IN ('true', 'false')) AS n_text, count(DISTINCT CASE WHEN regexp_matches(s, '^[0-9]+$') THEN 'n' WHEN s IN ('true', 'false') THEN 'b' ELSE 't' END) > 1 AS mixed FROM t GROUP BY 1"
)
def mixed_kinds(spark, sf_dir):
    k = F.col("event_id")
    v = F.when(k % 3 == 0, (k % 50).cast("string")).when(k % 3 == 1, "true").otherwise(F.col("event_type"))
    return rows.mixed_kinds(read(spark, sf_dir, "events").select(v.alias("v"), k.cast("string").alias("w")))


# Structure: the cascade of rules in SQL, column by column

_TYPES = {
    "customer": {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "int", "c_mktsegment": "str"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "int", "o_orderdate": "time", "o_orderpriority": "str"},
    "part": {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "int"},
    "nation": {"n_nationkey": "int", "n_name": "str", "n_regionkey": "int"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
}


def _facts_sql(table: str, column: str, kind: str) -> str:
    s, digits = f"trim({column}::VARCHAR)", f"regexp_extract(trim({column}::VARCHAR), '([0-9]{{1,15}})$', 1)"
    return (
        f"SELECT '{table}' AS t, '{column}' AS c, '{kind}' AS k, count(*) AS n, count({column}) AS known, count(DISTINCT {s}) AS dist, count(DISTINCT {s}) / count(*)::DOUBLE AS ratio, "
        f"bool_and(lower({s}) IN ('true', 't', 'yes', 'y', '1', 'on', 'active', 'enabled', 'false', 'f', 'no', 'n', '0', 'off', 'inactive', 'disabled')) AS bools, "
        f"avg((regexp_matches({s}, '^[A-Za-z0-9][A-Za-z0-9#_./-]*$') AND regexp_matches({s}, '[A-Za-z]') AND regexp_matches({s}, '[0-9]'))::INT) AS ids, avg(length({s})) AS len, "
        f"count(DISTINCT regexp_replace({s}, '[0-9]+$', '')) = 1 AND count(nullif({digits}, '')) = count({column}) AND count(DISTINCT {s}) = count({column}) "
        f"AND max(nullif({digits}, '')::DOUBLE) - min(nullif({digits}, '')::DOUBLE) + 1 = count({column}) AS seq, "
        + (f"min({column})::DOUBLE AS low, max({column})::DOUBLE AS high" if kind == "int" else "NULL::DOUBLE AS low, NULL::DOUBLE AS high")
        + f" FROM {table}"
    )


_CASCADE = (
    "CASE WHEN dist BETWEEN 1 AND 2 AND bools THEN 'categorical' WHEN regexp_matches(c, '^(.*_)?(id|no|num|number|key|code|pk|idx)$') AND ratio > 0.95 THEN 'identifier' WHEN seq AND ratio >= 0.9 THEN 'identifier' "
    "WHEN k = 'time' THEN 'datetime' WHEN k = 'int' AND low >= 1000 AND high <= 2100 THEN 'numeric' WHEN k = 'int' THEN CASE WHEN dist <= 20 AND ratio <= 0.2 THEN 'categorical' ELSE 'numeric' END "
    "WHEN ids > 0.7 AND ratio > 0.95 THEN 'identifier' WHEN dist <= 50 AND ratio <= 0.5 THEN 'categorical' WHEN len > 30 OR ratio > 0.9 THEN 'text' ELSE 'categorical' END"
)


def _facts_of(*tables: str) -> str:
    return " UNION ALL ".join(_facts_sql(t, c, k) for t in tables for c, k in _TYPES[t].items())


@query(f"SELECT t AS table_name, c AS column_name, {_CASCADE} AS structural_type FROM ({_facts_of('customer', 'orders', 'part')})")
def structural_types(spark, sf_dir):
    found = [(n, c, k) for n in ("customer", "orders", "part") for c, k in structure.structural_types(read(spark, sf_dir, n))]
    return spark.createDataFrame(found, "table_name string, column_name string, structural_type string")


@query(
    f"WITH f AS (SELECT *, {_CASCADE} AS kind FROM ({_facts_of('nation', 'labels', 'part')})) SELECT 'primary' AS kind, t AS table_name, c AS column_name FROM f WHERE kind = 'identifier' "
    "UNION ALL SELECT 'unique', t, c FROM f WHERE dist = n UNION ALL SELECT 'foreign', t, c FROM f WHERE c IN (SELECT c FROM f GROUP BY c HAVING count(DISTINCT t) > 1)"
)
def constraints(spark, sf_dir):
    found = structure.constraints({n: read(spark, sf_dir, n) for n in ("nation", "labels", "part")})
    return spark.createDataFrame(found, "kind string, table_name string, column_name string")


@query(
    f"WITH f AS (SELECT *, {_CASCADE} AS kind FROM ({_facts_of('orders')})) SELECT CASE WHEN kind = 'numeric' THEN 'histogram' WHEN dist <= 12 THEN 'pie' ELSE 'bar' END AS kind, c AS x FROM f "
    "WHERE kind = 'numeric' OR (kind = 'categorical' AND dist <= 20)"
)
def chart_plan(spark, sf_dir):
    facts = structure.column_facts(read(spark, sf_dir, "orders"))
    plan = charts.default_charts([(c.name, structure.structural_type(c)) for c in facts], {c.name: c.distinct for c in facts})
    return spark.createDataFrame([(c.kind, c.x) for c in plan], "kind string, x string")


@query("SELECT n_name AS x, sum(n_nationkey)::DOUBLE AS y FROM nation GROUP BY 1")
def lookup_sum(spark, sf_dir):
    """Each name once: the bars of a lookup table show its first number."""
    return overview.bar_counts(read(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey"), "n_name")


@query("SELECT o_orderpriority AS x, count(*)::DOUBLE AS y FROM orders GROUP BY 1 ORDER BY y DESC, x LIMIT 15")
def bar_counts(spark, sf_dir):
    return overview.bar_counts(read(spark, sf_dir, "orders"), "o_orderpriority")


# Overview


@query(
    "SELECT false AS has_missing_values, false AS has_duplicates, false AS has_mixed_types, list_sort(list(c)) AS potential_id_columns FROM "
    "(SELECT 'p_partkey' AS c, count(DISTINCT p_partkey) / count(*) AS r FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) / count(*) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) / count(*) FROM part) WHERE r > 0.95"
)
def dataset_flags(spark, sf_dir):
    return overview.dataset_flags(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"))


@query(
    "SELECT 'n_name' AS column_name, (SELECT list(n_name ORDER BY n_nationkey)[1:5] FROM nation) AS sample_values UNION ALL SELECT 'n_nationkey', (SELECT list(n_nationkey::VARCHAR ORDER BY n_nationkey)[1:5] FROM nation) "
    "UNION ALL SELECT 'n_regionkey', (SELECT list(n_regionkey::VARCHAR ORDER BY n_nationkey)[1:5] FROM nation)"
)
def sample_values(spark, sf_dir):
    return overview.sample_values(read(spark, sf_dir, "nation"), "n_nationkey")


@query("SELECT 'doc_id' AS column_name FROM labels HAVING count(DISTINCT doc_id) = count(*)")
def primary_keys(spark, sf_dir):
    return overview.primary_keys(read(spark, sf_dir, "labels"))


@query(
    "WITH a AS (SELECT min(o_totalprice) AS a, quantile_cont(o_totalprice, 0.25) AS b, median(o_totalprice) AS c, avg(o_totalprice) AS d, quantile_cont(o_totalprice, 0.75) AS e, max(o_totalprice) AS f FROM orders) "
    "SELECT unnest(['min', 'q25', 'median', 'mean', 'q75', 'max']) AS name, round_even(unnest([a, b, c, d, e, f]), 4) AS value FROM a"
)
def column_data_numeric(spark, sf_dir):
    return overview.column_data(read(spark, sf_dir, "orders"), "o_totalprice", "numeric").withColumn("value", F.col("value").cast("double"))


@query("SELECT p_brand AS name, count(*)::VARCHAR AS value FROM part GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 20")
def column_data_categorical(spark, sf_dir):
    return overview.column_data(read(spark, sf_dir, "part"), "p_brand", "categorical")


_TWICE = "SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders"


@query(
    f"WITH t AS ({_TWICE}), u AS (SELECT DISTINCT * FROM t WHERE s IS NOT NULL) SELECT (SELECT count(*) FROM t) AS rows_before, (SELECT count(*) FROM u) AS rows_after, (SELECT count(*) FROM t WHERE s IS NULL) AS missing_before, 0::BIGINT AS missing_after, "
    "(SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicates_removed, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) - (SELECT count(*) FROM u) AS rows_dropped"
)
def overview_totals(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s"))
    return overview.totals(overview.dataset_metadata("orders", t, t.where("s is not null").distinct()))


@query(
    "SELECT 'o_totalprice' AS feature, 'numeric' AS kind, min(o_totalprice) AS min, max(o_totalprice) AS max, round_even(avg(o_totalprice), 6) AS mean, round_even(stddev_samp(o_totalprice), 6) AS std, NULL::VARCHAR[] AS options FROM orders "
    "UNION ALL SELECT 'o_orderpriority', 'categorical', NULL, NULL, NULL, NULL, list(v ORDER BY n DESC, v)[1:50] FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)"
)
def training_stats(spark, sf_dir):
    return overview.training_stats(read(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderpriority"])


@query(
    "WITH j AS (SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS p, count(DISTINCT c_name) AS c FROM orders JOIN customer ON o_custkey = c_custkey) "
    "SELECT 'o_totalprice' AS column_name, 'numeric' AS kind UNION ALL SELECT 'o_orderpriority', CASE WHEN p <= greatest(20, 0.05 * n) THEN 'categorical' ELSE 'text' END FROM j UNION ALL SELECT 'c_name', CASE WHEN c <= greatest(20, 0.05 * n) THEN 'categorical' ELSE 'text' END FROM j"
)
def joined_kinds(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return overview.joined_kinds(o.join(c, o.o_custkey == c.c_custkey).select("o_totalprice", "o_orderpriority", "c_name"))


# Imputation

_HOLED = (
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 25 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 7)::INT END AS few, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS word, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN month(o_orderdate)::INT END AS month_no, o_orderdate AS d, CASE WHEN o_orderkey % 9 <> 0 OR o_orderkey = 0 THEN o_orderkey END AS seq, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus || o_orderkey END AS tag FROM orders"
)
_KINDS = {"price": "currency", "few": "integer", "word": "text", "month_no": "month", "seq": "integer", "tag": "text"}


def _holed(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 25 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 3 != 0, (k % 7).cast("int")).alias("few"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("word"),
        F.when(k % 5 != 0, F.month("o_orderdate")).alias("month_no"), F.col("o_orderdate").alias("d"), F.when((k % 9 != 0) | (k == 0), k).alias("seq"), F.when(k % 6 != 0, F.concat("o_orderstatus", k.cast("string"))).alias("tag"),
    )


@query(
    f"WITH t AS ({_HOLED}), s AS (SELECT count(*) AS n, 1 - count(price) / count(*) AS pn, count(DISTINCT price) AS pd, 1 - count(few) / count(*) AS fn, count(DISTINCT few) AS fd, count(DISTINCT word) AS wd, count(DISTINCT tag) AS td, "
    "count(seq) >= 0.5 * (max(seq) - min(seq) + 1) AND count(DISTINCT seq) = count(seq) AS sq FROM t) "
    "SELECT 'price' AS column_name, CASE WHEN pn <= 0.05 AND pd > 5 THEN 'median' ELSE 'other' END AS method, false AS flag FROM s "
    "UNION ALL SELECT 'few', CASE WHEN fn > 0.25 AND fn <= 0.6 AND fd <= 10 THEN 'mode' ELSE 'other' END, fn > 0.25 FROM s UNION ALL SELECT 'word', CASE WHEN wd / n < 0.5 THEN 'mode' ELSE 'unknown' END, false FROM s "
    "UNION ALL SELECT 'month_no', 'derive', false FROM s UNION ALL SELECT 'seq', CASE WHEN sq THEN 'sequence' ELSE 'other' END, false FROM s UNION ALL SELECT 'tag', CASE WHEN td / n < 0.5 THEN 'mode' ELSE 'unknown' END, false FROM s"
)
def impute_plan(spark, sf_dir):
    plan = imputation.decide(_holed(spark, sf_dir), _KINDS)
    return spark.createDataFrame([(f.column, f.method, f.flag) for f in plan], "column_name string, method string, flag boolean")


@query(
    f"WITH t AS ({_HOLED}) SELECT k, coalesce(price, (SELECT median(price) FROM t)) AS price, coalesce(few, (SELECT few FROM t WHERE few IS NOT NULL GROUP BY few ORDER BY count(*) DESC, few LIMIT 1)) AS few, few IS NULL AS few_missing, "
    "coalesce(word, (SELECT word FROM t WHERE word IS NOT NULL GROUP BY word ORDER BY count(*) DESC, word LIMIT 1)) AS word, coalesce(month_no, month(d)::INT) AS month_no, d, k AS seq, coalesce(tag, 'Unknown') AS tag FROM t"
)
def impute_table(spark, sf_dir):
    return imputation.impute_table(_holed(spark, sf_dir), _KINDS, "k")


_GROUPED = "SELECT o_orderkey AS k, o_orderstatus AS g, CASE WHEN o_orderkey % 20 <> 0 THEN ascii(o_orderstatus) * 1000.0::DOUBLE + o_orderkey % 10 END AS v FROM orders"


@query(
    f"WITH t AS ({_GROUPED}), s AS (SELECT g, avg(v) AS m, var_samp(v) AS w FROM t GROUP BY g) "
    "SELECT CASE WHEN count(*) BETWEEN 2 AND 9 AND min(m) <> max(m) AND avg(w) / (SELECT var_samp(v) FROM t) < 0.7 THEN 'g' END AS grouping FROM s"
)
def impute_grouping(spark, sf_dir):
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderstatus").alias("g"), F.when(k % 20 != 0, F.ascii("o_orderstatus") * 1000.0 + k % 10).alias("v"))
    return spark.createDataFrame([(imputation.grouping_for(t, "v", ["g"]),)], "grouping string")


@query(
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 + 1 > day(last_day(make_date(2023, (o_orderkey % 12 + 1)::INT, 1))) THEN last_day(make_date(2023, (o_orderkey % 12 + 1)::INT, 1)) ELSE make_date(2023, (o_orderkey % 12 + 1)::INT, (o_orderkey % 31 + 1)::INT) END AS d FROM orders"
)
def date_repair(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("k"), imputation.repaired_date(F.format_string("2023-%02d-%02d", k % 12 + 1, k % 31 + 1)).alias("d"))


@query(
    "WITH t AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 END AS s FROM orders), m AS (SELECT floor(median(s))::INT AS s FROM t) "
    "SELECT o_orderkey AS k, lpad((x // 3600)::VARCHAR, 2, '0') || ':' || lpad((x % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((x % 60)::VARCHAR, 2, '0') AS at FROM "
    "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN ((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60)::INT ELSE m.s END AS x FROM orders, m)"
)
def impute_time(spark, sf_dir):
    k = F.col("o_orderkey")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    t = read(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 5 != 0, F.concat(two(k % 24), F.lit(":"), two(k % 60), F.lit(":00"))).alias("at"))
    return imputation.apply(t, imputation.decide(t, {"at": "time"}), "k")


@query(
    "SELECT count(o_orderkey) >= 0.5 * (max(o_orderkey) - min(o_orderkey) + 1) AS numeric_sequence, false AS text_sequence, 'number' AS which FROM orders "
    "UNION ALL SELECT false, count(*) >= 0.5 * (max(o_orderkey) - min(o_orderkey) + 1), 'text' FROM orders UNION ALL SELECT false, false, 'neither' FROM orders HAVING count(*) > 0"
)
def sequence_facts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ORD-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("t"), "o_orderpriority")
    parts = [impute.sequence_facts(o, c).withColumn("which", F.lit(w)) for c, w in (("o_orderkey", "number"), ("t", "text"), ("o_orderpriority", "neither"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Columns that are split


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 END::DOUBLE AS size_value_min, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 + 5 END::DOUBLE AS size_value_max, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 100 END::DOUBLE AS size_value, CASE WHEN o_orderkey % 2 = 1 THEN 'or above' END AS size_text FROM orders")
def split_components(spark, sf_dir):
    k = F.col("o_orderkey")
    size = F.when(k % 2 == 0, F.concat(k % 100, F.lit("-"), k % 100 + 5)).otherwise(F.concat(k % 100, F.lit(" or above")))
    return ranges.split_components(read(spark, sf_dir, "orders").select(k.alias("k"), size.alias("size")), "size")


@query("SELECT o_orderkey AS k, (o_orderkey % 100)::DOUBLE AS size_min, (o_orderkey % 100 + 5)::DOUBLE AS size_max FROM orders")
def split_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    return ranges.split_ranges(read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(k % 100, F.lit(" to "), k % 100 + 5).alias("size")), "size")


@query("SELECT o_orderkey AS k, (o_orderkey % 90)::DOUBLE AS at_latitude, -(o_orderkey % 180)::DOUBLE + 0.0::DOUBLE AS at_longitude FROM orders")
def split_coordinates(spark, sf_dir):
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(k % 90, F.lit(", "), -(k % 180)).alias("at"))
    return ranges.split_coordinates(t, "at").withColumn("at_longitude", F.col("at_longitude") + 0.0)


@query("SELECT o_orderkey AS k, (o_orderkey % 500)::DOUBLE AS cost, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS \"cost_(currency_type)\" FROM orders")
def split_money(spark, sf_dir):
    k = F.col("o_orderkey")
    return ranges.split_money(read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.when(k % 2 == 0, "$").otherwise("€"), k % 500).alias("cost")), "cost")


@query("SELECT o_orderkey AS k, (o_orderkey % 500 + 1)::DOUBLE AS pay, CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END AS pay_time_unit FROM orders")
def split_pay(spark, sf_dir):
    k = F.col("o_orderkey")
    return ranges.split_pay(read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("$"), k % 500 + 1, F.when(k % 2 == 0, " per month").otherwise(" per year")).alias("pay")), "pay")


@query('SELECT o_orderkey AS k, round_even((o_orderkey % 50 + 1) * CASE WHEN o_orderkey % 2 = 0 THEN 2080 * 83.12 ELSE 105.45 END, 2)::DOUBLE AS "pay_(INR_per_year)" FROM orders')
def split_pay_mixed(spark, sf_dir):
    k = F.col("o_orderkey")
    return ranges.split_pay(read(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.when(k % 2 == 0, "$").otherwise("£"), k % 50 + 1, F.when(k % 2 == 0, " per hour").otherwise(" per year")).alias("pay")), "pay")


# Features

@query(
    "WITH p AS (SELECT avg(o_totalprice) AS m FROM orders), s AS (SELECT o_custkey AS k, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), "
    "b AS (SELECT o_orderkey AS k, coalesce(sum(o_totalprice) OVER w, 0) AS s, count(o_totalprice) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_orderdate ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT o.o_orderkey, round_even((s.s + 30 * p.m) / (s.n + 30), 2) AS m_estimate, round_even((b.s + p.m) / (b.n + 1), 2) AS ordered FROM orders o JOIN s ON s.k = o_custkey JOIN b ON b.k = o_orderkey, p"
)
def target_encoders(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    out = features.target_encoded(o, "o_custkey", "o_totalprice", features.M_ESTIMATE)
    out = features.ordered_target_encoded(out, "o_orderdate", "o_totalprice", "o_orderkey")
    return out.select("o_orderkey", F.bround("o_custkey_enc", 2).alias("m_estimate"), F.bround("o_orderdate_enc", 2).alias("ordered"))


@query(
    "WITH t AS (SELECT o_orderkey AS k, o_totalprice AS y, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS two, o_orderpriority AS five, 'c' || (o_orderkey % 40) AS forty, 'd' || (o_orderkey % 150) AS many FROM orders) "
    "SELECT k, y, (two = 'b')::INT AS two_b, (five = '1-URGENT')::INT AS \"five_1-URGENT\", (five = '2-HIGH')::INT AS \"five_2-HIGH\", (five = '3-MEDIUM')::INT AS \"five_3-MEDIUM\", (five = '4-NOT SPECIFIED')::INT AS \"five_4-NOT SPECIFIED\", (five = '5-LOW')::INT AS \"five_5-LOW\", "
    "round_even((sum(y) OVER (PARTITION BY forty) + 10 * avg(y) OVER ()) / (count(*) OVER (PARTITION BY forty) + 10), 2) AS forty_enc, count(*) OVER (PARTITION BY many) / (count(*) OVER ())::DOUBLE AS many_freq FROM t"
)
def encode_table(spark, sf_dir):
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(
        k.alias("k"), F.col("o_totalprice").alias("y"), F.when(k % 2 == 0, "a").otherwise("b").alias("two"), F.col("o_orderpriority").alias("five"), F.concat(F.lit("c"), k % 40).alias("forty"), F.concat(F.lit("d"), k % 150).alias("many")
    )
    out = features.encode(t, features.encoding_plan(t, ["two", "five", "forty", "many"]), "y", "k")
    return out.withColumn("forty_enc", F.bround("forty_enc", 2))


@query("SELECT p_partkey, len(string_split_regex(trim(regexp_replace(lower(p_type), '[^a-z0-9_]+', ' ', 'g')), ' '))::DOUBLE AS words FROM part")
def text_features(spark, sf_dir):
    t = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    out = features.text_features("p_type", "counts", 100).fit(t).transform(t)
    return out.select("p_partkey", F.aggregate(vector_to_array("p_type_vector"), F.lit(0.0), lambda a, x: a + x).alias("words"))


@query(
    "WITH q AS (SELECT quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS a, quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM lineitem), "
    "t AS (SELECT len(list_filter(a, lambda x: x < l_quantity)) AS quantity, l_linenumber AS line, l_returnflag AS flag, len(list_filter(b, lambda x: x < l_extendedprice)) AS y FROM lineitem, q), "
    "j AS (SELECT 'l_quantity' AS feature, quantity::VARCHAR AS x, y, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'l_linenumber', line::VARCHAR, y, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'l_returnflag', flag, y, count(*) FROM t GROUP BY ALL), "
    "w AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS a, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j), m AS (SELECT feature, round_even(sum(n / a * ln(n * a / (nx * ny))), 8) AS mi FROM w GROUP BY 1), "
    "r AS (SELECT feature, round_even(mi / max(mi) OVER (), 6) AS score FROM m), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, feature)::INT AS rank FROM r) SELECT * FROM o WHERE rank = 1 OR (score >= 0.01 AND rank <= 10)"
)
def ranked_features(spark, sf_dir):
    return features.ranked_features(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber", "l_returnflag"], "l_extendedprice")


@query("SELECT o_orderpriority, is_test, CASE WHEN is_test THEN ceil(0.2 * n) ELSE n - ceil(0.2 * n) END::BIGINT AS n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (SELECT unnest([true, false]) AS is_test)")
def split_counts(spark, sf_dir):
    return features.split(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority").groupBy("o_orderpriority", "is_test").agg(F.count(F.lit(1)).alias("n"))


# Metrics

_SAID = "SELECT l_linenumber % 4 AS y, (l_linenumber + (l_orderkey % 3 = 0)::INT) % 4 AS p FROM lineitem"


def _said(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).alias("y"), ((F.col("l_linenumber") + (F.col("l_orderkey") % 3 == 0).cast("int")) % 4).alias("p"))


_CLASSES = (
    f"WITH r AS ({_SAID}), c AS (SELECT c, (SELECT count(*) FROM r WHERE y = c)::DOUBLE AS t, (SELECT count(*) FROM r WHERE p = c)::DOUBLE AS s, (SELECT count(*) FROM r WHERE p = c AND y = c)::DOUBLE AS h, (SELECT count(*) FROM r)::DOUBLE AS n FROM (VALUES (0), (1), (2), (3)) v(c)), "
    "m AS (SELECT *, h / s AS pr, h / t AS re FROM c), k AS (SELECT c, t, h, s, n, pr, re, 2 * pr * re / (pr + re) AS f1, 5 * pr * re / (4 * pr + re) AS f2, h / (t + s - h) AS ja, (n - t - s + h) / (n - t) AS sp FROM m) "
)


@query(_CLASSES + "SELECT c::BIGINT AS class, t::BIGINT AS support, round_even(pr, 8) AS precision, round_even(re, 8) AS recall, round_even(f1, 8) AS f1, round_even(f2, 8) AS f2, round_even(ja, 8) AS jaccard, round_even(sp, 8) AS specificity FROM k")
def per_class_metrics(spark, sf_dir):
    return metrics.per_class(_said(spark, sf_dir), "y", "p").withColumn("class", F.col("class").cast("long"))


@query(_CLASSES + "SELECT round_even(sum(h) / sum(s), 8) AS precision_micro, round_even(sum(h) / sum(t), 8) AS recall_micro, round_even(avg(f2), 8) AS f2_macro, round_even(avg(ja), 8) AS jaccard_macro, round_even(avg(sp), 8) AS specificity_macro, round_even(sum(re * t) / sum(t), 8) AS recall_weighted FROM k")
def more_metrics(spark, sf_dir):
    return metrics.classification_metrics(_said(spark, sf_dir), "y", "p").select("precision_micro", "recall_micro", "f2_macro", "jaccard_macro", "specificity_macro", "recall_weighted")


_SCORED = "SELECT (l_orderkey % 3 = 0)::INT AS y, round(l_quantity / 50 + (l_orderkey % 3 = 0)::INT * 0.2::DOUBLE, 2) AS s FROM lineitem"


def _scored(spark, sf_dir) -> DataFrame:
    y = (F.col("l_orderkey") % 3 == 0).cast("int")
    return read(spark, sf_dir, "lineitem").select(y.alias("y"), F.round(F.col("l_quantity") / 50 + y * 0.2, 2).alias("s"))


@query(
    f"WITH b AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM ({_SCORED}) GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) "
    "SELECT round_even(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 8)::DOUBLE AS roc_auc FROM r"
)
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir), "y", "s")


@query(
    f"WITH b AS (SELECT s, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS c FROM ({_SCORED}) GROUP BY 1), r AS (SELECT p, sum(p) OVER w AS tp, sum(c) OVER w AS said FROM b WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) "
    "SELECT round_even(sum(p * tp / said) / sum(p), 8) AS pr_auc FROM r"
)
def pr_auc(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), "y", "s")


@query(f"SELECT round_even(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 8) AS log_loss FROM (SELECT y, least(greatest(s / 1.3, 1e-15), 1 - 1e-15) AS q FROM ({_SCORED}))")
def log_loss(spark, sf_dir):
    return metrics.log_loss(_scored(spark, sf_dir).withColumn("q", F.col("s") / 1.3), "y", "q")


@query("SELECT round_even(avg((y IN (a, (a + 1) % 5, (a + 2) % 5))::INT), 8) AS top_k_accuracy FROM (SELECT l_linenumber % 5 AS y, l_orderkey % 5 AS a FROM lineitem)")
def top_k_accuracy(spark, sf_dir):
    a = F.col("l_orderkey") % 5  # class a is the likeliest, then the following ones
    scores = F.array(*[F.lit(1.0) - ((F.lit(i) - a + 5) % 5) * 0.1 for i in range(5)])
    return metrics.top_k_accuracy(read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 5).alias("y"), scores.alias("s")), "y", "s")


@query(
    "WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), a AS (SELECT count(*) AS n, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((ln(1 + p) - ln(1 + y)) ** 2)) AS e FROM r) "
    "SELECT round_even(1 - (1 - r2) * (n - 1) / (n - 4), 6) AS adjusted_r2, round_even(e, 6) AS rmsle FROM a"
)
def regression_extras(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return metrics.regression_extras(t, "l_extendedprice", "p", 3)


@query("WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM t WHERE floor((r + 1) * 200 / greatest(n, 200)::DOUBLE) > floor(r * 200 / greatest(n, 200)::DOUBLE)")
def evenly_spaced(spark, sf_dir):
    return metrics.evenly_spaced(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


# Inputs of a model, and steps


@query(
    "WITH s AS (SELECT max(o_totalprice) AS b FROM orders) SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'price above ' || printf('%g', b) END, CASE WHEN o_orderkey % 7 = 0 THEN 'status unseen: new' END], lambda x: x IS NOT NULL) AS warnings FROM orders, s"
)
def input_warnings(spark, sf_dir):
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(k, F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    stats = overview.training_stats(t, ["price"], ["status"])
    given = t.withColumn("price", F.when(k % 10 == 0, 1e9).otherwise(F.col("price"))).withColumn("status", F.when(k % 7 == 0, "new").otherwise(F.col("status")))
    return inputs.warnings(given, stats).select("o_orderkey", "warnings")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Diesel' WHEN 1 THEN 'Diesel' WHEN 2 THEN '0' ELSE 'petrol' END AS v FROM orders")
def canonical_values(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.when(k % 4 == 0, "Diesel").when(k % 4 == 1, "diesel ").when(k % 4 == 2, "0.0").otherwise("petrol")
    return read(spark, sf_dir, "orders").select("o_orderkey", inputs.canonical(v, ["Diesel", "0"]).alias("v"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100)::DOUBLE END AS number, CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS flag FROM orders")
def coerced_inputs(spark, sf_dir):
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "none").otherwise((k % 100).cast("string")).alias("number"), F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("?").alias("flag"))
    return inputs.coerced(t, {"number": "numeric", "flag": "boolean"})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE (o_orderkey % 100)::VARCHAR END AS v, round_even(o_orderkey % 100 + 0.125, 2)::DOUBLE AS f, (o_orderkey % 100) AS i FROM orders")
def forced_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    n = (k % 100).cast("string")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", rows.blank_leftovers(F.when(k % 2 == 0, "n/a").otherwise(n)).alias("v"), rows.forced_numeric(F.concat(n, F.lit(".125")), "float", True).alias("f"), rows.forced_numeric(F.concat(n, F.lit(".0")), "integer", True).alias("i")
    )


@query(
    "WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS z FROM orders), d AS (SELECT n, z, z / n >= 0.7 AS sparse FROM c) "
    "SELECT 0::INT AS nth, 'drop_empty_rows' AS step, 'done' AS state, 6::INT AS columns, n AS rows, z AS nulls FROM d "
    "UNION ALL SELECT 1, 'drop_sparse_columns', 'done', CASE WHEN sparse THEN 5 ELSE 6 END, n, CASE WHEN sparse THEN 0 ELSE z END FROM d "
    "UNION ALL SELECT 2, 'drop_sparse_rows', 'done', CASE WHEN sparse THEN 5 ELSE 6 END, n, CASE WHEN sparse THEN 0 ELSE z END FROM d"
)
def step_log(spark, sf_dir):
    t = read(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")))
    out, log = steps.run(t, ["drop_empty_rows", "drop_sparse_columns", "drop_sparse_rows"])
    out.write.format("noop").mode("overwrite").save()  # the user's action; rows and nulls are observed meanwhile
    return steps.log_table(spark, log, after_action=True).select("nth", "step", "state", "columns", "rows", "nulls")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def drop_identifiers(spark, sf_dir):
    """Identifiers by structure go; the key comes back to tell the rows."""
    t = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    left = inputs.drop_identifiers(t)
    return inputs.project(t, ["p_partkey", *left.columns])


# Inclusion of columns, and columns that hold more than one kind

_KEYED = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
}


def _inclusion_sql() -> str:
    number = "coalesce(CASE WHEN {0} = floor({0}) THEN ({0})::BIGINT::VARCHAR END, ({0})::DOUBLE::VARCHAR)"
    texts = {"r_name", "n_name", "s_name", "c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority"}
    token = lambda c: f"'s' || {c}" if c in texts else f"'d' || {c}::VARCHAR" if c == "o_orderdate" else "'n' || " + number.format(c)
    values = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {token(c)} AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in _KEYED.items() for c in cs)
    return (
        f"WITH a AS ({values}), v AS (SELECT t, c, v, count(*) AS n FROM a GROUP BY ALL), f AS (SELECT t, c, count(*) AS k, max(n) = 1 AS is_key FROM v GROUP BY ALL), "
        "p AS (SELECT x.t AS t, x.c AS c, y.t AS u, y.c AS d, count(*) AS both FROM v x JOIN v y ON x.v = y.v AND (x.t, x.c) <> (y.t, y.c) GROUP BY ALL) "
        "SELECT p.t AS child_table, p.c AS child_column, u AS parent_table, d AS parent_column, g.k AS child_values, f.k AS parent_values, f.is_key AS parent_is_key "
        "FROM p JOIN f g ON g.t = p.t AND g.c = p.c AND g.k = p.both JOIN f ON f.t = u AND f.c = d"
    )


@query(_inclusion_sql())
def inclusion_dependencies(spark, sf_dir):
    return inclusion.inclusion_dependencies({t: read(spark, sf_dir, t).select(*cs) for t, cs in _KEYED.items()})


_MIXED_UNITS = "CASE o_orderkey % 10 WHEN 0 THEN (o_orderkey % 40) || ' kg' WHEN 1 THEN (o_orderkey % 7) || ' kg' WHEN 2 THEN (o_orderkey % 9 + 1) || ' lb' WHEN 3 THEN 'n/a' ELSE (o_orderkey % 50)::VARCHAR END"


@query(f"SELECT k, CASE WHEN v LIKE '%kg' THEN printf('%.1f', split_part(v, ' ', 1)::DOUBLE) WHEN v LIKE '%lb' THEN round_even(split_part(v, ' ', 1)::DOUBLE * 0.45359237, 2)::DOUBLE::VARCHAR WHEN v = 'n/a' THEN '' ELSE v END AS v FROM (SELECT o_orderkey AS k, {_MIXED_UNITS} AS v FROM orders)")
def mixed_units(spark, sf_dir):
    """Numbers beside numbers with units: the unit of most strings wins, the others are converted to it."""
    t = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", _MIXED_UNITS.replace("(o_orderkey % 50)::VARCHAR", "cast(o_orderkey % 50 AS string)") + " AS v")
    return mixed.clean_mixed(t, "v")[0]


@query(
    "SELECT o_orderkey::DOUBLE AS k, CASE o_orderkey % 10 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS rating, o_orderkey % 2 = 0 AS open, "
    "CASE o_orderkey % 10 WHEN 0 THEN o_orderkey % 40 WHEN 1 THEN o_orderkey % 7 WHEN 2 THEN round_even((o_orderkey % 9 + 1) * 0.45359237, 2) WHEN 3 THEN NULL ELSE o_orderkey % 50 END::DOUBLE AS \"load_(kg)\" FROM orders"
)
def clean_by_all_values(spark, sf_dir):
    """Types that rest on all values: a rating of 0, 1 and some 2 stays a number, yes and no is boolean, numbers with units become numbers."""
    k = F.col("o_orderkey")
    t = read(spark, sf_dir, "orders").select(
        k.cast("double").alias("k"), F.when(k % 10 == 0, "2").when(k % 10 == 1, "0").otherwise("1").alias("rating"), F.when(k % 2 == 0, "yes").otherwise("No").alias("open"),
        F.when(k % 10 == 0, F.concat(k % 40, F.lit(" kg"))).when(k % 10 == 1, F.concat(k % 7, F.lit(" kg"))).when(k % 10 == 2, F.concat(k % 9 + 1, F.lit(" lb"))).when(k % 10 == 3, "n/a").otherwise((k % 50).cast("string")).alias("load"),
    )
    return cleaning.apply(t, cleaning.decide(t)).select(F.col("k").cast("double").alias("k"), F.col("rating").cast("int").alias("rating"), "open", "load_(kg)")


# Profiles that merge, boosting for several classes


@query(
    "SELECT column_name, rows, nulls, low, high FROM (SELECT 'o_totalprice' AS column_name, count(*) AS rows, count(*) - count(o_totalprice) AS nulls, min(o_totalprice)::DOUBLE AS low, max(o_totalprice)::DOUBLE AS high FROM orders "
    "UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), NULL, NULL FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE FROM orders)"
)
def merged_profiles(spark, sf_dir):
    """Sketches of each month, merged: the exact parts here, estimates are held against exact ones in tests."""
    o = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice", "o_orderpriority", "o_custkey")
    return sketches.estimates(sketches.merged(sketches.sketched(o, by=["month"]))).select("column_name", "rows", "nulls", "low", "high")


@query(
    "WITH t AS (SELECT l_linenumber % 3 AS y, [CASE WHEN l_linenumber % 3 = 0 THEN 0.5 ELSE 0.2 END + (l_orderkey % 7) / 100, CASE WHEN l_linenumber % 3 = 1 THEN 0.4 ELSE 0.3 END - (l_partkey % 5) / 100, 0.1 + (l_suppkey % 9) / 100] AS p FROM lineitem), "
    "e AS (SELECT y, unnest([0, 1, 2]) AS c, unnest(p) AS s FROM t), b AS (SELECT c, s, sum((y = c)::INT) AS pos, sum((y <> c)::INT) AS neg FROM e GROUP BY c, s), "
    "r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b), "
    "k AS (SELECT c, sum(pos) AS n, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc FROM r GROUP BY c) "
    "SELECT round_even(avg(roc), 8) AS roc_auc_macro, round_even(sum(roc * n) / sum(n), 8) AS roc_auc_weighted, (SELECT round_even(avg(-ln(p[y + 1])), 8) FROM t) AS log_loss FROM k"
)
def several_class_metrics(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    p = F.array(
        F.when(n == 0, 0.5).otherwise(0.2) + (F.col("l_orderkey") % 7) / 100, F.when(n == 1, 0.4).otherwise(0.3) - (F.col("l_partkey") % 5) / 100, F.lit(0.1) + (F.col("l_suppkey") % 9) / 100
    )
    out = metrics.multiclass_metrics(read(spark, sf_dir, "lineitem").select(n.alias("y"), p.alias("p")), "y", "p")
    return out.select("roc_auc_macro", "roc_auc_weighted", "log_loss")


@query()
def boosted_three_classes(spark, sf_dir):
    """Large, middle and small orders from the month and half the price, by boosted trees; predictions of the held-out rows."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), (F.col("o_totalprice") * (1 + F.col("o_orderkey") % 3)).alias("x"), F.col("o_orderpriority").alias("p"), ((F.col("o_totalprice") > 120000).cast("int") + (F.col("o_totalprice") > 300000).cast("int")).alias("y"))
    t = features.split(o, "o_orderkey", "y")
    model = models.train(t.where("not is_test"), "y", ["m", "x"], ["p"], "boosted_trees", "classification")
    return models.predict(model, t.where("is_test"), ["o_orderkey", "y"])


# Times that follow another column: hours from six to fourteen by a number

_TIMED = "SELECT o_orderkey AS k, o_orderkey % 997 / 997.0::DOUBLE AS x, 21600 + floor(28800 * (o_orderkey % 997 / 997.0::DOUBLE)) AS s FROM orders"


@query(
    f"WITH t AS ({_TIMED}), m AS (SELECT regr_slope(sin(s * pi() / 43200), x) AS a, regr_intercept(sin(s * pi() / 43200), x) AS b, regr_slope(cos(s * pi() / 43200), x) AS c, regr_intercept(cos(s * pi() / 43200), x) AS d FROM t WHERE k % 4 <> 0), "
    "f AS (SELECT k, CASE WHEN k % 4 <> 0 THEN s ELSE round((atan2(a * x + b, c * x + d) + 2 * pi()) % (2 * pi()) * 43200 / pi()) END::BIGINT AS s FROM t, m) "
    "SELECT k, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS at FROM f"
)
def times_by_model(spark, sf_dir):
    k = F.col("o_orderkey")
    x = (k % 997) / F.lit(997.0)
    t = read(spark, sf_dir, "orders").select(k.cast("string").alias("k"), x.alias("x"), F.when(k % 4 != 0, temporal.time_text(21600 + F.floor(28800 * x))).alias("at"))
    out = imputation.apply(t, imputation.decide(t, {"k": "text", "x": "float", "at": "time"}), "k")
    return out.select(F.col("k").cast("long").alias("k"), "at")
