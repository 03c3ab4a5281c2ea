"""SQL-surface acceptance queries.

The library adds no SQL operators of its own: joins, aggregates, windows, set
operations and functions are Spark SQL text run by ``sqlrun.run`` over the
registered datasets.  One query per construct family shows the text reaches
Spark intact through the pipeline (flat scans for the TPC-H tables,
a view with the day over the flat `events`).  Queries avoid unbounded per-group work:
window partitions and collected arrays are bounded by the data model
(lines per order, orders per customer, event types per user).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import SparkSession

from . import fixtures as fx
from . import register
from .common import BANDS_DUCK, DUCK_EV, EV_VIEW, flat, run_sql, tpch


def _sql(name: str, spark_sql: str, duck_sql: str | None, tables: tuple[str, ...] = (),
         events: bool = False, extra: Callable[[SparkSession, str], dict] | None = None) -> None:
    def fn(spark: SparkSession, sf: str):
        ds = tpch(sf, *tables)
        kw = extra(spark, sf) if extra else {}
        if events:
            ds.append(flat(sf, "events"))
            kw["views"] = [EV_VIEW, *kw.get("views", [])]
        text = spark_sql.replace("{SF}", sf)
        return run_sql(spark, ds, text, **kw)
    fn.__name__ = name
    register(name, duck_sql)(fn)


# ----------------------------------------------------------- sources
_sql("sql_direct_file",
     "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty "
     "FROM parquet.`{SF}/lineitem.parquet` GROUP BY 1, 2",
     "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS sum_qty "
     "FROM lineitem GROUP BY 1, 2", ("region",))

_sql("sql_values",
     "SELECT s.label, COUNT(*) AS n FROM orders o JOIN "
     "(VALUES ('F', 'fulfilled'), ('O', 'open'), ('P', 'partial')) AS s(code, label) "
     "ON o.o_orderstatus = s.code GROUP BY s.label",
     "SELECT s.label, COUNT(*) AS n FROM orders o JOIN "
     "(VALUES ('F', 'fulfilled'), ('O', 'open'), ('P', 'partial')) AS s(code, label) "
     "ON o.o_orderstatus = s.code GROUP BY s.label", ("orders",))

# Lines are counted before the join: one row per line number is shuffled.
_RANGE_JOIN = ("WITH per AS (SELECT l_linenumber, COUNT(l_orderkey) AS n FROM lineitem GROUP BY l_linenumber) "
               "SELECT CAST(r.id AS BIGINT) AS line_no, COALESCE(p.n, 0) AS n "
               "FROM range(1, 9) r{ID} LEFT JOIN per p ON p.l_linenumber = r.id")
_sql("sql_range", _RANGE_JOIN.replace("{ID}", ""), _RANGE_JOIN.replace("{ID}", "(id)"), ("lineitem",))


def _csv_view(spark: SparkSession, sf: str) -> dict:
    path = fx.part_csv(spark, sf)
    return {"views": [{"name": "part_csv", "sql":
                       "CREATE TEMPORARY VIEW part_csv (p_partkey BIGINT, p_name STRING, "
                       "p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE) "
                       f"USING csv OPTIONS (path '{path}', header 'true')"}]}


_sql("sql_view_using_csv",
     "SELECT p_type, COUNT(*) AS n, MAX(p_retailprice) AS max_price, "
     "CAST(SUM(p_size) AS BIGINT) AS sum_size FROM part_csv GROUP BY p_type",
     "SELECT p_type, COUNT(*) AS n, MAX(p_retailprice) AS max_price, "
     "CAST(SUM(p_size) AS BIGINT) AS sum_size FROM part GROUP BY p_type",
     ("region",), extra=_csv_view)

# -------------------------------------------------- projection, filter
_PRED = ("SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders "
         "WHERE (o_orderstatus IN ('F', 'P') OR o_totalprice BETWEEN 100000 AND 200000) "
         "AND o_orderpriority LIKE '%HIGH%' AND NOT (o_custkey IS NULL) "
         "GROUP BY o_orderpriority, o_orderstatus")
_sql("sql_predicates", _PRED, _PRED, ("orders",))

_CASE = ("SELECT CASE WHEN l_discount >= 0.08 THEN 'deep' WHEN l_discount >= 0.04 THEN 'mid' "
         "ELSE 'none' END AS band, IF(l_tax > 0.04, 'taxed', 'light') AS tax_band, "
         "COALESCE(NULLIF(l_returnflag, 'N'), 'none') AS flag, COUNT(*) AS n "
         "FROM lineitem GROUP BY 1, 2, 3")
_sql("sql_case", _CASE, _CASE, ("lineitem",))

_DISTINCT = "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"
_sql("sql_distinct", _DISTINCT, _DISTINCT, ("orders",))

_CTE = ("WITH big AS (SELECT o_custkey, o_orderpriority FROM orders "
        "WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)) "
        "SELECT o_orderpriority, COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS customers "
        "FROM big GROUP BY o_orderpriority")
_sql("sql_cte_scalar", _CTE, _CTE, ("orders",))

# ---------------------------------------------------------------- joins
_SEMI = ("SELECT c_mktsegment, COUNT(*) AS n FROM customer c "
         "WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) "
         "AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey "
         "AND o.o_orderstatus = 'F') GROUP BY c_mktsegment")
_sql("sql_semi_join", _SEMI, _SEMI, ("customer", "orders"))

_ANTI = ("SELECT c_mktsegment, COUNT(*) AS n FROM customer c WHERE NOT EXISTS "
         "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) "
         "GROUP BY c_mktsegment")
_sql("sql_anti_join", _ANTI, _ANTI, ("customer", "orders"))

# The many side of an outer join is counted before the join, so that no hot
# key meets in one task.
_LEFT = ("WITH big AS (SELECT o_custkey, COUNT(o_orderkey) AS n_big FROM orders "
         "WHERE o_totalprice > 450000 GROUP BY o_custkey) "
         "SELECT c.c_custkey, c.c_mktsegment, COALESCE(b.n_big, 0) AS n_big "
         "FROM customer c LEFT JOIN big b ON b.o_custkey = c.c_custkey")
_sql("sql_left_join", _LEFT, _LEFT, ("customer", "orders"))

_RIGHT = ("WITH per AS (SELECT s_nationkey, COUNT(s_suppkey) AS n FROM supplier "
          "WHERE s_acctbal > 5000 GROUP BY s_nationkey) "
          "SELECT n.n_name, COALESCE(p.n, 0) AS suppliers FROM per p "
          "RIGHT JOIN nation n ON p.s_nationkey = n.n_nationkey")
_sql("sql_right_join", _RIGHT, _RIGHT, ("supplier", "nation"))

_FULL = ("WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n_big FROM orders "
         "WHERE o_totalprice > 450000 GROUP BY o_custkey), "
         "b AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING') "
         "SELECT COALESCE(a.k, b.k) AS k, a.n_big, b.c_acctbal FROM a FULL OUTER JOIN b ON a.k = b.k")
_sql("sql_full_join", _FULL, _FULL, ("customer", "orders"))

_THETA = ("SELECT o.o_orderpriority, COUNT(*) AS n FROM orders o JOIN customer c "
          "ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40 "
          "GROUP BY o.o_orderpriority")
_sql("sql_theta_join", _THETA, _THETA, ("orders", "customer"))

_LATERAL = ("SELECT c.c_custkey, t.n_orders, t.max_price FROM customer c, "
            "LATERAL (SELECT COUNT(*) AS n_orders, MAX(o.o_totalprice) AS max_price "
            "FROM orders o WHERE o.o_custkey = c.c_custkey) t")
_sql("sql_lateral_join", _LATERAL, _LATERAL, ("customer", "orders"))

_INTERVAL = ("SELECT o.o_orderpriority, COUNT(*) AS n FROM orders o JOIN lineitem l "
             "ON l.l_orderkey = o.o_orderkey "
             "AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '60' DAY "
             "GROUP BY o.o_orderpriority")
_sql("sql_interval_join", _INTERVAL, _INTERVAL, ("orders", "lineitem"))

# Balances against bands without an equal key: bands as wide as three of their
# mean distances, so that the matches grow with the table and not its square.
# Both sides get a bin of a band's width to meet in.
_sql("sql_range_bins",
     "WITH w AS (SELECT CAST(33000 AS DOUBLE) / COUNT(*) AS width FROM supplier), "
     "b AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + (SELECT width FROM w) AS hi FROM supplier), "
     "s AS (SELECT s_suppkey, lo, hi, explode(sequence(floor(lo / (SELECT width FROM w)), "
     "floor(hi / (SELECT width FROM w)))) AS bin FROM b), "
     "c AS (SELECT c_custkey, c_acctbal, floor(c_acctbal / (SELECT width FROM w)) AS bin FROM customer) "
     "SELECT s.s_suppkey, COUNT(*) AS n, MIN(c.c_acctbal) AS least, MAX(c.c_custkey) AS last_key "
     "FROM c JOIN s ON c.bin = s.bin AND c.c_acctbal >= s.lo AND c.c_acctbal < s.hi GROUP BY s.s_suppkey",
     BANDS_DUCK, ("customer", "supplier"))

# ---------------------------------------------------------- aggregation
_AGGF = ("SELECT l_returnflag, COUNT(*) FILTER (WHERE l_discount > 0.05) AS n_disc, "
         "ROUND(SUM(l_quantity) FILTER (WHERE l_tax > 0.04), 2) AS q_taxed, "
         "MIN(l_extendedprice) AS min_price, MAX(l_extendedprice) AS max_price, "
         "ROUND(AVG(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY l_returnflag")
_sql("sql_agg_filter", _AGGF, _AGGF, ("lineitem",))

_HAVING = ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey "
           "HAVING COUNT(*) >= 15")
_sql("sql_having", _HAVING, _HAVING, ("orders",))

_ROLLUP = ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, "
           "CAST(GROUPING(l_linestatus) AS INT) AS g FROM lineitem "
           "GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_rollup", _ROLLUP, _ROLLUP, ("lineitem",))

_CUBE = ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders "
         "GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_cube", _CUBE, _CUBE, ("orders",))

_GSETS = ("SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer "
          "GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
_sql("sql_grouping_sets", _GSETS, _GSETS, ("customer",))

_sql("sql_pivot",
     "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) "
     "PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
     "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, "
     "COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, "
     "COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority",
     ("orders",))

_sql("sql_unpivot",
     "SELECT l_orderkey, l_linenumber, measure, amount FROM "
     "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem) "
     "UNPIVOT (amount FOR measure IN (l_quantity AS quantity, l_extendedprice AS price))",
     "SELECT l_orderkey, l_linenumber, 'quantity' AS measure, l_quantity AS amount FROM lineitem "
     "UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem",
     ("lineitem",))

# Approximate answers beside the exact ones: within the functions' bounds?
# (a relative standard deviation of 5 % for the sketch, taken four times; a
# rank error of n / 10,000, with the value's rank found by counting)
_sql("sql_approx",
     "WITH a AS (SELECT event_type, COUNT(*) AS n, approx_count_distinct(user_id) AS users, "
     "percentile_approx(value, 0.5) AS median FROM ev GROUP BY event_type), "
     "e AS (SELECT event_type, COUNT(DISTINCT user_id) AS users FROM ev GROUP BY event_type), "
     "r AS (SELECT ev.event_type, SUM(CASE WHEN ev.value <= a.median THEN 1 ELSE 0 END) AS at_most, "
     "SUM(CASE WHEN ev.value < a.median THEN 1 ELSE 0 END) AS under "
     "FROM ev JOIN a ON ev.event_type = a.event_type GROUP BY ev.event_type) "
     "SELECT a.event_type, a.n, ABS(a.users - e.users) <= 0.2 * e.users AS users_near, "
     "r.under <= 0.5 * a.n + a.n / 10000 + 1 AND r.at_most >= 0.5 * a.n - a.n / 10000 - 1 AS median_near "
     "FROM a JOIN e ON a.event_type = e.event_type JOIN r ON a.event_type = r.event_type",
     "SELECT event_type, COUNT(*) AS n, TRUE AS users_near, TRUE AS median_near "
     "FROM events GROUP BY event_type", events=True)

# A day's sketches are kept as binary columns; a week's figures come from them
# alone.  Beside them the exact ones: counts are equal, users within four
# standard errors (1.6 % each), the median's rank within 4 %.
_SKETCHES = [
    {"name": "daily", "sql":
     "CREATE TEMPORARY VIEW daily AS SELECT event_type, event_date, hll_sketch_agg(user_id, 12) AS users, "
     "kll_sketch_agg_double(value) AS amounts FROM ev GROUP BY event_type, event_date"},
    {"name": "weekly", "sql":
     "CREATE TEMPORARY VIEW weekly AS SELECT event_type, CAST(weekofyear(to_date(event_date)) AS INT) AS week, "
     "hll_sketch_estimate(hll_union_agg(users)) AS users, kll_merge_agg_double(amounts) AS amounts "
     "FROM daily GROUP BY 1, 2"}]
_sql("sql_sketch_rollup",
     "WITH a AS (SELECT event_type, week, users, kll_sketch_get_n_double(amounts) AS n, "
     "kll_sketch_get_quantile_double(amounts, CAST(0.5 AS DOUBLE)) AS median FROM weekly), "
     "e AS (SELECT ev.event_type, a.week, COUNT(DISTINCT ev.user_id) AS users, "
     "SUM(CASE WHEN ev.value <= a.median THEN 1 ELSE 0 END) AS at_most, "
     "SUM(CASE WHEN ev.value < a.median THEN 1 ELSE 0 END) AS under FROM ev JOIN a ON ev.event_type = a.event_type "
     "AND CAST(weekofyear(to_date(ev.event_date)) AS INT) = a.week GROUP BY ev.event_type, a.week) "
     "SELECT a.event_type, a.week, a.n, ABS(a.users - e.users) <= 0.065 * e.users + 1 AS users_near, "
     "e.under <= 0.54 * a.n + 1 AND e.at_most >= 0.46 * a.n - 1 AS median_near "
     "FROM a JOIN e ON a.event_type = e.event_type AND a.week = e.week",
     "SELECT event_type, CAST(weekofyear(ts) AS INTEGER) AS week, COUNT(*) AS n, TRUE AS users_near, "
     "TRUE AS median_near FROM events GROUP BY 1, 2", events=True, extra=lambda spark, sf: {"views": _SKETCHES})

_sql("sql_collect",
     "SELECT user_id, array_join(array_sort(collect_set(event_type)), ',') AS types, "
     "COUNT(*) AS n FROM ev GROUP BY user_id",
     f"WITH {DUCK_EV} SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') "
     "AS types, COUNT(*) AS n FROM ev GROUP BY user_id", events=True)

# -------------------------------------------------------------- windows
# Windows are over the lines of an order, whose number the data model bounds.
_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_RANK = ("SELECT l_orderkey, " + _LINE + ", "
         f"CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {_LINE}) AS BIGINT) AS rn, "
         "CAST(RANK() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS BIGINT) AS rk, "
         "CAST(DENSE_RANK() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS BIGINT) AS drk, "
         f"CAST(NTILE(4) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, {_LINE}) AS BIGINT) AS quartile "
         "FROM lineitem")
_sql("sql_window_rank", _RANK, _RANK, ("lineitem",))

_W = f"PARTITION BY l_orderkey ORDER BY l_shipdate, {_LINE}"
_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_LAG = (f"SELECT l_orderkey, {_LINE}, LAG(l_extendedprice) OVER ({_W}) AS prev_price, "
        f"LEAD(l_partkey) OVER ({_W}) AS next_part, "
        f"FIRST_VALUE(l_partkey) OVER ({_W}) AS first_part, "
        f"LAST_VALUE(l_partkey) OVER ({_W} {_WHOLE}) AS last_part, "
        f"NTH_VALUE(l_partkey, 2) OVER ({_W} {_WHOLE}) AS second_part FROM lineitem")
_sql("sql_window_lag", _LAG, _LAG, ("lineitem",))

_LW = ("PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, "
       "l_extendedprice")
_ROWS = ("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
         f"SUM(l_quantity) OVER ({_LW} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS qty_2, "
         f"SUM(l_quantity) OVER ({_LW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
         "AS qty_running FROM lineitem")
_sql("sql_window_rows", _ROWS, _ROWS, ("lineitem",))

_RANGE = (f"SELECT l_orderkey, {_LINE}, COUNT(*) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate "
          "RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS lines_past_month, "
          "ROUND(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice "
          "RANGE BETWEEN 5000 PRECEDING AND 5000 FOLLOWING), 2) AS similar_quantity FROM lineitem")
_sql("sql_window_range", _RANGE, _RANGE, ("lineitem",))

# -------------------------------------------------------- sort / limit
_TOPK = ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
         "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("sql_topk", _TOPK, _TOPK, ("orders",))

_OFFSET = ("SELECT o_orderkey, o_totalprice FROM orders "
           "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
_sql("sql_offset", _OFFSET, _OFFSET, ("orders",))

# LIMIT alone picks no particular rows: how many there are, and that each is
# a row of the table.
_LIMIT = ("WITH picked AS (SELECT l_orderkey, l_linenumber FROM lineitem LIMIT 10) "
          "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE "
          "l.l_orderkey = picked.l_orderkey AND l.l_linenumber = picked.l_linenumber) THEN 1 ELSE 0 END) AS BIGINT) "
          "AS found FROM picked")
_sql("sql_limit", _LIMIT, _LIMIT, ("lineitem",))

# ------------------------------------------------------ set operations
_UNION_ALL = ("SELECT c_nationkey AS nationkey, 'customer' AS side FROM customer "
              "UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
_sql("sql_union_all", _UNION_ALL, _UNION_ALL, ("customer", "supplier"))

_UNION = "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"
_sql("sql_union", _UNION, _UNION, ("customer", "supplier"))

_INTERSECT = ("SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 "
              "INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_sql("sql_intersect", _INTERSECT, _INTERSECT, ("orders", "customer"))

_INTERSECT_ALL = ("SELECT c_nationkey AS k FROM customer "
                  "INTERSECT ALL SELECT s_nationkey FROM supplier")
_sql("sql_intersect_all", _INTERSECT_ALL, _INTERSECT_ALL, ("customer", "supplier"))

_EXCEPT = ("SELECT c_custkey AS k FROM customer EXCEPT "
           "SELECT o_custkey FROM orders WHERE o_totalprice > 450000")
_sql("sql_except", _EXCEPT, _EXCEPT, ("customer", "orders"))

_EXCEPT_ALL = "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"
_sql("sql_except_all", _EXCEPT_ALL, _EXCEPT_ALL, ("customer", "supplier"))

# ------------------------------------------------------------ functions
_sql("sql_string",
     "SELECT c_custkey, upper(c_mktsegment) AS seg_upper, lower(c_name) AS name_lower, "
     "substring(c_name, 1, 8) AS name_prefix, concat(c_mktsegment, '-', CAST(c_nationkey AS STRING)) AS seg_nation, "
     "CAST(length(c_name) AS BIGINT) AS name_len, regexp_replace(c_name, '[0-9]', '#') AS masked, "
     "regexp_extract(c_name, '([0-9]+)$', 1) AS digits, trim(concat('  ', c_mktsegment, ' ')) AS trimmed, "
     "lpad(CAST(c_nationkey AS STRING), 3, '0') AS padded, replace(c_name, 'Customer', 'C') AS short_name "
     "FROM customer",
     "SELECT c_custkey, upper(c_mktsegment) AS seg_upper, lower(c_name) AS name_lower, "
     "substring(c_name, 1, 8) AS name_prefix, concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR)) AS seg_nation, "
     "CAST(length(c_name) AS BIGINT) AS name_len, regexp_replace(c_name, '[0-9]', '#', 'g') AS masked, "
     "regexp_extract(c_name, '([0-9]+)$', 1) AS digits, trim(concat('  ', c_mktsegment, ' ')) AS trimmed, "
     "lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded, replace(c_name, 'Customer', 'C') AS short_name "
     "FROM customer", ("customer",))

_sql("sql_date",
     "SELECT CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS month, "
     "CAST(year(o_orderdate) AS INT) AS yr, CAST(quarter(o_orderdate) AS INT) AS qtr, "
     "COUNT(*) AS n, MIN(CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING)) AS first_due, "
     "MAX(datediff(DATE'2002-01-01', CAST(o_orderdate AS DATE))) AS max_age_days "
     "FROM orders GROUP BY 1, 2, 3",
     "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month, "
     "CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(quarter(o_orderdate) AS INTEGER) AS qtr, "
     "COUNT(*) AS n, MIN(CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR)) AS first_due, "
     "CAST(MAX(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')) AS INTEGER) AS max_age_days "
     "FROM orders GROUP BY 1, 2, 3", ("orders",))

_sql("sql_math",
     "SELECT l_returnflag, "
     "CAST(SUM(CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(15, 2)))) AS DOUBLE) AS revenue, "
     "CAST(SUM(floor(l_quantity / 7)) AS BIGINT) AS sevens, CAST(SUM(ceil(l_extendedprice / 1000)) AS BIGINT) AS thousands, "
     "CAST(SUM(CAST(l_quantity AS BIGINT) % 7) AS BIGINT) AS mod7, ROUND(MAX(sqrt(l_quantity)), 6) AS max_sqrt, "
     "ROUND(MAX(power(l_quantity, 2)), 2) AS max_sq, ROUND(MIN(abs(l_extendedprice - 10000)), 2) AS near_10k "
     "FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, "
     "CAST(SUM(CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(15, 2)))) AS DOUBLE) AS revenue, "
     "CAST(SUM(floor(l_quantity / 7)) AS BIGINT) AS sevens, CAST(SUM(ceil(l_extendedprice / 1000)) AS BIGINT) AS thousands, "
     "CAST(SUM(CAST(l_quantity AS BIGINT) % 7) AS BIGINT) AS mod7, ROUND(MAX(sqrt(l_quantity)), 6) AS max_sqrt, "
     "ROUND(MAX(power(l_quantity, 2)), 2) AS max_sq, ROUND(MIN(abs(l_extendedprice - 10000)), 2) AS near_10k "
     "FROM lineitem GROUP BY l_returnflag", ("lineitem",))

_sql("sql_array",
     "SELECT p_partkey, CAST(size(split(p_name, ' ')) AS BIGINT) AS n_words, "
     "element_at(split(p_name, ' '), 1) AS first_word, "
     "array_join(transform(split(p_name, ' '), w -> upper(w)), '_') AS upper_words, "
     "array_contains(split(p_name, ' '), 'bolt') AS is_bolt FROM part",
     "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n_words, "
     "string_split(p_name, ' ')[1] AS first_word, "
     "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w)), '_') AS upper_words, "
     "list_contains(string_split(p_name, ' '), 'bolt') AS is_bolt FROM part", ("part",))

_sql("sql_array_column",
     "SELECT vec_id, label, CAST(size(embedding) AS BIGINT) AS dim, "
     "element_at(embedding, 1) AS first_value, element_at(embedding, -1) AS last_value FROM embeddings",
     "SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim, "
     "embedding[1] AS first_value, embedding[-1] AS last_value FROM embeddings", ("embeddings",))

_sql("sql_struct",
     "SELECT s.seg AS seg, COUNT(*) AS n, MAX(s.bal) AS max_bal, MIN(s.nation) AS min_nation "
     "FROM (SELECT named_struct('seg', c_mktsegment, 'bal', c_acctbal, 'nation', c_nationkey) AS s "
     "FROM customer) GROUP BY s.seg",
     "SELECT s.seg AS seg, COUNT(*) AS n, MAX(s.bal) AS max_bal, MIN(s.nation) AS min_nation "
     "FROM (SELECT {'seg': c_mktsegment, 'bal': c_acctbal, 'nation': c_nationkey} AS s "
     "FROM customer) GROUP BY s.seg", ("customer",))

_sql("sql_map",
     "SELECT element_at(map('F', 'fulfilled', 'O', 'open', 'P', 'partial'), o_orderstatus) AS status, "
     "COUNT(*) AS n FROM orders GROUP BY 1",
     "SELECT MAP {'F': 'fulfilled', 'O': 'open', 'P': 'partial'}[o_orderstatus] AS status, "
     "COUNT(*) AS n FROM orders GROUP BY 1", ("orders",))

_sql("sql_json",
     "SELECT event_type, CAST(SUM(CAST(get_json_object(props, '$.k') AS INT)) AS BIGINT) AS sum_k, "
     "MAX(from_json(props, 'k INT').k) AS max_k FROM ev GROUP BY event_type",
     f"WITH {DUCK_EV} SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, "
     "MAX(CAST(json_extract(props, '$.k') AS INTEGER)) AS max_k FROM ev GROUP BY event_type",
     events=True)

_sql("sql_explode",
     "SELECT word, COUNT(*) AS n FROM part LATERAL VIEW explode(split(p_name, ' ')) w AS word "
     "GROUP BY word",
     "SELECT word, COUNT(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) "
     "GROUP BY word", ("part",))

# Whole texts are measured below the join, so no text is shuffled.
_TEXT = ("WITH d AS (SELECT doc_id, lang, source, length(text) AS chars, n_chars FROM documents) "
         "SELECT d.lang, d.source, COUNT(*) AS n, "
         "CAST(SUM(d.chars) AS BIGINT) AS chars, CAST(SUM(d.n_chars) AS BIGINT) AS stated_chars, "
         "CAST(SUM(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good, "
         "CAST(SUM(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unlabelled "
         "FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang, d.source")
_sql("sql_text_stats", _TEXT, _TEXT, ("documents", "labels"))

_TURNS = ("SELECT role, COUNT(*) AS turns, COUNT(DISTINCT conv_id) AS conversations, "
          "CAST(SUM(length(text)) AS BIGINT) AS chars, MAX(turn) AS max_turn "
          "FROM conversations GROUP BY role")
_sql("sql_conversation_turns", _TURNS, _TURNS, ("conversations",))

_sql("sql_page_hosts",
     "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, COUNT(*) AS pages, "
     "CAST(SUM(length(html)) AS BIGINT) AS html_chars FROM pages GROUP BY 1",
     "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, COUNT(*) AS pages, "
     "CAST(SUM(length(html)) AS BIGINT) AS html_chars FROM pages GROUP BY 1", ("pages",))

# Turn after turn of every conversation, each step adding to the one before; as
# many steps as the longest has turns, so Spark's limits on both are lifted.
_RECURSIVE = ("WITH RECURSIVE walk(conv_id, turn, steps, chars) AS ("
              "SELECT conv_id, turn, 1, CAST(length(text) AS BIGINT) FROM conversations WHERE turn = 0 "
              "UNION ALL SELECT c.conv_id, c.turn, w.steps + 1, w.chars + length(c.text) "
              "FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1) "
              "SELECT conv_id, CAST(MAX(steps) AS INT) AS steps, MAX(chars) AS chars FROM walk GROUP BY conv_id")
_sql("sql_recursive_cte", _RECURSIVE, _RECURSIVE, ("conversations",),
     extra=lambda spark, sf: {"sparkSessionConfig": {"spark.sql.cteRecursionLevelLimit": "-1",
                                                     "spark.sql.cteRecursionRowLimit": "-1"}})

# ------------------------------------------------- batch time windows
_sql("sql_tumbling",
     "SELECT CAST(CAST(window.start AS TIMESTAMP_NTZ) AS STRING) AS window_start, event_type, "
     "COUNT(*) AS n FROM ev GROUP BY window(ts, '6 hours'), event_type",
     f"WITH {DUCK_EV} SELECT CAST(time_bucket(INTERVAL '6 hours', ts) AS VARCHAR) AS window_start, "
     "event_type, COUNT(*) AS n FROM ev GROUP BY 1, 2", events=True)

_sql("sql_sliding",
     "SELECT CAST(CAST(window.start AS TIMESTAMP_NTZ) AS STRING) AS window_start, COUNT(*) AS n "
     "FROM ev GROUP BY window(ts, '2 hours', '1 hour')",
     f"WITH {DUCK_EV}, s AS (SELECT date_trunc('hour', ts) AS w FROM ev "
     "UNION ALL SELECT date_trunc('hour', ts) - INTERVAL '1 hour' FROM ev) "
     "SELECT CAST(w AS VARCHAR) AS window_start, COUNT(*) AS n FROM s GROUP BY 1", events=True)

_sql("sql_session",
     "SELECT user_id, CAST(CAST(session_window.start AS TIMESTAMP_NTZ) AS STRING) AS session_start, "
     "CAST(CAST(session_window.end AS TIMESTAMP_NTZ) AS STRING) AS session_end, COUNT(*) AS n "
     "FROM ev GROUP BY user_id, session_window(ts, '2 hours')",
     f"WITH {DUCK_EV}, g AS (SELECT user_id, ts, CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) "
     "IS NULL OR ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '2 hours' "
     "THEN 1 ELSE 0 END AS new_s FROM ev), "
     "s AS (SELECT *, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) "
     "SELECT user_id, CAST(MIN(ts) AS VARCHAR) AS session_start, "
     "CAST(MAX(ts) + INTERVAL '2 hours' AS VARCHAR) AS session_end, COUNT(*) AS n "
     "FROM s GROUP BY user_id, sid", events=True)
