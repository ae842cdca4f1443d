"""One query per category of SQL that the engine hands to Spark after its guard. Each text runs on either engine."""

from __future__ import annotations

QUERIES = {
    "sql_inner_join": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "sql_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_right_join": "SELECT s_suppkey, count(l_orderkey) AS n FROM lineitem RIGHT JOIN supplier ON s_suppkey = l_suppkey AND l_quantity > 49 GROUP BY s_suppkey",
    "sql_full_join": "SELECT coalesce(l.doc_id, e.vec_id) AS id, l.quality, e.label FROM labels l FULL OUTER JOIN embeddings e ON l.doc_id = e.vec_id",
    "sql_cross_join": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "sql_natural_join": "SELECT doc_id, quality, lang FROM documents NATURAL JOIN labels",
    "sql_self_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)",
    "sql_anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_in_subquery": "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 15)",
    "sql_scalar_subquery": "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "sql_correlated_subquery": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)",
    "sql_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey - 20",
    "sql_range_join": "SELECT r_regionkey, count(*) AS n FROM region JOIN part ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 9 GROUP BY r_regionkey",
    "sql_lateral_join": "SELECT n_name, t.n AS n FROM nation, LATERAL (SELECT count(*) AS n FROM supplier WHERE s_nationkey = n_nationkey) t",
    "sql_group_having": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "sql_distinct_agg": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "sql_filter_agg": "SELECT count(*) FILTER (WHERE l_discount > 0.05) AS n, count(*) AS n_all FROM lineitem",
    "sql_grouping_sets": "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_median_mode": "SELECT l_returnflag, median(l_quantity) AS med, min(l_shipdate) AS first_date FROM lineitem GROUP BY l_returnflag",
    "sql_ranking": "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rnk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "sql_analytic": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter FROM orders",
    "sql_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events",
    "sql_qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "sql_order_limit": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 5",
    "sql_fetch_first": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey FETCH FIRST 7 ROWS ONLY",
    "sql_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "sql_union_all": "SELECT lang FROM documents UNION ALL SELECT role FROM conversations",
    "sql_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "sql_except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "sql_cte": "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_mktsegment, round(avg(s), 4) AS avg_spend FROM spend JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    "sql_strings": "SELECT p_partkey, upper(p_brand) AS u, length(p_name) AS n, substring(p_type, 1, 3) AS s, replace(p_brand, 'Brand', 'B') AS r, concat(p_brand, '-', p_type) AS c, trim(p_name) AS t FROM part",
    "sql_dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS mon FROM orders",
    "sql_math": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net, floor(l_tax * 100) AS f, abs(l_quantity - 25) AS a, sqrt(l_quantity) > 5 AS q FROM lineitem",
    "sql_case": "SELECT CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS size, count(*) AS n FROM documents GROUP BY 1",
    "sql_values": "SELECT x, y FROM (VALUES (1, 'a'), (2, 'b')) AS t(x, y)",
    "sql_unpivot_by_hand": "SELECT doc_id, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels",
    "sql_q1_report": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_q3_join_top": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "sql_q5_regions": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
}

#: Spark SQL whose wording differs elsewhere, with the same meaning in plain SQL.
WORDED = {
    "sql_pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS qty_o, 'F' AS qty_f))", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS qty_o, sum(l_quantity) FILTER (l_linestatus = 'F') AS qty_f FROM lineitem GROUP BY l_returnflag"),
    "sql_unpivot": ("SELECT doc_id, k, v FROM labels UNPIVOT INCLUDE NULLS (v FOR k IN (quality, toxic))", "SELECT doc_id, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"),
    "sql_range_frame": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS recent FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS recent FROM orders"),
    "sql_percentiles": ("SELECT l_returnflag, percentile(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag"),
    "sql_arrays": ("SELECT n_regionkey, size(collect_list(n_name)) AS n, array_join(sort_array(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_json": ("SELECT n_nationkey, get_json_object(to_json(named_struct('name', n_name)), '$.name') AS name FROM nation", "SELECT n_nationkey, n_name AS name FROM nation"),
    "sql_map": ("SELECT n_nationkey, element_at(map('key', n_regionkey), 'key') AS k FROM nation", "SELECT n_nationkey, n_regionkey AS k FROM nation"),
    "sql_last_by": ("SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey"),
}

#: Texts of other dialects, with what they mean in plain SQL.
DIALECTS = {
    "dialect_top": ("SELECT TOP 5 n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name LIMIT 5"),
    "dialect_isnull": ("SELECT ISNULL(NULL, n_name) AS x FROM nation", "SELECT n_name AS x FROM nation"),
    "dialect_brackets": ("SELECT [n_name] FROM [nation]", "SELECT n_name FROM nation"),
    "dialect_quotes": ('SELECT "n_name" AS "the name" FROM nation', 'SELECT n_name AS "the name" FROM nation'),
    "dialect_cast": ("SELECT n_nationkey::varchar(10) AS k FROM nation", "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation"),
    "dialect_group_concat": ("SELECT n_regionkey, length(GROUP_CONCAT(n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(length(n_name)) AS INTEGER) AS n FROM nation GROUP BY n_regionkey"),
    "dialect_charindex": ("SELECT n_nationkey, CHARINDEX('_', n_name) AS p FROM nation", "SELECT n_nationkey, CAST(instr(n_name, '_') AS INTEGER) AS p FROM nation"),
    "dialect_strftime": ("SELECT o_orderkey, STRFTIME('%Y-%m', o_orderdate) AS ym FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders"),
    "dialect_safe_cast": ("SELECT SAFE_CAST(n_name AS INT) AS x FROM nation", "SELECT TRY_CAST(n_name AS INTEGER) AS x FROM nation"),
}
