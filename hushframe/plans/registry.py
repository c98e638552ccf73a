"""The registered queries of the engine, each over whole tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.control.registry import Control
from hushframe.control.service import Service
from hushframe.errors import QueryError, Unplannable
from hushframe.functions.blind import blind_equals, blind_hex, blind_index, blind_sql, ieee_divide
from hushframe.limits import UNBOUNDED
from hushframe.model import DatasetSlug, DeclaredSchema, read_footers
from hushframe.operators.disclosure import MinimumCount
from hushframe.plans import corpus
from hushframe.plans.scope import Scope
from hushframe.sources import mappers, synthetic
from hushframe.sources.folders import work_folder
from hushframe.sources.ndjson import read_ndjson
from hushframe.sources.snapshots import Vault

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
K = 11
KEY = b"an example key of the blind index"

# Gated queries: (SQL, DuckDB SQL if another); one table each. Only rows with n >= K are released.
GATED: dict[str, tuple[str, str | None]] = {
    "gated_group_count": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", None),
    "gated_count_literal": ("SELECT o_orderstatus, COUNT(1) AS n FROM orders GROUP BY o_orderstatus", None),
    "gated_sum_avg_min_max": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, AVG(l_quantity) AS avg_qty, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "gated_where": ("SELECT l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS hi FROM lineitem WHERE l_quantity > 24.0D AND l_returnflag <> 'A' GROUP BY l_linestatus", "SELECT l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS hi FROM lineitem WHERE l_quantity > 24.0 AND l_returnflag <> 'A' GROUP BY l_linestatus"),
    "gated_having": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 50", None),
    "gated_order_limit": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey ASC NULLS LAST LIMIT 5", None),
    "gated_order_offset": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey ASC NULLS LAST LIMIT 5 OFFSET 3", None),
    "gated_subquery_alias": ("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority) t WHERE n > 0", None),
    "gated_plain_below": ("SELECT seg, COUNT(*) AS n FROM (SELECT c_mktsegment AS seg, c_custkey FROM customer) t GROUP BY seg", None),
    "gated_cte": ("WITH c AS (SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus) SELECT o_orderstatus, n, hi FROM c", None),
    "gated_group_by_expr": ("SELECT l_orderkey DIV 1000 AS band, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey DIV 1000", "SELECT l_orderkey // 1000 AS band, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey // 1000"),
    "gated_group_by_ordinal": ("SELECT upper(event_type) AS kind, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1", None),
    "gated_count_distinct_beside_n": ("SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, COUNT(value) AS some FROM events GROUP BY event_type", None),
    "gated_global": ("SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders", None),
    "gated_suppress_all": ("SELECT o_orderkey, COUNT(*) AS n, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderkey", None),
    "gated_rare_first": ("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n ASC, c_nationkey ASC NULLS LAST LIMIT 3", None),
    "gated_case_group": ("SELECT CASE WHEN l_quantity > 25.0D THEN 'large' ELSE 'small' END AS size, COUNT(*) AS n FROM lineitem GROUP BY 1", "SELECT CASE WHEN l_quantity > 25.0 THEN 'large' ELSE 'small' END AS size, COUNT(*) AS n FROM lineitem GROUP BY 1"),
    "gated_sort_below": ("SELECT c_mktsegment, COUNT(*) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal) t GROUP BY c_mktsegment", None),
    "gated_region_suppressed": ("SELECT r_name, COUNT(*) AS n FROM region GROUP BY r_name", None),
    "expr_in": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority", None),
    "expr_not_in": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F') GROUP BY o_orderpriority", None),
    "expr_between": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey BETWEEN 10 AND 500 GROUP BY o_orderstatus", None),
    "expr_not_between": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey NOT BETWEEN 10 AND 500 GROUP BY o_orderstatus", None),
    "expr_like": ("SELECT p_brand, COUNT(*) AS n FROM part WHERE p_name LIKE '%a%' GROUP BY p_brand", None),
    "expr_not_like": ("SELECT p_brand, COUNT(*) AS n FROM part WHERE p_type NOT LIKE 'S%' GROUP BY p_brand", None),
    "expr_ilike": ("SELECT p_brand, COUNT(*) AS n FROM part WHERE p_type ILIKE '%ST%' GROUP BY p_brand", None),
    "expr_case": ("SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state, COUNT(*) AS n FROM orders GROUP BY 1", None),
    "expr_coalesce": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE COALESCE(c_custkey, 0) > 100 GROUP BY c_mktsegment", None),
    "expr_nullif": ("SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NOT NULL GROUP BY c_mktsegment", None),
    "expr_lower_upper": ("SELECT lower(c_mktsegment) AS seg, COUNT(*) AS n FROM customer WHERE upper(c_mktsegment) <> 'X' GROUP BY lower(c_mktsegment)", None),
    "expr_concat": ("SELECT l_returnflag || '/' || l_linestatus AS k, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag || '/' || l_linestatus", None),
    "expr_try_cast": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE TRY_CAST(o_orderpriority AS BIGINT) IS NULL GROUP BY o_orderstatus", None),
    "expr_cast": ("SELECT CAST(o_custkey AS STRING) AS k, COUNT(*) AS n FROM orders WHERE CAST(o_custkey AS DOUBLE) > 5.0D GROUP BY CAST(o_custkey AS STRING)", "SELECT CAST(o_custkey AS VARCHAR) AS k, COUNT(*) AS n FROM orders WHERE CAST(o_custkey AS DOUBLE) > 5.0 GROUP BY CAST(o_custkey AS VARCHAR)"),
    "expr_distinct_from": ("SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R' GROUP BY l_linestatus", None),
    "expr_is_true": ("SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE (l_orderkey > 100) IS TRUE AND l_partkey IS NOT NULL GROUP BY l_linestatus", None),
    "expr_int_arith": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey * 2 + 1 - o_orderkey > 0 AND o_orderkey % 7 = 3 GROUP BY o_orderstatus", None),
    "expr_float_div": ("SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_extendedprice / 2.0D - l_quantity > -l_tax GROUP BY l_linestatus", "SELECT l_linestatus, COUNT(*) AS n FROM lineitem WHERE l_extendedprice / 2.0 - l_quantity > -l_tax GROUP BY l_linestatus"),
    "expr_count_ratio": ("SELECT l_returnflag, COUNT(*) AS n, COUNT(*) * 100 DIV 60 AS pct FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n, COUNT(*) * 100 // 60 AS pct FROM lineitem GROUP BY l_returnflag"),
}

_WINDOW = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS LAST, o_orderkey ASC NULLS LAST)"
_WHOLE = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS LAST, o_orderkey ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _window(what: str, frame: str = _WINDOW, bigint: bool = False) -> tuple[str, str | None]:
    return f"SELECT o_orderkey, o_custkey, {f'CAST({what} {frame} AS BIGINT)' if bigint else f'{what} {frame}'} AS w FROM orders", None


# Open queries over any tables: (Spark SQL, DuckDB SQL if another).
OPEN: dict[str, tuple[str, str | None]] = {
    "project_rename": ("SELECT n_nationkey AS k, n_name AS name FROM nation", None),
    "select_star": ("SELECT * FROM region", None),
    "filter_pushed": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'", None),
    "join_inner": ("SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_self": ("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_comma": ("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey", None),
    "join_cross_theta": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey", None),
    "join_semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "join_semi_exists": ("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)", None),
    "join_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "join_left_outer": ("SELECT c.c_custkey, COUNT(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey", None),
    "join_right_outer": ("SELECT n.n_name, COUNT(s.s_suppkey) AS suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name", None),
    "join_full_outer": ("SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey", None),
    "join_of_aggregates": ("SELECT a.c_nationkey, a.customers, b.suppliers FROM (SELECT c_nationkey, COUNT(*) AS customers FROM customer GROUP BY c_nationkey) a JOIN (SELECT s_nationkey, COUNT(*) AS suppliers FROM supplier GROUP BY s_nationkey) b ON a.c_nationkey = b.s_nationkey", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)", None),
    "scalar_subquery_select": ("SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region", None),
    "having_subquery": ("SELECT o_custkey, COUNT(*) AS orders FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) / COUNT(DISTINCT o_custkey) FROM orders)", None),
    "range_join": ("SELECT n.n_nationkey, r.id AS k FROM nation n JOIN range(0, 10) r ON n.n_nationkey >= r.id * 3", "SELECT n.n_nationkey, r.k FROM nation n JOIN (SELECT unnest(range(0, 10)) AS k) r ON n.n_nationkey >= r.k * 3"),
    "explode_inflation": ("SELECT n_nationkey, x FROM nation LATERAL VIEW EXPLODE(ARRAY(1, 2, 3)) t AS x", "SELECT n_nationkey, unnest([1, 2, 3]) AS x FROM nation"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", None),
    "order_top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 20", None),
    "limit_below": ("SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) t", None),
    "values_rows": ("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(k, v)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)"),
    "no_from": ("SELECT 1 + 2 AS three", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS rows, SUM(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", None),
    "cube": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS rows FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)", None),
    "grouping_sets": ("SELECT c_nationkey, c_mktsegment, COUNT(*) AS rows FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())", None),
    "agg_filter": ("SELECT l_linestatus, COUNT(*) FILTER (WHERE l_quantity > 25) AS large, MAX(l_tax) FILTER (WHERE l_returnflag = 'R') AS tax FROM lineitem GROUP BY l_linestatus", None),
    "array_agg_sorted": ("SELECT n_regionkey, array_join(array_sort(ARRAY_AGG(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(ARRAY_AGG(n_name)), ',') AS names FROM nation GROUP BY n_regionkey"),
    "string_agg_sorted": ("SELECT n_regionkey, LISTAGG(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "first_value_by": ("SELECT o_custkey, MIN_BY(o_orderkey, o_orderkey) AS first FROM orders GROUP BY o_custkey", "SELECT o_custkey, FIRST(o_orderkey ORDER BY o_orderkey) AS first FROM orders GROUP BY o_custkey"),
    "any_value": ("SELECT r_regionkey, ANY_VALUE(r_name) AS name FROM region GROUP BY r_regionkey", None),
    "percentile": ("SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS mid, percentile(l_quantity, 0.9) AS high FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS mid, quantile_cont(l_quantity, 0.9) AS high FROM lineitem GROUP BY l_returnflag"),
    "statistics": ("SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, MEDIAN(l_quantity) AS med, BIT_XOR(l_orderkey) AS bx, BOOL_AND(l_tax >= 0) AS taxed FROM lineitem GROUP BY l_returnflag", None),
    "agg_over_agg": ("SELECT orders, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS orders FROM orders GROUP BY o_custkey) t GROUP BY orders", None),
    "window_row_number": _window("ROW_NUMBER()", bigint=True), "window_rank": _window("RANK()", bigint=True), "window_dense_rank": _window("DENSE_RANK()", bigint=True), "window_percent_rank": _window("PERCENT_RANK()"), "window_cume_dist": _window("CUME_DIST()"),
    "window_ntile": ("SELECT o_orderkey, o_custkey, CAST(NTILE(4) " + _WINDOW + " AS BIGINT) AS w FROM orders", None), "window_lag": _window("LAG(o_totalprice)"), "window_lead": _window("LEAD(o_totalprice, 2)"),
    "window_first_value": _window("FIRST_VALUE(o_totalprice)", _WHOLE), "window_last_value": _window("LAST_VALUE(o_totalprice)", _WHOLE), "window_nth_value": _window("NTH_VALUE(o_totalprice, 2)", _WHOLE),
    "window_count_over": ("SELECT n_nationkey, COUNT(*) OVER () AS w FROM nation", None),
    "window_frame": _window("MAX(o_totalprice)", "OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC NULLS LAST, o_orderkey ASC NULLS LAST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "window_lag_over_aggregate": ("SELECT c_nationkey, COUNT(*) AS n, LAG(MAX(c_acctbal)) OVER (ORDER BY c_nationkey) AS prev FROM customer GROUP BY c_nationkey", None),
    "window_below_aggregate": ("SELECT c, COUNT(*) AS n FROM (SELECT COUNT(*) OVER (PARTITION BY n_regionkey) AS c FROM nation) t GROUP BY c", None),
    "cte_join": ("WITH r AS (SELECT n_regionkey FROM nation) SELECT a.n_regionkey, COUNT(*) AS pairs FROM r a JOIN r b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_regionkey", None),
    "scalar_strings": ("SELECT p_partkey, SUBSTR(p_name, 2, 3) AS s, REPEAT(p_brand, 2) AS r, LPAD(p_type, 30, '*') AS l, LENGTH(p_name) AS n FROM part", "SELECT p_partkey, SUBSTR(p_name, 2, 3) AS s, REPEAT(p_brand, 2) AS r, LPAD(p_type, 30, '*') AS l, CAST(LENGTH(p_name) AS INTEGER) AS n FROM part"),
    "scalar_math": ("SELECT s_suppkey, ABS(s_acctbal) AS a, FLOOR(s_acctbal) AS f, SIGN(s_acctbal) AS s FROM supplier", "SELECT s_suppkey, ABS(s_acctbal) AS a, CAST(FLOOR(s_acctbal) AS BIGINT) AS f, CAST(SIGN(s_acctbal) AS DOUBLE) AS s FROM supplier"),
    "scalar_dates": ("SELECT o_orderkey, CAST(DATE_TRUNC('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS m, YEAR(o_orderdate) AS y FROM orders", "SELECT o_orderkey, CAST(DATE_TRUNC('MONTH', o_orderdate) AS TIMESTAMP) AS m, CAST(YEAR(o_orderdate) AS INTEGER) AS y FROM orders"),
    "scalar_regex": ("SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '') AS r, p_name RLIKE '^[a-m]' AS early FROM part", "SELECT p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '', 'g') AS r, regexp_matches(p_name, '^[a-m]') AS early FROM part"),
    "json_field": ("SELECT event_id, get_json_object(props, '$') IS NOT NULL AS has FROM events", "SELECT event_id, json_extract(props, '$') IS NOT NULL AS has FROM events"),
    "dot_product": ("SELECT vec_id, ROUND(aggregate(zip_with(embedding, embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (a, x) -> a + x), 4) AS dot FROM embeddings", "SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS dot FROM embeddings"),
    "cosine_distance": (
        "SELECT v.vec_id, 0D + ROUND(1 - aggregate(zip_with(v.embedding, q.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (a, x) -> a + x) / SQRT(aggregate(v.embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)) / SQRT(aggregate(q.embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE) * x)), 4) AS d FROM embeddings v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
        "SELECT v.vec_id, 0 + ROUND(1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / SQRT(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / SQRT(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 4) AS d FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q",
    ),
    "array_functions": ("SELECT n_regionkey, array_size(array_compact(ARRAY_AGG(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END))) AS even FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(COUNT(*) FILTER (WHERE n_nationkey % 2 = 0) AS INTEGER) AS even FROM nation GROUP BY n_regionkey"),
}


def _path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def _scope(spark: SparkSession, sf_dir: str, sql: str, policy: MinimumCount | None) -> Scope:
    scope = Scope(spark, policy is not None, policy, UNBOUNDED)
    for table in TABLES:
        if table in sql:
            scope.register_frame(table, scope.session.read.parquet(_path(sf_dir, table)))
    return scope


def _gated(sql: str) -> Query:
    return lambda spark, sf_dir: _scope(spark, sf_dir, sql, MinimumCount(K)).dataframe(sql)[0]


def _open(sql: str) -> Query:
    return lambda spark, sf_dir: _scope(spark, sf_dir, sql, None).dataframe(sql)[0]


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case of the corpus with the gate's verdict; accepted ones say how many rows survive."""
    folder = work_folder(spark, "trips")
    scope = Scope(spark, True, MinimumCount(corpus.K))
    for table, rows_of, columns in (("trips", corpus.TRIPS, corpus.COLUMNS), ("lookalike", corpus.LOOKALIKE, corpus.LOOKALIKE_COLUMNS)):
        spark.createDataFrame(rows_of, columns).write.parquet(f"{folder}/{table}")
        scope.register(table, f"{folder}/{table}")
    rows = []
    for name, sql, _ in corpus.CASES:
        try:
            verdict = f"rows:{scope.sql(sql).row_count}"
        except Unplannable:
            verdict = "unplannable"
        except QueryError:
            verdict = "refused"
        rows.append((name, verdict))
    return spark.createDataFrame(rows, "name string, verdict string")


def suppressed_rows_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For several k: groups of customers by nation that a gated scope releases, and those its policy counts as suppressed."""
    rows = []
    for k in (1, 5, 11, 50, 60, 10**6):
        with Scope(spark, policy=MinimumCount(k)) as scope:
            scope.register("customer", _path(sf_dir, "customer"))
            result = scope.sql("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
        rows.append((k, result.row_count, result.suppressed_rows))
    return spark.createDataFrame(rows, "k long, kept long, suppressed long")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, "customer")).select("c_custkey", blind_index(KEY, F.col("c_name")).alias("bidx"))


def _known_name(sf_dir: str) -> str:
    return "Customer#000000007"


def declared_schema_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What declared registration says of tables: the right schema, a renamed column, another family, another order, a low row cap, a list column."""
    region = (("r_regionkey", "int32"), ("r_name", "string"))
    cases = {
        "right": ("region", region, 5), "renamed": ("region", (("regionkey", "int32"), region[1]), 5), "family": ("region", (("r_regionkey", "int64"), region[1]), 5),
        "order": ("region", region[::-1], 5), "extra": ("region", (*region, ("x", "string")), 5), "row_cap": ("region", region, 4), "list": ("embeddings", (("vec_id", "int64"), ("embedding", "string"), ("label", "int32")), 10**9),
    }
    rows = []
    for name, (table, columns, cap) in cases.items():
        try:
            read_footers([_path(sf_dir, table)])[0].check(DeclaredSchema(columns), cap)
            rows.append((name, "registered"))
        except QueryError as e:
            rows.append((name, e.what))
    return spark.createDataFrame(rows, "name string, verdict string")


# Invented payloads of the connectors.
PAYLOADS = {
    "mapper_invoices": (mappers.INVOICES, {"QueryResponse": {"Invoice": [
        {"Id": "1", "TxnDate": "2024-01-05", "TotalAmt": 120.5, "Balance": 0, "CurrencyRef": {"value": "USD"}, "CustomerRef": {"value": "7", "name": "Acme"}},
        {"Id": "2", "TotalAmt": "99", "Balance": 10.25, "CurrencyRef": {"value": "EUR"}, "CustomerRef": {"name": 5}}, {"Id": "3", "TxnDate": "2024-02-01", "TotalAmt": 7, "CurrencyRef": {}}]}}),
    "mapper_partners": (mappers.PARTNERS, {"jsonrpc": "2.0", "id": 1, "result": [{"id": 1, "name": "Ada", "email": "ada@example.org", "is_company": False}, {"id": 2, "name": "Firm", "email": None, "is_company": True}, {"id": 3, "name": 4, "is_company": "yes"}]}),
    "mapper_contacts": (mappers.CONTACTS, {"contacts": [{"id": "a", "name": "Bo", "email": "bo@example.org", "stage": "lead"}, {"id": "b", "name": "Cy", "email": None, "stage": "won"}]}),
}


def _mapped(name: str) -> Query:
    mapper, payload = PAYLOADS[name]
    return lambda spark, sf_dir: mapper.rows(spark.createDataFrame([(json.dumps(payload),)], "payload string"))


def ndjson_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as NDJSON and read back strictly."""
    folder = work_folder(spark, "ndjson")
    events = spark.read.parquet(_path(sf_dir, "events")).select("event_id", "user_id", "event_type", "value")
    events.select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    return read_ndjson(spark, folder, events.schema)


def snapshot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations synced twice: the current snapshot has them once."""
    vault, tenant, slug = Vault(work_folder(spark, "vault")), uuid.uuid4(), DatasetSlug("nations")
    for _ in range(2):
        vault.commit(tenant, slug, spark.read.parquet(_path(sf_dir, "nation")))
    return spark.read.parquet(*vault.current(tenant, slug).objects)


def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held datasets of one tenant of two."""
    vault, tenant = Vault(work_folder(spark, "vault")), uuid.uuid4()
    for who, name in ((tenant, "nations"), (tenant, "regions"), (uuid.uuid4(), "other")):
        vault.commit(who, DatasetSlug(name), spark.read.parquet(_path(sf_dir, "nation")).coalesce(1))
    return vault.listing(spark, tenant).select("slug", "suite", "object_count")


def synth_cohort_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.cohort(spark, 42, 10_000, 11).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


def synth_wide_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic.wide(spark, 42, 100_000)
    return made.groupBy("region").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("regions"), F.sum("n").alias("n"))


def budget_ledger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by event after a grant's life: open 3, charge 3, a refused charge, a keyed top-up tried twice, one more charge."""
    control = Control()
    grant = control.create_grant(uuid.uuid4(), uuid.uuid4(), DatasetSlug("nations"))
    control.open_budget(grant.id, 3)
    for _ in range(4):
        try:
            control.charge(grant.id)
        except QueryError:
            pass
    control.top_up(grant.id, 2, "request-1")
    control.top_up(grant.id, 2, "request-1")
    control.charge(grant.id)
    return control.ledger_frame(spark).groupBy("event").agg(F.count(F.lit(1)).alias("events"), F.sum("units").alias("units"))


def research_query_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing published, access asked and approved, and customers by nation queried under the budget."""
    steward, researcher, slug = uuid.uuid4(), uuid.uuid4(), DatasetSlug("customers")
    vault = Vault(work_folder(spark, "vault"))
    vault.commit(steward, slug, spark.read.parquet(_path(sf_dir, "customer")).coalesce(1))
    service = Service(spark, vault, cohort=K)
    listing = service.publish(steward, "customers", "Customers")
    request = service.control.request(researcher, listing.id)
    service.control.resolve(steward, request.id, True, 2)
    out = service.research_query(researcher, steward, "customers", "SELECT c_nationkey, COUNT(*) AS n FROM customers GROUP BY c_nationkey")
    return spark.createDataFrame([(r["c_nationkey"], r["n"], out["budget_remaining"]) for r in out["rows"]], "c_nationkey int, n long, budget_remaining int")


def ieee_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spark.read.parquet(_path(sf_dir, "supplier"))
    return supplier.groupBy(F.isnan(ieee_divide(F.col("s_acctbal") * 0, F.lit(0.0))).alias("nan"), (ieee_divide(F.col("s_acctbal"), F.lit(0.0)) > 0).alias("plus")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return (
        {name: _gated(sql) for name, (sql, _) in GATED.items()}
        | {name: _open(sql) for name, (sql, _) in OPEN.items()}
        | {name: _mapped(name) for name in PAYLOADS}
        | {
            "gate_verdicts": gate_verdicts, "suppressed_rows_report": suppressed_rows_report, "blind_index": _indexed,
            "blind_equality": lambda spark, sf_dir: blind_equals(_indexed(spark, sf_dir), "bidx", KEY, _known_name(sf_dir)).select("c_custkey"),
            "blind_miss": lambda spark, sf_dir: blind_equals(_indexed(spark, sf_dir), "bidx", KEY, "nobody").select("c_custkey"),
            "declared_schema_verdicts": declared_schema_verdicts, "ndjson_strict": ndjson_strict, "snapshot_current": snapshot_current, "dataset_listing": dataset_listing,
            "synth_cohort_groups": synth_cohort_groups, "synth_wide_groups": synth_wide_groups, "budget_ledger_report": budget_ledger_report, "research_query_flow": research_query_flow,
            "connector_catalog": lambda spark, sf_dir: mappers.connectors(spark), "ieee_division": ieee_division,
        }
    )


def _values(rows: list[tuple], columns: str) -> str:
    quoted = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS t({columns})"


def oracle_sql() -> dict[str, str]:
    released = {name: f"SELECT * FROM ({duck or sql}) AS released WHERE n >= {K}" for name, (sql, duck) in GATED.items()}
    plain = {name: duck or sql for name, (sql, duck) in OPEN.items()}
    index = f"SELECT c_custkey, {blind_sql(KEY, 'c_name')} AS bidx FROM customer"
    return released | plain | {
        "gate_verdicts": _values([(name, verdict) for name, _, verdict in corpus.CASES], "name, verdict"),
        "suppressed_rows_report": "SELECT k, count(*) FILTER (WHERE n >= k) AS kept, count(*) FILTER (WHERE n < k) AS suppressed FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey), (SELECT CAST(unnest([1, 5, 11, 50, 60, 1000000]) AS BIGINT) AS k) GROUP BY k",
        "blind_index": index, "blind_equality": f"SELECT c_custkey FROM customer WHERE c_name = '{_known_name('')}'", "blind_miss": f"SELECT c_custkey FROM ({index}) WHERE bidx = '{blind_hex(KEY, 'nobody')}'",
        "declared_schema_verdicts": _values([("right", "registered"), ("renamed", "schema"), ("family", "schema"), ("order", "schema"), ("extra", "schema"), ("row_cap", "row cap"), ("list", "schema")], "name, verdict"),
        "ndjson_strict": "SELECT event_id, user_id, event_type, value FROM events", "snapshot_current": "SELECT * FROM nation",
        "dataset_listing": "SELECT slug, 'plain-parquet' AS suite, CAST(1 AS BIGINT) AS object_count FROM (VALUES ('nations'), ('regions')) AS t(slug)",
        "synth_cohort_groups": "SELECT condition, CAST(n AS BIGINT) AS n FROM (VALUES ('under', 10), ('exact', 11), ('over', 12), ('single', 1), ('dominated', 22)) AS t(condition, n) UNION ALL SELECT 'common_' || (i % 4), count(*) FROM (SELECT unnest(range(56, 10000)) AS i) GROUP BY i % 4",
        "synth_wide_groups": "SELECT CAST(8 AS BIGINT) AS regions, CAST(100000 AS BIGINT) AS n",
        "budget_ledger_report": "SELECT event, CAST(events AS BIGINT) AS events, CAST(units AS BIGINT) AS units FROM (VALUES ('open', 1, 3), ('charge', 4, 4), ('top_up', 1, 2)) AS t(event, events, units)",
        "research_query_flow": f"SELECT c_nationkey, count(*) AS n, CAST(1 AS INTEGER) AS budget_remaining FROM customer GROUP BY c_nationkey HAVING count(*) >= {K}",
        "connector_catalog": _values(list(mappers.CONNECTORS), "connector, kind, auth"), "ieee_division": "SELECT true AS nan, s_acctbal > 0 AS plus, count(*) AS n FROM supplier GROUP BY s_acctbal > 0",
        "mapper_invoices": "SELECT * FROM (VALUES ('1', 'Acme', '2024-01-05', 'USD', CAST(120.5 AS DOUBLE), CAST(0 AS DOUBLE)), ('2', NULL, NULL, 'EUR', NULL, 10.25), ('3', NULL, '2024-02-01', NULL, 7, NULL)) AS t(id, customer, txn_date, currency, total, balance)",
        "mapper_partners": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Ada', 'ada@example.org', false), (2, 'Firm', NULL, true), (3, NULL, NULL, NULL)) AS t(id, name, email, is_company)",
        "mapper_contacts": "SELECT * FROM (VALUES ('a', 'Bo', 'bo@example.org', 'lead'), ('b', 'Cy', NULL, 'won')) AS t(id, name, email, stage)",
    }
