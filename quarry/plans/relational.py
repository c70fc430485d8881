"""The relational views of the sample inputs, with their seeded mistakes put right, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.packing import spread

#: name: (Spark SQL, SQL for the check where it differs). Money is added up as decimals, so that the order of rows does not show.
_NET = "CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
VIEWS: dict[str, str] = {
    "view_order_revenue": f"SELECT o_orderkey, CAST(sum({_NET}) AS DOUBLE) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "view_customer_lifetime_value": """SELECT c_custkey, c_name, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS lifetime_value
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey, c_name""",
    "view_stock_update": """SELECT p_partkey, p_size - coalesce(CAST(q AS INT), 0) AS stock FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) s ON l_partkey = p_partkey""",
    "view_low_stock": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size <= 10",
    "view_city_sales": f"""SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT o_orderkey) AS n_orders, CAST(coalesce(sum({_NET}), 0) AS DOUBLE) AS sales
      FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name""",
    "view_category_sales": f"SELECT p_type, CAST(coalesce(sum({_NET}), 0) AS DOUBLE) AS sales, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type",
    "view_daily_sales": f"SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_orderkey) AS n_orders, CAST(coalesce(sum({_NET}), 0) AS DOUBLE) AS sales FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY CAST(o_orderdate AS DATE)",
    "view_debt_class": """SELECT c_custkey, debt, CASE WHEN debt = 0 THEN 'none' WHEN debt < 500000 THEN 'normal' ELSE 'high' END AS class
      FROM (SELECT c_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS debt FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey) t""",
    "view_open_orders": """SELECT o_orderkey, c_name, n_name, datediff('day', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '2000-01-01 00:00:00') AS age
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O'""",
    "view_revenue_by_month": f"SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(sum({_NET}) AS DOUBLE) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "view_supplier_stock": "SELECT s_suppkey, s_name, count(DISTINCT l_partkey) AS n_parts, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS quantity FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name",
}
TABLES = ("customer", "lineitem", "nation", "orders", "part", "supplier")
#: Views that hold different values of a key in memory, and the column by which their lines are spread over more tasks for more input.
SPREAD = {"view_supplier_stock": "l_suppkey"}


def _view(text: str, spread_by: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in text}
        if spread_by:
            used["lineitem"] = spread(used["lineitem"].select("l_partkey", "l_quantity", spread_by), spread_by, mb=2)
        named = text.replace("datediff('day', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '2000-01-01 00:00:00')", "datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE))")
        for t in used:
            for before in ("FROM ", "JOIN "):
                named = named.replace(f"{before}{t} ", f"{before}{{{t}}} {t} ") if not named.endswith(f"{before}{t}") else named[: -len(t)] + f"{{{t}}} {t}"
        return spark.sql(named, **used)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _view(v, SPREAD.get(k)) for k, v in VIEWS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(VIEWS)
