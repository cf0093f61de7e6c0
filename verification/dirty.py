"""A deterministically dirtied view of the orders table, written for Spark and for DuckDB.

The clean test tables have neither nulls nor duplicates, so the cleaning operators are checked on
this view: mixed date notations, spelling variants, states, numbers as text, nulls, outliers, copies.
"""

from pyspark.sql import DataFrame, SparkSession

_TEMPLATE = """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN {ymd} ELSE {mdy} END AS order_date,
  CASE o_orderkey % 5 WHEN 0 THEN lower(o_orderpriority)
       WHEN 1 THEN concat(' ', o_orderpriority) ELSE o_orderpriority END AS priority,
  CASE o_custkey % 6 WHEN 0 THEN 'NY' WHEN 1 THEN 'ny' WHEN 2 THEN ' New York'
       WHEN 3 THEN 'CA' WHEN 4 THEN 'California' ELSE 'tx' END AS state,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN {comma} ELSE {plain} END AS revenue,
  CASE WHEN o_orderkey % 25 = 3 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE concat('seg', CAST(o_custkey % 8 AS {string})) END AS segment,
  CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE NULL END AS sparse_id
FROM orders
"""

_SPARK = _TEMPLATE.format(
    ymd="date_format(o_orderdate, 'yyyy-MM-dd')",
    mdy="date_format(o_orderdate, 'MM/dd/yyyy')",
    comma="format_number(o_totalprice, 2)",
    plain="format_string('%.2f', o_totalprice)",
    string="STRING",
)

_DUCKDB = _TEMPLATE.format(
    ymd="strftime(o_orderdate, '%Y-%m-%d')",
    mdy="strftime(o_orderdate, '%m/%d/%Y')",
    comma="format('{:,.2f}', o_totalprice)",
    plain="format('{:.2f}', o_totalprice)",
    string="VARCHAR",
)

_COPIES = "{base} UNION ALL SELECT * FROM ({base}) WHERE o_orderkey % 50 = 0"

DIRTY_SQL = _COPIES.format(base=_DUCKDB)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(_COPIES.format(base=_SPARK.replace("FROM orders", "FROM {orders}")), orders=orders)
