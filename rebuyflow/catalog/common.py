"""Registry of queries and their oracle SQL, and the shared SQL definitions of the inputs."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebuyflow.session import prepare


class Catalog:
    """Named queries of one group; an oracle is optional."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def register(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(prepare(spark), sf_dir)
            run.__name__, run.__doc__ = name, fn.__doc__
            self.queries[name] = run
            if oracle is not None:
                self.oracles[name] = oracle
            return fn
        return register


def r6(column: Column) -> Column:
    """Six decimals: enough to compare sums taken in different orders."""
    return F.round(column.cast("double"), 6)


def rounded(df: DataFrame) -> DataFrame:
    """All double columns rounded for comparison."""
    return df.select(*[r6(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


# Order items out of lineitem, orders and part.
ITEMS_SQL = """
items AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS order_id, p_type AS product_id,
         p_name AS product_name, CAST(l_linenumber AS VARCHAR) AS order_item_code,
         md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
             CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(18,2)), CAST(l_tax AS DECIMAL(18,2)),
             l_returnflag, l_linestatus, CAST(l_shipdate AS DATE))) AS order_section_item_no,
         o_orderdate AS ordered_at, CAST(o_orderdate AS DATE) AS ordered_on, CAST(l_quantity AS BIGINT) AS quantity,
         l_extendedprice AS order_total, l_shipdate AS extracted_at,
         CASE WHEN l_returnflag='R' AND l_linenumber=1 AND o_orderstatus='P' THEN 'RETURN_COMPLETE'
              WHEN l_returnflag='A' AND l_linenumber=2 AND o_orderstatus='P' THEN 'CANCEL_COMPLETE'
              WHEN l_returnflag='N' AND l_linenumber=3 AND o_orderstatus='O' THEN 'SHIPPING'
              WHEN l_linestatus='F' THEN 'PURCHASE_CONFIRMATION' ELSE 'SHIPPING_COMPLETE' END AS section_status
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey
)"""

# Daily events out of the events table.
DAYS_SQL = """
days AS (
  SELECT sha256('["' || customer_id || '", "' || product_id || '", "' || CAST(ordered_on AS VARCHAR) || '"]') AS event_id, *
  FROM (SELECT CAST(user_id AS VARCHAR) AS customer_id, event_type AS product_id, CAST(ts AS DATE) AS ordered_on,
               CASE WHEN MAX(value) > 250 THEN 'held' ELSE 'completed' END AS event_state,
               CASE WHEN MAX(value) > 250 THEN NULL ELSE COUNT(*) END AS quantity,
               COUNT(*) AS source_rows, MAX(ts) AS snapshot_observed_at
        FROM events GROUP BY 1, 2, 3)
)"""

# Nested order versions out of single lines.
VERSIONS_SQL = """
versions AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_no,
         CASE WHEN o_custkey % 50 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS member_code,
         CASE WHEN l_suppkey % 20 = 0 THEN 'other' ELSE 'b2s' END AS channel,
         o_orderdate + INTERVAL 16 HOURS AS wtime, date_trunc('month', l_shipdate) AS updated_at,
         CAST(floor(l_extendedprice) AS BIGINT) AS total_price,
         CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS total_payment_price,
         CASE WHEN l_linenumber = 7 THEN '[]'
              WHEN l_linenumber >= 4 THEN '[' || main || ',' || more || ']' ELSE '[' || main || ']' END AS sections
  FROM (
    SELECT *,
      '{"orderSectionCode":"' || l_orderkey || '/' || l_linenumber || '","orderSectionNo":"1","orderSectionStatus":"SHIPPING_COMPLETE","sectionItems":['
        || CASE WHEN l_linenumber % 2 = 0 THEN one || ',' || two ELSE one END || ']}' AS main,
      '{"orderSectionCode":"' || l_orderkey || '/' || l_linenumber || '","orderSectionNo":"2","orderSectionStatus":"CANCEL_COMPLETE","sectionItems":['
        || two || ']}' AS more
    FROM (
      SELECT *,
        '{"orderItemCode":"I' || l_linenumber || '","orderSectionItemNo":"' || l_orderkey || '-' || l_linenumber || 'a","qty":"'
          || CAST(l_quantity AS BIGINT) || '","productInfo":{' || CASE WHEN l_partkey % 10 = 0 THEN '' ELSE '"prodNo":"' || l_partkey || '",' END
          || '"prodName":"' || p_name || '"}}' AS one,
        '{"orderItemCode":"J' || l_linenumber || '","orderSectionItemNo":"' || l_orderkey || '-' || l_linenumber || 'b","qty":"'
          || CAST(l_quantity AS BIGINT) || '.5","productInfo":{"prodNo":"S' || l_suppkey || '","prodName":"extra"}}' AS two
      FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey))
),
latest AS (
  SELECT * FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY order_no, updated_at) AS same_update_rows,
           ROW_NUMBER() OVER (PARTITION BY order_no ORDER BY updated_at DESC, sections DESC, member_code DESC NULLS LAST,
                              wtime DESC, total_price DESC, total_payment_price DESC) AS version_rank
    FROM versions WHERE channel = 'b2s')
  WHERE version_rank = 1
)"""

# Item rows of the latest versions (`every_web`), and those whose local (UTC+9) order day is within the window (`web`).
UNNEST_SQL = VERSIONS_SQL + """,
every_web AS (
  SELECT member_code AS customer_id, order_no AS order_id, wtime AS ordered_at, ordered_on,
         updated_at AS source_updated_at, same_update_rows AS latest_timestamp_row_count, total_price AS order_total,
         total_payment_price AS paid_total, section_position, item_position,
         s->>'$.orderSectionCode' AS order_section_code, s->>'$.orderSectionNo' AS order_section_no,
         s->>'$.orderSectionStatus' AS section_status, i->>'$.orderItemCode' AS order_item_code,
         i->>'$.orderSectionItemNo' AS order_section_item_no, i->>'$.productInfo.prodNo' AS product_id,
         i->>'$.productInfo.prodName' AS product_name, i->>'$.qty' AS quantity_raw,
         CASE WHEN regexp_full_match(i->>'$.qty', '[0-9]+') THEN TRY_CAST(i->>'$.qty' AS BIGINT) END AS quantity,
         sha256(CAST(i AS VARCHAR)) AS item_json_sha256
  FROM (
    SELECT *, s->('$.sectionItems[' || item_position || ']') AS i FROM (
      SELECT *, unnest(range(CAST(json_array_length(s->'$.sectionItems') AS INT)))::INT AS item_position FROM (
        SELECT *, CAST(sections AS JSON)->('$[' || section_position || ']') AS s FROM (
          SELECT *, CAST(wtime + INTERVAL 9 HOURS AS DATE) AS ordered_on,
                 unnest(range(CAST(json_array_length(CAST(sections AS JSON)) AS INT)))::INT AS section_position
          FROM latest WHERE member_code IS NOT NULL))))
),
web AS (SELECT * FROM every_web WHERE ordered_on BETWEEN DATE '1995-06-01' AND DATE '2001-05-31')"""

APP_SQL = """
every_app AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, 'APP-' || o_orderkey AS order_id, o_orderdate AS ordered_at,
         CAST(o_orderdate + INTERVAL 9 HOURS AS DATE) AS ordered_on, o_orderdate AS source_updated_at,
         CAST(1 AS BIGINT) AS latest_timestamp_row_count, CAST(NULL AS BIGINT) AS order_total,
         CAST(NULL AS BIGINT) AS paid_total, 0 AS section_position, 0 AS item_position, 'APP' AS order_section_code,
         '0' AS order_section_no,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'PRODUCT_PREPARATION' WHEN '2-HIGH' THEN 'SHIPPING'
              WHEN '3-MEDIUM' THEN 'SHIPPING_COMPLETE' WHEN '5-LOW' THEN 'RETURN_COMPLETE' ELSE 'APP_ON_HOLD' END AS section_status,
         o_orderkey || '-0' AS order_item_code, '0' AS order_section_item_no, CAST(o_orderkey % 97 AS VARCHAR) AS product_id,
         'app item' AS product_name, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS quantity_raw, CAST(o_orderkey % 5 + 1 AS BIGINT) AS quantity,
         sha256('{"productId":"' || (o_orderkey % 97) || '","productName":"app item","quantity":' || (o_orderkey % 5 + 1) || '}') AS item_json_sha256
  FROM orders
),
app AS (SELECT * FROM every_app WHERE ordered_on BETWEEN DATE '1995-06-01' AND DATE '2001-05-31')"""
