"""Projections of the given tables into the library's inputs.

Order items come from lineitem/orders/part, daily events from events, order versions (nested JSON) from single
lines, so every query's work grows with the tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebuyflow.functions.scalars import list_key
from rebuyflow.plans.skew import balanced


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table. Its schema is read from the footers once per process, not by a job per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def line_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order number of every line: how many lines an order has is seen here without a join."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part and order. The line side is the large one; parts and orders join on their keys.

    Orders join last and by the order number as the items carry it, so a shuffled line lies with the others of its order
    and what groups by order needs no further shuffle. Where an order holds a large share of the lines they join by the
    plain key, and grouping combines before a shuffle of its own.
    """
    line = table(spark, sf_dir, "lineitem").withColumn("order_id", F.col("l_orderkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    described = line.join(part, line.l_partkey == part.p_partkey)
    if not balanced(line_orders(spark, sf_dir), ["order_id"]):
        return described.join(orders, described.l_orderkey == orders.o_orderkey)
    return described.join(orders.withColumn("order_id", F.col("o_orderkey").cast("string")).drop("o_orderkey"), "order_id")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order item rows; `order_section_item_no` is a digest of all line columns (lines have no key of their own)."""
    status = (F.when(F.expr("l_returnflag='R' AND l_linenumber=1 AND o_orderstatus='P'"), "RETURN_COMPLETE")
              .when(F.expr("l_returnflag='A' AND l_linenumber=2 AND o_orderstatus='P'"), "CANCEL_COMPLETE")
              .when(F.expr("l_returnflag='N' AND l_linenumber=3 AND o_orderstatus='O'"), "SHIPPING")
              .when(F.col("l_linestatus") == "F", "PURCHASE_CONFIRMATION").otherwise("SHIPPING_COMPLETE"))
    money = [F.col(c).cast("decimal(18,2)").cast("string") for c in ("l_extendedprice", "l_discount", "l_tax")]
    identity = F.md5(F.concat_ws("|", "order_id", "l_linenumber", "l_partkey", "l_suppkey",
                                 F.col("l_quantity").cast("bigint").cast("string"), *money, "l_returnflag", "l_linestatus",
                                 F.col("l_shipdate").cast("date").cast("string")))
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        "order_id",
        F.col("p_type").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("l_linenumber").cast("string").alias("order_item_code"),
        identity.alias("order_section_item_no"),
        F.col("o_orderdate").cast("timestamp").alias("ordered_at"),
        F.col("o_orderdate").cast("date").alias("ordered_on"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").alias("order_total"),
        F.col("l_shipdate").cast("timestamp").alias("extracted_at"),
        status.alias("section_status"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events: user = customer, event type = product, any value above 250 holds the day."""
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").cast("string").alias("customer_id"), F.col("event_type").alias("product_id"),
                     F.col("ts").cast("date").alias("ordered_on"))
            .agg((F.max("value") > 250).alias("held"), F.count("*").alias("n"), F.max("ts").alias("seen"))
            .select(list_key(F.col("customer_id"), F.col("product_id"), F.col("ordered_on")).alias("event_id"),
                    "customer_id", "product_id", "ordered_on",
                    F.when(F.col("held"), "held").otherwise("completed").alias("event_state"),
                    F.when(~F.col("held"), F.col("n")).alias("quantity"),
                    F.col("n").alias("source_rows"),
                    F.col("seen").cast("timestamp").alias("snapshot_observed_at")))


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested order versions: every line is one version of its order, dated by its ship month.

    A version has one section of one item, a second item on even lines, a second section on lines 4 to 6, and no
    section at all on line 7. Quantities of second items are not whole numbers; some products have no number.
    """
    text = F.concat
    lit = F.lit

    def item(code, number, qty, product, name):
        return text(lit('{"orderItemCode":"'), code, lit('","orderSectionItemNo":"'), number, lit('","qty":"'), qty,
                    lit('","productInfo":{'), product, lit('"prodName":"'), name, lit('"}}'))

    line, order = F.col("l_linenumber").cast("string"), F.col("order_id")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    qty = F.col("l_quantity").cast("bigint").cast("string")
    numbered = text(lit('"prodNo":"'), part, lit('",'))
    first = item(text(lit("I"), line), text(order, lit("-"), line, lit("a")), qty,
                 F.when(F.col("l_partkey") % 10 == 0, "").otherwise(numbered), F.col("p_name"))
    second = item(text(lit("J"), line), text(order, lit("-"), line, lit("b")), text(qty, lit(".5")),
                  text(lit('"prodNo":"S'), supp, lit('",')), lit("extra"))
    items = F.when(F.col("l_linenumber") % 2 == 0, text(first, lit(","), second)).otherwise(first)

    def section(number, status, content):
        return text(lit('{"orderSectionCode":"'), order, lit("/"), line, lit('","orderSectionNo":"'), lit(number),
                    lit('","orderSectionStatus":"'), lit(status), lit('","sectionItems":['), content, lit("]}"))

    main = section("1", "SHIPPING_COMPLETE", items)
    more = section("2", "CANCEL_COMPLETE", second)
    sections = (F.when(F.col("l_linenumber") == 7, "[]")
                .when(F.col("l_linenumber") >= 4, text(lit("["), main, lit(","), more, lit("]")))
                .otherwise(text(lit("["), main, lit("]"))))
    return _lines(spark, sf_dir).select(
        order.alias("order_no"),
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("member_code"),
        F.when(F.col("l_suppkey") % 20 == 0, "other").otherwise("b2s").alias("channel"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("wtime"),
        F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("updated_at"),
        F.floor("l_extendedprice").cast("bigint").alias("total_price"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").alias("total_payment_price"),
        sections.alias("sections"))


def whole_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested order versions that carry every row of `order_items`: what the daily batch is given.

    An order has a section per status, and two versions: in the earlier one every section is still in preparation. The
    lists are those of one order.
    """
    item = F.struct(F.col("order_item_code").alias("orderItemCode"), F.col("order_section_item_no").alias("orderSectionItemNo"),
                    F.col("quantity").cast("string").alias("qty"),
                    F.struct(F.col("product_id").alias("prodNo"), F.col("product_name").alias("prodName")).alias("productInfo"))
    listed = (order_items(spark, sf_dir).groupBy("order_id", "customer_id", "ordered_at")
              .agg(F.sort_array(F.collect_list(F.struct("section_status", item.alias("item")))).alias("rows")))
    statuses = F.array_distinct(F.col("rows.section_status"))  # sorted, as the rows are
    orders = listed.withColumn("sections", F.transform(statuses, lambda status: F.struct(
        status.alias("section_status"), F.transform(F.filter("rows", lambda r: r["section_status"] == status), lambda r: r["item"]).alias("items")))).drop("rows")

    def version(days: int, status):
        sections = F.transform("sections", lambda s, i: F.struct(
            F.col("order_id").alias("orderSectionCode"), (i + 1).cast("string").alias("orderSectionNo"), status(s).alias("orderSectionStatus"), s["items"].alias("sectionItems")))
        return F.struct(F.date_add("ordered_at", days).cast("timestamp").alias("updated_at"), F.to_json(sections).alias("sections"))

    versions = F.array(version(0, lambda s: F.lit("PRODUCT_PREPARATION")), version(1, lambda s: s["section_status"]))
    return orders.withColumn("v", F.explode(versions)).select(
        F.col("order_id").alias("order_no"), F.col("customer_id").alias("member_code"), F.lit("b2s").alias("channel"), F.col("ordered_at").alias("wtime"),
        "v.updated_at", F.lit(0).cast("bigint").alias("total_price"), F.lit(0).cast("bigint").alias("total_payment_price"), "v.sections")


def app_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second order source: every order is one app order whose status follows its priority."""
    orders = table(spark, sf_dir, "orders")
    status = (F.when(F.col("o_orderpriority") == "1-URGENT", "paid").when(F.col("o_orderpriority") == "2-HIGH", "shipping")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "delivered").when(F.col("o_orderpriority") == "5-LOW", "refunded")
              .otherwise("on_hold"))
    key = F.col("o_orderkey").cast("string")
    items = F.concat(F.lit('[{"productId":"'), (F.col("o_orderkey") % 97).cast("string"), F.lit('","productName":"app item","quantity":'),
                     (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("}]"))
    return orders.select(key.alias("order_id"), F.col("o_custkey").cast("string").alias("member_code"),
                         F.col("o_orderdate").cast("timestamp").alias("paid_at"),
                         F.col("o_orderdate").cast("timestamp").alias("updated_at"), status.alias("status"), items.alias("items"))
