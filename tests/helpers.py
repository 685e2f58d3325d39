"""Small inputs built by hand."""
from datetime import date, datetime

from pyspark.sql import functions as F

from rebuyflow.schemas import DAILY_EVENT

ITEM = ("customer_id string, order_id string, product_id string, order_item_code string, order_section_item_no string, "
        "ordered_at timestamp, ordered_on date, quantity bigint, extracted_at timestamp, section_status string")
SEEN = datetime(2026, 9, 16, 1)


def items(spark, rows):
    """Rows (day, product, quantity, status[, order]) of customer 001, one order each unless named."""
    out = []
    for i, (day, product, quantity, status, *order) in enumerate(rows):
        d = date.fromisoformat(day)
        out.append(("001", order[0] if order else str(i), product, str(i), str(i), datetime(d.year, d.month, d.day, 1), d, quantity, SEEN, status))
    return spark.createDataFrame(out, ITEM)


def events(spark, rows):
    """Rows (id, customer, product, day, state, quantity)."""
    data = [(i, c, p, date.fromisoformat(d), state, q if state == "completed" else None, 1, 1, SEEN) for i, c, p, d, state, q in rows]
    return spark.createDataFrame(data, DAILY_EVENT)


def identity():
    return F.concat_ws("|", "order_id", "order_section_item_no")


def by(df, key, *fields):
    """{key: value or tuple of values} of a small frame."""
    return {r[key]: (r[fields[0]] if len(fields) == 1 else tuple(r[f] for f in fields)) for r in df.collect()}
