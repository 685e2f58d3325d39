"""Table contracts. Empty text is NULL; identifiers are always strings."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# One nested order version of the web shop; `sections` is JSON text.
ORDER_VERSION = _schema(order_no=S, member_code=S, channel=S, wtime=TS, updated_at=TS, total_price=L,
                        total_payment_price=L, sections=S)

# One paid order of the second (app) source; `items` is JSON text.
APP_ORDER = _schema(order_id=S, member_code=S, paid_at=TS, updated_at=TS, status=S, items=S)

ORDER_ITEM = _schema(
    extracted_at=TS, customer_id=S, order_id=S, ordered_at=TS, ordered_on=D, source_updated_at=TS,
    latest_timestamp_row_count=L, order_total=L, paid_total=L, section_position=I, item_position=I,
    order_section_code=S, order_section_no=S, section_status=S, order_item_code=S, order_section_item_no=S,
    product_id=S, product_name=S, quantity_raw=S, quantity=L, item_json_sha256=S)

POLICY_ADDED = _schema(source_record_number=L, policy_version=S, purchase_decision=S, eligible_quantity=L,
                       sequence_barrier=T.BooleanType(), training_ready=T.BooleanType())

DAILY_EVENT = _schema(event_id=S, customer_id=S, product_id=S, ordered_on=D, event_state=S, quantity=L,
                      source_rows=L, order_count=L, snapshot_observed_at=TS)

PAIR_ERROR = _schema(origin_event_id=S, customer_id=S, product_id=S, origin_on=D, predicted_gap=L, actual_gap=L,
                     error_days=L, alarm_gap=L)

STORE_RHYTHM = _schema(customer_id=S, product_id=S, cart_on=D, cart_quantity=L)

EXCLUSION = _schema(id=S, reason=S)

# Fixed value: header of the legacy fourteen-column export.
LEGACY_HEADER = ("member_code", "고객명", "연락처", "등급", "사업자여부", "가입일", "order_no", "주문일",
                 "주문총액", "결제금액", "섹션상태", "prod_no", "상품명", "수량")


def require_columns(df: DataFrame, required) -> DataFrame:
    """The frame unchanged, or an error naming the missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    return df


def same_schema(frames) -> None:
    """Every frame has the same column names and types, in order."""
    first, *rest = [[(f.name, f.dataType) for f in df.schema.fields] for df in frames]
    if any(other != first for other in rest):
        raise ValueError("Schemas differ")
