"""Declared schemas of the sources; nothing is inferred."""

from __future__ import annotations

TRANSACTIONS = "transaction_id long, user_id long, user_uuid string, amount double, currency string, transaction_type string, promo_code_id long, status string, created_at long"
CANCELLATIONS = "cancellation_id long, original_transaction_id long, reason string, cancelled_at string, refund_amount double"
RATES = "update_id long, timestamp long, rate_tgrk_punk double, rate_tgrk_rub double"
USERS = "user_id long, user_uuid string, name string, email string, registered_at long, is_test_user boolean"
TEST_USERS = "test_user_uuid string"
PROMO_CODES = "promo_code_id long, code string, max_uses long, expiry_date string"
#: One message of the event stream: all three kinds, told apart by ``_source``.
STREAM_EVENT = f"_source string, {TRANSACTIONS}, {CANCELLATIONS}, {RATES}"
KINDS = {"transaction": TRANSACTIONS, "cancellation": CANCELLATIONS, "exchange_rate": RATES}
WATERMARKS = "watermark_id string, table_name string, source_partition string, rows_in_batch long, committed_at string"
DEAD_LETTERS = "dlq_pk string, source_table string, reason string, payload_json string, event_day_observed string"


def columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]
