"""Columns of the canonical transaction table and of links."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

# The canonical columns in their order.
CANONICAL = T.StructType(
    [T.StructField(n, _S) for n in ("record_uid", "source_kind", "source_name", "txn_id", "order_id", "reference_id", "ref_digits", "merchant_id")]
    + [T.StructField("amount_minor", _L), T.StructField("fee_minor", _L), T.StructField("currency", _S), T.StructField("txn_ts", T.TimestampNTZType()), T.StructField("day_bucket", T.DateType()), T.StructField("status", _S), T.StructField("is_refund", T.BooleanType()), T.StructField("raw", _S)]
)

LINKS = T.StructType([T.StructField(n, _S) for n in ("left_uid", "right_uid", "stage", "rule")] + [T.StructField("confidence", _D), T.StructField("amount_delta_minor", _L), T.StructField("time_delta_sec", _L)])

# What source columns are called, lower case and without punctuation, by canonical column.
ALIASES = {
    "txn_id": ["txnid", "transactionid", "txn", "paymentid", "utr", "rrn", "gatewaytxnid", "transactionreference", "bankreferenceno"],
    "order_id": ["orderid", "order", "orderno", "ordernumber", "invoiceid", "invoiceno", "merchantorderid", "externalorderid"],
    "reference_id": ["referenceid", "reference", "ref", "refno", "narration", "description", "remarks", "particulars", "settlementreference"],
    "merchant_id": ["merchantid", "merchant", "sellerid", "storeid", "vendorid", "mid"],
    "amount_minor": ["amount", "amt", "grossamount", "orderamount", "paymentamount", "settlementamount", "netamount", "value", "credit", "transactionamount"],
    "fee_minor": ["fee", "fees", "commission", "charges", "gatewayfee", "mdr", "processingfee", "deduction"],
    "currency": ["currency", "curr", "ccy", "currencycode"],
    "txn_ts": ["timestamp", "datetime", "date", "txndate", "transactiondate", "createdat", "paymentdate", "settlementdate", "valuedate", "time"],
    "status": ["status", "state", "txnstatus", "paymentstatus"],
}
# Statuses of money that went back, and of money that never moved.
REFUNDED = ("refund", "refunded", "reversal", "reversed", "chargeback")
FAILED = ("failed", "failure", "declined", "cancelled", "canceled", "void")
