"""Links folded into one case per order, unlinked payment or unlinked settlement, and the cases' types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.config import CONFIG, EngineConfig

_ORDER = ["order_uid", "payment_uid", "order_id", "merchant_id", "currency", "order_amount_minor", "payment_amount_minor", "order_ts", "payment_ts", "payment_is_refund", "payment_fee_minor", "payment_merchant_id", "payment_currency", "op_confidence", "op_stage", "op_rule", "op_time_delta_sec"]
_SETTLEMENT = ["settlement_uid", "settlement_amount_minor", "settlement_fee_minor", "settlement_ts", "ps_confidence", "ps_time_delta_sec"]


def build_cases(orders: DataFrame, payments: DataFrame, settlements: DataFrame, op_links: DataFrame, ps_links: DataFrame, repeats: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """One row a case, with its legs, deltas and type. Empty legs are fine; a repeat's reason is the first by name.

    Payments take both links and their repeats in one partitioning by their uid; settlements and then orders join in full,
    so that each leg is shuffled once and unlinked rows need no pass of their own. Rows without a partner get a key of
    their own instead of a null, which would gather them all in one task.
    """
    c = F.col
    p = payments.select(c("record_uid").alias("payment_uid"), c("order_id").alias("p_order_id"), c("merchant_id").alias("p_merchant_id"), c("currency").alias("p_currency"), c("amount_minor").alias("payment_amount_minor"), c("fee_minor").alias("p_fee_minor"), c("txn_ts").alias("payment_ts"), c("is_refund").alias("p_is_refund"))
    op = op_links.select(c("right_uid").alias("_p1"), c("left_uid").alias("_o"), c("confidence").alias("op_confidence"), c("stage").alias("op_stage"), c("rule").alias("op_rule"), c("time_delta_sec").alias("op_time_delta_sec"))
    ps = ps_links.select(c("left_uid").alias("_p2"), c("right_uid").alias("_s"), c("confidence").alias("ps_confidence"), c("time_delta_sec").alias("ps_time_delta_sec"))
    d = repeats.groupBy(c("record_uid").alias("_d")).agg(F.min("dupe_reason").alias("dupe_reason"))
    own = lambda link, *uids: F.coalesce(link, *[F.concat(F.lit("#"), u) for u in uids])
    paid = p.join(op, c("payment_uid") == c("_p1"), "left").join(ps, c("payment_uid") == c("_p2"), "left").join(d, c("payment_uid") == c("_d"), "left").withColumn("_s", own(c("_s"), c("payment_uid")))
    s = settlements.select(c("record_uid").alias("settlement_uid"), c("order_id").alias("s_order_id"), c("merchant_id").alias("s_merchant_id"), c("currency").alias("s_currency"), c("amount_minor").alias("settlement_amount_minor"), c("fee_minor").alias("settlement_fee_minor"), c("txn_ts").alias("settlement_ts"))
    settled = paid.join(s, c("_s") == c("settlement_uid"), "full").withColumn("_o", own(c("_o"), c("payment_uid"), c("settlement_uid")))
    o = orders.select(c("record_uid").alias("order_uid"), c("order_id").alias("o_order_id"), c("merchant_id").alias("o_merchant_id"), c("currency").alias("o_currency"), c("amount_minor").alias("order_amount_minor"), c("txn_ts").alias("order_ts"))
    x = o.join(settled, c("order_uid") == c("_o"), "full")
    loose = c("order_uid").isNull() & c("payment_uid").isNull()
    of_leg = lambda n: F.when(c("order_uid").isNotNull(), c(f"o_{n}")).when(c("payment_uid").isNotNull(), c(f"p_{n}")).otherwise(c(f"s_{n}"))
    x = x.withColumns({n: of_leg(n) for n in ("order_id", "merchant_id", "currency")} | {
        "payment_merchant_id": F.when(loose, c("s_merchant_id")).otherwise(c("p_merchant_id")), "payment_currency": F.when(loose, c("s_currency")).otherwise(c("p_currency")),
        "payment_is_refund": F.when(loose, F.lit(False)).otherwise(c("p_is_refund")), "payment_fee_minor": F.when(loose, F.lit(0).cast("long")).otherwise(c("p_fee_minor")), "is_duplicate": c("_d").isNotNull(),
    })
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    by_rate = F.rint(zero("payment_amount_minor") * config.fee_bps / 10_000).cast("long")
    x = x.withColumns(
        {
            "expected_fee_minor": F.coalesce(F.nullif("settlement_fee_minor", F.lit(0)), F.nullif("payment_fee_minor", F.lit(0)), by_rate),
            "configured_fee_minor": by_rate,
            "payment_delta_minor": zero("payment_amount_minor") - zero("order_amount_minor"),
            "settlement_delta_minor": zero("payment_amount_minor") - zero("settlement_amount_minor"),
            "case_id": F.coalesce("order_uid", "payment_uid", "settlement_uid"),
            "confidence": F.coalesce("op_confidence", "ps_confidence", F.lit(0.0)),
        }
    )
    return x.withColumn("exception_type", case_type(config)).select("case_id", *_ORDER, *_SETTLEMENT, "is_duplicate", "dupe_reason", "expected_fee_minor", "configured_fee_minor", "payment_delta_minor", "settlement_delta_minor", "exception_type", "confidence")


def case_type(config: EngineConfig = CONFIG) -> Column:
    """The first type whose condition holds: causes stand before symptoms."""
    c = F.col
    rules = [
        ("DUPLICATE", c("is_duplicate")),
        ("REFUND", c("payment_is_refund")),
        ("ORPHAN_SETTLEMENT", c("order_uid").isNull() & c("payment_uid").isNull()),
        ("ORPHAN_PAYMENT", c("order_uid").isNull()),
        ("MISSING_PAYMENT", c("payment_uid").isNull()),
        ("CURRENCY_MISMATCH", c("payment_currency") != c("currency")),
        ("MERCHANT_MISMATCH", c("payment_merchant_id") != c("merchant_id")),
        ("PARTIAL_PAYMENT", c("payment_delta_minor") < -config.amount_tolerance),
        ("OVERPAYMENT", c("payment_delta_minor") > config.amount_tolerance),
        ("MISSING_SETTLEMENT", c("settlement_uid").isNull()),
        ("SETTLEMENT_SHORTFALL", (c("settlement_delta_minor") > config.amount_tolerance) & (F.abs(c("settlement_delta_minor") - c("expected_fee_minor")) > config.fee_tolerance)),
        ("AMOUNT_MISMATCH", c("settlement_delta_minor") < -config.amount_tolerance),
        ("FEE_VARIANCE", F.abs(c("expected_fee_minor") - c("configured_fee_minor")) > config.fee_tolerance),
        ("TIMING_MISMATCH", F.abs("op_time_delta_sec") > config.window_sec),
        ("TIMING_MISMATCH", c("ps_time_delta_sec") > config.settlement_sec),
    ]
    name, condition = rules[0]
    out = F.when(condition, name)
    for name, condition in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise("MATCHED")
