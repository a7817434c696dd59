"""Three canonical legs derived from the table `orders`, so that every rule, offset and case type occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("record_uid", "txn_id", "order_id", "ref_digits", "merchant_id", "amount_minor", "fee_minor", "currency", "txn_ts", "day_bucket", "status", "is_refund")


def _named(prefix: str, base: int, k: Column) -> Column:
    return F.concat(F.lit(prefix), (k + base).cast("string"))


def _uid(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 10, "0"))


def _pick(b: Column, default: Column, **cases: Column) -> Column:
    """default, but cases['bN_M'] in buckets N, M."""
    out = None
    for name, value in cases.items():
        hit = b.isin(*map(int, name[1:].split("_")))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def _after(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + seconds.cast("long") * 1_000_000).cast("timestamp_ntz")


def base(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    amount = F.rint(F.col("o_totalprice") * 100).cast("long")
    return orders.select(k.alias("k"), (k % 200).alias("b"), F.expr("o_orderkey div 200").alias("j"), F.col("o_custkey").alias("cust"), amount.alias("amt"), _after(F.col("o_orderdate"), (k * 7919) % 86_400).alias("ts")).withColumns({"fee": F.expr("(amt * 200) div 10000"), "merch": _named("M", 1000, F.col("cust") % 40)})


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumns({"day_bucket": F.to_date("txn_ts"), "is_refund": F.lower("status") == "refunded"}).select(*COLUMNS)


def orders_leg(orders: DataFrame) -> DataFrame:
    x, k, b = base(orders), F.col("k"), F.col("b")
    null = F.lit(None).cast("string")
    return _finish(
        x.select(
            _uid("ORD-", k).alias("record_uid"), _pick(b, _named("TXN", 500_000, k), b14_15_16_17_18=null).alias("txn_id"), _pick(b, _named("ORD", 100_000, k), b16_18=null).alias("order_id"),
            _pick(b, (k + 100_000).cast("string"), b14_15_17_18=F.lit("")).alias("ref_digits"), F.col("merch").alias("merchant_id"), F.col("amt").alias("amount_minor"), F.lit(0).cast("long").alias("fee_minor"),
            F.lit("INR").alias("currency"), F.col("ts").alias("txn_ts"), F.lit("PLACED").alias("status"),
        )
    )


def _payments(orders: DataFrame) -> DataFrame:
    """Payments with k, b, j and d (0 the payment itself, 1 and 2 its repeats)."""
    x = base(orders).where("b <> 0").withColumn("d", F.explode(F.when(F.col("b") == 4, F.array(F.lit(0), F.lit(1))).when(F.col("b") == 20, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))))
    k, b, j, d, amt, ts = (F.col(c) for c in ("k", "b", "j", "d", "amt", "ts"))
    null = F.lit(None).cast("string")
    odd = F.when(j % 3 == 0, 30 * 3600).when(j % 3 == 1, 45 * 60).otherwise(-20 * 3600)
    delay = _pick(b, (k % 90 + 1) * 60, b10=F.lit(5 * 86_400), b18=odd) + F.when(d == 1, 90).when(d == 2, 300).otherwise(0)
    return x.select(
        "k", "b", "j", "d", "ts", "merch", "amt",
        _uid("PAY-", k * 10 + d).alias("record_uid"),
        F.when(d == 2, _named("TXNN", 500_000, k)).otherwise(_pick(b, _named("TXN", 500_000, k), b7=_named("TXNX", 900_000, k), b14_15_16_17_18=null)).alias("txn_id"),
        _pick(b, _named("ORD", 100_000, k), b7=_named("ORDX", 900_000, k), b16_17_18=null).alias("order_id"),
        _pick(b, (k + 100_000).cast("string"), b7=(k + 900_000).cast("string"), b14_15_18_22_23=F.lit("")).alias("ref_digits"),
        _pick(b, F.col("merch"), b7=_named("MX", 9_000, k % 50), b8=_named("M", 1_000, (F.col("cust") % 40 + 1) % 40)).alias("merchant_id"),
        _pick(b, amt, b2=F.expr("amt div 2"), b3=amt + 50_000, b7=amt + 70_000, b15=amt - 20_000, b18=amt - 50).alias("amount_minor"),
        _pick(b, F.col("fee"), b6=F.col("fee") + 1_000).alias("fee_minor"),
        _pick(b, F.lit("INR"), b9=F.lit("USD")).alias("currency"),
        _after(ts, delay).alias("txn_ts"),
        _pick(b, F.lit("CAPTURED"), b5=F.lit("REFUNDED"), b19=F.lit("FAILED")).alias("status"),
    )


def payments_leg(orders: DataFrame) -> DataFrame:
    return _finish(_payments(orders).where("status <> 'FAILED'"))


def settlements_leg(orders: DataFrame) -> DataFrame:
    p = _payments(orders).where("d = 0 and b not in (1, 5, 19)")
    k, b, j = F.col("k"), F.col("b"), F.col("j")
    null, blank = F.lit(None).cast("string"), F.lit("")
    net = F.col("amount_minor") - F.col("fee_minor")
    days = _pick(b, k % 3 + 1, b11=F.lit(10), b24=F.lit(20), b23=j % 8)
    a = p.select(
        _uid("SET-", k).alias("record_uid"), _pick(b, F.col("txn_id"), b14_15_16_17_18_21_22_23=null).alias("txn_id"), _pick(b, F.col("order_id"), b16_17_18_21_23=null).alias("order_id"),
        _pick(b, F.col("ref_digits"), b14_15_18_22_23=blank).alias("ref_digits"), "merchant_id", _pick(b, net, b12=net - 30_000, b13=F.col("amount_minor") + 5_000).alias("amount_minor"), "fee_minor", "currency",
        _after(F.col("txn_ts"), days * 86_400).alias("txn_ts"),
    )
    o = base(orders).where("b = 25")
    loose = o.select(
        _uid("SET-", k + 5_000_000).alias("record_uid"), _named("TXNORPH", 0, k).alias("txn_id"), _named("ORDORPH", 0, k).alias("order_id"), blank.alias("ref_digits"), F.col("merch").alias("merchant_id"),
        (F.col("amt") % 500_000 + 1_000).alias("amount_minor"), F.lit(0).cast("long").alias("fee_minor"), F.lit("INR").alias("currency"), F.col("ts").alias("txn_ts"),
    )
    return _finish(a.unionByName(loose).withColumn("status", F.lit("SETTLED")))


def truth(orders: DataFrame) -> DataFrame:
    """order_id, expected_label."""
    x, k, b = base(orders), F.col("k"), F.col("b")
    lit = F.lit
    label = _pick(b, lit("MATCHED"), b0_7_19=lit("MISSING_PAYMENT"), b1=lit("MISSING_SETTLEMENT"), b2_15=lit("PARTIAL_PAYMENT"), b3=lit("OVERPAYMENT"), b4_20=lit("DUPLICATE"), b5=lit("REFUND"), b6=lit("FEE_VARIANCE"), b8=lit("MERCHANT_MISMATCH"), b9=lit("CURRENCY_MISMATCH"), b10_11_24=lit("TIMING_MISMATCH"), b12=lit("SETTLEMENT_SHORTFALL"), b13=lit("AMOUNT_MISMATCH"))
    own = x.select(_named("ORD", 100_000, k).alias("order_id"), label.alias("expected_label"))
    stray = x.where("b = 7").select(_named("ORDX", 900_000, k).alias("order_id"), lit("ORPHAN_PAYMENT").alias("expected_label"))
    loose = x.where("b = 25").select(_named("ORDORPH", 0, k).alias("order_id"), lit("ORPHAN_SETTLEMENT").alias("expected_label"))
    return own.unionByName(stray).unionByName(loose)
