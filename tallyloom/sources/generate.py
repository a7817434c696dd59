"""Reproducible datasets of any size with labelled anomalies; rows come from hashes of seed and key and don't depend on partitions."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import CONFIG


def generate_orders(spark: SparkSession, n: int, seed: int = 42, customers: int = 10_000, days: int = 365) -> DataFrame:
    """n rows of o_orderkey (0, 1, ...), o_custkey, o_totalprice and o_orderdate, from which plans.legs derives legs and truth."""
    draw = lambda salt, size: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(size))
    price = (draw("price", 49_900_000) + 100_000) / 100
    return spark.range(n).select(F.col("id").alias("o_orderkey"), draw("customer", customers).alias("o_custkey"), price.alias("o_totalprice"), F.timestamp_seconds(F.lit(1_767_225_600) + draw("day", days) * 86_400).cast("timestamp_ntz").alias("o_orderdate"))


@dataclass(frozen=True)
class AnomalyMix:
    """Share of orders that carry each anomaly, in the order in which they are dealt. The default rates."""

    amount_mismatch: float = 0.020
    duplicate: float = 0.010
    missing_payment: float = 0.010
    missing_settlement: float = 0.005
    timing_mismatch: float = 0.005
    refund: float = 0.005
    fee_variance: float = 0.010
    partial_payment: float = 0.005
    orphan_payment: float = 0.003
    merchant_mismatch: float = 0.002

    def kinds(self) -> tuple[str, ...]:
        return tuple(f.name for f in fields(self))


# Prices in major units, gateways and the number of merchants.
PRICES = (499, 899, 1250, 2500, 4999, 12500, 250, 75)
GATEWAYS = ("RAZORPAY", "PAYU", "CASHFREE", "STRIPE")
MERCHANTS = 40
START = 1_785_542_400  # 2026-08-01T00:00:00Z


def _text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def _named(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def generate_dataset(spark: SparkSession, n: int, seed: int = 42, mix: AnomalyMix | None = None, coverage: bool | None = None, start: int = START) -> dict[str, DataFrame]:
    """orders, payments and settlements as their sources write them, and ground_truth (order_id, txn_id, expected_label, expected_payment, expected_settlement).

    coverage gives each anomaly at least one order (default: below 2,000 orders, where rates alone would miss some): the
    first orders take one kind each, in the order of the mix. An orphan payment is two findings, as its order misses one.
    """
    mix, coverage = mix or AnomalyMix(), n < 2_000 if coverage is None else coverage
    kinds = mix.kinds()
    i = F.col("id")
    draw = lambda salt, size: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(size))
    within = lambda salt, low, high: F.lit(low) + draw(salt, high - low + 1)
    kind, edge = F.lit(None).cast("string"), 0.0
    roll = draw("kind", 1_000_000) / 1_000_000
    bands = []
    for k in kinds:
        bands.append((k, edge, edge + getattr(mix, k)))
        edge += getattr(mix, k)
    for k, low, high in reversed(bands):
        kind = F.when((roll >= low) & (roll < high), k).otherwise(kind)
    if coverage:
        for j, k in enumerate(kinds):
            kind = F.when(i == j, k).otherwise(kind)
    scale = CONFIG.amount_scale
    fee_of = lambda minor: F.floor(minor * CONFIG.fee_bps / 10_000).cast("long")
    x = spark.range(n).select("id", kind.alias("kind"), (F.element_at(F.array(*[F.lit(p) for p in PRICES]), (draw("price", len(PRICES)) + 1).cast("int")).cast("long") * scale).alias("gross"), within("time", 0, 30 * 86_400).alias("t0"), draw("merchant", MERCHANTS).alias("m"))
    x = x.withColumn("t", F.lit(start) + F.col("t0")).drop("t0")
    gross, is_ = F.col("gross"), lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    most_short = F.greatest(F.lit(6), F.least(F.lit(400), F.floor(gross / (2 * scale))))
    short = draw("sign", 2) == 0
    off = F.when(short, -(5 + F.pmod(F.xxhash64(F.lit(seed), F.lit("short"), "id"), most_short - 4))).otherwise(within("over", 5, 400)) * scale
    part = F.floor(gross * (3_500 + draw("part", 4_001)) / 10_000)
    more = F.greatest(F.floor(gross * within("bps", 30, 120) / 10_000), F.lit(CONFIG.fee_tolerance * 3))
    paid = F.when(is_("amount_mismatch"), gross + off).when(is_("partial_payment"), part).when(is_("orphan_payment"), gross + within("extra", 1, 20) * 7 * scale).otherwise(gross).cast("long")
    x = x.withColumn("paid", paid)
    x = x.withColumn("fee", fee_of(gross) + F.when(is_("fee_variance"), more).otherwise(0).cast("long"))
    arrived = F.when(is_("amount_mismatch") | is_("partial_payment"), F.col("paid") - fee_of(F.col("paid"))).otherwise(gross - F.col("fee"))
    late = is_("timing_mismatch")
    x = x.withColumns({
        "net": arrived.cast("long"), "pt": F.col("t") + F.when(late, within("late", 4, 9) * 86_400).otherwise(within("soon", 1, 90) * 60),
        "order_id": _named("ORD", i + 100_000), "txn_id": _named("TXN", i + 500_000), "merchant": _named("M", F.col("m") + 1_000), "stray": is_("orphan_payment"),
    })
    x = x.withColumns({
        "st": F.col("pt") + F.when(late, within("settle late", 9, 20)).otherwise(within("settle", 1, 3)) * 86_400,
        "p_order": F.when(F.col("stray"), _named("ORDX", i + 900_000)).otherwise(F.col("order_id")), "p_txn": F.when(F.col("stray"), _named("TXNX", i + 900_000)).otherwise(F.col("txn_id")),
        "p_merchant": F.when(F.col("stray"), _named("MX", i % 50 + 9_000)).when(is_("merchant_mismatch"), _named("M", (F.col("m") + 1 + draw("other", MERCHANTS - 1)) % MERCHANTS + 1_000)).otherwise(F.col("merchant")),
        "has_payment": ~is_("missing_payment"), "has_settlement": ~(is_("missing_payment") | is_("missing_settlement") | is_("refund")),
    })
    major = lambda c: (F.col(c) / scale).cast("double")
    orders = x.select("order_id", "txn_id", F.col("merchant").alias("merchant_id"), major("gross").alias("amount"), F.lit("INR").alias("currency"), _text(F.col("t")).alias("timestamp"), F.lit("PLACED").alias("status"), _named("ORD-", i + 100_000).alias("reference"))
    times = F.when(is_("duplicate"), F.array(F.lit(0), F.lit(90))).otherwise(F.array(F.lit(0)))
    gateway = F.element_at(F.array(*[F.lit(g) for g in GATEWAYS]), (draw("gateway", len(GATEWAYS)) + 1).cast("int"))
    p = x.where("has_payment").withColumn("again", F.explode(times))
    payments = p.select(F.col("p_txn").alias("transaction_id"), F.col("p_order").alias("order_id"), F.col("p_merchant").alias("merchant_id"), major("paid").alias("amount"), major("fee").alias("fee"), F.lit("INR").alias("currency"), _text(F.col("pt") + F.col("again")).alias("payment_date"), F.when(is_("refund"), "REFUNDED").otherwise("CAPTURED").alias("status"), F.concat(F.lit("PAY-"), "p_order", F.lit("-"), gateway).alias("narration"))
    loose = spark.range(max(1, int(n * 0.002))).select(
        _named("TXNORPH", i).alias("utr"), _named("ORDORPH", i).alias("order_id"), _named("M", draw("loose", MERCHANTS) + 1_000).alias("merchant_id"), within("loose amount", 100, 5_000).cast("double").alias("settlement_amount"), F.lit(0.0).alias("commission"), F.lit("INR").alias("currency"),
        _text(F.lit(start) + within("loose day", 1, 30) * 86_400).alias("settlement_date"), F.lit("SETTLED").alias("status"), _named("STL-ORPH-", i).alias("settlement_reference"),
    )
    settlements = x.where("has_settlement").select(
        F.col("p_txn").alias("utr"), F.col("p_order").alias("order_id"), F.col("p_merchant").alias("merchant_id"), major("net").alias("settlement_amount"), major("fee").alias("commission"), F.lit("INR").alias("currency"),
        _text(F.col("st")).alias("settlement_date"), F.lit("SETTLED").alias("status"), F.concat(F.lit("STL-"), "p_order").alias("settlement_reference"),
    ).unionByName(loose)
    label = F.when(is_("amount_mismatch"), F.when(short, "PARTIAL_PAYMENT").otherwise("OVERPAYMENT")).when(F.col("stray"), "MISSING_PAYMENT").when(F.col("kind").isNull(), "MATCHED").otherwise(F.upper("kind"))
    yes, no = F.lit(True), F.lit(False)
    own = x.select("order_id", "txn_id", label.alias("expected_label"), F.col("has_payment").alias("expected_payment"), F.col("has_settlement").alias("expected_settlement"))
    strays = x.where("stray").select(F.col("p_order").alias("order_id"), F.col("p_txn").alias("txn_id"), F.lit("ORPHAN_PAYMENT").alias("expected_label"), yes.alias("expected_payment"), yes.alias("expected_settlement"))
    left = loose.select("order_id", F.col("utr").alias("txn_id"), F.lit("ORPHAN_SETTLEMENT").alias("expected_label"), no.alias("expected_payment"), yes.alias("expected_settlement"))
    return {"orders": orders, "payments": payments, "settlements": settlements, "ground_truth": own.unionByName(strays).unionByName(left)}
