"""Queries of the operators in this folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import entity_match, leakage, nearest_time, packing, pii
from tallyloom.operators.instants import resolve_instants
from tallyloom.plans.data_oracle import times
from tallyloom.session import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Settlements without ids, paired with the nearest payment of their merchant within 900 seconds."""
    s = _table(spark, d, "settlements").where(nearest_time.blank(F.col("txn_id")) & nearest_time.blank(F.col("order_id")))
    left = s.select(F.col("record_uid").alias("left_id"), F.col("merchant_id").alias("entity"), F.unix_micros(F.col("txn_ts").cast("timestamp")).alias("us"))
    p = _table(spark, d, "payments").where("merchant_id is not null")
    p = resolve_instants(p, "txn_ts", "source_name", "received_at", _table(spark, d, "feeds"), keep=["record_uid", "merchant_id"])
    right = p.select(F.col("record_uid").alias("right_id"), F.col("merchant_id").alias("entity"), F.col("instant_us").alias("us"))
    return nearest_time.nearest_within(left, right, 900_000_000).select(F.col("right_id").alias("payment_uid"), F.col("left_id").alias("settlement_uid"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Payments without ids with the order they pay for and the confidence of the match."""
    return entity_match.match_tables(*(_table(spark, d, t) for t in ("payments", "order_txns", "feeds")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("order_uid", "payment_uid")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of 4,096 tokens."""
    return packing.pack(packing.token_counts(_table(spark, d, "documents")))


#: Limits that bind in turn: few documents a container, or few attention cells, or tokens.
THREE_LIMITS = {"capacity": packing.CAPACITY, "max_documents": 6, "max_attention": packing.CAPACITY**2 // 4}


def p7_three_limits(spark: SparkSession, d: str) -> DataFrame:
    """Containers under limits of tokens, documents and attention cost: how many each limit stops, and what each leaves unused."""
    packed = packing.pack(packing.token_counts(_table(spark, d, "documents")), **THREE_LIMITS)
    loads = packing.container_loads(packed, **THREE_LIMITS)
    least = F.least("tokens_unused", "documents_unused", "attention_unused")
    bound = F.when(F.col("tokens_unused") == least, "tokens").when(F.col("attention_unused") == least, "attention").otherwise("documents")
    return loads.groupBy(bound.alias("tightest")).agg(F.count("*").alias("containers"), *[F.round(F.avg(f"{x}_unused"), 4).alias(f"{x}_unused") for x in ("tokens", "documents", "attention")])


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What both packings promise, as counts of documents and of broken promises."""
    counts = cut(packing.token_counts(_table(spark, d, "documents")))
    out = [packing.packing_checks(counts, packing.pack(counts, **k), **k).withColumn("limits", F.lit(name)) for name, k in (("tokens", {}), ("three", THREE_LIMITS))]
    return out[0].unionByName(out[1])


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the words covered and the share of them found."""
    return leakage.leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("item_id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information in documents, distinct."""
    return pii.find_pii(_table(spark, d, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def p9_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Documents with placeholders for personal information."""
    documents = _table(spark, d, "documents")
    return pii.replace_pii(documents, pii.find_pii(documents)).select("doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_matches, p7_containers, p7_three_limits, p7_checks, p8_found, p8_leaks, p9_found, p9_replaced)}

_NEAREST = f"""
  with {times("select record_uid, merchant_id, txn_ts as tx, zone_name as z, date_order as o from payments p left join feeds f on p.source_name = f.source_name where merchant_id is not null")},
  asked as (select record_uid, merchant_id, epoch_us(txn_ts) as t from settlements where trim(coalesce(txn_id, '')) = '' and trim(coalesce(order_id, '')) = '')
  select payment_uid, settlement_uid from (
    select p.record_uid as payment_uid, a.record_uid as settlement_uid, row_number() over (partition by a.record_uid order by abs(p.us - a.t), p.record_uid) as n
    from asked a join read p on p.merchant_id = a.merchant_id and p.us between a.t - 900000000 and a.t + 900000000) where n = 1"""

ORACLES = {
    "p3_found": _NEAREST,
    "p7_checks": """
      select count(*) as documents, count(*) as placed, 0::bigint as tokens_lost, 0::bigint as split, 0::bigint as over_tokens, 0::bigint as over_documents, 0::bigint as over_attention, l.limits
      from documents, (values ('tokens'), ('three')) l(limits) group by l.limits""",
}
