"""Repeated payments: the same transaction id again, or the same merchant, order and amount again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, small


def occurrence(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """df with occurrence: the row's place within its key by time (missing last), then tie.

    A key is cut by day, each day ranked by itself and shifted by the rows of earlier days, so that a key with a third of
    all rows isn't sorted by one task.
    """
    day = F.coalesce(F.to_date(time), F.lit("9999-12-31").cast("date"))
    x = df.withColumn("_day", day)
    own = [f"_k{i}" for i in range(len(keys))]
    sizes = x.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.where("_before > 0").select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("_day").alias("_d"), "_before")
    x = x.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(F.col(time).asc_nulls_last(), tie)))
    on = F.col("_day") == F.col("_d")
    for k, o in zip(keys, own, strict=True):
        on &= F.col(k).eqNullSafe(F.col(o))
    return x.join(before, on, "left").withColumn("occurrence", (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, "occurrence")


def _of_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """df's rows whose keys occur more than once (nulls are alike): a count with a map-side part, then a small list to look rows up in."""
    own = [f"_o{i}" for i in range(len(keys))]
    again = small(cut(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)])))
    on = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        on &= F.col(k).eqNullSafe(F.col(o))
    return cut(df.join(again, on, "left_semi"))


def repeated_payments(payments: DataFrame) -> DataFrame:
    """record_uid, dupe_key, dupe_reason, occurrence (from 2 on); an exact repeat isn't reported as a near one too."""
    exact = occurrence(_of_repeated(payments.where("txn_id is not null and txn_id <> ''").select("record_uid", "txn_id", "txn_ts"), ["txn_id"]), ["txn_id"], "txn_ts", "record_uid").where("occurrence > 1")
    exact = cut(exact.select("record_uid", F.col("txn_id").alias("dupe_key"), F.lit("EXACT_TXN_ID").alias("dupe_reason"), "occurrence"))
    alike = ["merchant_id", "order_id", "amount_minor"]
    near = occurrence(_of_repeated(payments.where("order_id is not null and order_id <> ''").select("record_uid", *alike, "txn_ts"), alike), alike, "txn_ts", "record_uid").where("occurrence > 1")
    key = F.concat("merchant_id", F.lit("|"), "order_id", F.lit("|"), F.col("amount_minor").cast("string"))
    near = near.join(exact.select("record_uid"), "record_uid", "left_anti")
    return exact.unionByName(near.select("record_uid", key.alias("dupe_key"), F.lit("SAME_ORDER_AMOUNT").alias("dupe_reason"), "occurrence"))
