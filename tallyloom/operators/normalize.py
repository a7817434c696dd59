"""Source tables of any columns into the canonical transaction table."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import CONFIG
from tallyloom.functions.money import minor_units
from tallyloom.schema import ALIASES, CANONICAL, FAILED, REFUNDED
from tallyloom.session import cut, small

_TEXT = ("txn_id", "order_id", "reference_id", "merchant_id", "currency", "status")
# Time formats in the order they are tried, after what the engine reads by itself.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")
PREFIX = {"ORDER": "ORD", "PAYMENT": "PAY", "SETTLEMENT": "SET"}


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.strip().lower())


def detect_mapping(columns: list[str], explicit: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical column to source column: explicit choices, then equal slugs, then aliases in their order.

    Of source columns with one slug the last counts; an explicit choice of a column that is not there counts as absent.
    """
    by_slug = {slug(c): c for c in columns}
    out = {k: v for k, v in (explicit or {}).items() if v in columns}
    for field, names in ALIASES.items():
        if field not in (explicit or {}):
            hit = next((by_slug[n] for n in (field, *names) if n in by_slug), None)
            if hit is not None:
                out[field] = hit
    return out


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def read_time(c: Column) -> Column:
    """The first reading of a time that succeeds, without zone; null if none does."""
    text = trimmed(c)
    return F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS])


def is_refund(status: Column, signed_minor: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*REFUNDED) | F.coalesce(signed_minor < 0, F.lit(False))


def is_failed(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*FAILED)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def normalize(df: DataFrame, kind: str, source: str, mapping: dict[str, str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """df as canonical rows of kind ORDER, PAYMENT or SETTLEMENT.

    Absent columns give nulls, absent amounts 0, absent currency the default, absent merchant UNKNOWN. Failed rows are
    dropped, then record_uid numbers the rest: by order_by if given, else by their places in the files df was read from
    (which needs no shuffle), else by all columns as JSON. Empty strings stay empty, digits of a null reference are empty.
    A frame without columns or rows gives an empty result. A column named _metadata is taken as the place of the row.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], CANONICAL)
    columns = [c for c in dict.fromkeys(df.columns) if c != "_metadata"]
    at = detect_mapping(columns, mapping)
    types = dict(df.dtypes)
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    filed = not order_by and has_place(df)
    text = {f: trimmed(F.col(f"`{at[f]}`")) if f in at else F.lit(None).cast("string") for f in _TEXT}

    def money(f: str) -> Column:
        if f not in at:
            return F.lit(0).cast("long")
        return minor_units(F.col(f"`{at[f]}`"), types[at[f]] not in ("string", "void"), CONFIG.amount_scale)

    time = read_time(F.col(f"`{at['txn_ts']}`")) if "txn_ts" in at else F.lit(None).cast("timestamp_ntz")
    key = F.struct(*[F.col(f"`{c}`") for c in order_by]) if order_by else F.struct("_metadata.file_path", "_metadata.file_block_start") if filed else raw
    x = df.select(
        *[text[f].alias(f) for f in ("txn_id", "order_id", "reference_id")],
        F.coalesce(text["merchant_id"], F.lit("UNKNOWN")).alias("merchant_id"),
        money("amount_minor").alias("signed"), money("fee_minor").alias("fee"),
        F.upper(F.coalesce(text["currency"], F.lit(CONFIG.default_currency))).alias("currency"),
        time.alias("txn_ts"), text["status"].alias("status"), raw.alias("raw"),
        key.alias("_at"),
    ).where(~is_failed(F.col("status")))
    x = numbered_by_place(x, "_at", "_n") if filed else numbered(x, "_at", "_n")
    return x.select(
        F.concat(F.lit(f"{PREFIX[kind]}-"), F.lpad((F.col("_n") - 1).cast("string"), 10, "0")).alias("record_uid"),
        F.lit(kind).alias("source_kind"), F.lit(source).alias("source_name"), "txn_id", "order_id", "reference_id",
        digits(F.coalesce("reference_id", F.lit(""))).alias("ref_digits"), "merchant_id", F.abs("signed").alias("amount_minor"), F.abs("fee").alias("fee_minor"),
        "currency", "txn_ts", F.to_date("txn_ts").alias("day_bucket"), "status", is_refund(F.col("status"), F.col("signed")).alias("is_refund"), "raw",
    )


def has_place(df: DataFrame) -> bool:
    """Whether df's rows know the file and block they were read from."""
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return False
    return True


def numbered_by_place(df: DataFrame, block: str, out: str) -> DataFrame:
    """df with 1, 2, ... in the order of files, blocks and rows; block: the struct of file and block start.

    Rows of a block are read by one task in their order, so a running id less the block's first one is the place in the
    block. Blocks are counted in a pass that reads only what df's filters need, and the counts meet the rows by broadcast:
    a row a block of some 128 MB, so a million of them stand for 100 TB.
    """
    df = df.withColumn("_seq", F.monotonically_increasing_id())
    sizes = cut(df.groupBy(block).agg(F.count("*").alias("_size"), F.min("_seq").alias("_first")))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = cut(before.select(F.col(block).alias("_block"), "_before", "_first"))
    return df.join(small(before, 1_000_000), F.col(block) == F.col("_block")).withColumn(out, F.col("_before") + F.col("_seq") - F.col("_first") + 1).drop("_seq", "_before", "_first", "_block")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """df with 1, 2, ... in the order of key: ranges are sorted in parallel, and each starts at the count of those before."""
    ranged = df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(key)
    ranged = ranged.withColumn("_seq", F.monotonically_increasing_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_seq").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row a partition, so always small
    return ranged.join(F.broadcast(before.select("_part", "_before", "_first")), "_part").withColumn(out, F.col("_before") + F.col("_seq") - F.col("_first") + 1).drop("_part", "_seq", "_before", "_first")
