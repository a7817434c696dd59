"""Problem 2: messages delivered more than once, dropped through per-file deletion vectors.

Only the identifier, the delivery order and the row's place (file, row number) are shuffled. Keys seen once leave at the
first aggregation, whose map-side part also collapses a key that holds a third of all rows; the losers' places become
bitmaps of 32,768 rows each, and the wide rows are read again in place with a bit test, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import cut, small

ROWS_A_BITMAP = 32_768
#: Bitmaps (4 KB each) that one read holds in memory; more files are read in several groups.
BITMAPS_A_READ = 8_192

_FILE, _ROW = "__place_file", "__place_row"


def placed(df: DataFrame) -> DataFrame:
    """df, as read from Parquet, with each row's file and number in it."""
    return df.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))


def message_key(c: Column) -> Column:
    """Trimmed, in upper case; null if it has no digit and so identifies nothing."""
    key = F.upper(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(key.rlike("[0-9]"), key)


def deletion_vectors(rows: DataFrame, key: Column, order: str, tie: str) -> DataFrame:
    """(file, bucket, bitmap, dropped) of all rows but the first of each key; rows: from placed().

    First is the least order, then tie, then place; nulls come last. Null keys identify nothing and lose no row.
    """
    narrow = rows.select(key.alias("k"), F.struct(F.col(order).isNull().alias("a"), F.col(order).alias("b"), F.col(tie).isNull().alias("c"), F.col(tie).alias("d"), F.col(_FILE).alias("f"), F.col(_ROW).alias("r")).alias("w"))
    narrow = narrow.where("k is not null")
    first = cut(narrow.groupBy("k").agg(F.min("w").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("k1"), F.col("first.f").alias("ff"), F.col("first.r").alias("fr")))
    losers = narrow.select("k", F.col("w.f").alias("f"), F.col("w.r").alias("r")).join(small(first), F.col("k") == F.col("k1")).where((F.col("f") != F.col("ff")) | (F.col("r") != F.col("fr")))
    return losers.groupBy(F.col("f").alias("file"), F.expr(f"r div {ROWS_A_BITMAP}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(r % {ROWS_A_BITMAP})").alias("bitmap"), F.count("*").alias("dropped"))


def apply_vectors(rows: DataFrame, vectors: DataFrame, dropped: bool = False) -> DataFrame:
    """rows (from placed()) without the rows that vectors marks, or those only. vectors: cut or read from a table."""
    files = vectors.groupBy("file").count().orderBy("file").collect()  # a row a file, as the reader's own listing
    groups: list[list[str]] = [[]]
    held = 0
    for f, n in files:
        if held + n > BITMAPS_A_READ and groups[-1]:
            groups.append([])
            held = 0
        groups[-1].append(f)
        held += n
    bucket, bit = F.expr(f"{_ROW} div {ROWS_A_BITMAP}"), F.expr(f"cast({_ROW} % {ROWS_A_BITMAP} as int)")
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.expr("1 + __bit div 8").cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.expr("shiftright(__byte, __bit % 8) & 1") == 1, F.lit(False))
    out = None
    for g in groups:
        part, mine = rows, vectors
        if len(groups) > 1:
            part, mine = rows.where(F.col(_FILE).isin(g)), vectors.where(F.col("file").isin(g))
        joined = part.withColumn("__bucket", bucket).join(F.broadcast(mine.select(F.col("file").alias("__file"), F.col("bucket").alias("__b"), F.col("bitmap").alias("__bitmap"))), (F.col(_FILE) == F.col("__file")) & (F.col("__bucket") == F.col("__b")), "inner" if dropped else "left")
        joined = joined.withColumn("__bit", bit).withColumn("__byte", byte).where(marked if dropped else ~marked).select(*rows.columns)
        out = joined if out is None else out.unionByName(joined)
    if len(groups) > 1 and not dropped:
        out = out.unionByName(rows.where(~F.col(_FILE).isin([f for f, _ in files])))
    return out.drop(_FILE, _ROW)


def redelivered(spark: SparkSession, path: str, columns: list[str] | None = None, dropped: bool = False, key: str = "txn_id", order: str = "received_at", tie: str = "record_uid") -> DataFrame:
    """The table at path with one copy of each message, or the copies to drop.

    Rows are one message if key agrees after trimming and ignoring case and has a digit. The earliest order stays, then
    the least tie, then the first in file order (so exact repeats keep one row). Null, blank and digitless keys are all
    kept. An empty table gives an empty result. Other columns pass through as they
    are; names that start with two underscores are reserved.
    """
    table = spark.read.parquet(path)
    vectors = cut(deletion_vectors(placed(table.select(*dict.fromkeys([key, order, tie]))), message_key(F.col(key)), order, tie))
    return apply_vectors(placed(table.select(*(columns or table.columns))), vectors, dropped)


def flag_audit(payments: DataFrame, flags: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per dupe_reason of an earlier detector (upper case, null as '(none)'): rows flagged, of these confirmed, false alarms.

    Repeated flags of one record count once a reason; flags of unknown records are false alarms; null record_uid is left out.
    """
    f = flags.where("record_uid is not null").select("record_uid", F.upper(F.coalesce("dupe_reason", F.lit("(none)"))).alias("dupe_reason")).distinct()
    hit = f.join(dropped.select(F.col("record_uid").alias("_d")).distinct(), F.col("record_uid") == F.col("_d"), "left")
    return hit.groupBy("dupe_reason").agg(F.count("*").alias("flagged"), F.count("_d").alias("confirmed"), F.count_if(F.col("_d").isNull()).alias("false_alarms"))
