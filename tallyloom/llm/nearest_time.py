"""Problem 3: records paired with the nearest record in time of the same entity, within a tolerance.

Buckets are as wide as the tolerance, so that a partner lies in the same bucket or an adjacent one: rows are joined on the
entity and the same or adjacent bucket, filtered by difference, and the least (difference, id) is kept. What is joined is
not the rows of a crowded bucket but summaries: instants of the right side are first reduced to one row each (the least
id), a bucket is cut into SLOTS slots, and a slot offers its first and its last instant, one of which is the nearest for
any instant outside it. So an asked instant meets at most 3 * SLOTS slots however many rows share an entity. Within its own
slot the nearest before and after it are found by running over the slot in order of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, small

SLOTS = 16


def nearest_within(left: DataFrame, right: DataFrame, tolerance_us: int) -> DataFrame:
    """left_id, right_id, gap_us: each left row with its nearest right row of the same entity.

    left: left_id, entity, us; right: right_id, entity, us. Ties go to the least right_id. Rows with a null entity or time
    have no partner; a left row without one gives no row; repeated left rows are each paired. Empty sides give no rows.
    """
    step = max(-(-tolerance_us // SLOTS), 1)
    slot = F.expr(f"us div {step} - if(us < 0 and us % {step} <> 0, 1, 0)")
    bucket = F.expr(f"slot div {SLOTS} - if(slot < 0 and slot % {SLOTS} <> 0, 1, 0)")
    left = left.where("entity is not null and us is not null and left_id is not null").select("left_id", "entity", "us")
    asked = cut(left.select("entity", "us").distinct().withColumn("slot", slot).withColumn("bucket", bucket))
    beside = F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)])).alias("_b")
    near = asked.select(F.col("entity").alias("_e"), "bucket").distinct().select("_e", beside).distinct()
    offered = right.where("entity is not null and us is not null and right_id is not null").select("entity", "us", "right_id").withColumn("slot", slot).withColumn("bucket", bucket)
    offered = offered.join(small(cut(near)), (F.col("entity") == F.col("_e")) & (F.col("bucket") == F.col("_b")), "left_semi")
    offered = cut(offered.groupBy("entity", "us", "slot", "bucket").agg(F.min("right_id").alias("right_id")))

    # other slots of the same and the adjacent buckets
    ends = offered.groupBy("entity", "bucket", "slot").agg(F.min(F.struct("us", "right_id")).alias("first"), F.max(F.struct("us", "right_id")).alias("last"))
    ends = ends.select(F.col("entity").alias("_e"), F.col("bucket").alias("_o"), F.col("slot").alias("_s"), "first", "last")
    gap = lambda c: F.struct(F.abs(F.col(f"{c}.us") - F.col("us")).alias("gap_us"), F.col(f"{c}.right_id").alias("right_id"))
    across = asked.select("entity", "us", "slot", beside).join(ends, (F.col("entity") == F.col("_e")) & (F.col("_b") == F.col("_o")) & (F.col("slot") != F.col("_s")))
    across = across.select("entity", "us", F.when(F.col("_s") < F.col("slot"), gap("last")).otherwise(gap("first")).alias("best"))

    # within a slot
    here = Window.partitionBy("entity", "slot")
    both = asked.select("entity", "slot", "us", F.lit(None).cast(dict(offered.dtypes)["right_id"]).alias("right_id")).unionByName(offered.select("entity", "slot", "us", "right_id"))
    offer = F.when(F.col("right_id").isNotNull(), F.struct("us", "right_id"))
    back = here.orderBy(F.col("us").asc(), F.col("right_id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    on = here.orderBy(F.col("us").desc(), F.col("right_id").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("before", F.last(offer, ignorenulls=True).over(back)).withColumn("after", F.last(offer, ignorenulls=True).over(on)).where("right_id is null")
    inside = inside.select("entity", "us", F.least(F.when(F.col("before").isNotNull(), gap("before")), F.when(F.col("after").isNotNull(), gap("after"))).alias("best"))

    met = inside.unionByName(across).where(F.col("best.gap_us") <= tolerance_us)
    best = met.groupBy("entity", "us").agg(F.min("best").alias("best"))
    found = cut(best.select(F.col("entity").alias("_e"), F.col("us").alias("_u"), "best.right_id", "best.gap_us"))
    return left.join(small(found), (F.col("entity") == F.col("_e")) & (F.col("us") == F.col("_u"))).select("left_id", "right_id", "gap_us")


def blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[\s\p{Z}]*$"), F.lit(True))
