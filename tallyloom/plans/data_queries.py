"""Queries of the general data problems (1, 2, 4 and 6) by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators import instants, malformed, orphans, redelivery
from tallyloom.plans import data_oracle


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Readable times of payments and orders that are not yet in the canonical spelling, as microseconds."""
    feeds = _table(spark, d, "feeds")
    legs = [instants.found_instants(_table(spark, d, leg), feeds, leg) for leg in ("payments", "order_txns")]
    return legs[0].unionByName(legs[1])


def p1_states(spark: SparkSession, d: str) -> DataFrame:
    """Rows of payments by source, reading and state of the time."""
    got = instants.resolve_instants(_table(spark, d, "payments"), "txn_ts", "source_name", "received_at", _table(spark, d, "feeds"), keep=["source_name"])
    return got.groupBy("source_name", "instant_format", "instant_state").count().withColumnRenamed("count", "n")


def p1_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Times of both legs read without any declared date order, against the reading with it: rows by source and outcome."""
    from pyspark.sql import functions as F

    feeds = _table(spark, d, "feeds")
    out = None
    for leg in ("payments", "order_txns"):
        told = instants.resolve_instants(_table(spark, d, leg), "txn_ts", "source_name", "received_at", feeds, "told", keep=["source_name", "txn_ts", "received_at"])
        both = instants.resolve_instants(told, "txn_ts", "source_name", "received_at", feeds.withColumn("date_order", F.lit(None).cast("string")), "free", keep=["source_name", "told_us"])
        outcome = F.when(F.col("free_state") == "ambiguous", "ambiguous").when(F.col("free_us").eqNullSafe(F.col("told_us")), "same").otherwise("other")
        part = both.groupBy(F.lit(leg).alias("leg"), "source_name", outcome.alias("outcome")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Redelivered payments rows."""
    return redelivery.redelivered(spark, f"{d}/payments.parquet", ["record_uid"], dropped=True)


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """payments with one row a message, all columns."""
    return redelivery.redelivered(spark, f"{d}/payments.parquet")


def p2_flag_audit(spark: SparkSession, d: str) -> DataFrame:
    """The earlier detector's flags against the copies found."""
    return redelivery.flag_audit(_table(spark, d, "payments"), _table(spark, d, "payment_dupes"), p2_found(spark, d))


def p4_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every payments line with its reason or its values."""
    return malformed.parse_lines(_table(spark, d, "payments"), _table(spark, d, "feeds"), keep=["record_uid"]).drop("parse_field")


def p4_broken_fields(spark: SparkSession, d: str) -> DataFrame:
    """Failed lines by source, reason and the first broken field."""
    from pyspark.sql import functions as F

    got = malformed.parse_lines(_table(spark, d, "payments"), _table(spark, d, "feeds"), keep=["source_name"])
    return got.where("parse_reason is not null").groupBy("source_name", "parse_reason", "parse_field").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that do not parse, with the first reason that applies."""
    from pyspark.sql import functions as F

    return p4_parsed(spark, d).where(F.col("parse_reason").isNotNull() & (F.col("parse_reason") != "source")).select("record_uid", F.col("parse_reason").alias("reason"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References to orders that are missing, deleted or late."""
    return orphans.find_orphans(_table(spark, d, "payments"), _table(spark, d, "settlements"), _table(spark, d, "recon"), _table(spark, d, "order_txns"))


def p6_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Orphans as known at the end of each of four increments of equal time."""
    return orphans.play(_table(spark, d, "payments"), _table(spark, d, "settlements"), _table(spark, d, "recon"), _table(spark, d, "order_txns"), 4, snapshots=True).table("snapshots")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot of orphans per table, day and state."""
    return orphans.orphan_counts(p6_found(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_states, p1_inferred, p2_found, p2_kept, p2_flag_audit, p4_found, p4_parsed, p4_broken_fields, p6_found, p6_counts, p6_snapshots)}

_TRIM = r"upper(regexp_replace(txn_id, '^\s+|\s+$', '', 'g'))"
_COPIES = f"""
  select record_uid from (
    select record_uid, row_number() over (partition by {_TRIM} order by received_at nulls last, record_uid nulls last) as n
    from payments where regexp_matches(txn_id, '[0-9]'))
  where n > 1"""
_KEY = "nullif(upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '')"
_ORPHANS = f"""
  with o as (select {_KEY.format("order_id")} as k, min(received_at) as a, min(deleted_at) as d from order_txns group by 1),
  r as (
    select 'payments' as child, record_uid as child_key, {_KEY.format("order_id")} as k, received_at as t from payments
    union all
    select 'settlements', record_uid, {_KEY.format("regexp_extract(reference_id, '(?i)ORD[A-Z]*[-_ ]?[0-9]+')")}, received_at from settlements),
  x as (
    select child, child_key, t, a, d, o.k is not null as there from r left join o on r.k = o.k where r.k is not null
    union all
    select 'recon', case_id, built_at, received_at, deleted_at, record_uid is not null
    from recon left join order_txns on order_uid = record_uid where order_uid is not null)
  select * from (
    select child, child_key, strftime(t, '%Y-%m-%d') as period,
           case when not there then 'missing' when d <= t then 'deleted' when a > t then 'late' end as ref_state
    from x) where ref_state is not null"""

_SNAPSHOTS = f"""
  with r as (
    select 'payments' as child, {_KEY.format("order_id")} as k, received_at as t from payments
    union all
    select 'settlements', {_KEY.format("regexp_extract(reference_id, '(?i)ORD[A-Z]*[-_ ]?[0-9]+')")}, received_at from settlements
    union all
    select 'recon', '#' || order_uid, built_at from recon),
  p as (
    select {_KEY.format("order_id")} as k, received_at as a, deleted_at as d from order_txns
    union all
    select '#' || record_uid, received_at, deleted_at from order_txns),
  span as (select epoch_us(min(t)) as low, epoch_us(max(t)) as high from r where k is not null),
  edges as (select make_timestamp(case when i = 4 then high else low + cast(round_even((high - low) * i / 4, 0) as bigint) end) as e, i from span, (values (1), (2), (3), (4)) v(i)),
  seen as (
    select e, i, k, min(a) filter (a <= e or i = 4) as a, min(d) filter (greatest(a, d) <= e or i = 4) as d from p, edges group by 1, 2, 3),
  x as (
    select edges.e, child, case when s.a is null then 'missing' when s.d <= t then 'deleted' when s.a > t then 'late' end as ref_state
    from r join edges on (t <= edges.e or t is null) left join seen s on s.k = r.k and s.e = edges.e where r.k is not null)
  select e as as_of, child, ref_state, count(*) as cases from x where ref_state is not null group by 1, 2, 3"""

ORACLES = data_oracle.ORACLES | {
    "p2_found": _COPIES,
    "p2_kept": f"select * from payments where record_uid not in ({_COPIES})",
    "p2_flag_audit": f"""
      select upper(coalesce(dupe_reason, '(none)')) as dupe_reason, count(distinct f.record_uid) as flagged,
             count(distinct c.record_uid) as confirmed, count(distinct f.record_uid) - count(distinct c.record_uid) as false_alarms
      from payment_dupes f left join ({_COPIES}) c on f.record_uid = c.record_uid
      where f.record_uid is not null group by 1""",
    "p6_found": _ORPHANS,
    "p6_snapshots": _SNAPSHOTS,
    "p6_counts": f"select child, period, ref_state, count(*) as cases from ({_ORPHANS}) group by 1, 2, 3",
}
