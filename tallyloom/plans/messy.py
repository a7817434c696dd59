"""Source files of three legs as shops and gateways write them, rendered from `orders`, and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.normalize import normalize
from tallyloom.session import shared_folder
from tallyloom.sources.export import load_any

#: How times are rendered, by k % 10; the ninth is none and the tenth is null.
SPELLINGS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")
STATUSES = ("PLACED", "Captured", "REFUNDED", "failed", "Void", "chargeback", " settled ")


def spelt_time(k: Column, day: Column) -> Column:
    out = F.when(k % 10 == 8, "soon")
    for i, f in enumerate(SPELLINGS):
        out = out.when(k % 10 == i, F.date_format(day, f))
    return out


def _money(k: Column, minor: Column) -> Column:
    cents, whole = F.lpad((minor % 100).cast("string"), 2, "0"), F.floor(minor / 100)
    plain = F.concat(whole.cast("string"), F.lit("."), cents)
    return F.when(k % 6 == 0, plain).when(k % 6 == 1, F.concat(F.lit("₹"), F.format_number(whole, 0), F.lit("."), cents)).when(k % 6 == 2, F.concat(F.lit("INR "), plain)).when(k % 6 == 3, F.concat(F.lit("("), plain, F.lit(")"))).when(k % 6 == 4, F.concat(F.lit("-"), plain)).otherwise("n/a")


def source_rows(orders: DataFrame, kind: str) -> DataFrame:
    """The rows of one source file, in the order of k."""
    k = F.col("o_orderkey")
    minor = F.rint(F.col("o_totalprice") * 100).cast("long")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (k % 7 + 1).cast("int"))
    num = k.cast("string")
    x = orders.orderBy("o_orderkey")
    if kind == "ORDER":
        return x.select(
            F.concat(F.lit(" ORD"), num, F.lit(" ")).alias("Order No"), F.concat(F.lit("T"), num).alias("Transaction ID"), F.when(k % 4 > 0, F.concat(F.lit("M"), (F.col("o_custkey") % 40).cast("string"))).alias("MERCHANT_ID"),
            _money(k, minor).alias("Order Amount"), spelt_time(k, F.col("o_orderdate")).alias("Txn Date"), status.alias("Status"), F.when(k % 3 > 0, F.concat(F.lit("PAY-ORD-"), num, F.lit("-XYZ9"))).alias("Narration"), F.when(k % 5 > 0, F.lit("usd")).alias("Currency"),
        )
    if kind == "PAYMENT":
        return x.select(F.concat(F.lit("U"), num).alias("utr"), F.concat(F.lit("O-"), num).alias("invoice_no"), (minor / 100).alias("amt"), _money(k + 1, minor).alias("fee"), spelt_time(k + 3, F.col("o_orderdate")).alias("payment_date"), status.alias("state"))
    return x.select(F.col("o_totalprice").alias("net_amount"), (F.col("o_totalprice") / 50).alias("commission"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("value_date"), F.concat(F.lit("SET "), num, F.lit("/"), (k % 9).cast("string")).alias("remarks"))


def normalized(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The canonical leg of a source written as CSV (orders), JSON lines (payments) or Parquet (settlements) and loaded again."""
    rows = source_rows(spark.read.parquet(f"{d}/orders.parquet"), kind)
    suffix = {"ORDER": "csv", "PAYMENT": "jsonl", "SETTLEMENT": "parquet"}[kind]
    path = f"{shared_folder(spark, 'source')}.{suffix}"
    if suffix == "csv":
        rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif suffix == "jsonl":
        rows.write.option("ignoreNullFields", False).json(path)
    else:
        rows.write.parquet(path)
    return normalize(load_any(spark, path), kind, f"shop.{suffix}")


QUERIES = {
    "normalized_orders": lambda s, d: normalized(s, d, "ORDER"),
    "normalized_payments": lambda s, d: normalized(s, d, "PAYMENT"),
    "normalized_settlements": lambda s, d: normalized(s, d, "SETTLEMENT"),
}

_SPELT = "case {0} % 10 " + " ".join(f"when {i} then strftime(o_orderdate, '{f}')" for i, f in enumerate(("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d"))) + " when 8 then 'soon' end"
_READ = "coalesce(try_cast(case when not contains(tx, '/') and tx <> 'soon' and tx[3:3] <> '-' then tx end as timestamp), " + ", ".join(f"try_strptime(tx, '{f}')" for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d")) + ")"
_SPENT = """case {0} % 6 when 0 then plain when 1 then '₹' || format('{{:,}}', minor // 100) || '.' || lpad((minor % 100)::varchar, 2, '0') when 2 then 'INR ' || plain when 3 then '(' || plain || ')' when 4 then '-' || plain else 'n/a' end"""
_SIGNED = "case {0} % 6 when 3 then -minor when 4 then -minor when 5 then 0 else minor end"
_STATUS = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "][1 + k % 7]"
_BASE = "select o_orderkey as k, o_custkey, o_totalprice, o_orderdate, cast(round_even(o_totalprice * 100, 0) as bigint) as minor, (minor // 100)::varchar || '.' || lpad((minor % 100)::varchar, 2, '0') as plain from orders"


def _canonical(kind: str, prefix: str, source: str, rows: str) -> str:
    return f"""
  with base as ({_BASE}), x as ({rows})
  select '{prefix}-' || lpad((row_number() over (order by k) - 1)::varchar, 10, '0') as record_uid, '{kind}' as source_kind, '{source}' as source_name, txn_id, order_id, reference_id,
    regexp_replace(coalesce(reference_id, ''), '\\D', '', 'g') as ref_digits, coalesce(merchant_id, 'UNKNOWN') as merchant_id, abs(signed)::bigint as amount_minor, abs(fee)::bigint as fee_minor, upper(coalesce(currency, 'INR')) as currency,
    ts as txn_ts, ts::date as day_bucket, status, lower(coalesce(status, '')) in ('refund', 'refunded', 'reversal', 'reversed', 'chargeback') or signed < 0 as is_refund, raw
  from x where lower(coalesce(status, '')) not in ('failed', 'failure', 'declined', 'cancelled', 'canceled', 'void')"""


ORACLES = {
    "timestamp_parse": f"select o_orderkey as k, {_READ} as txn_ts from (select *, {_SPELT.format('o_orderkey')} as tx from orders)",
    "normalized_orders": _canonical("ORDER", "ORD", "shop.csv", f"""
      select k, 'T' || k as txn_id, 'ORD' || k as order_id, nar as reference_id, mer as merchant_id, {_SIGNED.format("k")} as signed, 0 as fee, cur as currency, {_READ} as ts, trim(st) as status,
        to_json(struct_pack("Order No" := ' ORD' || k || ' ', "Transaction ID" := 'T' || k, "MERCHANT_ID" := mer, "Order Amount" := spent, "Txn Date" := tx, "Status" := st, "Narration" := nar, "Currency" := cur))::varchar as raw
      from (select *, case when k % 3 > 0 then 'PAY-ORD-' || k || '-XYZ9' end as nar, case when k % 4 > 0 then 'M' || (o_custkey % 40) end as mer, case when k % 5 > 0 then 'usd' end as cur, {_STATUS} as st, {_SPELT.format("k")} as tx, {_SPENT.format("k")} as spent from base)"""),
    "normalized_payments": _canonical("PAYMENT", "PAY", "shop.jsonl", f"""
      select k, 'U' || k as txn_id, 'O-' || k as order_id, null::varchar as reference_id, null::varchar as merchant_id, minor as signed, {_SIGNED.format("(k + 1)")} as fee, null::varchar as currency, {_READ} as ts, trim(st) as status,
        to_json(struct_pack(amt := minor / 100, fee := spent, invoice_no := 'O-' || k, payment_date := tx, state := st, utr := 'U' || k))::varchar as raw
      from (select *, {_STATUS} as st, {_SPELT.format("(k + 3)")} as tx, {_SPENT.format("(k + 1)")} as spent from base)"""),
    "normalized_settlements": _canonical("SETTLEMENT", "SET", "shop.parquet", """
      select k, null::varchar as txn_id, null::varchar as order_id, 'SET ' || k || '/' || (k % 9) as reference_id, null::varchar as merchant_id, minor as signed, cast(round_even(o_totalprice / 50 * 100, 0) as bigint) as fee, null::varchar as currency,
        date_trunc('second', o_orderdate) as ts, null::varchar as status,
        to_json(struct_pack(net_amount := o_totalprice, commission := o_totalprice / 50, value_date := strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), remarks := 'SET ' || k || '/' || (k % 9)))::varchar as raw
      from base"""),
}
