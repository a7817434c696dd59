"""DuckDB SQL for the engine's queries, written as text and apart from the Spark plans."""

from __future__ import annotations

from tallyloom.schema import FAILED, REFUNDED

_BASE = """
base as (
  select o_orderkey as k, o_orderkey % 200 as b, o_orderkey // 200 as j, o_custkey as cust,
         cast(round_even(o_totalprice * 100, 0) as bigint) as amt,
         'M' || (1000 + o_custkey % 40) as merch,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400) as ts
  from orders),
legs_o as (
  select 'ORD-' || lpad(k::varchar, 10, '0') as record_uid,
         case when b between 14 and 18 then null else 'TXN' || (500000 + k) end as txn_id,
         case when b in (16, 18) then null else 'ORD' || (100000 + k) end as order_id,
         case when b in (14, 15, 17, 18) then '' else (100000 + k)::varchar end as ref_digits,
         merch as merchant_id, amt as amount_minor, 0::bigint as fee_minor, 'INR' as currency, ts as txn_ts,
         ts::date as day_bucket, 'PLACED' as status, false as is_refund
  from base),
pay as (
  select k, b, j, d, 'PAY-' || lpad((k * 10 + d)::varchar, 10, '0') as record_uid,
         case when d = 2 then 'TXNN' || (500000 + k) when b = 7 then 'TXNX' || (900000 + k) when b between 14 and 18 then null else 'TXN' || (500000 + k) end as txn_id,
         case when b = 7 then 'ORDX' || (900000 + k) when b between 16 and 18 then null else 'ORD' || (100000 + k) end as order_id,
         case when b = 7 then (900000 + k)::varchar when b in (14, 15, 18, 22, 23) then '' else (100000 + k)::varchar end as ref_digits,
         case b when 7 then 'MX' || (9000 + k % 50) when 8 then 'M' || (1000 + (cust % 40 + 1) % 40) else merch end as merchant_id,
         case b when 2 then amt // 2 when 3 then amt + 50000 when 7 then amt + 70000 when 15 then amt - 20000 when 18 then amt - 50 else amt end as amount_minor,
         (amt * 200) // 10000 + case when b = 6 then 1000 else 0 end as fee_minor,
         case when b = 9 then 'USD' else 'INR' end as currency,
         ts + to_seconds(case when b = 10 then 432000 when b = 18 then case j % 3 when 0 then 108000 when 1 then 2700 else -72000 end else 60 * (1 + k % 90) end
                         + case d when 1 then 90 when 2 then 300 else 0 end) as txn_ts,
         case b when 5 then 'REFUNDED' when 19 then 'FAILED' else 'CAPTURED' end as status
  from base, (values (0), (1), (2)) v(d)
  where b <> 0 and (d = 0 or (b = 4 and d = 1) or (b = 20 and d = 2))),
legs_p as (
  select record_uid, txn_id, order_id, ref_digits, merchant_id, amount_minor, fee_minor, currency, txn_ts, txn_ts::date as day_bucket, status, status = 'REFUNDED' as is_refund
  from pay where status <> 'FAILED'),
legs_s as (
  select *, txn_ts::date as day_bucket, 'SETTLED' as status, false as is_refund from (
    select 'SET-' || lpad(k::varchar, 10, '0') as record_uid,
           case when b between 14 and 18 or b between 21 and 23 then null else txn_id end as txn_id,
           case when b in (16, 17, 18, 21, 23) then null else order_id end as order_id,
           case when b in (14, 15, 18, 22, 23) then '' else ref_digits end as ref_digits, merchant_id,
           case b when 13 then amount_minor + 5000 when 12 then amount_minor - fee_minor - 30000 else amount_minor - fee_minor end as amount_minor,
           fee_minor, currency,
           txn_ts + to_days(cast(case b when 11 then 10 when 24 then 20 when 23 then j % 8 else 1 + k % 3 end as integer)) as txn_ts
    from pay where d = 0 and b not in (1, 5, 19)
    union all
    select 'SET-' || lpad((k + 5000000)::varchar, 10, '0'), 'TXNORPH' || k, 'ORDORPH' || k, '', merch, 1000 + amt % 500000, 0::bigint, 'INR', ts from base where b = 25))"""

_COLUMNS = "record_uid, txn_id, order_id, ref_digits, merchant_id, amount_minor, fee_minor, currency, txn_ts, day_bucket, status, is_refund"

_DUPES = """
exact_d as (
  select record_uid, txn_id as dupe_key, 'EXACT_TXN_ID' as dupe_reason, row_number() over (partition by txn_id order by txn_ts nulls last, record_uid) as occurrence
  from legs_p where txn_id <> ''),
near_d as (
  select record_uid, merchant_id || '|' || order_id || '|' || amount_minor as dupe_key, 'SAME_ORDER_AMOUNT' as dupe_reason,
         row_number() over (partition by merchant_id, order_id, amount_minor order by txn_ts nulls last, record_uid) as occurrence
  from legs_p where order_id <> ''),
dupes as materialized (
  select * from exact_d where occurrence > 1
  union all
  select * from near_d where occurrence > 1 and record_uid not in (select record_uid from exact_d where occurrence > 1))"""

_DT = "date_diff('second', l.txn_ts, r.txn_ts)"
_DA = "abs(l.amount_minor - r.amount_minor)"
_GUARD = "not (coalesce(l.txn_id, '') <> '' and coalesce(r.txn_id, '') <> '' and l.txn_id <> r.txn_id and coalesce(l.order_id, '') <> '' and coalesce(r.order_id, '') <> '' and l.order_id <> r.order_id)"
_TERM = {
    "txn": "0.40", "order": "0.25",
    "amount": f"case when {_DA} <= 100 then 0.20 else 0 end",
    "ref": "case when length(l.ref_digits) > 3 and l.ref_digits = r.ref_digits then 0.05 else 0 end",
    "merchant": "case when l.merchant_id = r.merchant_id then 0.05 else 0 end",
    "day2": f"case when abs({_DT}) <= 172800 then 0.05 else 0 end",
    "day7": f"case when abs({_DT}) <= 604800 then 0.05 else 0 end",
}
_SAME = "l.{0} = r.{0} and l.{0} <> ''"
_WITHIN = f"({_DT} is null or abs({_DT}) <= 172800)"
_BLOCK = f"l.merchant_id = r.merchant_id and l.currency = r.currency and (l.amount_minor / 10000)::bigint = (r.amount_minor / 10000)::bigint and l.day_bucket = r.day_bucket + ({{}}) and {_DA} <= 10000 and abs({_DT}) <= 172800 and {_GUARD}"
_NET = f"l.merchant_id = r.merchant_id and l.currency = r.currency and r.day_bucket = l.day_bucket + {{}} and r.amount_minor <= l.amount_minor + 100 and r.amount_minor >= l.amount_minor - l.amount_minor / 10 and {_DT} between 0 and 604800 and {_GUARD}"
#: name, stage, rule, condition, terms, offset
_OP = [
    ("l1", "L1", "exact_transaction_id", _SAME.format("txn_id"), ("txn", "amount", "merchant", "day2"), 0),
    ("l3", "L3", "order_id_and_amount", _SAME.format("order_id") + f" and {_DA} <= 100", ("order", "amount", "merchant", "day2"), 0),
    ("l4", "L4", "order_id_within_window", _SAME.format("order_id") + f" and {_WITHIN}", ("order", "amount", "merchant", "day2"), 0),
    ("l2a", "L2", "reference_digits_and_amount", f"l.ref_digits = r.ref_digits and length(l.ref_digits) >= 5 and {_DA} <= 100", ("ref", "amount", "merchant", "day2"), 0),
    ("l2b", "L2", "order_id_inside_reference", f"length(l.order_id) >= 5 and r.ref_digits <> '' and contains(l.order_id, r.ref_digits) and {_WITHIN}", ("ref", "amount", "merchant", "day2"), 0),
    *[("l5", "L5", "blocked_merchant_amount_day", _BLOCK.format(o), ("amount", "merchant", "day2"), o) for o in (0, -1, 1)],
]
_PS = [
    ("l1", "L1", "exact_transaction_id", _SAME.format("txn_id"), ("txn", "amount", "merchant"), 0),
    ("l2", "L2", "reference_digits", "l.ref_digits = r.ref_digits and length(l.ref_digits) >= 5", ("ref", "amount", "merchant"), 0),
    ("l3", "L3", "order_id", _SAME.format("order_id"), ("order", "amount", "merchant"), 0),
    *[("l5", "L5", "blocked_merchant_net_of_fee", _NET.format(o), ("merchant", "day7"), o) for o in range(8)],
]
_ORDER = "confidence desc, abs(amount_delta_minor), abs(time_delta_sec) nulls last"


def _pass(left: str, right: str, p: tuple) -> str:
    _, stage, rule, condition, terms, _ = p
    return f"""
  select left_uid, right_uid, '{stage}' as stage, '{rule}' as rule, confidence, amount_delta_minor, time_delta_sec from (
    select *, row_number() over (partition by left_uid order by {_ORDER}, right_uid) as a, row_number() over (partition by right_uid order by {_ORDER}, left_uid) as b from (
      select l.record_uid as left_uid, r.record_uid as right_uid, cast({" + ".join(_TERM[t] for t in terms)} as double) as confidence,
             l.amount_minor - r.amount_minor as amount_delta_minor, {_DT} as time_delta_sec
      from {left} l join {right} r on {condition}))
  where a = 1 and b = 1"""


def _chain(tag: str, left: str, right: str, passes: list[tuple]) -> str:
    out, done = [], []
    for i, p in enumerate(passes):
        seen_l = "".join(f" and record_uid not in (select left_uid from {t})" for t in done)
        seen_r = "".join(f" and record_uid not in (select right_uid from {t})" for t in done)
        extra = " and record_uid not in (select record_uid from dupes)" if tag == "ps" else ""
        name = f"{tag}_{i}"
        out.append(f"{name} as materialized ({_pass(f'(select * from {left} where true{seen_l}{extra})', f'(select * from {right} where true{seen_r})', p)})")
        done.append(name)
    out.append(f"{tag}_links as materialized ({' union all '.join(f'select * from {t}' for t in done)})")
    return ",\n".join(out)


_LINKS = ",\n".join([_BASE, _DUPES, _chain("op", "legs_o", "legs_p", _OP), _chain("ps", "legs_p", "legs_s", _PS)])

_RECON = """
joined as (
  select o.record_uid as order_uid, p.record_uid as payment_uid,
         case when o.record_uid is null then p.order_id else o.order_id end as order_id,
         case when o.record_uid is null then p.merchant_id else o.merchant_id end as merchant_id,
         case when o.record_uid is null then p.currency else o.currency end as currency,
         o.amount_minor as order_amount_minor, p.amount_minor as payment_amount_minor, o.txn_ts as order_ts, p.txn_ts as payment_ts, p.is_refund as payment_is_refund,
         p.fee_minor as payment_fee_minor, p.merchant_id as payment_merchant_id, p.currency as payment_currency,
         m.confidence as op_confidence, m.stage as op_stage, m.rule as op_rule, m.time_delta_sec as op_time_delta_sec
  from legs_o o left join op_links m on m.left_uid = o.record_uid full join legs_p p on p.record_uid = m.right_uid),
all_legs as (
  select j.* replace (
           case when j.order_uid is null and j.payment_uid is null then s.order_id else j.order_id end as order_id,
           case when j.order_uid is null and j.payment_uid is null then s.merchant_id else j.merchant_id end as merchant_id,
           case when j.order_uid is null and j.payment_uid is null then s.currency else j.currency end as currency,
           case when j.order_uid is null and j.payment_uid is null then false else j.payment_is_refund end as payment_is_refund,
           case when j.order_uid is null and j.payment_uid is null then 0 else j.payment_fee_minor end as payment_fee_minor,
           case when j.order_uid is null and j.payment_uid is null then s.merchant_id else j.payment_merchant_id end as payment_merchant_id,
           case when j.order_uid is null and j.payment_uid is null then s.currency else j.payment_currency end as payment_currency),
         s.record_uid as settlement_uid, s.amount_minor as settlement_amount_minor, s.fee_minor as settlement_fee_minor, s.txn_ts as settlement_ts,
         n.confidence as ps_confidence, n.time_delta_sec as ps_time_delta_sec
  from joined j left join ps_links n on n.left_uid = j.payment_uid full join legs_s s on s.record_uid = n.right_uid),
priced as (
  select a.*, d.record_uid is not null as is_duplicate, d.dupe_reason,
         coalesce(nullif(settlement_fee_minor, 0), nullif(payment_fee_minor, 0), (coalesce(payment_amount_minor, 0) * 200 / 10000)::bigint) as expected_fee_minor,
         (coalesce(payment_amount_minor, 0) * 200 / 10000)::bigint as configured_fee_minor,
         coalesce(payment_amount_minor, 0) - coalesce(order_amount_minor, 0) as payment_delta_minor,
         coalesce(payment_amount_minor, 0) - coalesce(settlement_amount_minor, 0) as settlement_delta_minor
  from all_legs a left join dupes d on d.record_uid = a.payment_uid),
cases as materialized (
  select coalesce(order_uid, payment_uid, settlement_uid) as case_id, *,
         case when is_duplicate then 'DUPLICATE' when payment_is_refund then 'REFUND'
              when order_uid is null and payment_uid is null then 'ORPHAN_SETTLEMENT' when order_uid is null then 'ORPHAN_PAYMENT' when payment_uid is null then 'MISSING_PAYMENT'
              when payment_currency <> currency then 'CURRENCY_MISMATCH' when payment_merchant_id <> merchant_id then 'MERCHANT_MISMATCH'
              when payment_delta_minor < -100 then 'PARTIAL_PAYMENT' when payment_delta_minor > 100 then 'OVERPAYMENT' when settlement_uid is null then 'MISSING_SETTLEMENT'
              when settlement_delta_minor > 100 and abs(settlement_delta_minor - expected_fee_minor) > 50 then 'SETTLEMENT_SHORTFALL'
              when settlement_delta_minor < -100 then 'AMOUNT_MISMATCH' when abs(expected_fee_minor - configured_fee_minor) > 50 then 'FEE_VARIANCE'
              when abs(op_time_delta_sec) > 172800 or ps_time_delta_sec > 604800 then 'TIMING_MISMATCH' else 'MATCHED' end as exception_type,
         coalesce(op_confidence, ps_confidence, 0.0)::double as confidence
  from priced)"""
_SEVERITY = ("DUPLICATE", "ORPHAN_PAYMENT", "ORPHAN_SETTLEMENT", "MISSING_PAYMENT", "MERCHANT_MISMATCH", "CURRENCY_MISMATCH", "PARTIAL_PAYMENT", "OVERPAYMENT", "AMOUNT_MISMATCH", "SETTLEMENT_SHORTFALL", "REFUND", "FEE_VARIANCE", "MISSING_SETTLEMENT", "TIMING_MISMATCH", "UNKNOWN", "MATCHED")
_GRAVE = f"""
grave as (
  select order_id, arg_min(exception_type, list_position([{", ".join(f"'{t}'" for t in _SEVERITY)}], exception_type)) as predicted
  from cases where order_id is not null group by 1)"""
_TRUTH = """
truth as (
  select 'ORD' || (100000 + k) as order_id,
         case when b in (0, 7, 19) then 'MISSING_PAYMENT' when b = 1 then 'MISSING_SETTLEMENT' when b in (2, 15) then 'PARTIAL_PAYMENT' when b = 3 then 'OVERPAYMENT'
              when b in (4, 20) then 'DUPLICATE' when b = 5 then 'REFUND' when b = 6 then 'FEE_VARIANCE' when b = 8 then 'MERCHANT_MISMATCH' when b = 9 then 'CURRENCY_MISMATCH'
              when b in (10, 11, 24) then 'TIMING_MISMATCH' when b = 12 then 'SETTLEMENT_SHORTFALL' when b = 13 then 'AMOUNT_MISMATCH' else 'MATCHED' end as expected_label
  from base
  union all select 'ORDX' || (900000 + k), 'ORPHAN_PAYMENT' from base where b = 7
  union all select 'ORDORPH' || k, 'ORPHAN_SETTLEMENT' from base where b = 25),
matrix as (
  select expected_label as expected, coalesce(predicted, 'MISSING_FROM_OUTPUT') as predicted, count(*) as n from truth left join grave using (order_id) group by 1, 2)"""

_IMPACT = "abs(payment_delta_minor) + abs(settlement_delta_minor)"


def _over(ctes: str, query: str) -> str:
    return f"with {ctes}\n{query}"


def _cases(query: str) -> str:
    return _over(f"{_LINKS},\n{_RECON}", query)


def _breakdown(impact: str, where: str = "true", by: str = "exception_type") -> str:
    return f"select {by}, count(*) as n, cast(sum({impact}) as bigint) as impact_minor from cases where {where} group by 1"


_TOTALS = """count(*) as total_cases, count(*) filter (exception_type = 'MATCHED') as matched, count(*) filter (exception_type <> 'MATCHED') as exceptions,
  cast(coalesce(sum(order_amount_minor), 0) as bigint) as gross_order_minor, cast(coalesce(sum(payment_amount_minor), 0) as bigint) as gross_payment_minor,
  cast(coalesce(sum(settlement_amount_minor), 0) as bigint) as gross_settlement_minor, cast(coalesce(sum(payment_amount_minor), 0) - coalesce(sum(settlement_amount_minor), 0) as bigint) as settlement_gap_minor"""
_STATS = " union all ".join(
    f"select '{leg}' as leg, '{p[1]}' as stage, '{p[2]}' as rule, {p[5]}::integer as day_offset, (select count(*) from {tag}_{i}) as matched"
    for leg, tag, passes in (("order_payment", "op", _OP), ("payment_settlement", "ps", _PS))
    for i, p in enumerate(passes)
)
_RENDERED = """
rendered as (
  select o_orderkey as k, cast(round_even(o_totalprice * 100, 0) as bigint) as amt, o_orderdate as day from orders)"""
ORACLES = {
    "canonical_orders": _over(_BASE, f"select {_COLUMNS} from legs_o"),
    "canonical_payments": _over(_BASE, f"select {_COLUMNS} from legs_p"),
    "canonical_settlements": _over(_BASE, f"select {_COLUMNS} from legs_s"),
    "repeated_payments": _over(f"{_BASE},{_DUPES}", "select * from dupes"),
    "op_links": _over(_LINKS, "select * from op_links"),
    "ps_links": _over(_LINKS, "select * from ps_links"),
    "links_all": _over(_LINKS, "select *, 'order_payment' as leg from op_links union all select *, 'payment_settlement' from ps_links"),
    "cascade_stats": _over(_LINKS, _STATS),
    "cascade_rollup": _over(_LINKS, f"select rule, cast(sum(matched) as bigint) as matched from ({_STATS}) group by 1 having sum(matched) > 0"),
    "ai_candidates": _over(
        _LINKS,
        f"""select left_uid, right_uid, amount_delta_minor, time_delta_sec, affinity, rk from (
  select *, row_number() over (partition by left_uid order by affinity desc, right_uid) as rk from (
    select l.record_uid as left_uid, r.record_uid as right_uid, l.amount_minor - r.amount_minor as amount_delta_minor, {_DT} as time_delta_sec,
           cast(case when {_DA} <= 10000 then 0.5 else 0.15 end + case when l.ref_digits <> '' and l.ref_digits = r.ref_digits then 0.35 else 0 end + case when l.order_id = r.order_id then 0.15 else 0 end as double) as affinity
    from legs_o l join legs_p r on l.merchant_id = r.merchant_id and l.currency = r.currency and abs(l.day_bucket - r.day_bucket) <= 2
    where l.record_uid not in (select left_uid from op_links) and r.record_uid not in (select right_uid from op_links))) where rk <= 3""",
    ),
    "recon_cases": _cases("select * from cases"),
    "exceptions": _cases("select * from cases where exception_type <> 'MATCHED'"),
    "run_summary": _cases(f"select {_TOTALS} from cases"),
    "breakdown_engine": _cases(_breakdown("abs(payment_delta_minor + settlement_delta_minor)")),
    "breakdown_api": _cases(_breakdown(_IMPACT)),
    "by_type": _cases(_breakdown(_IMPACT, "exception_type <> 'MATCHED'")),
    "by_merchant_top8": _cases(_breakdown(_IMPACT, "exception_type <> 'MATCHED'", "merchant_id") + " order by impact_minor desc, merchant_id limit 8"),
    "largest_breaks": _cases(f"select case_id, exception_type, merchant_id, {_IMPACT} as impact_minor, order_amount_minor, payment_amount_minor, settlement_amount_minor from cases where exception_type <> 'MATCHED' order by impact_minor desc, case_id limit 10"),
    "exception_page": _cases(f"select case_id, exception_type, merchant_id, {_IMPACT} as impact_minor, count(*) over () as total from cases where exception_type <> 'MATCHED' and {_IMPACT} >= 1000 order by impact_minor desc, case_id limit 20 offset 40"),
    "mix_top10": _cases("select exception_type, count(*) as n from cases where exception_type <> 'MATCHED' group by 1 order by n desc, exception_type limit 10"),
    "unexplained": _cases("select case_id, case when settlement_uid is not null then settlement_delta_minor - expected_fee_minor else coalesce(payment_amount_minor, 0) end as unexplained_minor from cases"),
    "slim_cases": _cases(
        """select case_id, exception_type, currency, merchant_id, order_amount_minor, payment_amount_minor, settlement_amount_minor, expected_fee_minor, payment_delta_minor, settlement_delta_minor,
  op_time_delta_sec as order_to_payment_seconds, ps_time_delta_sec as payment_to_settlement_seconds, order_uid is not null as has_order, payment_uid is not null as has_payment,
  settlement_uid is not null as has_settlement, is_duplicate, dupe_reason as duplicate_reason, confidence as engine_confidence, op_rule as match_rule from cases"""
    ),
    "case_batches": _cases("select case_id, case when n <= 500 then n end as place, case when n <= 500 then (n - 1) // 12 end as batch, n <= 500 as within from (select case_id, row_number() over (order by case_id) as n from cases where exception_type <> 'MATCHED')"),
    "fingerprint_groups": _cases(
        """select cases, count(*) as groups from (select count(*) as cases from cases group by exception_type, order_amount_minor, payment_amount_minor, settlement_amount_minor, expected_fee_minor,
  payment_delta_minor, settlement_delta_minor, order_uid is null, payment_uid is null, settlement_uid is null, is_duplicate, currency) group by 1"""
    ),
    "merged_decisions": _cases("select case_id, exception_type, case when n % 9 = 0 then 'REOPENED' when n % 3 = 0 then 'ACCEPTED' else 'NONE' end as decision from (select *, regexp_extract(case_id, '(\\d+)$', 1)::bigint as n from cases)"),
    "severity_dedupe": _over(f"{_LINKS},\n{_RECON},{_GRAVE}", "select * from grave"),
    "confusion_matrix": _over(f"{_LINKS},\n{_RECON},{_GRAVE},{_TRUTH}", "select * from matrix"),
    "accuracy_metrics": _over(
        f"{_LINKS},\n{_RECON},{_GRAVE},{_TRUTH}",
        """select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from (
  select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, label_correct / total as label_accuracy from (
    select cast(coalesce(sum(n) filter (expected = 'MATCHED' and predicted = 'MATCHED'), 0) as bigint) as tp, cast(coalesce(sum(n) filter (expected <> 'MATCHED' and predicted = 'MATCHED'), 0) as bigint) as fp,
           cast(coalesce(sum(n) filter (expected = 'MATCHED' and predicted <> 'MATCHED'), 0) as bigint) as fn, cast(coalesce(sum(n) filter (expected <> 'MATCHED' and predicted <> 'MATCHED'), 0) as bigint) as tn,
           cast(coalesce(sum(n) filter (expected = predicted), 0) as bigint) as label_correct, cast(sum(n) as bigint) as total from matrix))""",
    ),
    "score_bands": _cases("select case when confidence >= 0.6 then 'HIGH' when confidence >= 0.4 then 'MIDDLE' else 'LOW' end as band, count(*) as n from cases group by 1"),
    "money_parse": _over(_RENDERED, "select k, case when k % 4 = 3 then -amt else amt end as amount_minor from rendered"),
    "status_flags": f"select record_uid, lower(coalesce(status, '')) in ({', '.join(f"'{s}'" for s in REFUNDED)}) or coalesce(amount_minor < 0, false) as is_refund, lower(coalesce(status, '')) in ({', '.join(f"'{s}'" for s in FAILED)}) as is_failed from payments",
    "ref_digits": "select record_uid, regexp_replace(reference_id, '[^\\p{Nd}]', '', 'g') as digits from payments",
    "money_display": _over(
        _RENDERED,
        """select k, 'Rs ' || sign || case when length(w) <= 3 then w when length(w) <= 5 then left(w, -3) || ',' || right(w, 3) when length(w) <= 7 then left(w, -5) || ',' || w[-5:-4] || ',' || right(w, 3)
         else left(w, -7) || ',' || w[-7:-6] || ',' || w[-5:-4] || ',' || right(w, 3) end || '.' || lpad((amt % 100)::varchar, 2, '0')
         || case when amt >= 1000000000 then ' (' || sign || printf('%.2f', amt / 1000000000.0::double) || ' crore)' when amt >= 10000000 then ' (' || sign || printf('%.2f', amt / 10000000.0::double) || ' lakh)' else '' end as display
  from (select k, amt, case when k % 2 = 0 then '' else '-' end as sign, (amt // 100)::varchar as w from rendered)""",
    ),
    "export_flatten": _cases(
        """select exception_type, coalesce(array_to_string(list_sort(list(distinct op_rule) filter (op_rule is not null)), ' | '), '') as rules, '{"first":"' || min(case_id) || '","last":"' || max(case_id) || '"}' as span from cases group by 1"""
    ),
}
_STATUSES = """
statuses as (
  select *, case when n % 9 = 0 then 'REOPENED' when n % 3 = 0 then 'ACCEPTED' when exception_type <> 'MATCHED' then 'OPEN' else 'CLOSED' end as status
  from (select *, regexp_extract(case_id, '(\\d+)$', 1)::bigint as n from cases))"""
_VERDICTS = """
verdicts as (
  select case_id, case when n % 14 = 0 then 'NOTHING' else exception_type end as classification, case when n % 4 = 0 then 'RESOLVED' else 'NEEDS_HUMAN' end as resolution, case when n % 22 = 0 then 1.5 else (n % 10) / 10 end::double as confidence,
    n, exception_type, order_amount_minor, payment_amount_minor, settlement_amount_minor, expected_fee_minor, payment_delta_minor, settlement_delta_minor, order_uid is null as a, payment_uid is null as b, settlement_uid is null as c, is_duplicate, currency
  from (select *, regexp_extract(case_id, '(\\d+)$', 1)::bigint as n from cases) where exception_type <> 'MATCHED' and n % 2 = 0)"""
_ALIKE = "exception_type, order_amount_minor, payment_amount_minor, settlement_amount_minor, expected_fee_minor, payment_delta_minor, settlement_delta_minor, a, b, c, is_duplicate, currency"
_OPEN_CASES = "(select *, order_uid is null as a, payment_uid is null as b, settlement_uid is null as c from cases where exception_type <> 'MATCHED')"


def _met(least: float) -> str:
    """Exceptions with the surest verdict on a case alike."""
    return f"""
met as (
  select x.case_id, m.v from {_OPEN_CASES} x
  left join (select {_ALIKE}, max({{'confidence': confidence, 'classification': classification, 'resolution': resolution}}) as v from verdicts where confidence >= {least} group by all) m
  on {" and ".join(f"x.{k} is not distinct from m.{k}" for k in _ALIKE.split(", "))})"""


_WITH = f"{_LINKS},\n{_RECON}"
ORACLES |= {
    "case_recount": _over(f"{_WITH},{_STATUSES}", f"select {_TOTALS}, " + ", ".join(f"count(*) filter (status = '{v}') as n_{v.lower()}" for v in ("ACCEPTED", "REOPENED", "OPEN", "CLOSED")) + " from statuses"),
    "breakdown_by_status": _over(f"{_WITH},{_STATUSES}", f"select exception_type, status, count(*) as n, cast(sum({_IMPACT}) as bigint) as impact_minor, cast(sum(abs(payment_delta_minor + settlement_delta_minor)) as bigint) as net_impact_minor from statuses group by 1, 2"),
    "run_rates": _over(
        f"{_WITH},{_STATUSES}",
        """select round(count(*) filter (exception_type = 'MATCHED') / count(*), 6) as match_rate, round(count(*) filter (status = 'OPEN') / count(*), 6) as coverage, round(count(*) filter (status = 'OPEN') / any_value(r), 6) as coverage_of_records,
  round(any_value(r) / 10, 6) as throughput from statuses, (select (select count(*) from legs_o) + (select count(*) from legs_p) + (select count(*) from legs_s) as r)""",
    ),
    "case_lookup": _cases("select * from cases where case_id = 'ORD-0000000007'"),
    "truth_unique": _over(f"{_LINKS},\n{_RECON},{_GRAVE},{_TRUTH}", "select order_id, min(l) as expected_label from (select order_id, expected_label as l from truth union all select order_id, case when order_id[-1:] in ('0', '5') then 'AMOUNT_MISMATCH' else expected_label end from truth) group by 1"),
    "fired_evidence": _over(
        _LINKS,
        f"""select left_uid, right_uid, cast(case when t then 0.40 else 0 end + case when o then 0.25 else 0 end + case when a then 0.20 else 0 end + case when g then 0.05 else 0 end + case when m then 0.05 else 0 end + case when w then 0.05 else 0 end as double) as score,
  concat_ws(' ', case when t then 'exact_txn_id' end, case when o then 'exact_order_id' end, case when a then 'exact_amount' end, case when g then 'reference_digits' end, case when m then 'same_merchant' end, case when w then 'within_window' end) as fired
  from (select left_uid, right_uid, l.txn_id = r.txn_id as t, l.order_id = r.order_id as o, l.amount_minor = r.amount_minor as a, l.ref_digits = r.ref_digits and length(l.ref_digits) > 3 as g, l.merchant_id = r.merchant_id as m, abs({_DT}) <= 172800 as w
    from op_links k join legs_o l on l.record_uid = k.left_uid join legs_p r on r.record_uid = k.right_uid)""",
    ),
    "verdict_checks": _over(
        f"{_WITH},{_VERDICTS}",
        """select case_id, concat_ws(' ', case when n % 14 = 0 then 'classification' end, case when n % 22 = 0 then 'confidence' end, case when n % 26 = 0 then 'explanation' end, case when n % 34 = 0 then 'evidence' end) as broken from verdicts
  union all select 'NO-SUCH-0', ''""",
    ),
    "verdict_memory": _over(f"{_WITH},{_VERDICTS},{_met(-1)}", "select case_id, v.classification as classification, v.resolution as resolution, v.confidence as confidence, v is not null as from_cache from met"),
    "verdict_stage": _over(
        f"{_WITH},{_VERDICTS},{_met(0.8)}",
        """select analyzed, hits as cache_hits, greatest(analyzed - hits - 500, 0) as skipped_over_budget, cast(ceil(least(analyzed - hits, 500) / 12) as bigint) as calls, answered, greatest(least(analyzed - hits, 500) - answered, 0) as unanswered, 1::bigint as unknown, broken from (
    select count(*) as analyzed, count(*) filter (v is not null) as hits, count(*) filter (v is null and case_id in (select case_id from verdicts)) as answered, (select count(*) from verdicts where n % 14 = 0 or n % 22 = 0 or n % 26 = 0 or n % 34 = 0) as broken from met)""",
    ),
}
# one rule over whole legs; swept rules once a day offset
for _tag, _left, _right, _passes in (("op", "legs_o", "legs_p", _OP), ("ps", "legs_p", "legs_s", _PS)):
    for _p in _passes:
        _name = f"{_tag}_{_p[0]}"
        if _p[0] != "l5":
            ORACLES[_name] = _over(_BASE, _pass(_left, _right, _p))
    ORACLES[f"{_tag}_l5"] = _over(_BASE, " union all ".join(f"select *, {_p[5]}::integer as day_offset from ({_pass(_left, _right, _p)})" for _p in _passes if _p[0] == "l5"))
