"""DuckDB SQL for times, lines and nearest payments, written as text and apart from the Spark plans."""

from __future__ import annotations

from tallyloom.functions.instants import ABBREVIATIONS

_CLOCK = r"(?:[Tt ] ?(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)? ?([AaPp][Mm])? ?([Zz]|(?:GMT|UTC|UT|gmt|utc)?[+-]\d{1,2}(?::?\d\d)?|[A-Za-z]{2,5})?)?"
_DAY_NAME = r"(?:[A-Za-z]{3,9},? )?"
#: family, pattern, names of its groups
_FAMILIES = [
    ("year_first", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK, "a b c h i s f p z"),
    ("numeric", r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d\d)" + _CLOCK, "a b c h i s f p z"),
    ("day_month", _DAY_NAME + r"(\d{1,2})[- /]([A-Za-z]{3,9})[- /](\d{4}|\d\d)" + _CLOCK, "c b a h i s f p z"),
    ("month_day", _DAY_NAME + r"([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})" + _CLOCK, "b c a h i s f p z"),
    ("compact", r"(\d{4})(\d\d)(\d\d)[Tt](\d\d)(\d\d)(\d\d)(?:[.,](\d{1,9}))?([Zz]|(?:GMT|UTC|UT|gmt|utc)?[+-]\d{1,2}(?::?\d\d)?|[A-Za-z]{2,5})?", "a b c h i s f z"),
]
_ZONES = ", ".join(f"('{k}', {v})" for k, v in ABBREVIATIONS.items())


def _names(groups: str) -> str:
    return "[" + ", ".join(f"'{g}'" for g in groups.split()) + "]"


def _parts() -> str:
    cases = []
    for name, pattern, groups in _FAMILIES:
        fields = f"regexp_extract(t, '^{pattern}$', {_names(groups)})"
        if name == "compact":
            fields = f"struct_insert({fields}, p := '')"
        picked = ", ".join(f"{g} := x.{g}" for g in "abchisfpz")
        cases.append(f"when regexp_full_match(t, '{pattern}') then (select struct_pack({picked}) from (select {fields} as x))")
    kinds = " ".join(f"when regexp_full_match(t, '{p}') then '{n}'" for n, p, _ in _FAMILIES if n != "compact")
    return f"case when regexp_full_match(t, '\\d{{8,19}}') then null {' '.join(cases)} end as q, case when regexp_full_match(t, '\\d{{8,19}}') then 'digits' {kinds} when regexp_full_match(t, '{_FAMILIES[-1][1]}') then 'compact' end as kind"


def times(rows: str, prefix: str = "") -> str:
    """CTEs ending in {prefix}read: rows' columns with fmt, us and blank. rows: a query with tx (the spelling), z and o (zone and date order)."""
    p = prefix
    return rf"""
{p}tidy as materialized (select *, trim(regexp_replace(tx, '[\s\p{{Z}}]+', ' ', 'g')) as t0 from ({rows})),
{p}cut_up as materialized (select *, {_parts()} from (select *, case when length(t0) between 6 and 64 then t0 end as t from {p}tidy)),
{p}fields as (
  select *,
    case kind when 'numeric' then case lower(o) when 'dmy' then q.c when 'mdy' then q.c when 'ymd' then case when length(q.c) = 2 then lpad(q.a, 2, '0') end end else q.a end as yy,
    case kind when 'numeric' then case lower(o) when 'mdy' then q.a else q.b end
      when 'day_month' then (list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(q.b, 3))))::varchar
      when 'month_day' then (list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(q.b, 3))))::varchar
      when 'digits' then null else q.b end as mm,
    case kind when 'numeric' then case lower(o) when 'dmy' then q.a when 'mdy' then q.b else q.c end else q.c end as dd,
    upper(coalesce(q.z, '')) as zz
  from {p}cut_up),
{p}clocks as (
  select f.*, try_cast(case when length(yy) = 2 then '20' || yy else yy end || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') as date) as dt,
    case when q.p = '' then case when q.h = '' then 0 when try_cast(q.h as int) < 24 then try_cast(q.h as int) end when try_cast(q.h as int) between 1 and 12 then try_cast(q.h as int) % 12 + case upper(q.p) when 'PM' then 12 else 0 end end as hh,
    case when q.i = '' then 0 when try_cast(q.i as int) < 60 then try_cast(q.i as int) end as ii, case when q.s = '' then 0 when try_cast(q.s as int) < 60 then try_cast(q.s as int) end as ss,
    case when q.f = '' then 0 else try_cast(rpad(left(q.f, 6), 6, '0') as bigint) end as ff,
    case when zz = '' then null when regexp_matches(zz, '\d') then
      case when length(zn) <= 2 then case when try_cast(zn as int) <= 18 then try_cast(zn as int) * 60 end else case when try_cast(lpad(zn, 4, '0')[1:2] as int) <= 18 and try_cast(lpad(zn, 4, '0')[3:4] as int) < 60 then try_cast(lpad(zn, 4, '0')[1:2] as int) * 60 + try_cast(lpad(zn, 4, '0')[3:4] as int) end end
        * case when contains(zz, '-') then -1 else 1 end
      else k.minutes end as off
  from (select *, regexp_replace(zz, '\D', '', 'g') as zn from {p}fields) f left join (values {_ZONES}) k(name, minutes) on k.name = f.zz),
{p}locals as (
  select *,
    case kind when 'digits' then case length(t)
        when 14 then epoch_us(try_strptime(t, '%Y%m%d%H%M%S')) when 12 then epoch_us(try_strptime(t, '%Y%m%d%H%M')) when 8 then epoch_us(try_strptime(t, '%Y%m%d')) end
      else epoch_us(dt) + ((hh * 60 + ii) * 60 + ss)::bigint * 1000000 + ff end as local_us,
    case when kind = 'digits' then case length(t) when 10 then try_cast(t as bigint) * 1000000 when 13 then try_cast(t as bigint) * 1000 when 16 then try_cast(t as bigint) end
      when zz <> '' then epoch_us(dt) + ((hh * 60 + ii) * 60 + ss)::bigint * 1000000 + ff - off::bigint * 60000000 end as fixed_us
  from {p}clocks),
{p}offsets as materialized (
  select *, local_us - (local_us - 86400000000 - epoch_us(timezone(z, make_timestamp(local_us - 86400000000)))) as before_us, epoch_us(timezone(z, make_timestamp(local_us))) as other_us
  from {p}locals),
{p}read as materialized (
  select * exclude (t0, t, q, yy, mm, dd, zz, zn, dt, hh, ii, ss, ff, off, local_us, fixed_us, before_us, other_us, kind), coalesce(t0, '') = '' as blank,
    case when kind = 'digits' or zz <> '' then coalesce(fixed_us, case when kind = 'digits' then zoned end) else zoned end as us,
    case when (case when kind = 'digits' or zz <> '' then coalesce(fixed_us, case when kind = 'digits' then zoned end) else zoned end) is null then null
      when kind = 'digits' then case when fixed_us is not null then 'epoch' else 'run' end when kind = 'numeric' then lower(o) when kind in ('day_month', 'month_day') then 'named_month' else 'year_first' end as fmt
  from (
    select *, case when epoch_us(timezone(z, timezone('UTC', make_timestamp(before_us)))) = local_us then before_us
                   when epoch_us(timezone(z, timezone('UTC', make_timestamp(other_us)))) = local_us then other_us else before_us end as zoned
    from {p}offsets))"""


_LEGS = """
  select 'payments' as leg, record_uid, p.source_name, txn_ts as tx, zone_name as z, date_order as o from payments p left join feeds f on p.source_name = f.source_name
  union all
  select 'order_txns', record_uid, p.source_name, txn_ts, zone_name, date_order from order_txns p left join feeds f on p.source_name = f.source_name"""
_CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z$"

# a field is quoted or plain; the delimiter is put in for D
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^"D\n]*)'
_NUMBER = r"(?:\d+|\d{1,3}(?:,\d{2,3})*,\d{3})(?:\.\d\d)?"
_MONEY = rf"(?:A\$|[₹$€]|[A-Za-z]{{3}} )?{_NUMBER}"
_AMOUNT = rf"(?:-?{_MONEY}|\({_MONEY}\))"
_NINE = ["transaction_id", "order_id", "merchant_id", "amount", "fee", "currency", "payment_date", "status", "narration"]
_DELIMITERS = [",", ";", "|", "\t"]


def _lines() -> str:
    """CTEs ending in judged: payments' record_uid, reason (without times), field, amount, currency and tx, z, o."""
    lexed, nine = [], []
    for d in _DELIMITERS:
        one = _FIELD.replace("D", r"\t" if d == "\t" else d)
        sep = {"\t": r"\t", "|": r"\|"}.get(d, d)
        here = "delimiter = chr(9)" if d == "\t" else f"delimiter = '{d}'"
        lexed.append(f"when {here} then regexp_full_match(raw, '{one}(?:{sep}{one})*')")
        nine.append(f"when {here} and regexp_full_match(raw, '{sep.join([one] * 9)}') then regexp_extract(raw, '^{sep.join([f'({one})'] * 9)}$', [{', '.join(repr(n) for n in _NINE)}])")
    fields = ", ".join(repr(n) for n in sorted(_NINE))
    plain = lambda n: f"""case when starts_with(nine.{n}, '"') then replace(nine.{n}[2:-2], '""', '"') else nine.{n} end"""
    value = lambda n: f"case when raw_format = 'json' then raw::json->>'$.{n}' else {plain(n)} end"
    return f"""
lines as materialized (
  select record_uid, raw, f.raw_format, f.source_name as known, zone_name as z, date_order as o,
    case {" ".join(lexed)} end as lexed, case {" ".join(nine)} end as nine,
    raw_format = 'json' and json_valid(raw) and regexp_matches(raw, '^\\s*\\{{') and not regexp_matches(raw, ',\\s*[}}\\]]') as whole
  from payments p left join feeds f on p.source_name = f.source_name),
shaped as materialized (
  select *, case when raw is null or known is null then null
      when raw_format = 'json' then case when not whole then 'json' when list_sort(json_keys(case when whole then raw end)) <> [{fields}] then 'columns' end
      when not lexed then 'quoting' when nine is null then 'columns' end as shape
  from lines),
celled as materialized (
  select *, case when shape is null and known is not null then {value("amount")} end as amount, case when shape is null and known is not null then trim({value("currency")}) end as currency,
    case when shape is null and known is not null then {value("payment_date")} end as tx
  from shaped),
judged as materialized (
  select record_uid, known, raw, z, o, tx, amount, currency,
    case when raw is null then null when known is null then 'source' when shape is not null then shape when not coalesce(regexp_full_match(amount, '{_AMOUNT}'), false) then 'amount' when not regexp_full_match(coalesce(currency, ''), '(?:[A-Za-z]{{3}})?') then 'currency' end as early
  from celled)"""


_PARSED = f"""
  with {_lines()},
  {times("select * from judged")},
  final as (select *, case when early is not null then early when raw is not null and not blank and us is null then 'timestamp' end as reason from read)"""
_MINOR = """case when reason is null and raw is not null then
      try_cast(regexp_replace(amount, '\\D', '', 'g') as bigint) * case when regexp_matches(amount, '\\.\\d\\d\\)?$') then 1 else 100 end * case when left(amount, 1) in ('-', '(') then -1 else 1 end end"""
ORACLES = {
    "p1_found": f"with {times(_LEGS)} select leg, record_uid, us as instant_us from read where us is not null and not regexp_matches(tx, '{_CANONICAL}')",
    "p1_states": f"""with {times(_LEGS)} select source_name, fmt as instant_format, case when blank then 'missing' when us is null then 'unreadable' else 'resolved' end as instant_state, count(*) as n
      from read where leg = 'payments' group by 1, 2, 3""",
    "p4_found": f"{_PARSED} select record_uid, reason from final where reason is not null and reason <> 'source'",
    "p4_parsed": f"""{_PARSED}
      select record_uid, reason as parse_reason, {_MINOR} as parsed_amount_minor, case when reason is null and known is not null and raw is not null then upper(currency) end as parsed_currency,
        case when reason is null and known is not null and raw is not null then us end as parsed_instant_us from final""",
}
