"""Problem 4: rows that fail to parse, by one anchored pattern per schema and field prefixes for the failures.

A schema is a feed's delimiter and format. A line that its schema's typed whole-row pattern matches is sound but for the
date, which the readings of problem 1 check; any other line passes through lexical prefixes of 1, 2, ... fields (the
first that fails names the first broken field), the field count, then typed prefixes up to amount and currency. A JSON
line has prefixes of 1, 2, ... members; an exact parse then tells those that are only in another order from broken ones.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.instants import with_readings
from tallyloom.session import small, staged

# The nine fields of a payment line, in order.
FIELDS = ("transaction_id", "order_id", "merchant_id", "amount", "fee", "currency", "payment_date", "status", "narration")

NUMBER = r"(?:\d++|\d{1,3}(?:,\d{2,3}){0,12},\d{3})(?:\.\d{2})?"
MONEY = rf"(?:A\$|[₹$€]|[A-Za-z]{{3}} )?{NUMBER}"
AMOUNT = rf"(?:-?{MONEY}|\({MONEY}\))"
CURRENCY = r"(?:[A-Za-z]{3})?"
#: Lines beyond this are matched by the same patterns in Python, which needs no stack for them; results are the same.
LONG = 4_000
_SEP = "\x01"


def _field(d: str) -> str:
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}\n]*+)'


def _typed(pattern: str) -> str:
    return rf'(?:"{pattern}"|{pattern})'


def _join(parts: list[str], d: str) -> str:
    return d.join(f"({p})" for p in parts)


def patterns(delimiter: str) -> dict[str, str]:
    """Of a delimited schema: whole (typed), cells (nine of any content), lexed (any number of fields), prefix_k, amount, currency."""
    d = re.escape(delimiter) if delimiter != "\t" else r"\t"
    f = _field(d)
    typed = [f, f, f, _typed(AMOUNT), f, _typed(CURRENCY), f, f, f]
    out = {"whole": f"^{_join(typed, d)}$", "cells": f"^{_join([f] * 9, d)}$", "lexed": f"^{f}(?:{d}{f})*+$"}
    out |= {f"prefix_{k}": f"^{d.join([f] * k)}(?={d}|$)" for k in range(1, 10)}
    out["amount"] = f"^{d.join(typed[:4])}(?={d}|$)"
    out["currency"] = f"^{d.join([f] * 5)}{d}{typed[5]}(?={d}|$)"
    return {k: v.replace("$)", r"\z)").removesuffix("$") + (r"\z" if v.endswith("$") else "") for k, v in out.items()}


_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'


def json_patterns() -> dict[str, str]:
    """Of the JSON schema: whole (typed) and prefix_k, in the order of FIELDS."""
    typed = {"amount": rf'"{AMOUNT}"', "currency": rf'"{CURRENCY}"'}
    members = [rf'"{k}"\s*:\s*({typed.get(k, _STRING)})' for k in FIELDS]
    lexical = [rf'"{k}"\s*:\s*(?:{_STRING}|-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null)' for k in FIELDS]
    out = {"whole": r"^\s*\{\s*" + r"\s*,\s*".join(members) + r"\s*\}\s*\z"}
    return out | {f"prefix_{k}": r"^\s*\{\s*" + r"\s*,\s*".join(lexical[:k]) + r"(?=\s*[,}])" for k in range(1, 10)}


def _unquoted(c: Column) -> Column:
    return F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def _only_once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(x: str) -> None:
    raise ValueError(x)


def _diagnose_long(raw: pd.Series, delimiter: pd.Series) -> pd.DataFrame:
    """reason, broken, amount, currency and payment_date of long lines, as the patterns give them for short ones."""
    rows = []
    compiled: dict[str | None, dict[str, re.Pattern]] = {}
    amount_is, currency_is = re.compile(AMOUNT, re.A), re.compile(CURRENCY, re.A)
    for text, d in zip(raw, delimiter, strict=True):
        d = None if d is None or d != d else d
        if d not in compiled:
            compiled[d] = {k: re.compile(v.replace(r"\z", r"\Z"), re.A) for k, v in (json_patterns() if d is None else patterns(d)).items()}
        p = compiled[d]
        broken = next((k for k in range(1, 10) if not p[f"prefix_{k}"].match(text)), None)
        if d is None:
            try:
                o = json.loads(text, parse_constant=_refuse, object_pairs_hook=_only_once)
            except (ValueError, RecursionError):
                o = None
            if not isinstance(o, dict) or set(o) != set(FIELDS):
                rows.append(("columns" if isinstance(o, dict) else "json", broken, None, None, None))
                continue
            cell = lambda k: o[k] if o[k] is None or isinstance(o[k], str) else json.dumps(o[k])  # noqa: E731, B023
            amount, currency, date = cell("amount"), cell("currency"), cell("payment_date")
        else:
            m = p["cells"].match(text)
            if not m:
                rows.append(("columns" if p["lexed"].match(text) else "quoting", broken, None, None, None))
                continue
            cells = [g[1:-1].replace('""', '"') if g.startswith('"') else g for g in m.groups()]
            amount, currency, date = cells[3], cells[5], cells[6]
        bad = "amount" if not amount_is.fullmatch(amount or "") else "currency" if not currency_is.fullmatch((currency or "").strip(" ")) else None
        rows.append((bad, broken, amount, currency, date))
    return pd.DataFrame(rows, columns=["reason", "broken", "amount", "currency", "payment_date"]).astype({"broken": "Int32"})


def _first_failing(line: Column, p: dict[str, str]) -> Column:
    step = F.when(~line.rlike(p["prefix_1"]), 1)
    for k in range(2, 10):
        step = step.when(~line.rlike(p[f"prefix_{k}"]), k)
    return step


def parse_lines(df: DataFrame, feeds: DataFrame, raw: str = "raw", source: str = "source_name", keep: list[str] | None = None) -> DataFrame:
    """df with parse_reason, parse_field (number of the first broken one; of a line with too many, null) and, where parse_reason is null, parsed_amount_minor, parsed_currency and parsed_instant_us.

    Reasons, the first that applies: json, quoting, columns, amount, currency, timestamp (as TESTDATA.md), and before all
    of them 'source' for a row whose feed is unknown. A null line has no reason and no values; a blank one has too few
    columns. Columns of df with the outputs' names are replaced; repeated rows stay; an empty df gives an empty result.
    """
    made = ["parse_reason", "parse_field", "parsed_amount_minor", "parsed_currency", "parsed_instant_us"]
    df = df.drop(*made)
    kept = keep if keep is not None else df.columns
    # the caller's columns travel under numbers, so that their names can't clash with working columns
    df = df.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)], F.col(raw).alias("_raw"), F.col(source).alias("_source"))
    raw, source = "_raw", "_source"
    schemas = [r[0] for r in feeds.where("raw_format = 'delimited' and delimiter is not null").select("delimiter").distinct().orderBy("delimiter").collect()]  # fixed and few
    known = feeds.groupBy(F.col("source_name").alias("_feed")).agg(F.min("delimiter").alias("_d"), F.min("raw_format").alias("_format"), F.min("zone_name").alias("_zone"), F.min("date_order").alias("_order"))
    x = df.join(small(known), F.col(source) == F.col("_feed"), "left")
    line = F.col("_line")
    short = F.length(F.col(raw)) <= LONG
    x = staged(x, {"_line": F.when(short, F.col(raw)), "_is_json": F.coalesce(F.col("_format") == "json", F.lit(False))})
    by = {d: patterns(d) for d in schemas}
    nine = _SEP.join(f"${k}" for k in range(1, 10))
    of_json = json_patterns()
    json_whole = of_json["whole"]
    is_json = F.col("_is_json")
    cells = F.when(is_json & line.rlike(json_whole), F.concat(F.lit("w" + _SEP), F.regexp_replace(line, json_whole, nine)))
    for d, p in by.items():
        mine = F.col("_d") == d
        cells = cells.when(mine & line.rlike(p["whole"]), F.concat(F.lit("w" + _SEP), F.regexp_replace(line, p["whole"], nine)))
        cells = cells.when(mine & line.rlike(p["cells"]), F.concat(F.lit("c" + _SEP), F.regexp_replace(line, p["cells"], nine)))
    x = staged(x, {"_cells": F.split(cells, _SEP)})
    whole = F.coalesce(F.col("_cells")[0] == "w", F.lit(False))
    # failures: the first field whose prefix pattern fails
    lexical = F.lit(None)
    broken = F.when(is_json, _first_failing(line, of_json))
    for d, p in by.items():
        mine = F.col("_d") == d
        first = F.when(F.col("_cells").isNull(), F.when(line.rlike(p["lexed"]), "columns").otherwise("quoting")).when(~line.rlike(p["amount"]), "amount").when(~line.rlike(p["currency"]), "currency")
        lexical = F.when(mine, first).otherwise(lexical)
        broken = broken.when(mine, _first_failing(line, p))
    boxed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    strict = boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull() & line.rlike(r"^\s*\{")
    keys = F.array_sort(F.json_object_keys(line))
    named = lambda k: F.get_json_object(line, f"$.{k}")
    amount_ok = lambda c: F.coalesce(c.rlike(f"^{AMOUNT}\\z"), F.lit(False))
    currency_ok = lambda c: F.coalesce(F.trim(c), F.lit("")).rlike(f"^{CURRENCY}\\z")
    json_reason = F.when(~F.coalesce(strict, F.lit(False)), "json").when(~F.coalesce(keys == F.array(*[F.lit(k) for k in sorted(FIELDS)]), F.lit(False)), "columns").when(~amount_ok(named("amount")), "amount").when(~currency_ok(named("currency")), "currency")
    reason = F.when(F.col(raw).isNull(), None).when(F.col("_feed").isNull(), "source").when(line.isNull(), None).when(whole, None).when(is_json, json_reason).otherwise(lexical)
    cell = lambda i, k: F.when(is_json & ~whole, named(k)).when(is_json, F.get_json_object(F.concat(F.lit('{"a":'), F.col("_cells")[i], F.lit("}")), "$.a") if k == "payment_date" else F.replace(F.col("_cells")[i], F.lit('"'), F.lit(""))).otherwise(_unquoted(F.col("_cells")[i]))
    x = staged(x, {"_reason": reason, "_broken": F.when(line.isNotNull() & F.col("_cells").isNull(), broken.cast("int"))})
    ok = F.col("_reason").isNull() & line.isNotNull() & F.col("_feed").isNotNull()
    x = staged(x, {"_amount": F.when(ok, cell(4, "amount")), "_currency": F.when(ok, cell(6, "currency")), "_date": F.when(ok, cell(7, "payment_date"))})

    @F.pandas_udf("reason string, broken int, amount string, currency string, payment_date string")
    def diagnose(text: pd.Series, d: pd.Series) -> pd.DataFrame:
        return _diagnose_long(text, d)

    usual = x.where(F.coalesce(F.length(F.col(raw)) <= LONG, F.lit(True)) | F.col("_feed").isNull())
    long = x.where((F.length(F.col(raw)) > LONG) & F.col("_feed").isNotNull()).withColumn("_long", diagnose(F.col(raw), F.when(~is_json, F.col("_d"))))
    long = long.withColumns({"_reason": F.col("_long.reason"), "_broken": F.col("_long.broken"), "_amount": F.col("_long.amount"), "_currency": F.col("_long.currency"), "_date": F.col("_long.payment_date")}).drop("_long")
    y = with_readings(usual.unionByName(long), F.col("_date"), F.col("_zone"), F.col("_order"), "_q")
    late = F.when(F.col("_reason").isNull() & ~F.coalesce(F.col("_date").rlike(r"^[\s\p{Z}]*$"), F.lit(True)) & F.coalesce(F.col("_q_us1"), F.col("_q_us2"), F.col("_q_us3")).isNull(), "timestamp")
    y = staged(y, {"_final": F.coalesce(F.col("_reason"), late)})
    digits = F.regexp_replace(F.col("_amount"), r"[^0-9]", "")
    scale = F.when(F.col("_amount").rlike(r"\.\d{2}\)?$"), 1).otherwise(100)
    value = digits.try_cast("decimal(36,0)") * scale * F.when(F.col("_amount").rlike(r"^[-(]"), -1).otherwise(1)
    sound = F.col("_final").isNull()
    return y.select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)],
        F.col("_final").alias(made[0]),
        F.when(F.col("_final").isin("json", "quoting", "columns"), F.col("_broken")).when(F.col("_final") == "amount", 4).when(F.col("_final") == "currency", 6).when(F.col("_final") == "timestamp", 7).alias(made[1]),
        F.when(sound, value.try_cast("bigint")).alias(made[2]),
        F.when(sound, F.upper(F.trim(F.col("_currency")))).alias(made[3]),
        F.when(sound, F.coalesce(F.col("_q_us1"), F.col("_q_us2"), F.col("_q_us3"))).alias(made[4]),
    )
