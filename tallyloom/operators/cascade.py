"""Links between two legs by an ordered cascade of rules, each over what the earlier ones left.

A rule is data: conditions over the columns of both sides (l_ and r_), the evidence it may count and the day offsets it
sweeps. A pass joins pending rows on the rule's keys, ranks every pair both ways and keeps mutual bests; ties go to the
least uid. Only narrow columns take part; new links are written to the shared folder after each pass, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.config import CONFIG, EngineConfig
from tallyloom.schema import LINKS
from tallyloom.session import cut, cut_counted

NARROW = ("record_uid", "txn_id", "order_id", "ref_digits", "merchant_id", "currency", "amount_minor", "txn_ts", "day_bucket")

# The weight of each kind of evidence; as decimals, so that sums are exact.
WEIGHTS = {"exact_txn_id": "0.40", "exact_order_id": "0.25", "exact_amount": "0.20", "reference_digits": "0.05", "same_merchant": "0.05", "within_window": "0.05"}

#: Pending sides are written anew once the links since the last time reach this share of them.
REWRITE = 1.0
ONE_PARTITION = 20_000
#: Distinct lengths of references up to which pieces are made by length; beyond, all pieces are made.
MOST_LENGTHS = 64
#: Pairs of a swept rule that one task may hold, some 30 MB.
SWEEP_PAIRS = 200_000


def _l(c: str) -> Column:
    return F.col(f"l_{c}")


def _r(c: str) -> Column:
    return F.col(f"r_{c}")


def seconds_between() -> Column:
    """From the left to the right time in whole seconds on the clock, null if either is missing."""
    return F.unix_timestamp(_r("txn_ts").cast("timestamp")) - F.unix_timestamp(_l("txn_ts").cast("timestamp"))


def _apart() -> Column:
    return F.abs(_l("amount_minor") - _r("amount_minor"))


@dataclass(frozen=True)
class Rule:
    stage: str
    name: str
    keys: tuple[tuple[str, str], ...]
    evidence: tuple[str, ...]
    keep: Callable[[EngineConfig], Column] = lambda c: F.lit(True)
    offsets: Callable[[EngineConfig], tuple[int, ...]] = lambda c: (0,)
    #: Sign of the offset: the right day is the left day plus sign times offset; 0: days play no part.
    day_sign: int = 0
    #: Prepares a side: adds or filters key columns.
    left: Callable[[DataFrame, EngineConfig], DataFrame] = lambda df, c: df
    right: Callable[[DataFrame, EngineConfig], DataFrame] = lambda df, c: df
    #: The keys are ids, of which each row has one: ranks then run in the join's own partitions.
    by_id: bool = False
    #: The left key is a piece of order_id, of which only lengths that the right key has are made.
    pieces: bool = False


def score(evidence: tuple[str, ...], config: EngineConfig, window_sec: int) -> Column:
    """Sum of the weights of what holds for the pair, as a double."""

    def weight(name: str) -> Column:
        w = F.lit(WEIGHTS[name]).cast("decimal(4,2)")
        holds = {
            "exact_amount": _apart() <= config.amount_tolerance,
            "same_merchant": _l("merchant_id") == _r("merchant_id"),
            "within_window": F.abs(seconds_between()) <= window_sec,
            "reference_digits": (F.length(_l("ref_digits")) > 3) & (_l("ref_digits") == _r("ref_digits")),
        }.get(name)
        return w if holds is None else F.when(F.coalesce(holds, F.lit(False)), w).otherwise(F.lit("0").cast("decimal(4,2)"))

    return reduce(lambda a, b: a + b, map(weight, evidence)).cast("double")


def fired(holds: dict[str, Column]) -> tuple[Column, Column]:
    """(score, names of the evidence that holds, in the order of WEIGHTS); what is missing or null does not hold."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(holds[k], F.lit(False)), F.lit(k)) for k in WEIGHTS if k in holds]))
    weights = [F.when(F.coalesce(holds[k], F.lit(False)), F.lit(w).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)")) for k, w in WEIGHTS.items() if k in holds]
    return reduce(lambda a, b: a + b, weights).cast("double"), names


def _filled(c: str) -> Callable[[DataFrame, EngineConfig], DataFrame]:
    return lambda df, _: df.where(F.col(c).isNotNull() & (F.col(c) != ""))


def _long_digits(df: DataFrame, _: EngineConfig) -> DataFrame:
    return df.where(F.length("ref_digits") >= 5)


def _runs(df: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """A row for every distinct substring of the digit runs of order_id: containment becomes equality. lengths: only of these."""
    runs = F.regexp_extract_all("order_id", F.lit(r"(\p{Nd}+)"), F.lit(1))
    if lengths is None:
        cuts = lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(F.sequence(F.lit(1), F.length(r) - i + 1), lambda n: F.substring(r, i, n))))
    else:
        some = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
        cuts = lambda r: F.flatten(F.transform(F.filter(some, lambda n: n <= F.length(r)), lambda n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n))))
    return df.where(F.length("order_id") >= 5).withColumn("piece", F.explode(F.array_distinct(F.flatten(F.transform(runs, cuts)))))


def _bucket(c: Column, size: int) -> Column:
    return F.rint(c / size).cast("long")


def _in_buckets(df: DataFrame, c: EngineConfig) -> DataFrame:
    return df.withColumn("bucket", _bucket(F.col("amount_minor"), c.amount_bucket))


def contradicted() -> Column:
    """Both sides have both ids and all of them differ."""
    there = lambda c: _l(c).isNotNull() & (_l(c) != "") & _r(c).isNotNull() & (_r(c) != "") & (_l(c) != _r(c))
    return F.coalesce(there("txn_id") & there("order_id"), F.lit(False))


def _in_window(c: EngineConfig) -> Column:
    return seconds_between().isNull() | (F.abs(seconds_between()) <= c.window_sec)


def _near_amount(c: EngineConfig) -> Column:
    return _apart() <= c.amount_tolerance


_ID = ("exact_amount", "same_merchant", "within_window")
_MC = (("merchant_id", "merchant_id"), ("currency", "currency"))

ORDER_PAYMENT = (
    Rule("L1", "exact_transaction_id", (("txn_id", "txn_id"),), ("exact_txn_id", *_ID), left=_filled("txn_id"), right=_filled("txn_id"), by_id=True),
    Rule("L3", "order_id_and_amount", (("order_id", "order_id"),), ("exact_order_id", *_ID), keep=_near_amount, left=_filled("order_id"), right=_filled("order_id"), by_id=True),
    Rule("L4", "order_id_within_window", (("order_id", "order_id"),), ("exact_order_id", *_ID), keep=_in_window, left=_filled("order_id"), right=_filled("order_id"), by_id=True),
    Rule("L2", "reference_digits_and_amount", (("ref_digits", "ref_digits"),), ("reference_digits", *_ID), keep=_near_amount, left=_long_digits, right=_long_digits, by_id=True),
    Rule("L2", "order_id_inside_reference", (("piece", "ref_digits"),), ("reference_digits", *_ID), keep=_in_window, left=lambda df, _: _runs(df), right=_filled("ref_digits"), pieces=True),
    Rule(
        "L5", "blocked_merchant_amount_day", (*_MC, ("bucket", "bucket")), _ID,
        keep=lambda c: (_apart() <= c.amount_bucket) & (F.abs(seconds_between()) <= c.window_sec) & ~contradicted(),
        offsets=lambda c: (0, -1, 1), day_sign=-1, left=_in_buckets, right=_in_buckets,
    ),
)

PAYMENT_SETTLEMENT = (
    Rule("L1", "exact_transaction_id", (("txn_id", "txn_id"),), ("exact_txn_id", "exact_amount", "same_merchant"), left=_filled("txn_id"), right=_filled("txn_id"), by_id=True),
    Rule("L2", "reference_digits", (("ref_digits", "ref_digits"),), ("reference_digits", "exact_amount", "same_merchant"), left=_long_digits, right=_long_digits, by_id=True),
    Rule("L3", "order_id", (("order_id", "order_id"),), ("exact_order_id", "exact_amount", "same_merchant"), left=_filled("order_id"), right=_filled("order_id"), by_id=True),
    Rule(
        "L5", "blocked_merchant_net_of_fee", _MC, ("same_merchant", "within_window"),
        keep=lambda c: (_r("amount_minor") <= _l("amount_minor") + c.amount_tolerance) & (_r("amount_minor") >= _l("amount_minor") - _l("amount_minor") / 10) & seconds_between().between(0, c.settlement_sec) & ~contradicted(),
        offsets=lambda c: tuple(range(c.settlement_days + 1)), day_sign=1,
    ),
)


def _terms(rule: Rule, config: EngineConfig, window_sec: int) -> tuple[Column, list[Column]]:
    """What a rule keeps and what it makes of a pair. Built once for all of a rule's offsets, as each column costs calls."""
    out = [_l("record_uid").alias("left_uid"), _r("record_uid").alias("right_uid"), F.lit(rule.stage).alias("stage"), F.lit(rule.name).alias("rule"), score(rule.evidence, config, window_sec).alias("confidence"), (_l("amount_minor") - _r("amount_minor")).alias("amount_delta_minor"), seconds_between().alias("time_delta_sec")]
    return rule.keep(config), out


def candidates(left: DataFrame, right: DataFrame, rule: Rule, offset: int, config: EngineConfig, window_sec: int, terms: tuple[Column, list[Column]] | None = None) -> DataFrame:
    """All pairs that satisfy the rule, with deltas and confidence."""
    b = rule.right(right.select(*NARROW), config)
    if rule.pieces:
        sizes = [r[0] for r in b.select(F.length(rule.keys[0][1])).distinct().limit(MOST_LENGTHS + 1).collect()]
        a = _runs(left.select(*NARROW), sizes if len(sizes) <= MOST_LENGTHS else None)
    else:
        a = rule.left(left.select(*NARROW), config)
    a, b = (x.toDF(*[f"{p}_{c}" for c in x.columns]) for x, p in ((a, "l"), (b, "r")))
    on = " and ".join(f"l_{x} = r_{y}" for x, y in rule.keys)
    if rule.day_sign:
        on += f" and date_add(l_day_bucket, {rule.day_sign * offset}) = r_day_bucket"
    keep, out = terms or _terms(rule, config, window_sec)
    key = [F.col(f"l_{rule.keys[0][0]}").alias("_key")] if rule.by_id else []
    return a.join(b, F.expr(on)).where(keep).select(*out, *key)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of both their sides: confidence, then amount, then time (missing last), then the other uid."""

    key = "_key, " if "_key" in pairs.columns else ""  # a uid has one key, so this divides pairs as the uid alone does
    best = "row_number() over (partition by {} order by confidence desc, abs(amount_delta_minor), abs(time_delta_sec) nulls last, {}) as {}"
    return pairs.selectExpr("*", best.format(f"{key}left_uid", "right_uid", "_a"), best.format(f"{key}right_uid", "left_uid", "_b")).where("_a = 1 and _b = 1").drop("_a", "_b", "_key")


def single_pass(left: DataFrame, right: DataFrame, rule: Rule, offset: int = 0, config: EngineConfig = CONFIG, window_sec: int | None = None, terms: tuple[Column, list[Column]] | None = None) -> DataFrame:
    """The rule's mutual bests over whole legs."""
    return mutual_best(candidates(left, right, rule, offset, config, config.window_sec if window_sec is None else window_sec, terms))


def swept_pairs(left: DataFrame, right: DataFrame, rule: Rule, config: EngineConfig, window_sec: int, terms: tuple[Column, list[Column]]) -> DataFrame:
    """candidates() of all the rule's offsets by one join, with place: the offset's number in their order."""
    a, b = rule.left(left.select(*NARROW), config), rule.right(right.select(*NARROW), config)
    a = a.select("*", F.posexplode(F.array(*[F.lit(k) for k in rule.offsets(config)])).alias("place", "offset"))
    a, b = (x.toDF(*[f"{p}_{c}" for c in x.columns]) for x, p in ((a, "l"), (b, "r")))
    on = " and ".join([*(f"l_{x} = r_{y}" for x, y in rule.keys), f"date_add(l_day_bucket, {rule.day_sign} * l_offset) = r_day_bucket"])
    keep, out = terms
    return a.join(b, F.expr(on)).where(keep).select(*out, F.col("l_place").alias("place"))


def _sweep(pairs: pd.DataFrame) -> pd.DataFrame:
    """Mutual bests of one place after the other, each among what the earlier ones left."""
    pairs = pairs.assign(_a=pairs["amount_delta_minor"].abs(), _t=pairs["time_delta_sec"].abs())
    out, lefts, rights = [], set(), set()
    for _, x in pairs.groupby("place", sort=True):
        x = x[~x["left_uid"].isin(lefts) & ~x["right_uid"].isin(rights)]
        rank = {"by": ["confidence", "_a", "_t"], "ascending": [False, True, True]}
        of_left = x.sort_values(rank["by"] + ["right_uid"], ascending=rank["ascending"] + [True], na_position="last").drop_duplicates("left_uid").index
        of_right = x.sort_values(rank["by"] + ["left_uid"], ascending=rank["ascending"] + [True], na_position="last").drop_duplicates("right_uid").index
        won = x.loc[of_left.intersection(of_right)]
        lefts |= set(won["left_uid"])
        rights |= set(won["right_uid"])
        out.append(won)
    return pd.concat(out)[pairs.columns[:-2]] if out else pairs[pairs.columns[:-2]]


def run_cascade(left: DataFrame, right: DataFrame, rules: tuple[Rule, ...], exclude_left: DataFrame | None = None, config: EngineConfig = CONFIG, window_sec: int | None = None) -> tuple[DataFrame, list[tuple[str, str, int, int]]]:
    """(links, statistics (stage, rule, offset, matched) of every pass).

    Null ids and blank references link nothing. Empty legs give no links and a zero for every pass. A pass is skipped once
    either side is empty. The offsets of a swept rule share one join; if it has at most SWEEP_PAIRS pairs one task plays the
    passes over them, else each pass is a job of its own, with the same result.
    """
    spark = left.sparkSession
    window_sec = config.window_sec if window_sec is None else window_sec
    a, b = left.select(*NARROW), right.select(*NARROW)
    if exclude_left is not None:
        a = a.join(exclude_left.select("record_uid").distinct(), "record_uid", "left_anti")
    links, stats = spark.createDataFrame([], LINKS), []
    n_a, n_b = a.count(), b.count()
    since, linked = None, 0  # links made since the pending sides were last written
    for rule in rules:
        terms = _terms(rule, config, window_sec)
        offsets = rule.offsets(config)
        counts = dict.fromkeys(range(len(offsets)), 0)
        new, n = None, 0
        if n_a and n_b:
            x, y = _without(a, since, "left_uid"), _without(b, since, "right_uid")
            if len(offsets) == 1:
                new, n = cut_counted(single_pass(x, y, rule, offsets[0], config, window_sec, terms))
                counts[0] = n
            else:
                new, counts = _swept(swept_pairs(x, y, rule, config, window_sec, terms), counts)
                n = sum(counts.values())
        stats += [(rule.stage, rule.name, offset, counts[i]) for i, offset in enumerate(offsets)]
        if n:
            links = links.unionByName(new)
            since = new if since is None else since.unionByName(new)
            n_a, n_b, linked = n_a - n, n_b - n, linked + n
            if rule is not rules[-1] and linked >= REWRITE * min(n_a, n_b) and n_a and n_b:
                a, b = _written(_without(a, since, "left_uid"), n_a), _written(_without(b, since, "right_uid"), n_b)
                since, linked = None, 0
    return links, stats


def _swept(pairs: DataFrame, counts: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(links, links by place) of a swept rule's pairs."""
    pairs, n = cut_counted(pairs)
    columns = [f.name for f in LINKS]
    if n <= SWEEP_PAIRS:
        done = cut(pairs.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda x: _sweep(x.drop(columns="_all", errors="ignore")), pairs.schema))
        counts = counts | {r["place"]: r["count"] for r in done.groupBy("place").count().collect()}  # a row an offset
        return done.select(*columns), counts
    done, counts = None, dict(counts)
    for place in counts:
        x = pairs.where(F.col("place") == place).drop("place")
        if done is not None:
            x = x.join(done.select("left_uid"), "left_uid", "left_anti").join(done.select("right_uid"), "right_uid", "left_anti")
        won, counts[place] = cut_counted(mutual_best(x).select(*columns))
        done = won if done is None else done.unionByName(won)
    return done, counts


def _without(side: DataFrame, links: DataFrame | None, uid: str) -> DataFrame:
    return side if links is None else side.join(links.select(F.col(uid).alias("record_uid")), "record_uid", "left_anti")


def _written(side: DataFrame, rows: int) -> DataFrame:
    """A pending side written to the shared folder, in one partition if it is so small that exchanges would cost more."""
    return cut(side.coalesce(1) if rows <= ONE_PARTITION else side)


def stats_frame(spark, op: list, ps: list) -> DataFrame:
    rows = [("order_payment", *x) for x in op] + [("payment_settlement", *x) for x in ps]
    return spark.createDataFrame(rows, "leg string, stage string, rule string, day_offset int, matched bigint")


def closest_unlinked(left: DataFrame, right: DataFrame, links: DataFrame, k: int = 3, span: int = 2, config: EngineConfig = CONFIG) -> DataFrame:
    """The k likeliest partners of each unlinked left row: same merchant and currency, at most span days apart."""
    a = left.select(*NARROW).join(links.select(F.col("left_uid").alias("record_uid")), "record_uid", "left_anti").where("txn_ts is not null")
    b = right.select(*NARROW).join(links.select(F.col("right_uid").alias("record_uid")), "record_uid", "left_anti").where("txn_ts is not null")
    b = b.withColumn("probe", F.explode(F.array(*[F.date_add("day_bucket", d) for d in range(-span, span + 1)])))
    a, b = (x.select(*[F.col(c).alias(f"{p}_{c}") for c in x.columns]) for x, p in ((a, "l"), (b, "r")))
    pairs = a.join(b, (_l("merchant_id") == _r("merchant_id")) & (_l("currency") == _r("currency")) & (_l("day_bucket") == F.col("r_probe")))
    dec = lambda v: F.lit(v).cast("decimal(4,2)")
    likely = F.when(_apart() <= config.amount_bucket, dec("0.5")).otherwise(dec("0.15")) + F.when((_l("ref_digits") != "") & (_l("ref_digits") == _r("ref_digits")), dec("0.35")).otherwise(dec("0")) + F.when(_l("order_id") == _r("order_id"), dec("0.15")).otherwise(dec("0"))
    pairs = pairs.select(_l("record_uid").alias("left_uid"), _r("record_uid").alias("right_uid"), (_l("amount_minor") - _r("amount_minor")).alias("amount_delta_minor"), seconds_between().alias("time_delta_sec"), likely.cast("double").alias("affinity"))
    rank = F.row_number().over(Window.partitionBy("left_uid").orderBy(F.col("affinity").desc(), "right_uid"))
    return pairs.withColumn("rk", rank.cast("long")).where(F.col("rk") <= k)
