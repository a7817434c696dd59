"""Problem 1: times in mixed spellings and zones, resolved by a mixture of formats per source.

Every value has one or more valid readings (functions.instants). Per source a mixture over formats is fitted by
expectation-maximisation: a reading's likelihood is its format's weight times the density of its delay, the time from the
reading to the row's arrival. A declared date order enters as a prior: orders that contradict it count next to nothing,
less than the assumption that the value is no time at all. Values enter only as counts of (source, formats with their delay classes), so what one
source brings to the fit is bounded by the number of such classes and not by its rows. Posteriors choose the reading;
below MIN_POSTERIOR the row is marked ambiguous and gets no instant, and a row best explained as no time is unreadable.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.instants import CANONICAL, with_readings
from tallyloom.session import small, staged

#: A posterior that settles a reading.
MIN_POSTERIOR = 0.9
ROUNDS = 60
ORDERS = ("dmy", "mdy", "ymd")
#: Prior of a date order against the declared one, and of no time at all against the likeliest reading.
CONTRARY, NO_TIME = 1e-12, 1e-6


def _delay_class(us: Column, arrival: Column) -> Column:
    """Signed power of two of the delay's seconds; 99 where the arrival is unknown."""
    seconds = (F.unix_micros(arrival.cast("timestamp")) - us) / 1e6
    size = F.floor(F.log2(F.abs(seconds) + 1)).cast("int")
    return F.coalesce(F.when(seconds < 0, -size - 1).otherwise(size), F.lit(99))


def fit_source(classes: pd.DataFrame, declared: str | None = None, rounds: int = ROUNDS) -> pd.DataFrame:
    """The choice (from 1; 0: no time) and posterior of one source's classes that are not plain.

    classes: signature ('fmt:delay' joined by '/') and n. A class is plain if it has one reading and that is not against the
    declared order.
    """
    options = [[tuple(x.split(":")) for x in s.split("/")] for s in classes.signature]
    formats = sorted({f for o in options for f, _ in o})
    delays = sorted({d for o in options for _, d in o})
    prior = {f: CONTRARY if declared in ORDERS and f in ORDERS and f != declared else 1.0 for f in formats}
    weight = dict.fromkeys(formats, 1 / len(formats))
    density = dict.fromkeys(delays, 1 / len(delays))
    shares: list[list[float]] = []
    for _ in range(rounds):
        shares = []
        to_f, to_d = dict.fromkeys(formats, 0.5), dict.fromkeys(delays, 0.05)  # smoothing
        for o, n in zip(options, classes.n, strict=True):
            p = [weight[f] * density[d] for f, d in o]
            none = NO_TIME * max(p)
            p = [x * prior[f] for x, (f, _) in zip(p, o, strict=True)]
            total = sum(p) + none
            r = [x / total for x in p]
            shares.append([none / total, *r])
            for (f, d), x in zip(o, r, strict=True):
                to_f[f] += n * x
                to_d[d] += n * x
        new = {f: x / sum(to_f.values()) for f, x in to_f.items()}
        moved = max(abs(new[f] - weight[f]) for f in formats)
        weight, density = new, {d: x / sum(to_d.values()) for d, x in to_d.items()}
        if moved < 1e-9:
            break
    out = []
    for s, o, r in zip(classes.signature, options, shares, strict=True):
        if len(o) > 1 or prior[o[0][0]] < 1:
            best = max(range(len(r)), key=lambda i: (r[i], -i))
            out.append((s, best, float(r[best])))
    return pd.DataFrame(out, columns=["signature", "choice", "posterior"])


def resolve_instants(df: DataFrame, text: str, source: str, arrival: str, feeds: DataFrame | None, out: str = "instant", keep: list[str] | None = None) -> DataFrame:
    """df with {out}_us, {out}_format, {out}_posterior and {out}_state.

    feeds: source_name, zone_name, date_order (as TESTDATA.md); a source's declared order is the prior of its all-numeric
    dates, a source without one has the order inferred. Without a zone a spelling that names none is unreadable. State: missing
    (null or blank), unreadable, ambiguous (no instant given), resolved. Repeated rows stay, extra columns too; columns
    of df named as outputs are replaced. An empty df gives an empty result. keep: columns to keep, default all.
    """
    made = [f"{out}_us", f"{out}_format", f"{out}_posterior", f"{out}_state"]
    df = df.drop(*made)
    kept = keep if keep is not None else df.columns
    # the caller's columns travel under numbers, so that their names can't clash with working columns
    df = df.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)], F.col(text).alias("_text"), F.col(source).alias("_source"), F.col(arrival).alias("_arrival"))
    text, source, arrival = "_text", "_source", "_arrival"
    if feeds is None:
        wide = df.withColumns({"_zone": F.lit(None).cast("string"), "_order": F.lit(None).cast("string")})
    else:
        known = feeds.groupBy(F.col("source_name").alias("_feed")).agg(F.min("zone_name").alias("_zone"), F.min("date_order").alias("_order"))
        wide = df.join(small(known), F.col(source) == F.col("_feed"), "left")
    wide = with_readings(wide.withColumn("_order", F.lower("_order")), F.col(text), F.col("_zone"), F.lit(None).cast("string"), "_t")
    arrived = F.col(arrival)
    # the declared order's reading comes first, as of readings that agree only the first counts
    swap = F.when((F.col("_order") == "mdy") & (F.col("_t_f2") == "mdy"), 2).when((F.col("_order") == "ymd") & F.col("_t_us3").isNotNull(), 3)
    turned = {}
    for x in ("us", "f"):
        a, b, c = (F.col(f"_t_{x}{i}") for i in (1, 2, 3))
        turned |= {f"_t_{x}1": F.when(swap == 2, b).when(swap == 3, c).otherwise(a), f"_t_{x}2": F.when(swap == 2, a).otherwise(b), f"_t_{x}3": F.when(swap == 3, a).otherwise(c)}
    wide = staged(wide, turned)
    one, two, three = F.col("_t_us1"), F.col("_t_us2"), F.col("_t_us3")
    tag = lambda i, c: F.when(c.isNotNull(), F.concat(F.col(f"_t_f{i}"), F.lit(":"), _delay_class(c, arrived).cast("string")))
    two_new = F.when(one.isNull() | (two != one), two)
    three_new = F.when((one.isNull() | (three != one)) & (two.isNull() | (three != two)), three)
    wide = staged(wide, {"_t_us2": two_new, "_t_us3": three_new})
    wide = staged(wide, {"_t_sig": F.concat_ws("/", tag(1, one), tag(2, two), tag(3, three))})
    classes = wide.where(F.col("_t_sig") != "").groupBy(F.coalesce(F.col(source), F.lit("")).alias("src"), F.col("_order").alias("declared"), F.col("_t_sig").alias("signature")).agg(F.count("*").alias("n"))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return fit_source(rows.sort_values("signature"), key[1]).assign(src=key[0])[["src", "signature", "choice", "posterior"]]

    choices = classes.groupBy("src", "declared").applyInPandas(fit, "src string, signature string, choice int, posterior double")
    rows = choices.limit(10_001).collect()  # classes, not rows: formats times delay classes a source
    options = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(F.col(f"_t_f{i}").alias("f"), c.alias("us"))) for i, c in ((1, one), (2, two), (3, three))]), lambda x: x.isNotNull())
    if not rows:  # every value had at most one reading, none against a declared order
        wide = wide.withColumns({"_us": F.coalesce(one, two, three), "_fmt": F.when(one.isNotNull(), F.col("_t_f1")).when(two.isNotNull(), F.col("_t_f2")).when(three.isNotNull(), F.col("_t_f3")), "_post": F.lit(1.0)})
    else:
        table = df.sparkSession.createDataFrame(rows, choices.schema) if len(rows) <= 10_000 else choices
        table = F.broadcast(table) if len(rows) <= 10_000 else table
        wide = wide.join(table.withColumnsRenamed({"src": "_src", "signature": "_sig", "choice": "_choice", "posterior": "_posterior"}), (F.coalesce(F.col(source), F.lit("")) == F.col("_src")) & (F.col("_t_sig") == F.col("_sig")), "left")
        picked = F.when(F.coalesce(F.col("_choice"), F.lit(1)) > 0, F.try_element_at(options, F.coalesce(F.col("_choice"), F.lit(1))))
        wide = wide.withColumns({"_us": picked["us"], "_fmt": picked["f"], "_post": F.coalesce(F.col("_posterior"), F.lit(1.0))})
    blank = F.col(text).isNull() | F.col(text).rlike(r"^[\s\p{Z}]*$")
    state = F.when(blank, "missing").when(F.col("_us").isNull(), "unreadable").when(F.col("_post") < MIN_POSTERIOR, "ambiguous").otherwise("resolved")
    wide = wide.withColumn("_state", state)
    return wide.select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)],
        F.when(F.col("_state") == "resolved", F.col("_us")).alias(made[0]),
        F.when(F.col("_us").isNotNull(), F.col("_fmt")).alias(made[1]),
        F.when(F.col("_us").isNotNull(), F.col("_post")).alias(made[2]),
        F.col("_state").alias(made[3]),
    )


def found_instants(df: DataFrame, feeds: DataFrame, leg: str) -> DataFrame:
    """p1_found's rows of one leg: leg, record_uid, instant_us of times that are readable and not yet canonical."""
    got = resolve_instants(df.where(~F.coalesce(F.col("txn_ts").rlike(CANONICAL), F.lit(False))), "txn_ts", "source_name", "received_at", feeds, keep=["record_uid"])
    return got.where(F.col("instant_us").isNotNull()).select(F.lit(leg).alias("leg"), "record_uid", F.col("instant_us"))
