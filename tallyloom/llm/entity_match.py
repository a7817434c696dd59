"""Problem 5: payments that lost their ids, matched to orders by noisy attributes.

Pairs come from blocks of merchant, log-amount and half-days, and where the merchant is missing from blocks of currency or
of digits of the reference in its stead; amounts may be gross or net of a fee, whose usual rates are read from the
payments that name one. Each pair has a vector of similarities (reference, amount, time, currency), of which any may be missing. Regularised Gaussian mixtures, two components for matched and two for unmatched
pairs, are fitted without labels by expectation-maximisation over all pairs. Transitivity enters every expectation step:
an order is paid once and a payment pays once, so the odds of a pair compete with those of all pairs that share its order
or its payment. The posterior is the confidence; mutual bests above one half are matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.instants import resolve_instants
from tallyloom.operators.orphans import order_key
from tallyloom.session import cut, small, staged

FEATURES = ("s_ref", "s_amount", "s_time", "s_currency")
#: Variances are kept at or above these and drawn towards the pairs' own by SHRINK pseudo-pairs.
FLOOR = {"s_ref": 0.02**2, "s_amount": 0.08**2, "s_time": 0.15**2, "s_currency": 0.05**2}
SHRINK = 2.0
#: Pseudo-pairs of each unmatched component whose references have nothing in common, as unrelated numbers don't.
UNRELATED = 20.0
#: Iterations end once no component's weight moves by more than this share of itself, or after MOST_ITERATIONS.
CONVERGED = 0.02
MOST_ITERATIONS = 25
HALF_DAY = 43_200_000_000
#: Width of a block of ln(amount + 3000 minor units); amounts within AMOUNT_OFF of each other lie in the same or adjacent blocks.
AMOUNT_STEP = 0.045
#: How far an amount may be off and still be the same payment: minor units, or this share.
AMOUNT_OFF = (120.0, 0.0015)
#: Hours from an order to its payment that blocking covers.
MOST_HOURS = 36.0
#: A net share (amount less fee over amount, to three places) is usual if this share of the payments that name a fee has it.
USUAL = 0.01


def _amount_block(c: Column) -> Column:
    return F.floor(F.log(F.greatest(c, F.lit(0)) + 3000.0) / AMOUNT_STEP).cast("int")


def merchant_key(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", "")), F.lit(""))


def reference_core(c: Column) -> Column:
    """Digits of the longest digit-like run of a reference, with O and l read as 0 and 1 next to digits and separators within dropped."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?<![A-Za-z])[lI|](?=[O0-9])", "1"), r"(?<=[0-9])[Oo](?=[0-9])", "0")
    joined = F.regexp_replace(plain, r"(?<=[0-9]{3})[ -](?=[0-9]{3})", "")
    return F.nullif(F.regexp_extract(joined, r"([0-9]{5,})", 1), F.lit(""))


def reference_similarity(ref: Column, order: Column) -> Column:
    """1 equal, 0.95 neighbours swapped, 0.9 one digit lost (and others appended), 0.85 the order's last digits, 0.6 one or two
    digits changed, else 0; null where the reference names nothing. Numbers of any length; edits count from five digits on."""
    n = F.length(order)
    same_length = (F.length(ref) == n) & (n >= 5)
    edits = F.levenshtein(ref, order, 2)  # -1 beyond
    same_digits = F.array_sort(F.split(ref, "")) == F.array_sort(F.split(order, ""))
    lost = F.levenshtein(F.substring(ref, F.lit(1), n - 1), order, 1) == 1
    return (
        F.when(ref.isNull() | order.isNull(), None)
        .when(ref == order, 1.0)
        .when(same_length & (edits == 2) & same_digits, 0.95)
        .when((n >= 5) & (F.length(ref) >= n - 1) & lost, 0.9)
        .when((F.length(ref) >= 5) & (F.length(ref) < n) & F.endswith(order, ref), 0.85)
        .when(same_length & (edits >= 0), 0.6)
        .otherwise(0.0)
    )


def net_shares(charged: DataFrame) -> list[float]:
    """The usual shares of an amount that arrive once a fee is kept back, 1 first; charged: amount and fee of payments.

    At most 1/USUAL of them, as each holds that share of the rows.
    """
    share = F.round(1 - F.col("fee") / F.col("amount"), 3)
    sizes = charged.where("amount > 10000 and fee > 0").groupBy(share.alias("share")).agg(F.count("*").alias("n"))
    rows = sizes.where("share between 0.5 and 0.998").orderBy(F.col("n").desc()).limit(int(1 / USUAL)).collect()  # of at most 499 values
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return [1.0, *sorted(r["share"] for r in rows if r["n"] >= USUAL * total)]


def _grams(digits: Column) -> Column:
    """Every run of four digits of a number of at least eight, as keys: one change, swap or loss leaves some. Else none."""
    runs = F.transform(F.sequence(F.lit(1), F.length(digits) - 3), lambda i: F.concat(F.lit("#"), F.substring(digits, i, F.lit(4))))
    return F.when(F.length(digits) >= 8, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def candidate_pairs(payments: DataFrame, orders: DataFrame, shares: list[float]) -> DataFrame:
    """payment_uid, order_uid, FEATURES and chance (the payment came before the order) of all pairs within a block.

    payments: uid, merchant, amount, currency, us, arrived_us, ref. orders: the same with digits for ref. A payment without
    a merchant meets, in its blocks of amount and time, the orders whose number shares four digits in a row with its
    reference, or without a reference of eight digits those of its currency (of any, if that is missing too). Null amounts or times meet nobody.
    """
    code = lambda c: F.upper(F.trim(c))
    no_merchant = F.when(F.size(_grams(F.col("ref"))) > 0, _grams(F.col("ref"))).otherwise(F.array(F.coalesce(F.concat(F.lit("$"), code(F.col("currency"))), F.lit("$"))))
    nets = F.array_distinct(F.flatten(F.array(*[F.array(*[_amount_block(F.col("amount") / r) + k for k in (-1, 0, 1)]) for r in shares])))
    p = payments.where("amount is not null and us is not null").select(
        F.col("uid").alias("payment_uid"), F.col("amount").alias("pa"), F.col("currency").alias("pc"), F.col("us").alias("pt"), F.col("arrived_us").alias("pr"), "ref",
        F.when(F.col("merchant").isNotNull(), F.array(F.concat(F.lit("="), F.col("merchant")))).otherwise(no_merchant).alias("keys"), nets.alias("nets"), F.floor(F.col("us") / HALF_DAY).cast("int").alias("pb"),
    )
    p = p.withColumn("ba", F.explode("nets")).withColumn("bm", F.explode("keys")).select("*", F.explode(F.array(*[F.col("pb") - k for k in range(-2, 4)])).alias("bt")).drop("keys", "nets", "pb")
    bare = payments.where("merchant is null and amount is not null")
    asked = bare.select(F.explode(no_merchant).alias("_key")).distinct()
    o = orders.where("amount is not null and us is not null").select(
        F.col("uid").alias("order_uid"), F.concat(F.lit("="), F.col("merchant")).alias("mk"), F.concat(_grams(F.col("digits")), F.array_compact(F.array(F.lit("$"), F.concat(F.lit("$"), code(F.col("currency")))))).alias("others"),
        F.col("amount").alias("oa"), F.col("currency").alias("oc"), F.col("us").alias("ot"), F.col("arrived_us").alias("orr"), "digits",
        _amount_block(F.col("amount")).alias("oba"), F.floor(F.col("us") / HALF_DAY).cast("int").alias("obt"),
    )
    # keys other than the merchant only where a payment asks for them
    spare = o.withColumn("om", F.explode("others")).join(small(asked), F.col("om") == F.col("_key"), "left_semi")
    o = o.where("mk is not null").withColumn("om", F.col("mk")).unionByName(spare)
    pairs = p.join(o.drop("mk", "others"), (F.col("bm") == F.col("om")) & (F.col("ba") == F.col("oba")) & (F.col("bt") == F.col("obt")))
    apart = [F.abs(F.col("pa") - F.col("oa"))] + [F.abs(F.col("pa") - F.round(F.col("oa") * r)) + 1 for r in shares[1:]]
    hours = lambda a, b: (F.col(a) - F.col(b)) / 3.6e9
    by_text, by_arrival = hours("pt", "ot"), hours("pr", "orr")
    lag = F.when(by_text.between(0, 2), by_text).when(by_arrival.between(0, 2), by_arrival).when(by_text >= 0, by_text).otherwise(F.greatest(by_text, by_arrival))
    pairs = staged(pairs, {"s_lag": lag, "s_off": F.least(*apart) if len(apart) > 1 else apart[0].cast("double")})
    # a reference that names the order keeps a pair however late or far off it is
    like = F.col("s_off") <= F.greatest(F.lit(AMOUNT_OFF[0]), F.col("oa") * AMOUNT_OFF[1])
    named = F.coalesce(F.col("ref") == F.col("digits"), F.lit(False))
    # no payment comes an hour before its order: such pairs are alike by chance only
    pairs = staged(pairs, {"chance": like & ~named & by_text.between(-MOST_HOURS, -1) & by_arrival.between(-MOST_HOURS, -1)})
    pairs = pairs.where((like & F.col("s_lag").between(-0.05, MOST_HOURS)) | named | F.col("chance"))
    return pairs.select(
        "payment_uid", "order_uid",
        reference_similarity(F.col("ref"), F.col("digits")).alias("s_ref"),
        (F.log1p("s_off") / math.log1p(100)).alias("s_amount"),
        F.sqrt(F.when(F.col("chance"), -F.col("s_lag")).otherwise(F.greatest("s_lag", F.lit(0.0)))).alias("s_time"),
        (code(F.col("pc")) == code(F.col("oc"))).cast("double").alias("s_currency"), "chance",
    )


def _log_density(k: int) -> Column:
    total = F.col(f"w{k}")
    for f in FEATURES:
        z, mean, half, norm = F.col(f), F.col(f"m{k}_{f}"), F.col(f"h{k}_{f}"), F.col(f"n{k}_{f}")
        total = total + F.when(z.isNull(), 0.0).otherwise(norm - (z - mean) * (z - mean) * half)
    return total


def _model_table(spark, model: list[dict]) -> DataFrame:
    """The mixture as one row. As literals its numbers would be compiled into new code in every iteration."""
    row = {"_fold": 0}
    for k, c in enumerate(model):
        row[f"w{k}"] = math.log(c["weight"])
        for f in FEATURES:
            row |= {f"m{k}_{f}": float(c["mean"][f]), f"h{k}_{f}": 0.5 / c["var"][f], f"n{k}_{f}": -0.5 * math.log(2 * math.pi * c["var"][f])}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'int' if c == '_fold' else 'double'}" for c in row))


def _scored(pairs: DataFrame, model: list[dict]) -> DataFrame:
    """pairs with each component's responsibility and the posterior g after competition. pairs has a column fold, always 0."""
    table = F.broadcast(_model_table(pairs.sparkSession, model))  # one row
    pairs = pairs.join(table, F.col("fold") == F.col("_fold"))
    pairs = pairs.select("payment_uid", "order_uid", *FEATURES, *[_log_density(k).alias(f"l{k}") for k in range(4)])
    top = F.greatest("l0", "l1", "l2", "l3")
    e = [F.exp(F.col(f"l{k}") - F.col("top")) for k in range(4)]
    pairs = staged(pairs, {"top": top})
    pairs = staged(pairs, {"odds": F.least((e[0] + e[1]) / (e[2] + e[3] + 1e-30), F.lit(1e12)), "m": e[0] / (e[0] + e[1] + 1e-30), "u": e[2] / (e[2] + e[3] + 1e-30)})
    of = lambda c: F.sum("odds").over(Window.partitionBy(c))
    return pairs.withColumn("of_payment", of("payment_uid")).withColumn("of_order", of("order_uid")).withColumn("g", F.col("odds") / (1 + F.col("of_payment") + F.col("of_order") - F.col("odds"))).select("payment_uid", "order_uid", *FEATURES, "odds", "m", "u", "g")


def _moments(weighted: DataFrame, fixed: DataFrame) -> list[dict]:
    """Means and variances of the four components from responsibilities r0..r3, regularised; weights without the fixed rows."""
    weighted = weighted.withColumn("one", F.lit(1.0)).unionByName(fixed.withColumn("one", F.lit(0.0)))
    aggs = [F.sum("one").alias("n")]
    for k in range(4):
        aggs.append(F.sum(F.col(f"r{k}") * F.col("one")).alias(f"w{k}"))
        for f in FEATURES:
            there = F.when(F.col(f).isNotNull(), F.col(f"r{k}"))
            aggs += [F.sum(there).alias(f"n{k}_{f}"), F.sum(there * F.col(f)).alias(f"a{k}_{f}"), F.sum(there * F.col(f) * F.col(f)).alias(f"b{k}_{f}")]
    row = weighted.agg(*aggs).first().asDict()
    n = row["n"] or 1.0
    model = []
    for k in range(4):
        mean, var = {}, {}
        for f in FEATURES:
            total = sum(row[f"n{j}_{f}"] or 0.0 for j in range(4)) or 1.0
            centre = sum(row[f"a{j}_{f}"] or 0.0 for j in range(4)) / total
            spread = max(sum(row[f"b{j}_{f}"] or 0.0 for j in range(4)) / total - centre * centre, FLOOR[f])
            w, a, b = (row[f"{x}{k}_{f}"] or 0.0 for x in "nab")
            if f == "s_ref" and k >= 2:
                w += UNRELATED
            mean[f] = (a + 1e-3 * centre) / (w + 1e-3)
            var[f] = max((b - 2 * mean[f] * a + mean[f] ** 2 * w + SHRINK * min(spread, 4 * FLOOR[f])) / (w + SHRINK), FLOOR[f])
        model.append({"weight": max((row[f"w{k}"] or 0.0) / n, 1e-6), "mean": mean, "var": var})
    return model


def fit(pairs: DataFrame, converged: float = CONVERGED) -> list[dict]:
    """The mixture: components 0 and 1 matched (short and long delay), 2 and 3 unmatched (amounts alike and not); diagonal covariances.

    Pairs of a payment with a later order are known to be alike by chance, without any label: they enter the unmatched
    components' moments in full, so that these can't drift towards matches that look faint. pairs: cut.
    """
    open_, chance = pairs.where("not chance"), pairs.where("chance")
    alike = F.when(F.col("s_amount") < 0.2, 0.95).otherwise(0.05)
    fixed = chance.select(*FEATURES, F.lit(0.0).alias("r0"), F.lit(0.0).alias("r1"), alike.alias("r2"), (1 - alike).alias("r3"))
    # starting responsibilities from the similarities' size alone
    like = F.coalesce(F.col("s_ref") * 2 - 1, F.lit(0.0)) + (0.5 - F.col("s_amount")) + 0.7 * (1.25 - F.col("s_time"))
    start = F.when(like > 0.6, 0.95).otherwise(0.02)
    short = F.when(F.col("s_time") < 1.3, 0.95).otherwise(0.05)
    first = open_.select(*FEATURES, start.alias("g0"), short.alias("m0"), alike.alias("u0"))
    model = _moments(first.select(*FEATURES, (F.col("g0") * F.col("m0")).alias("r0"), (F.col("g0") * (1 - F.col("m0"))).alias("r1"), ((1 - F.col("g0")) * F.col("u0")).alias("r2"), ((1 - F.col("g0")) * (1 - F.col("u0"))).alias("r3")), fixed)
    for _ in range(MOST_ITERATIONS):
        s, last = _scored(open_, model), model
        model = _moments(s.select(*FEATURES, (F.col("g") * F.col("m")).alias("r0"), (F.col("g") * (1 - F.col("m"))).alias("r1"), ((1 - F.col("g")) * F.col("u")).alias("r2"), ((1 - F.col("g")) * (1 - F.col("u"))).alias("r3")), fixed)
        if all(abs(a["weight"] - b["weight"]) <= converged * b["weight"] for a, b in zip(model, last, strict=True)):
            break
    return model


def match(payments: DataFrame, orders: DataFrame, shares: list[float] = (1.0,), least: float = 0.5) -> DataFrame:
    """order_uid, payment_uid, confidence: one-to-one matches whose posterior is at least `least`.

    shares: from net_shares(). After each round of mutual bests the matched ones leave and the rest compete anew, until a
    round adds none.
    Ties go to the least order, then the least payment. Repeated uids count once. Empty sides, or no pair in any block,
    give no rows.
    """
    pairs = cut(candidate_pairs(payments.dropDuplicates(["uid"]), orders.dropDuplicates(["uid"]), list(shares)).distinct().withColumn("fold", F.lit(0)))
    if pairs.isEmpty():
        return pairs.select("order_uid", "payment_uid", F.lit(0.0).alias("confidence")).limit(0)
    left = cut(_scored(pairs.where("not chance"), fit(pairs)).where(F.col("g") >= least / 50).select("order_uid", "payment_uid", "odds"))
    out = None
    while True:
        total = lambda c: F.sum("odds").over(Window.partitionBy(c))
        now = left.withColumn("confidence", F.col("odds") / (1 + total("payment_uid") + total("order_uid") - F.col("odds")))
        rank = lambda a, b: F.row_number().over(Window.partitionBy(a).orderBy(F.col("confidence").desc(), F.col(b)))
        won = cut(now.withColumn("a", rank("payment_uid", "order_uid")).withColumn("b", rank("order_uid", "payment_uid")).where(f"a = 1 and b = 1 and confidence >= {least}").select("order_uid", "payment_uid", "confidence"))
        if won.isEmpty():
            break
        out = won if out is None else out.unionByName(won)
        # rivals of what was matched no longer compete
        left = cut(left.join(won.select("order_uid"), "order_uid", "left_anti").join(won.select("payment_uid"), "payment_uid", "left_anti"))
    return out if out is not None else left.select("order_uid", "payment_uid", F.lit(0.0).alias("confidence")).limit(0)


#: Payments in these states pay for nothing.
FAILED = ("FAILED", "FAILURE", "DECLINED", "CANCELLED", "CANCELED", "VOID")


def lost_payments(payments: DataFrame, feeds: DataFrame) -> DataFrame:
    """Input rows for match(): payments with a blank order_id and no digit in txn_id."""
    lost = payments.where(F.coalesce(F.col("order_id").rlike(r"^[\s\p{Z}]*$"), F.lit(True)) & ~F.coalesce(F.col("txn_id").rlike("[0-9]"), F.lit(False)))
    lost = cut(lost.select("record_uid", "merchant_id", "amount_minor", "currency", "txn_ts", "source_name", "received_at", "reference_id"))
    seen = cut(resolve_instants(lost, "txn_ts", "source_name", "received_at", feeds))
    arrived = F.unix_micros(F.col("received_at").cast("timestamp"))
    return seen.select(F.col("record_uid").alias("uid"), merchant_key(F.col("merchant_id")).alias("merchant"), F.col("amount_minor").alias("amount"), "currency", F.coalesce("instant_us", arrived).alias("us"), arrived.alias("arrived_us"), reference_core(F.col("reference_id")).alias("ref"))


def unpaid_orders(orders: DataFrame, payments: DataFrame, feeds: DataFrame) -> DataFrame:
    """Input rows for match(): orders, as their least record_uid, that no payment pays for by id."""
    paid = payments.where(~F.coalesce("is_refund", F.lit(False)) & ~F.upper(F.coalesce("status", F.lit(""))).isin(*FAILED)).select(order_key(F.col("order_id")).alias("_paid")).where("_paid is not null").distinct()
    keyed = orders.select(order_key(F.col("order_id")).alias("key"), F.struct("record_uid", "merchant_id", "amount_minor", "currency", "txn_ts", "source_name", "received_at").alias("o"))
    free = keyed.where("key is not null").groupBy("key").agg(F.min("o").alias("o")).join(paid, F.col("key") == F.col("_paid"), "left_anti")
    seen = resolve_instants(cut(free.select("key", "o.*")), "txn_ts", "source_name", "received_at", feeds)
    arrived = F.unix_micros(F.col("received_at").cast("timestamp"))
    return seen.select(F.col("record_uid").alias("uid"), merchant_key(F.col("merchant_id")).alias("merchant"), F.col("amount_minor").alias("amount"), "currency", F.coalesce("instant_us", arrived).alias("us"), arrived.alias("arrived_us"), F.nullif(F.regexp_replace("key", "[^0-9]", ""), F.lit("")).alias("digits"))


def match_tables(payments: DataFrame, orders: DataFrame, feeds: DataFrame) -> DataFrame:
    """match() over payments that lost their ids and the orders not paid by id, with the fee rates that payments name."""
    shares = net_shares(payments.select(F.col("amount_minor").alias("amount"), F.col("fee_minor").alias("fee")))
    return match(lost_payments(payments, feeds), unpaid_orders(orders, payments, feeds), shares)
