"""Queries of the reconciliation engine over the legs derived from `orders`."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.config import CONFIG, EngineConfig
from tallyloom.functions.money import minor_units, rupees
from tallyloom.operators import cascade, cases, duplicates, normalize, reports, verdicts
from tallyloom.plans import legs, messy
from tallyloom.session import at_once, checkpoint_dir, cut
from tallyloom.sources.datasets import changed
from tallyloom.sources.export import flattened
from tallyloom.sources.generate import generate_dataset


@dataclass
class Run:
    orders: DataFrame
    payments: DataFrame
    settlements: DataFrame
    repeats: DataFrame
    op_links: DataFrame
    ps_links: DataFrame
    stats: DataFrame
    cases: DataFrame


_RUNS: dict[tuple[str, str, int], Run] = {}


def reconcile(orders: DataFrame, payments: DataFrame, settlements: DataFrame, config: EngineConfig = CONFIG) -> Run:
    """The whole pass over three canonical legs: repeats, both cascades and cases. The cascades don't depend on each other and run side by side."""
    checkpoint_dir(orders.sparkSession)

    def second() -> tuple:
        repeats = cut(duplicates.repeated_payments(payments))
        return repeats, *cascade.run_cascade(payments, settlements, cascade.PAYMENT_SETTLEMENT, exclude_left=repeats, config=config, window_sec=config.settlement_sec)

    (op, op_stats), (repeats, ps, ps_stats) = at_once(orders.sparkSession, lambda: cascade.run_cascade(orders, payments, cascade.ORDER_PAYMENT, config=config), second)
    stats = cascade.stats_frame(orders.sparkSession, op_stats, ps_stats)
    return Run(orders, payments, settlements, repeats, op, ps, stats, cut(cases.build_cases(orders, payments, settlements, op, ps, repeats, config)))


def forget() -> None:
    """Forgets all runs; a session may be measured afresh."""
    _RUNS.clear()


def run_of(spark: SparkSession, d: str) -> Run:
    """The run over d's tables, computed once a session and state of the table, and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, d, changed(spark, f"{d}/orders.parquet"))
    if key not in _RUNS:
        o = spark.read.parquet(f"{d}/orders.parquet")
        checkpoint_dir(spark)
        _RUNS[key] = reconcile(*at_once(spark, *(partial(lambda leg: cut(leg(o)), leg) for leg in (legs.orders_leg, legs.payments_leg, legs.settlements_leg))))
    return _RUNS[key]


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    """o_totalprice as text in four spellings, by k % 4."""
    x = _orders(spark, d).select(F.col("o_orderkey").alias("k"), F.rint(F.col("o_totalprice") * 100).cast("long").alias("amt"))
    kind = F.col("k") % 4
    cents = F.lpad((F.col("amt") % 100).cast("string"), 2, "0")
    whole = F.floor(F.col("amt") / 100)
    plain = F.concat(whole.cast("string"), F.lit("."), cents)
    grouped = F.concat(F.lit("₹"), F.format_number(whole, 0), F.lit("."), cents)
    money = F.when(kind == 0, plain).when(kind == 1, grouped).when(kind == 2, F.concat(F.lit("INR "), plain)).otherwise(F.concat(F.lit("("), plain, F.lit(")")))
    return x.select("k", money.alias("money"))


def money_parse(spark, d):
    return _rendered(spark, d).select("k", minor_units(F.col("money"), numeric=False).alias("amount_minor"))


def timestamp_parse(spark, d):
    """o_orderdate written in every listed format by k % 10, as none and as null."""
    k = F.col("o_orderkey")
    return _orders(spark, d).select(k.alias("k"), normalize.read_time(messy.spelt_time(k, F.col("o_orderdate"))).alias("txn_ts"))


def status_flags(spark, d):
    x = spark.read.parquet(f"{d}/payments.parquet")
    return x.select("record_uid", normalize.is_refund(F.col("status"), F.col("amount_minor")).alias("is_refund"), normalize.is_failed(F.col("status")).alias("is_failed"))


def ref_digits(spark, d):
    return spark.read.parquet(f"{d}/payments.parquet").select("record_uid", normalize.digits(F.col("reference_id")).alias("digits"))


def _rule_query(leg: str, n: int, offset: int = 0):
    def query(spark, d):
        o = _orders(spark, d)
        if leg == "op":
            return cascade.single_pass(legs.orders_leg(o), legs.payments_leg(o), cascade.ORDER_PAYMENT[n], offset)
        return cascade.single_pass(legs.payments_leg(o), legs.settlements_leg(o), cascade.PAYMENT_SETTLEMENT[n], offset, window_sec=CONFIG.settlement_sec)

    return query


def _swept(leg: str, n: int):
    """A swept rule over whole legs, each day offset by itself."""

    def query(spark, d):
        rule = (cascade.ORDER_PAYMENT if leg == "op" else cascade.PAYMENT_SETTLEMENT)[n]
        parts = [_rule_query(leg, n, k)(spark, d).withColumn("day_offset", F.lit(k)) for k in rule.offsets(CONFIG)]
        return reduce(DataFrame.unionByName, parts)

    return query


def links_all(spark, d):
    run = run_of(spark, d)
    return run.op_links.withColumn("leg", F.lit("order_payment")).unionByName(run.ps_links.withColumn("leg", F.lit("payment_settlement")))


def cascade_stats(spark, d):
    return run_of(spark, d).stats


def cascade_rollup(spark, d):
    return run_of(spark, d).stats.groupBy("rule").agg(F.sum("matched").alias("matched")).where("matched > 0")


def ai_candidates(spark, d):
    run = run_of(spark, d)
    return cascade.closest_unlinked(run.orders, run.payments, run.op_links)


def mix_top10(spark, d):
    mix = reports.exceptions(run_of(spark, d).cases).groupBy("exception_type").agg(F.count("*").alias("n"))
    return reports.top(mix, 10, F.col("n").desc(), F.col("exception_type"))


def by_merchant_top8(spark, d):
    x = reports.breakdown(reports.exceptions(run_of(spark, d).cases), ["merchant_id"], reports.impact())
    return reports.top(x, 8, F.col("impact_minor").desc(), F.col("merchant_id"))


def largest_breaks(spark, d):
    x = reports.exceptions(run_of(spark, d).cases).select("case_id", "exception_type", "merchant_id", reports.impact().alias("impact_minor"), "order_amount_minor", "payment_amount_minor", "settlement_amount_minor")
    return reports.top(x, 10, F.col("impact_minor").desc(), F.col("case_id"))


def fingerprint_groups(spark, d):
    x = reports.slim(run_of(spark, d).cases).groupBy(reports.fingerprint().alias("f")).agg(F.count("*").alias("cases"))
    return x.groupBy("cases").agg(F.count("*").alias("groups"))


def merged_decisions(spark, d):
    """Cases with decisions of made-up reviewers: every third order key was decided once, every ninth again later."""
    x = run_of(spark, d).cases.select("case_id", "exception_type")
    n = F.regexp_extract("case_id", r"(\d+)$", 1).cast("long")
    first = x.where(n % 3 == 0).select("case_id", F.lit("ACCEPTED").alias("decision"), F.lit(1).alias("decided_at"))
    later = x.where(n % 9 == 0).select("case_id", F.lit("REOPENED").alias("decision"), F.lit(2).alias("decided_at"))
    return reports.merge_decisions(x, first.unionByName(later), "decision", "NONE")


def severity_dedupe(spark, d):
    return reports.gravest(run_of(spark, d).cases)


def confusion_matrix(spark, d):
    return reports.confusion(legs.truth(_orders(spark, d)), severity_dedupe(spark, d))


def accuracy_metrics(spark, d):
    return reports.accuracy(confusion_matrix(spark, d))


def score_bands(spark, d):
    return run_of(spark, d).cases.groupBy(reports.score_band(F.col("confidence"), 0.6, 0.4).alias("band")).agg(F.count("*").alias("n"))


def _with_status(spark, d):
    """Cases with a made-up status: decided by the reviewers of merged_decisions, else open if an exception."""
    decided = merged_decisions(spark, d).select(F.col("case_id").alias("_id"), "decision")
    return run_of(spark, d).cases.join(decided, F.col("case_id") == F.col("_id")).withColumn("status", F.when(F.col("decision") != "NONE", F.col("decision")).when(F.col("exception_type") != "MATCHED", "OPEN").otherwise("CLOSED")).drop("_id", "decision")


def case_recount(spark, d):
    return reports.recount(_with_status(spark, d), "status", ("ACCEPTED", "REOPENED", "OPEN", "CLOSED"))


def breakdown_by_status(spark, d):
    """Two keys, and both measures of impact."""
    x = _with_status(spark, d)
    a = reports.breakdown(x, ["exception_type", "status"], reports.impact())
    b = reports.breakdown(x, ["exception_type", "status"], reports.net_impact()).select(F.col("exception_type").alias("_t"), F.col("status").alias("_s"), F.col("impact_minor").alias("net_impact_minor"))
    return a.join(b, (F.col("exception_type") == F.col("_t")) & (F.col("status") == F.col("_s"))).drop("_t", "_s")


def run_rates(spark, d):
    """Rates of a run that is said to have taken ten seconds."""
    run = run_of(spark, d)
    n = sum(x.count() for x in (run.orders, run.payments, run.settlements))
    return reports.rates(_with_status(spark, d), n, 10.0, F.col("status") == "OPEN")


def case_lookup(spark, d):
    return reports.one_case(run_of(spark, d).cases, "ORD-0000000007")


def truth_unique(spark, d):
    """The truth written twice, the second time with another label for every fifth order."""
    t = legs.truth(_orders(spark, d))
    again = t.withColumn("expected_label", F.when(F.substring("order_id", -1, 1).isin("0", "5"), "AMOUNT_MISMATCH").otherwise(F.col("expected_label")))
    return reports.unique_truth(t.unionByName(again))


def fired_evidence(spark, d):
    """Score and evidence of the links of orders and payments, derived again from both records."""
    run = run_of(spark, d)
    a, b = (x.select(*[F.col(c).alias(f"{p}_{c}") for c in cascade.NARROW]) for x, p in ((run.orders, "l"), (run.payments, "r")))
    x = run.op_links.select("left_uid", "right_uid").join(a, F.col("left_uid") == F.col("l_record_uid")).join(b, F.col("right_uid") == F.col("r_record_uid"))
    same = lambda c: F.col(f"l_{c}") == F.col(f"r_{c}")
    score, names = cascade.fired({"exact_txn_id": same("txn_id"), "exact_order_id": same("order_id"), "exact_amount": same("amount_minor"), "reference_digits": same("ref_digits") & (F.length("l_ref_digits") > 3), "same_merchant": same("merchant_id"), "within_window": F.abs(cascade.seconds_between()) <= CONFIG.window_sec})
    return x.select("left_uid", "right_uid", score.alias("score"), F.array_join(names, " ").alias("fired"))


def _verdicts(cases):
    """Made-up verdicts: on every second exception, a few of them broken, and one on a case that does not exist."""
    n = F.regexp_extract("case_id", r"(\d+)$", 1).cast("long")
    v = reports.exceptions(cases).where(n % 2 == 0).select(
        "case_id", F.when(n % 14 == 0, "NOTHING").otherwise(F.col("exception_type")).alias("classification"), F.when(n % 4 == 0, "RESOLVED").otherwise("NEEDS_HUMAN").alias("resolution"), F.when(n % 22 == 0, 1.5).otherwise((n % 10) / 10).cast("double").alias("confidence"),
        F.when(n % 26 == 0, F.repeat(F.lit("x"), 501)).otherwise("as shown").alias("explanation"), F.when(n % 34 == 0, F.array_repeat(F.lit("e"), 7)).otherwise(F.array(F.lit("e"))).alias("evidence"), F.lit(None).cast("string").alias("suggested_action"),
    )
    return v.unionByName(cases.sparkSession.createDataFrame([("NO-SUCH-0", "MATCHED", "RESOLVED", 0.5, "x", None, None)], verdicts.VERDICT))


def verdict_checks(spark, d):
    return verdicts.checked(_verdicts(run_of(spark, d).cases)).select("case_id", F.array_join("broken", " ").alias("broken"))


def verdict_memory(spark, d):
    """Every exception with the verdict that a case of its fingerprint got before."""
    cases = run_of(spark, d).cases
    slim = reports.slim(reports.exceptions(cases))
    got = verdicts.recalled(slim, verdicts.remembered(slim, _verdicts(cases)))
    return got.drop("fingerprint", "explanation")


def verdict_stage(spark, d):
    cases = run_of(spark, d).cases
    slim = reports.slim(reports.exceptions(cases))
    v = _verdicts(cases)
    return verdicts.stage_stats(slim, v, verdicts.remembered(slim, v.where(F.col("confidence") >= 0.8)), 500, 12)


def generated_truth(spark, d):
    """The engine against the truth of 4,000 generated orders."""
    t = generate_dataset(spark, 4_000, seed=99)
    run = reconcile(*(cut(normalize.normalize(t[leg], kind, leg)) for leg, kind in (("orders", "ORDER"), ("payments", "PAYMENT"), ("settlements", "SETTLEMENT"))))
    return reports.confusion(t["ground_truth"], reports.gravest(run.cases))


def money_display(spark, d):
    return _orders(spark, d).select(F.col("o_orderkey").alias("k"), rupees(F.rint(F.col("o_totalprice") * 100).cast("long") * (F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1))).alias("display"))


def export_flatten(spark, d):
    x = run_of(spark, d).cases.groupBy("exception_type").agg(F.array_sort(F.collect_set("op_rule")).alias("rules"), F.struct(F.min("case_id").alias("first"), F.max("case_id").alias("last")).alias("span"))
    return flattened(x)


_CASES = {
    "recon_cases": lambda c: c,
    "exceptions": reports.exceptions,
    "run_summary": reports.run_summary,
    "breakdown_engine": lambda c: reports.breakdown(c, ["exception_type"], reports.net_impact()),
    "breakdown_api": lambda c: reports.breakdown(c, ["exception_type"], reports.impact()),
    "by_type": lambda c: reports.breakdown(reports.exceptions(c), ["exception_type"], reports.impact()),
    "exception_page": lambda c: reports.exception_page(c, 40, 20, least_impact=1_000),
    "unexplained": reports.unexplained,
    "slim_cases": reports.slim,
    "case_batches": lambda c: reports.batches(reports.exceptions(c), 500, 12),
}

QUERIES = {
    "canonical_orders": lambda s, d: legs.orders_leg(_orders(s, d)),
    "canonical_payments": lambda s, d: legs.payments_leg(_orders(s, d)),
    "canonical_settlements": lambda s, d: legs.settlements_leg(_orders(s, d)),
    "repeated_payments": lambda s, d: duplicates.repeated_payments(legs.payments_leg(_orders(s, d))),
    "op_links": lambda s, d: run_of(s, d).op_links,
    "ps_links": lambda s, d: run_of(s, d).ps_links,
}
for _n, _name in enumerate(("l1", "l3", "l4", "l2a", "l2b", "l5")):
    QUERIES[f"op_{_name}"] = _rule_query("op", _n) if _name != "l5" else _swept("op", _n)
for _n, _name in enumerate(("l1", "l2", "l3", "l5")):
    QUERIES[f"ps_{_name}"] = _rule_query("ps", _n) if _name != "l5" else _swept("ps", _n)
for _name, _report in _CASES.items():
    QUERIES[_name] = lambda s, d, r=_report: r(run_of(s, d).cases)
QUERIES |= {f.__name__: f for f in (money_parse, timestamp_parse, status_flags, ref_digits, links_all, cascade_stats, cascade_rollup, ai_candidates, mix_top10, by_merchant_top8, largest_breaks, fingerprint_groups, merged_decisions, severity_dedupe, confusion_matrix, accuracy_metrics, score_bands, money_display, export_flatten, case_recount, breakdown_by_status, run_rates, case_lookup, truth_unique, fired_evidence, verdict_checks, verdict_memory, verdict_stage, generated_truth)}
