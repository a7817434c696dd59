"""Aggregates, rankings and scores over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHED = "MATCHED"
# Types from the gravest cause to none.
SEVERITY = ("DUPLICATE", "ORPHAN_PAYMENT", "ORPHAN_SETTLEMENT", "MISSING_PAYMENT", "MERCHANT_MISMATCH", "CURRENCY_MISMATCH", "PARTIAL_PAYMENT", "OVERPAYMENT", "AMOUNT_MISMATCH", "SETTLEMENT_SHORTFALL", "REFUND", "FEE_VARIANCE", "MISSING_SETTLEMENT", "TIMING_MISMATCH", "UNKNOWN", "MATCHED")


def impact() -> Column:
    """|payment delta| + |settlement delta|."""
    return F.coalesce(F.abs("payment_delta_minor"), F.lit(0)) + F.coalesce(F.abs("settlement_delta_minor"), F.lit(0))


def net_impact() -> Column:
    """|payment delta + settlement delta|: opposite signs cancel."""
    return F.abs(F.coalesce("payment_delta_minor", F.lit(0)) + F.coalesce("settlement_delta_minor", F.lit(0)))


def _total(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def exceptions(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("exception_type") != MATCHED)


def run_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("total_cases"), F.count_if(F.col("exception_type") == MATCHED).alias("matched"), F.count_if(F.col("exception_type") != MATCHED).alias("exceptions"),
        _total("order_amount_minor").alias("gross_order_minor"), _total("payment_amount_minor").alias("gross_payment_minor"), _total("settlement_amount_minor").alias("gross_settlement_minor"),
        (_total("payment_amount_minor") - _total("settlement_amount_minor")).alias("settlement_gap_minor"),
    )


def breakdown(cases: DataFrame, by: list[str], measure: Column) -> DataFrame:
    return cases.groupBy(*by).agg(F.count("*").alias("n"), _total(measure).alias("impact_minor"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def recount(cases: DataFrame, status: str, values: tuple[str, ...]) -> DataFrame:
    """run_summary() with a count of cases for each value of a status column, as n_<value>; other and null values are not counted."""
    counts = cases.agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])
    return run_summary(cases).join(F.broadcast(counts))  # one row each


def rates(cases: DataFrame, records: int | Column, seconds: float, open_cases: Column) -> DataFrame:
    """One row: match_rate, coverage (share of cases still open), coverage_of_records and throughput; 0 over nothing."""
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    records, seconds = (x if isinstance(x, Column) else F.lit(x) for x in (records, seconds))
    x = cases.agg(F.count("*").alias("n"), F.count_if(F.col("exception_type") == MATCHED).alias("m"), F.count_if(open_cases).alias("o"))
    return x.select(share(F.col("m"), F.col("n")).alias("match_rate"), share(F.col("o"), F.col("n")).alias("coverage"), share(F.col("o"), records).alias("coverage_of_records"), share(records, seconds).alias("throughput"))


def one_case(cases: DataFrame, case_id: str) -> DataFrame:
    """The case of that id, or no row."""
    return cases.where(F.col("case_id") == case_id)


def unique_truth(truth: DataFrame) -> DataFrame:
    """One row an order_id: of several labels the first by name; nulls are left out."""
    return truth.where("order_id is not null").groupBy("order_id").agg(F.min("expected_label").alias("expected_label"))


def exception_page(cases: DataFrame, offset: int, limit: int, types: list[str] | None = None, merchant: str | None = None, least_impact: int = 0) -> DataFrame:
    """A page of exceptions, dearest first, with the number of all that the filters admit."""
    x = exceptions(cases).withColumn("impact_minor", impact()).where(F.col("impact_minor") >= least_impact)
    if types:
        x = x.where(F.col("exception_type").isin(types))
    if merchant:
        x = x.where(F.col("merchant_id") == merchant)
    total = x.agg(F.count("*").alias("total"))
    page = x.select("case_id", "exception_type", "merchant_id", "impact_minor").orderBy(F.col("impact_minor").desc(), "case_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row beside the page


def unexplained(cases: DataFrame) -> DataFrame:
    """What no fee explains: settled cases net of the expected fee, others in full."""
    return cases.select("case_id", F.when(F.col("settlement_uid").isNotNull(), F.col("settlement_delta_minor") - F.col("expected_fee_minor")).otherwise(F.coalesce("payment_amount_minor", F.lit(0))).alias("unexplained_minor"))


# The fields that decide a case, and below the columns of a slim case.
FINGERPRINT = ("exception_type", "order_amount_minor", "payment_amount_minor", "settlement_amount_minor", "expected_fee_minor", "payment_delta_minor", "settlement_delta_minor", "has_order", "has_payment", "has_settlement", "is_duplicate", "currency")


def slim(cases: DataFrame) -> DataFrame:
    """The columns by which a case is judged."""
    has = lambda c: F.col(c).isNotNull()
    return cases.select(
        "case_id", "exception_type", "currency", "merchant_id", "order_amount_minor", "payment_amount_minor", "settlement_amount_minor", "expected_fee_minor", "payment_delta_minor", "settlement_delta_minor",
        F.col("op_time_delta_sec").alias("order_to_payment_seconds"), F.col("ps_time_delta_sec").alias("payment_to_settlement_seconds"), has("order_uid").alias("has_order"), has("payment_uid").alias("has_payment"), has("settlement_uid").alias("has_settlement"),
        "is_duplicate", F.col("dupe_reason").alias("duplicate_reason"), F.col("confidence").alias("engine_confidence"), F.col("op_rule").alias("match_rule"),
    )


def fingerprint() -> Column:
    """32 hexadecimal digits over a slim case's deciding columns: equal for cases that differ in ids and times only."""
    return F.substring(F.sha2(F.to_json(F.struct(*FINGERPRINT), {"ignoreNullFields": "false"}), 256), 1, 32)


def batches(cases: DataFrame, budget: int, size: int) -> DataFrame:
    """case_id, place, batch, within: cases in the order of case_id, the first `budget` of them dealt into batches of `size`.

    The cases in budget are found by a top-k; places are given to those only, the others have none.
    """
    taken = cases.select("case_id").orderBy("case_id").limit(budget)
    placed = taken.withColumn("place", F.row_number().over(Window.orderBy("case_id")).cast("long"))  # at most `budget` rows
    x = cases.select("case_id").join(placed.withColumnRenamed("case_id", "_id"), F.col("case_id") == F.col("_id"), "left")
    return x.select("case_id", "place", F.expr(f"(place - 1) div {size}").alias("batch"), F.col("place").isNotNull().alias("within"))


def merge_decisions(cases: DataFrame, decisions: DataFrame, into: str, fallback: str | None = None) -> DataFrame:
    """cases with column `into` from decisions (case_id, decision, decided_at): the latest a case counts, then the greatest.

    Decisions of unknown cases are dropped; a case without one keeps its value, or gets the fallback.
    """
    last = decisions.where("case_id is not null and decision is not null").groupBy(F.col("case_id").alias("_id")).agg(F.max(F.struct("decided_at", "decision")).alias("_d"))
    held = F.col(into) if into in cases.columns else F.lit(None).cast("string")
    return cases.join(last, F.col("case_id") == F.col("_id"), "left").withColumn(into, F.coalesce(F.col("_d.decision"), held, F.lit(fallback))).drop("_id", "_d")


def score_band(c: Column, high: float = 0.95, middle: float = 0.80) -> Column:
    return F.when(c >= high, "HIGH").when(c >= middle, "MIDDLE").otherwise("LOW")


def gravest(cases: DataFrame) -> DataFrame:
    """order_id, predicted: the gravest type of each order id; types not listed come after all others."""
    rank = F.coalesce(*[F.when(F.col("exception_type") == t, F.lit(i)) for i, t in enumerate(SEVERITY)], F.lit(len(SEVERITY)))
    return cases.where("order_id is not null").groupBy("order_id").agg(F.min(F.struct(rank.alias("r"), F.col("exception_type").alias("t"))).alias("m")).select("order_id", F.col("m.t").alias("predicted"))


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """expected, predicted, n; truth (order_id, expected_label) counts once an order and without a prediction is MISSING_FROM_OUTPUT."""
    truth = unique_truth(truth)
    p = predicted.select(F.col("order_id").alias("_o"), "predicted")
    return truth.join(p, F.col("order_id") == F.col("_o"), "left").groupBy(F.col("expected_label").alias("expected"), F.coalesce("predicted", F.lit("MISSING_FROM_OUTPUT")).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """True and false positives and negatives (positive: matched), precision, recall, F1 and label accuracy; 0 over nothing is 0."""
    e, p, n = F.col("expected") == MATCHED, F.col("predicted") == MATCHED, F.col("n")
    count = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    x = matrix.agg(count(e & p).alias("tp"), count(~e & p).alias("fp"), count(e & ~p).alias("fn"), count(~e & ~p).alias("tn"), count(F.col("expected") == F.col("predicted")).alias("label_correct"), _total("n").alias("total"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    x = x.withColumns({"_p": F.col("tp") + F.col("fp"), "_r": F.col("tp") + F.col("fn")}).withColumns({"precision": ratio("tp", "_p"), "recall": ratio("tp", "_r"), "label_accuracy": ratio("label_correct", "total")})
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).drop("_p", "_r")
