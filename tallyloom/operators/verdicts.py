"""Verdicts on cases from outside as dataflow: their schema, a table of earlier ones by fingerprint, and what a stage did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.reports import fingerprint

VERDICT = "case_id string, classification string, resolution string, confidence double, explanation string, evidence array<string>, suggested_action string"
# What a verdict may hold.
CLASSES = ("MATCHED", "PARTIAL_MATCH", "MISSING_PAYMENT", "MISSING_SETTLEMENT", "AMOUNT_MISMATCH", "PARTIAL_PAYMENT", "OVERPAYMENT", "DUPLICATE", "REFUND", "FEE_VARIANCE", "TIMING_MISMATCH", "CURRENCY_MISMATCH", "MERCHANT_MISMATCH", "ORPHAN_PAYMENT", "ORPHAN_SETTLEMENT", "SETTLEMENT_SHORTFALL", "UNKNOWN")
RESOLUTIONS = ("RESOLVED", "NEEDS_HUMAN")
LONGEST_EXPLANATION, LONGEST_ACTION, MOST_EVIDENCE = 500, 200, 6


def checked(verdicts: DataFrame) -> DataFrame:
    """verdicts with broken: the names of the rules of the schema that a row breaks, empty for a sound one.

    A missing list of evidence or action is sound, all else must be there.
    """
    c = F.col
    rules = {
        "case_id": c("case_id").isNotNull(), "classification": c("classification").isin(*CLASSES), "resolution": c("resolution").isin(*RESOLUTIONS), "confidence": c("confidence").between(0, 1) & ~F.isnan("confidence"),
        "explanation": F.length("explanation") <= LONGEST_EXPLANATION, "evidence": c("evidence").isNull() | (F.size("evidence") <= MOST_EVIDENCE), "suggested_action": c("suggested_action").isNull() | (F.length("suggested_action") <= LONGEST_ACTION),
    }
    return verdicts.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])))


def remembered(slim: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The table of verdicts by the fingerprint of their cases: fingerprint, classification, resolution, confidence, explanation.

    Unknown cases are left out. Of several verdicts on one fingerprint the surest counts, then the greatest text.
    """
    keyed = slim.select(F.col("case_id").alias("_id"), fingerprint().alias("fingerprint"))
    v = verdicts.join(keyed, F.col("case_id") == F.col("_id"))
    best = v.groupBy("fingerprint").agg(F.max(F.struct("confidence", "classification", "resolution", "explanation")).alias("v"))
    return best.select("fingerprint", "v.classification", "v.resolution", "v.confidence", "v.explanation")


def recalled(slim: DataFrame, memory: DataFrame) -> DataFrame:
    """Each slim case with the verdict that its fingerprint had before, and from_cache; cases without one have nulls."""
    m = memory.withColumnRenamed("fingerprint", "_f")
    return slim.withColumn("fingerprint", fingerprint()).join(m, F.col("fingerprint") == F.col("_f"), "left").withColumn("from_cache", F.col("_f").isNotNull()).select("case_id", "fingerprint", "classification", "resolution", "confidence", "explanation", "from_cache")


def stage_stats(cases: DataFrame, verdicts: DataFrame, memory: DataFrame, budget: int, batch: int) -> DataFrame:
    """One row: cases analyzed, cache_hits, skipped_over_budget, calls (batches asked), answered and unanswered, unknown (verdicts on no case), broken.

    cases: slim. The budget goes to cases without an earlier verdict, in the order of case_id.
    """
    seen = recalled(cases, memory)
    ids = verdicts.select(F.col("case_id").alias("_v")).where("_v is not null").distinct()
    x = seen.join(ids, F.col("case_id") == F.col("_v"), "full")
    n = x.agg(F.count("case_id").alias("analyzed"), F.count_if("from_cache").alias("cache_hits"), F.count_if(~F.col("from_cache") & F.col("_v").isNotNull()).alias("answered"), F.count_if(F.col("case_id").isNull()).alias("unknown"))
    bad = checked(verdicts).agg(F.count_if(F.size("broken") > 0).alias("broken"))
    asked = F.least(F.col("analyzed") - F.col("cache_hits"), F.lit(budget))
    n = n.join(F.broadcast(bad))  # one row each
    return n.select("analyzed", "cache_hits", F.greatest(F.col("analyzed") - F.col("cache_hits") - budget, F.lit(0)).cast("bigint").alias("skipped_over_budget"), F.ceil(asked / batch).cast("bigint").alias("calls"), "answered", F.greatest(asked - F.col("answered"), F.lit(0)).cast("bigint").alias("unanswered"), "unknown", "broken")
