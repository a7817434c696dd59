"""Problem 6: references to records that do not exist, kept as incremental keyed state.

The state is an index of parents (key, first arrival, deletion) and the references by what is known of them: waiting for a
parent, bad (deleted before them, or come after them) and good. An increment brings new references, new parents and
deletions: references probe the index, arriving parents resolve waiting references, deletions reopen those that arrived
after them. Every table is kept as a few Parquet parts in a shared folder: an increment adds a part of its own, and parts
are merged like digits of a counter, so that their number stays logarithmic and each row is rewritten that often only. A
manifest an increment names the parts of the state, so a process that restarts takes it up where the last manifest left it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import cut, shared_folder, small

REFERENCE = "child string, child_key string, ref string, at timestamp_ntz"
PARENT = "ref string, arrived timestamp_ntz, deleted timestamp_ntz"


def order_key(c: Column) -> Column:
    """ASCII letters and digits in upper case; null if there are none."""
    key = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    return F.when(key != "", key)


def named_order(c: Column) -> Column:
    """The order that a free reference names: ORD, further letters, at most one hyphen, blank or underscore, digits."""
    return order_key(F.nullif(F.regexp_extract(c, r"(?i)ORD[A-Z]*[-_ ]?[0-9]+", 0), F.lit("")))


def _state(found: Column) -> Column:
    """ref_state at the reference's arrival, null where the reference is good."""
    return F.when(~found, "missing").when(F.col("deleted") <= F.col("at"), "deleted").when(F.col("arrived") > F.col("at"), "late")


_SCHEMAS = {"index": PARENT, "waiting": REFERENCE, "bad": REFERENCE + ", ref_state string", "good": REFERENCE, "snapshots": "as_of timestamp_ntz, child string, ref_state string, cases bigint"}
_BASE = ("child", "child_key", "ref", "at")


@dataclass(frozen=True)
class OrphanLedger:
    """State after some increments: per table the parts it is made of, as (path, rows), largest first.

    index holds partial rows (several parts may know a ref); a reference stands in one of waiting, bad and good. snapshots
    has the counts after each increment that was given a time.
    """

    spark: SparkSession = field(repr=False)
    folder: str
    parts: dict[str, tuple[tuple[str, int], ...]]
    epoch: int = -1

    @classmethod
    def empty(cls, spark: SparkSession, folder: str | None = None) -> OrphanLedger:
        return cls(spark, folder or shared_folder(spark, "ledger"), dict.fromkeys(_SCHEMAS, ()))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> OrphanLedger:
        """The ledger that the latest manifest in folder describes, an empty one if there is none."""
        try:
            last = spark.read.schema("epoch bigint, parts string").parquet(f"{folder}/manifests").orderBy(F.col("epoch").desc()).limit(1).collect()
        except AnalysisException:
            last = []
        if not last:
            return cls.empty(spark, folder)
        parts = {k: tuple((p, n) for p, n in v) for k, v in json.loads(last[0]["parts"]).items()}
        return cls(spark, folder, parts, last[0]["epoch"])

    def commit(self, epoch: int) -> OrphanLedger:
        """Writes the manifest that makes this the state after epoch."""
        row = [(epoch, json.dumps(self.parts))]
        self.spark.createDataFrame(row, "epoch bigint, parts string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifests")
        return replace(self, epoch=epoch)

    def tidy(self, before: OrphanLedger) -> None:
        """Deletes the parts of an earlier state that this one has no more; frames read from it must not be used after."""
        mine = {p for parts in self.parts.values() for p, _ in parts}
        for path in {p for parts in before.parts.values() for p, _ in parts} - mine:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def table(self, name: str) -> DataFrame:
        paths = [p for p, _ in self.parts[name]]
        reader = self.spark.read.schema(_SCHEMAS[name])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[name])

    waiting = property(lambda self: self.table("waiting"))
    bad = property(lambda self: self.table("bad"))
    good = property(lambda self: self.table("good"))

    def _written(self, name: str, df: DataFrame) -> tuple[tuple[str, int], ...]:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        n = self.spark.read.schema(_SCHEMAS[name]).parquet(path).count()  # from the footers
        return ((path, n),) if n else ()

    def _added(self, name: str, df: DataFrame) -> OrphanLedger:
        """With a part more; parts not more than twice as large as what comes after them are merged with it."""
        parts = [*self.parts[name], *self._written(name, df)]
        keep = len(parts)
        while keep > 1 and parts[keep - 2][1] <= 2 * sum(n for _, n in parts[keep - 1 :]):
            keep -= 1
        if keep < len(parts):
            merged = replace(self, parts=self.parts | {name: tuple(parts[keep - 1 :])}).table(name)
            parts = [*parts[: keep - 1], *self._written(name, _per_ref(merged) if name == "index" else merged)]
        return replace(self, parts=self.parts | {name: tuple(parts)})

    def _set(self, name: str, df: DataFrame) -> OrphanLedger:
        return replace(self, parts=self.parts | {name: self._written(name, df)})

    def known(self, keys: DataFrame) -> DataFrame:
        """What the index knows of keys (one column, ref, distinct)."""
        return _per_ref(self.table("index").join(small(keys), "ref", "left_semi"))

    def advance(self, refs: DataFrame, parents: DataFrame, as_of: datetime | None = None, forget: datetime | None = None) -> OrphanLedger:
        """The ledger after an increment. parents: new rows (deleted null) and deletions (arrived null or repeated).

        as_of: time of a snapshot to take. forget: good references from before it are dropped; give it only if no deletion
        yet to come lies before it.
        """
        fresh = cut(_per_ref(parents.where("ref is not null")))
        now = self._added("index", fresh)
        refs = cut(refs.where("ref is not null").select(*_BASE))
        known = cut(now.known(cut(refs.select("ref").unionByName(fresh.select("ref")).distinct())).withColumnRenamed("ref", "_ref"))
        there = small(known.where("arrived is not null"))
        state = _state(F.col("_ref").isNotNull()).alias("ref_state")
        probed = refs.join(there, F.col("ref") == F.col("_ref"), "left").select(*_BASE, state)
        # waiting references meet the parents that arrived just now, with what the index knows of them
        met = self.waiting.join(there, F.col("ref") == F.col("_ref"), "left").select(*_BASE, state)
        settled = cut(probed.unionByName(met))
        # deletions reopen references that arrived at or after them
        gone = cut(known.join(small(fresh.where("deleted is not null").select("ref")), F.col("_ref") == F.col("ref"), "left_semi").select("_ref", "deleted"))
        hit = lambda df: df.join(small(gone), (F.col("ref") == F.col("_ref")) & (F.col("deleted") <= F.col("at")))
        again = cut(hit(self.good.unionByName(self.bad.where("ref_state = 'late'").drop("ref_state"))).select(*_BASE))
        bad, good = settled.where("ref_state in ('deleted', 'late')"), settled.where("ref_state is null").select(*_BASE)
        if again.isEmpty():
            now = now._added("bad", bad)._added("good", good)
        else:
            rest = lambda df: df.join(small(gone), (F.col("ref") == F.col("_ref")) & (F.col("deleted") <= F.col("at")), "left_anti")
            kept = self.bad.where("ref_state <> 'late'").unionByName(rest(self.bad.where("ref_state = 'late'")))
            now = now._set("bad", kept.unionByName(again.withColumn("ref_state", F.lit("deleted"))).unionByName(bad))._set("good", rest(self.good).unionByName(good))
        if forget is not None:
            now = now._set("good", now.good.where(F.col("at") >= F.lit(forget).cast("timestamp_ntz")))
        now = now._set("waiting", settled.where("ref_state = 'missing'").select(*_BASE))
        if as_of is not None:
            counts = now.orphans().groupBy("child", "ref_state").agg(F.count("*").alias("cases"))
            now = now._added("snapshots", counts.select(F.lit(as_of).cast("timestamp_ntz").alias("as_of"), "child", "ref_state", "cases"))
        return now

    def orphans(self) -> DataFrame:
        """child, child_key, period, ref_state of every reference that is not good."""
        rows = self.waiting.withColumn("ref_state", F.lit("missing")).unionByName(self.bad)
        return rows.select("child", "child_key", F.date_format("at", "yyyy-MM-dd").alias("period"), "ref_state")


def _per_ref(parents: DataFrame) -> DataFrame:
    return parents.groupBy("ref").agg(F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"))


def references(payments: DataFrame, settlements: DataFrame, recon: DataFrame) -> DataFrame:
    """The references of the three child tables to orders, as REFERENCE rows; recon's keys are record ids, marked '#'."""
    at = lambda c: F.col(c).cast("timestamp_ntz").alias("at")
    p = payments.select(F.lit("payments").alias("child"), F.col("record_uid").alias("child_key"), order_key(F.col("order_id")).alias("ref"), at("received_at"))
    s = settlements.select(F.lit("settlements").alias("child"), F.col("record_uid").alias("child_key"), named_order(F.col("reference_id")).alias("ref"), at("received_at"))
    r = recon.select(F.lit("recon").alias("child"), F.col("case_id").alias("child_key"), F.concat(F.lit("#"), F.col("order_uid")).alias("ref"), at("built_at"))
    return p.unionByName(s).unionByName(r).where("ref is not null")


def parents(orders: DataFrame) -> DataFrame:
    """PARENT rows under both keys of an order: its order_id and, marked '#', its record id."""
    times = [F.col("received_at").cast("timestamp_ntz").alias("arrived"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted")]
    a = orders.select(order_key(F.col("order_id")).alias("ref"), *times)
    b = orders.select(F.concat(F.lit("#"), F.col("record_uid")).alias("ref"), *times)
    return a.unionByName(b).where("ref is not null")


def play(payments: DataFrame, settlements: DataFrame, recon: DataFrame, orders: DataFrame, increments: int = 3, snapshots: bool = False) -> OrphanLedger:
    """The ledger after the tables were played in increments of equal time by arrival."""
    spark = payments.sparkSession
    first = F.lit("1970-01-01").cast("timestamp_ntz")
    refs = cut(references(payments, settlements, recon))
    order_rows = parents(orders).withColumn("arrived", F.coalesce("arrived", first))
    came = order_rows.select("ref", "arrived", F.lit(None).cast("timestamp_ntz").alias("deleted"), F.col("arrived").alias("known"))
    # a deletion is known from its time on, but not before its row
    gone = order_rows.where("deleted is not null").select("ref", F.lit(None).cast("timestamp_ntz").alias("arrived"), "deleted", F.greatest("deleted", "arrived").alias("known"))
    events = cut(came.unionByName(gone))
    low, high = refs.agg(F.min("at"), F.max("at")).first()
    ledger = OrphanLedger.empty(spark)
    edges = [None, *[low + (high - low) * k / increments for k in range(1, increments)], None] if low is not None else [None, None]
    lit = lambda e: F.lit(e).cast("timestamp_ntz")
    between = lambda c, a, b: (F.lit(True) if a is None else F.col(c) > lit(a)) & (F.lit(True) if b is None else F.col(c) <= lit(b))
    for a, b in zip(edges, edges[1:], strict=False):
        new_refs = refs.where(between("at", a, b) if a is not None else F.col("at").isNull() | between("at", a, b))
        ledger = ledger.advance(new_refs, events.where(between("known", a, b)).drop("known"), (b or high) if snapshots else None)
    return ledger


def find_orphans(payments: DataFrame, settlements: DataFrame, recon: DataFrame, orders: DataFrame, increments: int = 3) -> DataFrame:
    """child, child_key, period and ref_state of references that are missing, deleted or late.

    Null and blank references are no cases; a reference without a time has a null period and can only be missing; parents
    without a time count as arrived at the start. Repeated rows are repeated cases; empty tables give an empty result.
    """
    return play(payments, settlements, recon, orders, increments).orphans()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Cases per child, period and ref_state."""
    return found.groupBy("child", "period", "ref_state").agg(F.count("*").alias("cases"))
