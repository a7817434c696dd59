"""The orphan ledger (operators.orphans) fed by a stream of references, parents and deletions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.orphans import OrphanLedger

#: kind: reference, parent or deletion; child and child_key only of references.
EVENT = "kind string, child string, child_key string, ref string, at timestamp_ntz"


class OrphanStream:
    """Advances a ledger by every micro-batch. Ledger and epoch are written together to a shared folder and taken up from
    there by a new process; a batch that is replayed after a failure is skipped."""

    def __init__(self, spark: SparkSession, folder: str):
        self.ledger = OrphanLedger.load(spark, folder)
        self._before = self.ledger

    @property
    def last(self) -> int:
        return self.ledger.epoch

    def take(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.last:
            return
        none = F.lit(None).cast("timestamp_ntz")
        refs = batch.where("kind = 'reference'").select("child", "child_key", "ref", "at")
        parents = batch.where("kind in ('parent', 'deletion')").select("ref", F.when(F.col("kind") == "parent", F.col("at")).otherwise(none).alias("arrived"), F.when(F.col("kind") == "deletion", F.col("at")).otherwise(none).alias("deleted"))
        as_of = batch.agg(F.max("at")).first()[0]
        older, self._before = self._before, self.ledger
        self.ledger = self.ledger.advance(refs, parents, as_of).commit(epoch)
        both = {k: (*self.ledger.parts[k], *self._before.parts[k]) for k in self.ledger.parts}
        replace(self.ledger, parts=both).tidy(older)  # what neither this state nor the one before it holds

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """events: a streaming frame of EVENT; checkpoint: a shared folder for the stream's own progress."""
        return events.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
