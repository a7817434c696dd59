"""A run from source tables to written results, in stages that a later call takes up where an earlier one ended."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallyloom.config import CONFIG, EngineConfig
from tallyloom.operators import reports
from tallyloom.operators.normalize import normalize
from tallyloom.plans.engine_queries import reconcile
from tallyloom.session import at_once, checkpoint_dir
from tallyloom.sources import datasets, export

KINDS = {"orders": "ORDER", "payments": "PAYMENT", "settlements": "SETTLEMENT"}
NORMALIZED, COMPLETED = "NORMALIZED", "COMPLETED"


@dataclass
class Outcome:
    folder: str
    manifest: dict
    resumed: str | None


def run_job(spark: SparkSession, tables: dict[str, DataFrame | str], folder: str, names: dict[str, str] | None = None, mappings: dict[str, dict[str, str]] | None = None, config: EngineConfig = CONFIG, resume: bool = True) -> Outcome:
    """Normalises the three tables (frames, or paths for load_any), reconciles them and writes everything under folder.

    Written are canonical/<leg>, recon, exceptions, links and a manifest. After each stage a checkpoint is written; with
    resume a stage that is done there is not done again. names: what each leg's source is called.
    """
    began = time.time()
    state = datasets.load_checkpoint(spark, folder) if resume else {}
    if state.get("stage") == COMPLETED:
        return Outcome(folder, export.read_manifest(spark, f"{folder}/manifest"), COMPLETED)
    resumed = state.get("stage")
    if resumed != NORMALIZED:

        def write(leg: str, kind: str) -> None:
            source = tables[leg]
            df = export.load_any(spark, source) if isinstance(source, str) else source
            export.write_parquet(normalize(df, kind, (names or {}).get(leg, leg), (mappings or {}).get(leg)), f"{folder}/canonical/{leg}")

        checkpoint_dir(spark)
        at_once(spark, *(partial(write, leg, kind) for leg, kind in KINDS.items()))
        datasets.save_checkpoint(spark, folder, {"stage": NORMALIZED})
    normalized = time.time()
    legs = {leg: spark.read.parquet(f"{folder}/canonical/{leg}") for leg in KINDS}
    run = reconcile(*legs.values(), config)
    export.write_run(run, folder)
    counts = {leg: df.count() for leg, df in legs.items()}
    seconds = time.time() - began
    manifest = export.read_manifest(spark, f"{folder}/manifest") | {
        "counts": counts, "repeats": run.repeats.count(), "summary": reports.run_summary(run.cases).first().asDict(),
        "timings": {"normalize_seconds": round(normalized - began, 3), "total_seconds": round(seconds, 3)}, "throughput_per_second": round(sum(counts.values()) / seconds, 1),
    }
    export.write_manifest(spark, f"{folder}/manifest", manifest)
    datasets.save_checkpoint(spark, folder, {"stage": COMPLETED})
    return Outcome(folder, manifest, resumed)


def export_run(spark: SparkSession, folder: str, out: str, dataset: str | None = None) -> list[str]:
    """Every table of a run, and of the dataset it read if that is named, as flat CSV under out; the names written."""
    written = []
    for name in [*(f"canonical/{leg}" for leg in KINDS), "recon", "exceptions", "links"]:
        if datasets.exists(spark, f"{folder}/{name}"):
            target = name.replace("/", "_")
            export.write_csv(spark.read.parquet(f"{folder}/{name}"), f"{out}/{target}")
            written.append(target)
    if dataset:
        for leg, df in datasets.load_dataset(spark, dataset).items():
            export.write_csv(df, f"{out}/source_dataset/{leg}")
            written.append(f"source_dataset/{leg}")
    if datasets.exists(spark, f"{folder}/manifest"):
        export.write_manifest(spark, f"{out}/manifest", export.read_manifest(spark, f"{folder}/manifest"))
        written.append("manifest")
    return written
