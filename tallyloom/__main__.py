"""python -m tallyloom demo | benchmark | reconcile | export; see --help of each."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from tallyloom.operators import reports
from tallyloom.plans import jobs
from tallyloom.session import local_session
from tallyloom.sources import datasets
from tallyloom.sources.generate import generate_dataset


def _show(manifest: dict) -> None:
    s, total = manifest["summary"], max(manifest["summary"]["total_cases"], 1)
    print(f"records {sum(manifest['counts'].values()):,} ({', '.join(f'{k} {v:,}' for k, v in manifest['counts'].items())})")
    print(f"cases {s['total_cases']:,}: matched {s['matched']:,} ({s['matched'] / total:.2%}), exceptions {s['exceptions']:,}")
    print(f"normalising {manifest['timings']['normalize_seconds']:.2f} s of {manifest['timings']['total_seconds']:.2f} s; {manifest['throughput_per_second']:,.0f} records a second")


def _generated(spark, size: int, seed: int, folder: str) -> tuple[dict, dict]:
    """Writes a dataset, runs over it and scores the run; manifest and accuracy."""
    datasets.write_dataset(generate_dataset(spark, size, seed), f"{folder}/dataset")
    tables = datasets.load_dataset(spark, f"{folder}/dataset")
    outcome = jobs.run_job(spark, {k: tables[k] for k in jobs.KINDS}, f"{folder}/run")
    cases = spark.read.parquet(f"{folder}/run/recon")
    return outcome.manifest, reports.accuracy(reports.confusion(tables["ground_truth"], reports.gravest(cases))).first().asDict()


def demo(spark, a) -> int:
    folder = f"{a.data}/DEMO_{uuid.uuid4().hex[:10].upper()}"
    manifest, accuracy = _generated(spark, a.size, a.seed, folder)
    _show(manifest)
    print(", ".join(f"{k} {accuracy[k]:.4f}" for k in ("precision", "recall", "f1", "label_accuracy")))
    mix = spark.read.parquet(f"{folder}/run/recon").groupBy("exception_type").count()
    for r in mix.collect():  # a row a type
        print(f"  {r['exception_type']:<24}{r['count']:>10,}")
    print(folder)
    return 0


def benchmark(spark, a) -> int:
    rows = []
    for size in map(int, a.sizes.split(",")):
        manifest, accuracy = _generated(spark, size, a.seed, f"{a.data}/BENCH_{uuid.uuid4().hex[:10].upper()}")
        rows.append({"orders": size, "records": sum(manifest["counts"].values()), "seconds": manifest["timings"]["total_seconds"], "throughput_per_second": manifest["throughput_per_second"], **{k: accuracy[k] for k in ("precision", "recall", "f1", "label_accuracy")}})
        print(json.dumps(rows[-1]))
    if a.json:
        with open(a.json, "w") as f:
            json.dump(rows, f, indent=1)
    return 0


def reconcile(spark, a) -> int:
    folder = f"{a.data}/{a.run or f'RUN_{uuid.uuid4().hex[:10].upper()}'}"
    outcome = jobs.run_job(spark, {"orders": a.orders, "payments": a.payments, "settlements": a.settlements}, folder)
    _show(outcome.manifest)
    print(folder)
    return 0


def export(spark, a) -> int:
    names = datasets.folders(spark, a.data)
    run = (names[0] if names else None) if a.run == "latest" else a.run if a.run in names else None
    if run is None:
        print(f"no run {a.run} under {a.data}", file=sys.stderr)
        return 1
    folder = f"{a.data}/{run}"
    made = datasets.exists(spark, f"{folder}/run")  # demo and benchmark keep a dataset beside the run
    for name in jobs.export_run(spark, f"{folder}/run" if made else folder, f"{a.out}/{run}", f"{folder}/dataset" if a.with_dataset and made else None):
        print(name)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    p.add_argument("--data", default="tallyloom-data", help="folder of runs, on any file system Spark knows")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("demo", help="generate a labelled dataset, reconcile it and score the result")
    d.add_argument("--size", type=int, default=25_000)
    d.add_argument("--seed", type=int, default=42)
    d.set_defaults(call=demo)
    b = sub.add_parser("benchmark", help="the same over several sizes")
    b.add_argument("--sizes", default="1000,10000,100000")
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--json", help="also write the rows to this file")
    b.set_defaults(call=benchmark)
    r = sub.add_parser("reconcile", help="reconcile three files; a run of the same name is resumed")
    for leg in jobs.KINDS:
        r.add_argument(f"--{leg}", required=True)
    r.add_argument("--run")
    r.set_defaults(call=reconcile)
    e = sub.add_parser("export", help="a run's tables as CSV")
    e.add_argument("--run", default="latest")
    e.add_argument("--out", default="exported")
    e.add_argument("--with-dataset", action="store_true")
    e.set_defaults(call=export)
    a = p.parse_args(argv)
    return a.call(local_session("tallyloom"), a)


if __name__ == "__main__":
    sys.exit(main())
