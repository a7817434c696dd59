"""Datasets, uploads, jobs that resume, the generator's truth and the command line."""

import pytest

from tallyloom import __main__ as cli
from tallyloom.config import EngineConfig
from tallyloom.operators import cascade, reports, verdicts
from tallyloom.plans import jobs
from tallyloom.sources import datasets, export
from tallyloom.sources.generate import AnomalyMix, generate_dataset


@pytest.fixture(scope="module")
def generated(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("data"))
    datasets.write_dataset(generate_dataset(spark, 600, seed=7), f"{folder}/set")
    return folder


def test_generator(spark):
    a, b = (generate_dataset(spark, 3000, seed=1) for _ in range(2))
    assert sorted(map(tuple, a["payments"].collect())) == sorted(map(tuple, b["payments"].repartition(5).collect()))
    labels = {r["expected_label"]: r["count"] for r in a["ground_truth"].groupBy("expected_label").count().collect()}
    assert 0.9 < labels["MATCHED"] / 3000 < 0.95 and labels["ORPHAN_SETTLEMENT"] == 6
    small = {r[0] for r in generate_dataset(spark, 50)["ground_truth"].select("expected_label").distinct().collect()}
    assert {"DUPLICATE", "REFUND", "FEE_VARIANCE", "MERCHANT_MISMATCH", "ORPHAN_PAYMENT", "TIMING_MISMATCH", "MISSING_SETTLEMENT"} <= small
    only = generate_dataset(spark, 400, mix=AnomalyMix(*[0.0] * 9, merchant_mismatch=1.0), coverage=False)["ground_truth"]
    assert only.where("expected_label = 'MERCHANT_MISMATCH'").count() == 400
    assert generate_dataset(spark, 0)["orders"].count() == 0


def test_job_scores_and_resumes(spark, generated, tmp_path):
    tables = datasets.load_dataset(spark, f"{generated}/set")
    first = jobs.run_job(spark, {k: tables[k] for k in jobs.KINDS}, str(tmp_path / "run"))
    cases = spark.read.parquet(str(tmp_path / "run" / "recon"))
    n = cases.count()
    got = reports.accuracy(reports.confusion(tables["ground_truth"], reports.gravest(cases))).first()
    assert got["precision"] >= 0.99 and got["recall"] >= 0.99 and got["label_accuracy"] >= 0.95
    assert first.resumed is None and first.manifest["summary"]["total_cases"] == n and len(first.manifest["cascade"]) == 19
    again = jobs.run_job(spark, {}, str(tmp_path / "run"))
    assert again.resumed == jobs.COMPLETED and again.manifest == first.manifest
    # a job that died after normalising takes the canonical legs up
    datasets.save_checkpoint(spark, str(tmp_path / "run"), {"stage": jobs.NORMALIZED})
    assert jobs.run_job(spark, {}, str(tmp_path / "run")).manifest["summary"] == first.manifest["summary"]
    assert datasets.load_checkpoint(spark, str(tmp_path / "none")) == {}
    names = jobs.export_run(spark, str(tmp_path / "run"), str(tmp_path / "csv"), f"{generated}/set")
    assert {"canonical_orders", "recon", "links", "manifest", "source_dataset/ground_truth"} <= set(names)
    assert export.load_any(spark, str(tmp_path / "csv" / "recon")).count() == n


def test_uploads(spark, tmp_path):
    raw = b'order_id,amount\n"A ""1""",5\n007,6\n'
    (tmp_path / "o.csv").write_bytes(raw)
    got = datasets.upload(spark, {"orders": str(tmp_path / "o.csv")}, str(tmp_path / "up"))
    assert [tuple(r) for r in got["orders"].collect()] == [('A "1"', "5"), ("007", "6")]
    assert (tmp_path / "up" / "uploads" / "orders_o.csv").read_bytes() == raw
    with pytest.raises(ValueError, match="unknown legs"):
        datasets.upload(spark, {"refunds": "x"}, str(tmp_path / "up"))
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, str(tmp_path / "none"))
    assert datasets.register_view(spark, "uploaded", str(tmp_path / "up" / "orders.parquet")).count() == spark.sql("select * from uploaded").count() == 2


def test_settings_reach_the_rules(spark):
    wide = EngineConfig(settlement_days=9, amount_bucket=50)
    assert cascade.PAYMENT_SETTLEMENT[-1].offsets(wide) == tuple(range(10))
    df = spark.createDataFrame([(120,)], "amount_minor bigint")
    assert cascade.ORDER_PAYMENT[-1].left(df, wide).first()["bucket"] == 2


def test_verdict_edges(spark):
    rows = [("a", "MATCHED", "RESOLVED", 0.5, "x", None, None), (None, None, None, None, None, None, None), ("b", "MATCHED", "RESOLVED", float("nan"), "x", ["e"] * 6, "y" * 200), ("b", "MATCHED", "RESOLVED", 1.0, "x" * 501, ["e"] * 7, "y" * 201)]
    got = [r["broken"] for r in verdicts.checked(spark.createDataFrame(rows, verdicts.VERDICT)).collect()]
    assert got == [[], ["case_id", "classification", "resolution", "confidence", "explanation"], ["confidence"], ["explanation", "evidence", "suggested_action"]]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    data = ["--data", str(tmp_path / "d")]
    assert cli.main([*data, "export"]) == 1
    assert cli.main([*data, "demo", "--size", "200"]) == 0
    assert "precision 1.0000" in capsys.readouterr().out
    assert cli.main([*data, "export", "--out", str(tmp_path / "o"), "--with-dataset"]) == 0
    assert "source_dataset/orders" in capsys.readouterr().out
    made = next((tmp_path / "d").glob("DEMO_*")) / "dataset"
    assert cli.main([*data, "reconcile", "--run", "R1", *(x for leg in jobs.KINDS for x in (f"--{leg}", f"{made}/{leg}.parquet"))]) == 0
    assert cli.main([*data, "export", "--run", "R1", "--out", str(tmp_path / "o2")]) == 0
    assert cli.main([*data, "benchmark", "--sizes", "100", "--json", str(tmp_path / "b.json")]) == 0 and (tmp_path / "b.json").exists()
