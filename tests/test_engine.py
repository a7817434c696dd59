"""The engine against its SQL on sf0.001, and scenarios on hand-built rows."""

import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tallyloom.functions.money import minor_units, rupees, with_display  # noqa: E402
from tallyloom.operators import cascade, cases, duplicates, normalize, reports  # noqa: E402
from tallyloom.plans import data_queries, engine_queries, legs, messy, oracle  # noqa: E402
from tallyloom.sources import export  # noqa: E402

T0 = datetime(2026, 8, 1, 10)


@pytest.mark.parametrize("name", [*oracle.ORACLES, *messy.ORACLES, *data_queries.ORACLES])
def test_oracle(spark, sf, name):
    con = compare.connect(sf)
    assert compare.compare(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["total_cases"] > 0 and row["matched"] + row["exceptions"] == row["total_cases"]


LEG = "record_uid string, txn_id string, order_id string, ref_digits string, merchant_id string, amount_minor bigint, fee_minor bigint, currency string, txn_ts timestamp_ntz, day_bucket date, status string, is_refund boolean"


def leg(spark, *rows):
    """rows: uid, txn, order, digits, merchant, amount, fee, currency, hours after T0 (None: no time), refund"""
    out = []
    for uid, txn, order, ref, m, amount, fee, cur, h, refund in rows:
        t = None if h is None else T0 + timedelta(hours=h)
        out.append((uid, txn, order, ref, m, amount, fee, cur, t, t and date(t.year, t.month, t.day), "OK", refund))
    return spark.createDataFrame(out, LEG)


def o(uid="O", txn="T1", order="ORD100000", ref="100000", m="M1", amount=100_000, fee=0, cur="INR", h=0, refund=False):
    return (uid, txn, order, ref, m, amount, fee, cur, h, refund)


def p(uid="P", h=0.1, fee=2_000, **k):
    return o(uid=uid, h=h, fee=fee, **k)


def s(uid="S", h=48, fee=2_000, amount=98_000, **k):
    return o(uid=uid, h=h, fee=fee, amount=amount, **k)


SCENARIOS = {
    "clean": ([o()], [p()], [s()], ["MATCHED"]),
    "within a rupee": ([o()], [p(amount=99_950)], [s(amount=97_950)], ["MATCHED"]),
    "partial": ([o(amount=500_000)], [p(amount=300_000)], [s(amount=294_000, fee=6_000)], ["PARTIAL_PAYMENT"]),
    "over": ([o()], [p(amount=150_000)], [s(amount=147_000, fee=3_000)], ["OVERPAYMENT"]),
    "short": ([o(amount=500_000)], [p(amount=500_000, fee=10_000)], [s(amount=460_000, fee=10_000)], ["SETTLEMENT_SHORTFALL"]),
    "more settled": ([o()], [p()], [s(amount=120_000)], ["AMOUNT_MISMATCH"]),
    "fee": ([o(amount=500_000)], [p(amount=500_000, fee=30_000)], [s(amount=470_000, fee=30_000)], ["FEE_VARIANCE"]),
    "order only": ([o()], [], [], ["MISSING_PAYMENT"]),
    "no settlement": ([o()], [p()], [], ["MISSING_SETTLEMENT"]),
    "settlement only": ([], [], [s()], ["ORPHAN_SETTLEMENT"]),
    "merchant": ([o()], [p(m="M2")], [s(m="M2")], ["MERCHANT_MISMATCH"]),
    "currency": ([o()], [p(cur="USD")], [s(cur="USD")], ["CURRENCY_MISMATCH"]),
    "refund": ([o()], [p(refund=True)], [s()], ["REFUND"]),
    "late": ([o()], [p(h=120)], [s(h=130)], ["TIMING_MISMATCH"]),
    "twice": ([o()], [p(), p(uid="P2", h=0.125)], [s()], ["DUPLICATE", "MATCHED"]),
    "all ids differ": ([o()], [p(txn="T2", order="ORD999999", ref="999999")], [], ["MISSING_PAYMENT", "ORPHAN_PAYMENT"]),
    "no times": ([o(txn=None, h=None)], [p(txn=None, h=None, amount=90_000)], [], ["PARTIAL_PAYMENT"]),
    "inside a reference": ([o(txn=None)], [p(txn=None, order=None, ref="0000")], [], ["MISSING_SETTLEMENT"]),
    "nothing but nulls": ([o(txn=None, order=None, ref=None, m=None, amount=None, cur=None, h=None)], [p(txn=None, order=None, ref=None, m=None, amount=None, cur=None, h=None, refund=None)], [], ["MISSING_PAYMENT", "ORPHAN_PAYMENT"]),
    "empty": ([], [], [], []),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, name):
    a, b, c, want = SCENARIOS[name]
    run = engine_queries.reconcile(leg(spark, *a), leg(spark, *b), leg(spark, *c))
    assert sorted(r["exception_type"] for r in run.cases.collect()) == sorted(want)


def test_links_are_one_to_one_and_independent_of_order(spark, sf):
    run = engine_queries.run_of(spark, sf)
    assert run.op_links.count() == run.op_links.select("left_uid").distinct().count() == run.op_links.select("right_uid").distinct().count()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again, _ = cascade.run_cascade(run.orders.orderBy(F.rand(3)), run.payments.orderBy(F.rand(4)), cascade.ORDER_PAYMENT)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, run.op_links.collect()))
    assert run.cases.groupBy("case_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("rules", [cascade.ORDER_PAYMENT[-1:], cascade.PAYMENT_SETTLEMENT[-1:]])
def test_sweeps_agree(spark, monkeypatch, rules):
    """One task over all offsets, a job an offset, and pass after pass over the records give the same links and counts."""
    import random

    r = random.Random(5)
    side = lambda p, low, high: [o(f"{p}{i:03}", txn=None, order=None, ref="", m=r.choice(["M1", "M1", "M2", None]), amount=r.choice([100_000, 100_020, 98_000, 97_990]), h=r.choice([None, *range(low, high, 7)])) for i in range(60)]
    a, b = leg(spark, *side("A", 0, 90)), leg(spark, *side("B", 0, 200))
    def play():
        links, stats = cascade.run_cascade(a, b, rules, window_sec=7 * 86_400)
        return sorted(map(tuple, links.collect())), stats
    one = play()
    monkeypatch.setattr(cascade, "SWEEP_PAIRS", 0)
    assert play() == one and len(one[0]) > 10
    x, y, slow, counts = a, b, [], []
    for k in rules[0].offsets(cascade.CONFIG):
        won = cascade.single_pass(x, y, rules[0], k, window_sec=7 * 86_400).checkpoint()
        slow += map(tuple, won.collect())
        counts.append(won.count())
        x, y = x.join(won, F.col("record_uid") == F.col("left_uid"), "left_anti"), y.join(won, F.col("record_uid") == F.col("right_uid"), "left_anti")
    assert sorted(slow) == one[0] and [s[3] for s in one[1]] == counts


def test_ties_go_to_the_least_uid(spark):
    links, _ = cascade.run_cascade(leg(spark, o("O1"), o("O2"), o("O3")), leg(spark, p("P1"), p("P2"), p("P3")), cascade.ORDER_PAYMENT[:1])
    assert [tuple(r)[:2] for r in links.collect()] == [("O1", "P1")]


def test_substring_join_equals_contains(spark):
    ids = ["ORD1002-345", "A12B12", "12345", "1234567890123456789012345678901234567890", "ORD", "", None, "٣٤٥٦٧٨", "x9999999999"]
    refs = ["2", "12", "345", "1002", "3456789012345678901234567890", "", None, "99999", "100", "٤٥"]
    left = leg(spark, *[o(f"O{i}", txn=None, order=x, h=None) for i, x in enumerate(ids)])
    right = leg(spark, *[p(f"P{i}", txn=None, order=None, ref=x, h=None) for i, x in enumerate(refs)])
    rule = next(r for r in cascade.ORDER_PAYMENT if r.name == "order_id_inside_reference")
    got = {(r["left_uid"], r["right_uid"]) for r in cascade.candidates(left, right, rule, 0, cascade.CONFIG, 1).collect()}
    assert got == {(f"O{i}", f"P{j}") for i, x in enumerate(ids) for j, y in enumerate(refs) if x and y and len(x) >= 5 and y in x}


def test_occurrences(spark):
    rows = [("a", "K", T0), ("b", "K", T0), ("c", "K", T0 + timedelta(days=3)), ("d", "K", None), ("e", None, T0), ("f", "K", T0 - timedelta(days=1))]
    df = spark.createDataFrame(rows, "record_uid string, k string, t timestamp_ntz")
    got = {r["record_uid"]: r["occurrence"] for r in duplicates.occurrence(df, ["k"], "t", "record_uid").collect()}
    assert got == {"f": 1, "a": 2, "b": 3, "c": 4, "d": 5, "e": 1}


def test_money(spark):
    texts = [("₹1,250.00", 125_000), ("(500.50)", -50_050), ("99.999", 10_000), ("-(5)", 0), ("1e5", 1_500), ("", 0), (None, 0), ("garbage", 0), ("(5)3", 0), ("9" * 500, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    for r in df.where(F.length("t").isNull() | (F.length("t") < 100)).select("i", minor_units(F.col("t"), False).alias("m")).collect():
        assert r["m"] == texts[r["i"]][1], texts[r["i"]]
    big = spark.createDataFrame([(12345678.90,), (None,)], "x double")
    assert [r[0] for r in big.select(minor_units(F.col("x"), True)).collect()] == [1_234_567_890, 0]
    shown = spark.createDataFrame([(123_456_789,), (-5,), (None,), (100_000_000_000,)], "a_minor bigint")
    assert [r[0] for r in shown.select(rupees(F.col("a_minor"))).collect()] == ["Rs 12,34,567.89 (12.35 lakh)", "Rs -0.05", "-", "Rs 1,00,00,00,000.00 (100.00 crore)"]
    assert with_display(shown).columns == ["a_minor", "a_display"]
    deep = spark.sql("select named_struct('x_minor', 5L, 'y', array(named_struct('z_minor', 100L), null)) as s, map('k', named_struct('v_minor', 7)) as m, 'old' as q_display, 1L as q_minor, cast(null as struct<n_minor:bigint>) as n")
    row = with_display(deep).first()
    assert row["s"]["x_display"] == "Rs 0.05" and row["s"]["y"][0]["z_display"] == "Rs 1.00" and row["s"]["y"][1] is None and row["m"]["k"]["v_display"] == "Rs 0.07" and row["q_display"] == "Rs 0.01" and row["n"] is None


def test_normalize(spark, tmp_path):
    rows = [("T1", "PAY-ORD-98231-XYZ", "₹1,250.00", "01/08/2026", "CAPTURED", "a"), ("T2", " x ", "-100", "2026-08-01 10:30:00", "ok", "b"), ("T3", None, "1", "soon", "FAILED", "c"), ("T4", "", None, None, "Refunded", "d"), ("T4", "", None, None, "Refunded", "d")]
    df = spark.createDataFrame(rows, ["Transaction ID", "Narration", "Amount", "Txn Date", "Status", "raw"])
    assert normalize.detect_mapping(df.columns)["reference_id"] == "Narration"
    out = {r["txn_id"]: r for r in normalize.normalize(df, "PAYMENT", "gw").collect()}
    assert set(out) == {"T1", "T2", "T4"}
    assert out["T1"]["ref_digits"] == "98231" and out["T1"]["amount_minor"] == 125_000 and out["T1"]["txn_ts"] == datetime(2026, 8, 1)
    assert out["T2"]["is_refund"] and out["T2"]["amount_minor"] == 10_000 and out["T2"]["reference_id"] == "x"
    assert out["T4"]["is_refund"] and out["T4"]["currency"] == "INR" and out["T4"]["merchant_id"] == "UNKNOWN" and out["T4"]["amount_minor"] == 0
    uids = sorted(r["record_uid"] for r in normalize.normalize(df, "PAYMENT", "gw", order_by=["Transaction ID"]).collect())
    assert uids == [f"PAY-{i:010}" for i in range(4)]
    assert normalize.normalize(df.limit(0), "ORDER", "x").count() == 0
    assert normalize.normalize(df.select(), "ORDER", "x").count() == 0
    df.drop("raw").toPandas().to_csv(tmp_path / "a.csv", index=False)
    assert export.load_any(spark, str(tmp_path / "a.csv")).count() == len(rows)


def test_listed_times(spark):
    texts = {"08/25/2026 10:00:00": datetime(2026, 8, 25, 10), "25/08/2026 10:00:00": datetime(2026, 8, 25, 10), "03/04/2026": datetime(2026, 4, 3), "08/25/2026": datetime(2026, 8, 25), "25-08-2026": datetime(2026, 8, 25), "2026/08/25": datetime(2026, 8, 25), "2026-08-25T10:00:00": datetime(2026, 8, 25, 10), " 2026-08-25 ": datetime(2026, 8, 25), "soon": None, "": None, "x" * 100_000: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", normalize.read_time(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values()) and got[len(texts)] is None


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet"])
def test_numbers_follow_files(spark, tmp_path, kind):
    """Rows are numbered in the order of files and of rows within them, without failed ones, whatever the size of splits."""
    path = f"{tmp_path}/a.{kind}"
    df = spark.range(5000).orderBy("id").select(F.concat(F.lit("T"), "id").alias("txn_id"), F.when(F.col("id") % 10 == 3, "failed").otherwise("ok").alias("status"))
    df = df.repartitionByRange(3, F.col("txn_id")).sortWithinPartitions(F.substring("txn_id", 2, 9).cast("int"))
    (df.write.option("header", True).csv if kind == "csv" else df.write.json if kind == "jsonl" else df.write.parquet)(path)
    rows = [r for f in sorted(Path(path).glob("part-*")) for r in export.load_any(spark, f"{f}").collect()] if kind == "parquet" else None
    seen = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        out = normalize.normalize(export.load_any(spark, path), "ORDER", "x")
        assert "Exchange rangepartitioning" not in out._jdf.queryExecution().toString()
        seen.append(sorted((r["record_uid"], r["txn_id"]) for r in out.collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert seen[0] == seen[1] and [u for u, _ in seen[0]] == [f"ORD-{i:010}" for i in range(4500)]
    if rows:
        assert [t for _, t in seen[0]] == [r["txn_id"] for r in rows if r["status"] == "ok"]


def test_sinks(spark, sf, tmp_path):
    run = engine_queries.run_of(spark, sf)
    export.write_run(run, str(tmp_path))
    assert export.read_exceptions(spark, str(tmp_path)).count() == reports.exceptions(run.cases).count()
    assert len(export.read_manifest(spark, str(tmp_path / "manifest"))["cascade"]) == 19
    df = spark.createDataFrame([(["a", None, "b"], (1, "x"))], "l array<string>, s struct<n:int,t:string>")
    assert tuple(export.flattened(df).first()) == ("a | b", '{"n":1,"t":"x"}')
    export.write_csv(df, str(tmp_path / "c"))
    assert export.load_any(spark, str(tmp_path / "c")).count() == 1


def test_accuracy(spark, sf):
    perfect = spark.createDataFrame([("o1", "MATCHED"), ("o2", "REFUND")], "order_id string, expected_label string")
    got = reports.accuracy(reports.confusion(perfect, perfect.withColumnRenamed("expected_label", "predicted"))).first()
    assert (got["precision"], got["recall"], got["f1"], got["label_accuracy"]) == (1.0, 1.0, 1.0, 1.0)
    nothing = reports.accuracy(reports.confusion(perfect.limit(0), perfect.limit(0).withColumnRenamed("expected_label", "predicted"))).first()
    assert nothing["f1"] == 0.0 and nothing["total"] == 0
    full = engine_queries.accuracy_metrics(spark, sf).first()
    assert full["precision"] >= 0.99 and full["label_accuracy"] >= 0.95


def test_truth_covers_every_type(spark, sf):
    types = {r[0] for r in legs.truth(spark.read.parquet(f"{sf}/orders.parquet")).select("expected_label").distinct().collect()}
    assert len(types) == 15


def test_case_type_needs_no_rows(spark):
    e = leg(spark)
    assert cases.build_cases(e, e, e, spark.createDataFrame([], cascade.LINKS), spark.createDataFrame([], cascade.LINKS), duplicates.repeated_payments(e)).count() == 0


def test_generated_orders(spark):
    from tallyloom.sources.generate import generate_orders

    a, b = (sorted(map(tuple, generate_orders(spark, 4000, seed=99).repartition(k).collect())) for k in (1, 7))
    assert a == b and a != sorted(map(tuple, generate_orders(spark, 4000, seed=8).collect()))
    orders = generate_orders(spark, 4000, seed=99)
    run = engine_queries.reconcile(legs.orders_leg(orders), legs.payments_leg(orders), legs.settlements_leg(orders))
    got = reports.accuracy(reports.confusion(legs.truth(orders), reports.gravest(run.cases))).first()
    assert got["precision"] >= 0.99 and got["recall"] >= 0.98 and got["label_accuracy"] >= 0.95
