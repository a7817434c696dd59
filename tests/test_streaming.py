from datetime import datetime

from tallyloom.streaming.orphans import EVENT, OrphanStream


def test_ledger_follows_a_stream(spark, tmp_path):
    t = lambda m: datetime(2026, 10, 1, 0, m)
    batches = [
        [("reference", "payments", "p1", "A", t(1)), ("parent", None, None, "B", t(0)), ("reference", "payments", "p2", "B", t(2)), ("reference", "payments", "p3", None, t(2)), (None, None, None, None, None)],
        [("parent", None, None, "A", t(5)), ("reference", "payments", "p4", "Z", t(6))],
        [("deletion", None, None, "B", t(1))],
    ]
    stream = OrphanStream(spark, str(tmp_path / "ledger"))
    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.start(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "progress"))
        query.awaitTermination(120)
        seen.append({(r["child_key"], r["ref_state"]) for r in stream.ledger.orphans().collect()})
        assert stream.last == i
    assert seen == [{("p1", "missing")}, {("p1", "late"), ("p4", "missing")}, {("p1", "late"), ("p2", "deleted"), ("p4", "missing")}]
    before = stream.ledger
    stream.take(spark.createDataFrame([], EVENT), 0)  # a replay
    assert stream.ledger is before


def test_a_new_process_takes_the_ledger_up(spark, tmp_path):
    """The stream's object is lost after each batch, once also before its progress was noted: a batch counts once."""
    t = lambda m: datetime(2026, 10, 1, 0, m)
    batches = [[("parent", None, None, "A", t(1)), ("reference", "payments", "p1", "A", t(2))], [("reference", "payments", "p2", "A", t(9)), ("reference", "payments", "p3", "Z", t(9))], [("deletion", None, None, "A", t(5))]]
    for i, rows in enumerate(batches):
        stream = OrphanStream(spark, str(tmp_path / "ledger"))
        assert stream.last == i - 1
        df = spark.createDataFrame(rows, EVENT)
        stream.take(df, i)
        OrphanStream(spark, str(tmp_path / "ledger")).take(df, i)  # replayed by a new process
    ledger = OrphanStream(spark, str(tmp_path / "ledger")).ledger
    assert {(r["child_key"], r["ref_state"]) for r in ledger.orphans().collect()} == {("p2", "deleted"), ("p3", "missing")}
    assert ledger.good.count() == 1 and ledger.table("snapshots").count() == 3
    kept = OrphanStream(spark, str(tmp_path / "ledger"))
    for i in range(3, 8):
        kept.take(spark.createDataFrame([("parent", None, None, f"B{i}", t(i))], EVENT), i)
    assert kept.ledger.table("index").select("ref").distinct().count() == 6 and len(list((tmp_path / "ledger" / "index").iterdir())) <= 8
