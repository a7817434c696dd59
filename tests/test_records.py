"""Redelivery, malformed lines and orphans on small fixtures, with nulls, ties, repeats, long texts and empty tables."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import malformed, orphans, redelivery

T0 = datetime(2026, 10, 1)
PAY = "record_uid string, txn_id string, received_at timestamp_ntz, payload string, k string, bucket int, bitmap string"


def at(n):
    return T0 + timedelta(seconds=n)


@pytest.fixture
def messages(spark, tmp_path):
    rows = [
        ("a", "T1", at(5), "x", "k", 1, "f"), ("b", " t1 ", at(3), "x", "k", 1, "f"), ("c", "T1", at(3), "x", "k", 1, "f"),  # b stays
        ("d", "T2", None, "x", "k", 1, "f"), ("e", "T2", at(9), "x", "k", 1, "f"),  # null times come last
        ("f", "NA", at(1), "x", "k", 1, "f"), ("g", "NA", at(1), "x", "k", 1, "f"), ("h", None, at(1), "x", "k", 1, "f"), ("i", " ", at(1), "x", "k", 1, "f"),
        ("j", "T3", at(1), "y" * 200_000, "k", 1, "f"), ("j", "T3", at(1), "y" * 200_000, "k", 1, "f"),  # exact repeats keep one
        (None, "T4", at(1), "x", "k", 1, "f"), ("l", "T4", at(1), "x", "k", 1, "f"),  # null uids come last
    ]
    rows += [(f"hot{i:05}", "T9", at(i), "z", "k", 1, "f") for i in range(3000)]
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame(rows, PAY).repartition(3).write.parquet(path)
    return path, rows


def test_one_copy_of_each_message(spark, messages):
    path, rows = messages
    kept = redelivery.redelivered(spark, path)
    dropped = redelivery.redelivered(spark, path, ["record_uid"], dropped=True)
    assert kept.columns == PAY.replace(",", "").split()[::2]
    names = sorted(str(r[0]) for r in kept.collect())
    assert names == sorted(["b", "e", "f", "g", "h", "i", "j", "l", "hot00000"])
    assert kept.count() + dropped.count() == len(rows)


def test_vectors_in_groups(spark, messages, monkeypatch):
    path, rows = messages
    want = sorted(str(r[0]) for r in redelivery.redelivered(spark, path).collect())
    monkeypatch.setattr(redelivery, "BITMAPS_A_READ", 1)
    assert sorted(str(r[0]) for r in redelivery.redelivered(spark, path).collect()) == want
    assert redelivery.redelivered(spark, path, ["record_uid"], dropped=True).count() == len(rows) - len(want)


def test_no_messages(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame([], PAY).write.parquet(path)
    assert redelivery.redelivered(spark, path).count() == 0
    assert redelivery.redelivered(spark, path, dropped=True).count() == 0


def test_flag_audit(spark):
    f = spark.createDataFrame([("a", "Exact"), ("a", "EXACT"), ("b", None), (None, "x"), ("z", "exact")], "record_uid string, dupe_reason string")
    d = spark.createDataFrame([("a",), ("a",)], "record_uid string")
    got = {tuple(r) for r in redelivery.flag_audit(f.limit(0), f, d).collect()}
    assert got == {("EXACT", 2, 1, 1), ("(NONE)", 1, 0, 1)}


FEEDS = [("c", "UTC", "dmy", ",", "delimited"), ("p", "UTC", "dmy", "|", "delimited"), ("j", "UTC", "dmy", None, "json")]
OK = ["T1", "O1", "M1", "1,637.03", "1.00", "INR", "01/10/2026", "CAPTURED", "hi"]


def line(d, *, quote=(), **changes):
    cells = list(OK)
    for k, v in changes.items():
        cells[int(k[1:])] = v
    return d.join(f'"{c}"' if i in quote or d in c else c for i, c in enumerate(cells))


def doc(**changes):
    return json.dumps(dict(zip(malformed.FIELDS, OK, strict=True)) | changes, ensure_ascii=False)


LINES = [
    ("c", line(","), None), ("p", line("|"), None), ("c", line(",", quote=range(9)), None), ("j", doc(), None),
    ("c", line(",", c8='say ""x""', quote=(8,)), None), ("c", line(",", c8="two\nlines, one", quote=(8,)), None),
    ("c", line(",", c8="x" * 300_000), None), ("c", line(",", c8='""' * 5_000, quote=(8,)), None), ("j", doc(narration='"\\' * 5_000), None),
    ("c", line(",", c8='"open'), "quoting"), ("c", line(",", c0='"a"b'), "quoting"), ("c", line(",", c0='a"b'), "quoting"), ("c", line(",", c8='"' + "x" * 300_000), "quoting"),
    ("c", line(",").rsplit(",", 1)[0], "columns"), ("p", "|".join([*OK, "x"]), "columns"), ("c", "", "columns"), ("c", line(",") + ',"open', "quoting"),
    ("c", line(",", c3="1-00"), "amount"), ("p", line("|", c3="--1"), "amount"), ("p", line("|", c3="(₹1,00,637.03)"), None), ("p", line("|", c3="A$5"), None), ("p", line("|", c3="(1"), "amount"), ("p", line("|", c3=""), "amount"), ("p", line("|", c3="NaN"), "amount"),
    ("p", line("|", c5="RUPEE"), "currency"), ("p", line("|", c5=""), None), ("p", line("|", c3="x", c5="RUPEE"), "amount"),
    ("p", line("|", c6="31/02/2026"), "timestamp"), ("p", line("|", c6=""), None), ("p", line("|", c6="pending"), "timestamp"),
    ("j", doc() + "x", "json"), ("j", doc()[:-1], "json"), ("j", "[]", "json"), ("j", "null", "json"), ("j", "", "json"), ("j", doc().replace('"status"', "status"), "json"), ("j", doc() + doc(), "json"),
    ("j", doc(note="x"), "columns"), ("j", json.dumps(dict(zip(malformed.FIELDS[:8], OK, strict=False))), "columns"), ("j", doc(amount=None), "amount"), ("j", doc(amount=12.5), "amount"), ("j", doc(amount=12), None), ("j", doc(currency=None), None), ("j", doc(payment_date="never"), "timestamp"),
    ("?", line(","), "source"), (None, line(","), "source"), ("c", None, None),
]


def test_reasons(spark):
    feeds = spark.createDataFrame(FEEDS, "source_name string, zone_name string, date_order string, delimiter string, raw_format string")
    rows = [(i, s, r) for i, (s, r, _) in enumerate(LINES)] * 2
    df = spark.createDataFrame(rows, "i int, source_name string, raw string").withColumn("_line", F.lit(0)).withColumn("parse_reason", F.lit("clash"))
    got = malformed.parse_lines(df, feeds).collect()
    assert len(got) == len(rows)
    for r in got:
        s, raw, want = LINES[r["i"]]
        assert r["_line"] == 0
        assert r["parse_reason"] == want, (s, (raw or "")[:200])
    values = {r["i"]: r for r in got}
    assert values[0]["parsed_amount_minor"] == 163703 and values[19]["parsed_amount_minor"] == -10063703
    assert values[9]["parse_field"] == 9 and values[10]["parse_field"] == 1
    assert malformed.parse_lines(df.limit(0), feeds).count() == 0


def test_long_lines_equal_short_ones(spark):
    """The same line with a narration of 10,000 characters has the same reason, field and values."""
    feeds = spark.createDataFrame(FEEDS, "source_name string, zone_name string, date_order string, delimiter string, raw_format string")
    base = [(s, r) for s, r, _ in LINES if r and len(r) < 1000]
    base += [("j", doc()[:-1] + ', "status": "again"}'), ("j", doc().replace('"fee"', '"fie"')), ("j", doc().replace('"1.00"', "01")), ("j", doc(amount="٣")), ("p", line("|", c3="٣")), ("j", doc(currency=" INR ")), ("p", line("|", c5="\tINR"))]
    rows = []
    for i, (s, r) in enumerate(base):
        marked = r.replace("hi", "hi" + "x" * 3) if "hi" in r else r
        rows += [(i, 0, s, marked), (i, 1, s, marked.replace("hixxx", "hi" + "x" * 10_000))]
    got = {}
    for r in malformed.parse_lines(spark.createDataFrame(rows, "i int, long int, source_name string, raw string"), feeds).collect():
        got[r["i"], r["long"]] = (r["parse_reason"], r["parse_field"], r["parsed_amount_minor"], r["parsed_currency"], r["parsed_instant_us"])
    for i, (s, r) in enumerate(base):
        assert got[i, 0] == got[i, 1], (s, r)
    n = len(base)
    assert got[n - 7, 1][:2] == ("json", None) and got[n - 6, 1][:2] == ("columns", 5)


ORD = "record_uid string, order_id string, received_at timestamp_ntz, deleted_at timestamp_ntz"


def tables(spark, refs):
    p = spark.createDataFrame([(u, o, t) for u, o, t in refs], "record_uid string, order_id string, received_at timestamp_ntz")
    s = spark.createDataFrame([("s1", "stl ord-7 b9", at(50)), ("s2", "nothing", at(50)), ("s3", None, at(50)), ("s4", "ORD--7", at(50))], "record_uid string, reference_id string, received_at timestamp_ntz")
    r = spark.createDataFrame([("c1", "u1", at(1)), ("c2", None, at(1)), ("c3", "gone", at(1)), ("c4", "u2", at(500))], "case_id string, order_uid string, built_at timestamp_ntz")
    return p, s, r


def test_orphan_states(spark):
    orders = spark.createDataFrame([("u1", "ORD1", at(10), None), ("u1b", "ord-1", at(5), None), ("u2", "ORD2", at(0), at(100)), ("u3", None, at(0), None), ("u4", "ORD4", None, None), ("u4", "ORD4", None, None)], ORD)
    refs = [("p1", "Ord 1", at(4)), ("p2", "ORD1", at(5)), ("p3", "ORD2", at(99)), ("p4", "ORD2", at(100)), ("p5", "ORD9", at(1)), ("p5", "ORD9", at(1)), ("p6", None, at(1)), ("p7", "--", at(1)), ("p8", "ORD9", None), ("p9", "ORD4", at(0))]
    p, s, r = tables(spark, refs)
    want = [
        ("payments", "p1", "2026-10-01", "late"), ("payments", "p4", "2026-10-01", "deleted"), ("payments", "p5", "2026-10-01", "missing"), ("payments", "p5", "2026-10-01", "missing"), ("payments", "p8", None, "missing"),
        ("recon", "c1", "2026-10-01", "late"), ("recon", "c3", "2026-10-01", "missing"), ("recon", "c4", "2026-10-01", "deleted"), ("settlements", "s1", "2026-10-01", "missing"),
    ]
    for n in (1, 2, 5):
        assert sorted(map(tuple, orphans.find_orphans(p, s, r, orders, n).collect()), key=repr) == sorted(want, key=repr), n
    assert orphans.find_orphans(p.limit(0), s.limit(0), r.limit(0), orders).count() == 0
    assert orphans.find_orphans(p, s, r, orders.limit(0)).where("ref_state <> 'missing'").count() == 0


def test_later_deletion_reopens(spark):
    ledger = orphans.OrphanLedger.empty(spark)
    ref = spark.createDataFrame([("payments", "p1", "ORD1", at(10)), ("payments", "p2", "ORD1", at(2))], orphans.REFERENCE)
    none = ref.limit(0)
    ledger = ledger.advance(ref, spark.createDataFrame([("ORD1", at(1), None)], orphans.PARENT))
    assert ledger.orphans().count() == 0
    ledger = ledger.advance(none, spark.createDataFrame([("ORD1", None, at(5))], orphans.PARENT))
    assert [tuple(r)[1:] for r in ledger.orphans().collect()] == [("p1", "2026-10-01", "deleted")]
    ledger = ledger.advance(spark.createDataFrame([("payments", "p3", "ORD8", at(20))], orphans.REFERENCE), spark.createDataFrame([], orphans.PARENT))
    assert ledger.waiting.count() == 1
    ledger = ledger.advance(none, spark.createDataFrame([("ORD8", at(30), None)], orphans.PARENT))
    assert {tuple(r)[1:] for r in ledger.orphans().collect()} == {("p1", "2026-10-01", "deleted"), ("p3", "2026-10-01", "late")}


def test_state_stays_small(spark):
    """Over many increments the parts of a table, and with them its plan, stay few; forgetting drops old good references."""
    ledger = orphans.OrphanLedger.empty(spark)
    none = spark.createDataFrame([], orphans.PARENT)
    for i in range(12):
        refs = spark.createDataFrame([("payments", f"p{i}", f"ORD{i % 3}", at(10 + i))], orphans.REFERENCE)
        ledger = ledger.advance(refs, spark.createDataFrame([(f"ORD{i}", at(i), None)], orphans.PARENT) if i < 2 else none, at(i), at(5 + i) if i == 9 else None)
        assert all(len(p) <= 6 for p in ledger.parts.values())
    assert ledger.waiting.count() == 4 and ledger.bad.count() == 0
    assert ledger.good.count() == len([i for i in range(12) if i % 3 < 2 and 10 + i >= 14])
    assert ledger.table("snapshots").where("cases > 0").count() == 10
